"""HTML to text on whole tables.

Tags are found by numpy over whole Arrow batches, inside the stage that reads them; only a page that is in any
way odd goes through the standard library's parser, which says what the text of every page is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.markup_batch import texts_of

INLINE = "inline"
LINES = "lines"

# Elements whose text is never page text.
PAGE_DROPPED = ("script", "style", "noscript")
MAIL_DROPPED = ("script", "style", "head", "meta", "noscript")
# Elements that hold text of their own kind, not page text.
SEPARATE_TEXT = ("template", "rt", "rp")
# Elements that never hold content.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen"
    " link menuitem meta nextid param source spacer track wbr".split()
)
REPLACEMENT = "\N{REPLACEMENT CHARACTER}"
# No character has a longer number; Python refuses to read numbers of thousands of digits.
LONGEST_NUMBER = 32
BATCH_BYTES = 4 << 20


class UnreadableReference(ValueError):
    """A numeric reference no reader makes sense of."""


def entity(name: str) -> str:
    """What a named reference stands for; one that is unknown stays, without a semicolon."""
    return html5.get(f"{name};", f"&{name}")


def character(number: str) -> str:
    """What a numeric reference stands for."""
    digits, base = (number[1:], 16) if number[:1] in "xX" else (number, 10)
    if len(digits) > LONGEST_NUMBER:
        raise UnreadableReference(number[:LONGEST_NUMBER])
    code = int(digits, base)
    try:
        # Codes below 256 follow the Windows code page.
        char = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
    except (UnicodeDecodeError, ValueError, OverflowError):
        char = chr(code) if code < 256 else REPLACEMENT
    return REPLACEMENT if "\ud800" <= char <= "\udfff" else char


class _TextNodes(HTMLParser):
    """Text nodes outside the dropped elements, in document order."""

    def __init__(self, dropped: Sequence[str]):
        super().__init__(convert_charrefs=False)
        self._hiding = frozenset(dropped) | frozenset(SEPARATE_TEXT)
        self._open: list[str] = []
        self._pieces: list[str] = []
        self.nodes: list[str] = []

    def end_node(self) -> None:
        if self._pieces and self._hiding.isdisjoint(self._open):
            self.nodes.append("".join(self._pieces))
        self._pieces.clear()

    def handle_starttag(self, tag, attrs):
        self.end_node()
        if tag not in VOID:
            self._open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.end_node()

    def handle_endtag(self, tag):
        self.end_node()
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data):
        self._pieces.append(data)

    def handle_entityref(self, name):
        self._pieces.append(entity(name))

    def handle_charref(self, name):
        self._pieces.append(character(name))

    def handle_comment(self, data):
        self.end_node()

    def handle_decl(self, decl):
        self.end_node()

    def handle_pi(self, data):
        self.end_node()

    def unknown_decl(self, data):
        self.end_node()
        if data[:6].upper() == "CDATA[":
            self._pieces.append(data[6:])
            self.end_node()


def parse_text(html: str, dropped: Sequence[str], layout: str) -> str | None:
    """Text of one document by the standard library's parser; None if that rejects it."""
    parser = _TextNodes(dropped)
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError, RecursionError):
        return None
    parser.end_node()
    return _laid_out(parser.nodes, layout)


def _laid_out(nodes: Sequence[str], layout: str) -> str:
    if layout == INLINE:
        return " ".join(filter(None, (node.strip() for node in nodes)))
    lines = (" ".join(line.split()) for line in "\n".join(nodes).splitlines())
    return "\n".join(filter(None, lines))


def _referred(match: re.Match) -> str:
    name = match.group()[1:-1]
    return character(name[1:]) if name[0] == "#" else entity(name)


def sure_texts(pages: Sequence[bytes], dropped: Sequence[str], layout: str) -> list[str | None]:
    """Text of each page that the batch reader is sure of, None for the others."""
    found = texts_of(pages, (*dropped, *SEPARATE_TEXT), VOID, _referred)
    return [None if nodes is None else _laid_out(nodes, layout) for nodes in found]


def _in_slices(pages: list[bytes]) -> Iterator[list[bytes]]:
    first = held = 0
    for number, page in enumerate(pages):
        if held and held + len(page) > BATCH_BYTES:
            yield pages[first:number]
            first, held = number, 0
        held += len(page)
    yield pages[first:]


def _texts(pages: list[bytes], dropped: Sequence[str], layout: str) -> list[str | None]:
    """Text of each page, by the parser where the batch reader is not sure; None where the parser rejects it."""
    texts: list[str | None] = []
    for some in _in_slices(pages):
        for page, text in zip(some, sure_texts(some, dropped, layout), strict=True):
            texts.append(parse_text(page.decode("utf-8"), dropped, layout) if text is None else text)
    return texts


def _sliced(values: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of at most ``BATCH_BYTES``, of one value at least: only a slice at a time becomes Python objects."""
    ends = np.cumsum(np.asarray(pc.binary_length(values).fill_null(0)), dtype=np.int64)
    first = 0
    while first < len(values):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        yield values.slice(first, stop - first)
        first = stop


def _text_column(html: Column, dropped: Sequence[str], layout: str) -> Column:
    dropped = tuple(dropped)

    @F.arrow_udf("string")
    def parsed(values: pa.Array) -> pa.Array:
        texts = [pa.array(_texts(some.to_pylist(), dropped, layout), pa.string()) for some in _sliced(values.cast(pa.binary()))]
        return pa.concat_arrays([pa.array([], pa.string()), *texts])

    return parsed(html)


def texts_of_each(html: Column, dropped: Sequence[str], layout: str) -> Column:
    """The same for an array of documents: NULL stays NULL, and so becomes what the parser rejects."""
    dropped = tuple(dropped)

    @F.arrow_udf("array<string>")
    def parsed(values: pa.Array) -> pa.Array:
        rows = values.to_pylist()
        places = [(row, at) for row, pages in enumerate(rows) for at, page in enumerate(pages or ()) if page is not None]
        texts = _texts([rows[row][at].encode() for row, at in places], dropped, layout)
        for (row, at), text in zip(places, texts, strict=True):
            rows[row][at] = text
        return pa.array(rows, pa.list_(pa.string()))

    return parsed(html)


def is_sure(html: Column, dropped: Sequence[str] = PAGE_DROPPED) -> Column:
    """Whether a page is read without the parser."""
    dropped = tuple(dropped)

    @F.arrow_udf("boolean")
    def sure(values: pa.Array) -> pa.Array:
        found = [text is not None for pages in _in_slices(values.cast(pa.binary()).to_pylist()) for text in sure_texts(pages, dropped, INLINE)]
        return pa.array(found, pa.bool_())

    return sure(F.coalesce(html, F.lit("")))


def with_markup_text(
    df: DataFrame, html_col: str, out_col: str, dropped: Sequence[str] = PAGE_DROPPED, layout: str = INLINE
) -> DataFrame:
    """Add ``out_col``, the text of ``html_col``. NULL html reads as empty.

    A document the parser rejects, such as one with an unknown marked section or a numeric reference
    of thousands of digits, gets NULL.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    return df.withColumn(out_col, _text_column(html, dropped, layout))
