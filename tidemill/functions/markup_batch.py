"""Markup of whole batches told apart by numpy; pages that it cannot be sure of are left to the parser.

The bytes of all pages of a batch lie in one array. Where tags, comments and declarations begin and end follows from
the places of ``<``, ``>``, quotes and double hyphens; what lies in them and in hidden elements is masked out, a
byte is left as the border of text nodes, and what remains of a page is decoded at once.

A page is sure when its tags hold no ``<``, no two kinds of quotes and whole pairs of quotes, end tags are bare,
comments hold no double hyphen, declarations are doctypes, raw text elements end as they should, hidden elements are
balanced inside, and every ``&`` in its text begins a reference that is closed by a semicolon.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np

BORDER = 0
# Elements whose content is no markup; elements that parsers treat in different ways.
RAW = ("script", "style")
UNSURE = ("textarea", "iframe", "noembed", "noframes", "xmp", "plaintext")
TITLE = "title"
REFERENCE = re.compile(r"&(?:#(?:[1-9][0-9]{0,6}|[xX][1-9a-fA-F][0-9a-fA-F]{0,5})|[a-zA-Z][a-zA-Z0-9]*);")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, np.bool_)
_LETTER[65:91] = _LETTER[97:123] = True
_NAME_END = np.zeros(256, np.bool_)
_NAME_END[[0x00, 0x09, 0x0A, 0x0C, 0x0D, 0x20, 0x2F, 0x3E]] = True
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x09, 0x0A, 0x0C, 0x0D, 0x20]] = True
_NAME = 8
_LONGEST_END = 24


# Set in the key of a name of more bytes.
_LONGER = 1 << 63


def _key(name: str) -> int:
    return int.from_bytes(name.encode()[:_NAME].ljust(_NAME, b"\0"), "little") | (_LONGER if len(name) > _NAME else 0)


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first eight bytes of the names that begin at the places, lower-cased, as numbers."""
    keys = np.zeros(len(at), np.uint64)
    inside = np.ones(len(at), np.bool_)
    for place in range(_NAME):
        byte = data[at + place]
        inside &= ~_NAME_END[byte]
        keys |= np.where(inside, _LOWER[byte], 0).astype(np.uint64) << np.uint64(8 * place)
    inside &= ~_NAME_END[data[at + _NAME]]
    keys[inside] |= np.uint64(_LONGER)
    return keys


def _next(places: np.ndarray, after: np.ndarray, none: int) -> np.ndarray:
    """The first of the sorted places that is not before each of ``after``; ``none`` where there is none."""
    at = np.searchsorted(places, after)
    return np.append(places, none)[at]


def _prefix(data: np.ndarray, at: np.ndarray, text: bytes) -> np.ndarray:
    return np.logical_and.reduce([_LOWER[data[at + k]] == byte for k, byte in enumerate(text)])


def texts_of(pages: Sequence[bytes], dropped: Sequence[str], void: frozenset[str], reference: Callable[[re.Match], str]) -> list[list[str] | None]:
    """Text nodes of each page outside the ``dropped`` elements, empty ones left out; None for a page that is unsure."""
    hiding = frozenset(dropped)
    if not pages:
        return []
    lengths = np.fromiter(map(len, pages), np.int64, len(pages))
    stops = np.cumsum(lengths)
    starts = stops - lengths
    size = int(stops[-1])
    # Room to look ahead at the end of the last page.
    data = np.frombuffer(b"".join(pages) + bytes(16), np.uint8)
    whole = data[:size]
    unsure = np.zeros(len(pages), np.bool_)
    unsure[np.searchsorted(stops, np.flatnonzero(whole == BORDER), "right")] = True

    opening = np.flatnonzero(whole == 0x3C)
    closing = np.flatnonzero(whole == 0x3E)
    page = np.searchsorted(stops, opening, "right")
    end = stops[page]
    first, second = data[opening + 1], data[opening + 2]
    is_start = _LETTER[first]
    is_end = (first == 0x2F) & _LETTER[second]
    is_comment = _prefix(data, opening, b"<!--")
    is_doctype = _prefix(data, opening, b"<!doctype")
    stop = _next(closing, opening, size) + 1
    keys = _keys(data, opening + 1 + is_end)

    # Comments and raw text hide what looks like markup inside them.
    hyphens = np.flatnonzero((whole[:-1] == 0x2D) & (whole[1:] == 0x2D)) if size else opening
    known_raw = [name for name in RAW if name in hiding]
    is_raw = is_start & np.isin(keys, np.array([_key(name) for name in RAW], np.uint64))
    covers = np.flatnonzero(is_comment | is_raw)
    cover_stop = stop.copy()
    broken = np.zeros(len(opening), np.bool_)
    at = np.flatnonzero(is_comment)
    dashes = _next(hyphens, opening[at] + 4, size)
    cover_stop[at] = dashes + 3
    broken[at] = (data[dashes + 2] != 0x3E) | (dashes + 3 > end[at]) | (data[opening[at] + 4] == 0x3E) | (_prefix(data, opening[at] + 4, b"->"))
    for name in RAW:
        ends = opening[is_end & (keys == np.uint64(_key(name)))]
        at = np.flatnonzero(is_raw & (keys == np.uint64(_key(name))))
        close = _next(ends, stop[at], size)
        cover_stop[at] = close
        broken[at] |= (close >= end[at]) | (name not in known_raw)
        # Older and newer parsers differ in what ends raw text that begins a comment.
        marks = opening[is_comment]
        broken[at] |= _next(marks, stop[at], size) < close
    # What is broken ends with its page.
    cover_stop = np.minimum(cover_stop, end)
    # One inside another is none; what it says of itself doesn't count.
    last, outer = -1, []
    for number, begin, until in zip(covers.tolist(), opening[covers].tolist(), cover_stop[covers].tolist(), strict=True):
        if begin >= last:
            last = until
            outer.append(number)
    around = np.searchsorted(opening[outer], opening, "left") - 1
    real = ~((around >= 0) & (opening < np.append(cover_stop[outer], 0)[around]))
    unsure[page[real & broken]] = True
    is_comment &= real
    is_raw &= real

    # Tags and doctypes.
    tag = real & ~is_comment
    following = np.append(opening[1:], size)
    following = np.minimum(following, end)
    doubles, singles = (
        np.searchsorted(quotes, stop) - np.searchsorted(quotes, opening) for quotes in (np.flatnonzero(whole == 0x22), np.flatnonzero(whole == 0x27))
    )
    bad = ~(is_start | is_end | is_doctype) | (stop > end) | (stop > following)
    bad |= (doubles % 2 == 1) | (singles % 2 == 1) | ((doubles > 0) & (singles > 0))
    special = np.isin(keys, np.array([_key(name) for name in UNSURE], np.uint64))
    bad |= (is_start | is_end) & special
    # An end tag is its name and white space.
    ends = np.flatnonzero(tag & is_end)
    room = stop[ends] - 1 - (opening[ends] + 2)
    spaced = np.zeros(len(ends), np.bool_)
    bad[ends] |= room > _LONGEST_END
    for place in range(_LONGEST_END):
        within = place < room
        if not within.any():
            break
        byte = data[np.where(within, opening[ends] + 2 + place, 0)]
        space = _SPACE[byte]
        bad[ends] |= within & ((_NAME_END[byte] | spaced) & ~space)
        spaced |= within & space
    self_closed = data[np.maximum(stop - 2, 0)] == 0x2F
    hidden_keys = np.array([_key(name) for name in hiding if name not in void and name not in RAW], np.uint64)
    opens_hidden = tag & is_start & np.isin(keys, hidden_keys)
    bad |= self_closed & (is_raw | opens_hidden)
    # In a title some parsers see no tags: sure only if it holds none.
    titles = np.flatnonzero(tag & is_start & (keys == np.uint64(_key(TITLE))))
    after = np.minimum(titles + 1, len(opening) - 1)
    bad[titles] |= (after == titles) | ~(is_end[after] & (keys[after] == np.uint64(_key(TITLE))) & (page[after] == page[titles]))
    unsure[page[tag & bad]] = True
    stop = np.minimum(stop, end)

    # What is no text: tags, comments, raw text, hidden elements; of sure pages, where they nest at most three deep.
    removed = np.zeros(size + 1, np.int8)

    def remove(begin: np.ndarray, until: np.ndarray) -> None:
        removed[begin] += 1
        removed[until] -= 1

    order = np.flatnonzero(real).tolist()
    position = {number: place for place, number in enumerate(order)} if opens_hidden.any() else {}
    spans, shut = [], -1
    for number in np.flatnonzero(opens_hidden).tolist():
        if unsure[page[number]] or number < shut:
            continue
        closer = _closer(order, position[number], page, keys, is_start, is_end, self_closed, void)
        if closer is None:
            unsure[page[number]] = True
        else:
            shut = closer
            spans.append((number, closer))
    sure = ~unsure[page]
    tokens = np.flatnonzero(real & sure)
    remove(opening[tokens], np.where(is_comment[tokens], cover_stop[tokens], stop[tokens]))
    raw = np.flatnonzero(is_raw & sure)
    remove(stop[raw], cover_stop[raw])
    spans = [(begin, until) for begin, until in spans if sure[begin]]
    if spans:
        begin, until = np.array(spans).T
        remove(opening[begin], stop[until])
    keep = np.cumsum(removed, dtype=np.int8)[:size] == 0
    out = whole.copy()
    out[opening[tokens]] = BORDER
    keep[opening[tokens]] = True
    kept = out[keep].tobytes()
    filled = np.flatnonzero(lengths)
    many = np.zeros(len(pages), np.int64)
    if len(filled):
        many[filled] = np.add.reduceat(keep, starts[filled], dtype=np.int64)
    until = np.cumsum(many)
    found: list[list[str] | None] = []
    for number, (a, b) in enumerate(zip((until - many).tolist(), until.tolist(), strict=True)):
        if unsure[number]:
            found.append(None)
            continue
        text = kept[a:b].decode("utf-8")
        if "&" in text:
            text, count = REFERENCE.subn(reference, text)
            # A reference that was read may be an & itself; so the borders of the others are counted before.
            if count != kept.count(b"&", a, b):
                found.append(None)
                continue
        found.append([node for node in text.split("\0") if node])
    return found


def _closer(order: list[int], place: int, page, keys, is_start, is_end, self_closed, void: frozenset[str]) -> int | None:
    """The end tag of a hidden element; None if tags inside it are not balanced, so that another may end it."""
    number = order[place]
    voids = {_key(name) for name in void}
    depth: dict[int, int] = {}
    for other in order[place + 1 :]:
        if page[other] != page[number]:
            return None
        key = int(keys[other])
        if is_start[other] and not self_closed[other] and key not in voids:
            if key == keys[number]:
                return None
            depth[key] = depth.get(key, 0) + 1
        elif is_end[other]:
            if key == keys[number]:
                return other
            if depth.get(key, 0) <= 0:
                return None
            depth[key] -= 1
    return None
