"""The batch reader of markup against the parser: the same text wherever it is sure."""

import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemill.functions import markup
from tidemill.functions.markup import INLINE, LINES, MAIL_DROPPED, PAGE_DROPPED, parse_text, sure_texts

PIECES = [
    "text", " ", "\n", "\u00e9\U0001f600", "a < b", "&amp;", "&lt;b&gt;", "&copy", "&#65;", "&#x41;", "&#0;", "&#9999999;", "&#128;", "&nope;", "&", "&#xD800;", "& amp;",
    "<p>", "</p>", "<P CLASS=x>", "<br>", "<br/>", "<b", "</b", ">", "<", "</ p>", "</p >", "</p x>", "<i title=\"x\">", "<i title='x>y'>", "<i title=\"a\" b='c'>", "<i a=b/>",
    "<!-- c -->", "<!-- <p> -->", "<!---->", "<!-->", "<!-- a -- b -->", "<!--", "-->", "--!>", "<!DOCTYPE html>", "<!doctype x \"y\">", "<!other>", "<![CDATA[x]]>", "<?pi?>",
    "<script>", "</script>", "<SCRIPT src='x'>var a=\"</p>\";</script>", "<script>if(a<b){}</script >", "<script/>", "<style>p{}</style>", "<style>", "<!--<script>-->",
    "<noscript>n</noscript>", "<noscript>", "</noscript>", "<noscriptx>y</noscriptx>", "<noscript><p>x</p></noscript>", "<div><noscript></div></noscript>", "<template>t</template>", "<rt>r</rt>", "<rp>",
    "<head><title>t</title><meta charset=x></head>", "<title>a<b>c</title>", "<title>plain &amp; so</title>", "<textarea><p></textarea>", "<plaintext>", "<iframe>x</iframe>", "\x00", "\r\n", "\x1c",
]


@pytest.mark.parametrize("seed", range(12))
def test_sure_pages_read_as_the_parser_reads_them(seed):
    chance = random.Random(seed)
    pages = ["".join(chance.choices(PIECES, k=chance.choice((0, 1, 2, 3, 6, 20)))) for _ in range(3000)]
    for dropped, layout in ((PAGE_DROPPED, INLINE), (MAIL_DROPPED, LINES), (("div",), INLINE)):
        found = sure_texts([page.encode() for page in pages], dropped, layout)
        wrong = [(page, text, parse_text(page, dropped, layout)) for page, text in zip(pages, found, strict=True) if text is not None and text != parse_text(page, dropped, layout)]
        assert wrong == []
        assert sum(text is not None for text in found) > 150
        # A page is read alike wherever it lies.
        assert [sure_texts([page.encode()], dropped, layout)[0] for page in pages[:300]] == found[:300]


def test_well_formed_pages_are_sure():
    page = (
        "<!DOCTYPE html><html><head><meta charset='utf-8'><title>A &amp; B</title><style>p{}</style><script>var t=\"</p>\";</script></head>"
        "<body><!-- ad --><p class=\"x\">one<br>two &copy; &#8217;</p><noscript>no <b>bold</b></noscript><p>three</p></body></html>"
    )
    assert sure_texts([page.encode()] * 3, PAGE_DROPPED, INLINE) == ["A & B one two \u00a9 \u2019 three"] * 3
    assert sure_texts([page.encode()], MAIL_DROPPED, LINES) == ["one\ntwo \u00a9 \u2019\nthree"]
    assert sure_texts([], PAGE_DROPPED, INLINE) == [] and sure_texts([b"", b"x"], PAGE_DROPPED, INLINE) == ["", "x"]


def test_pages_of_the_table_are_sure_and_fast(small):
    pages = pq.read_table(f"{small}/pages.parquet")["html"].to_pylist()
    pages = pages * (1 + 1000 // len(pages))
    coded = [page.encode() for page in pages]
    # CPU time, whatever else the machine does.
    sure_texts(coded[:10], PAGE_DROPPED, INLINE)
    begin = time.process_time()
    found = sure_texts(coded, PAGE_DROPPED, INLINE)
    middle = time.process_time()
    wanted = [parse_text(page, PAGE_DROPPED, INLINE) for page in pages]
    end = time.process_time()
    assert sum(text is not None for text in found) >= 0.9 * len(pages)
    assert all(text == told for text, told in zip(found, wanted, strict=True) if text is not None)
    assert 2 * (middle - begin) < end - middle


def test_the_unsure_are_counted(spark, monkeypatch):
    monkeypatch.setattr(markup, "BATCH_BYTES", 20)
    df = spark.createDataFrame([("<p>a</p>",), ("a < b",), (None,), ("<p>&amp b</p>",), ("x" * 90,)], "html string")
    assert [row[0] for row in df.select(markup.is_sure(F.col("html"))).collect()] == [True, False, True, False, True]
    texts = [row.text for row in markup.with_markup_text(df, "html", "text").collect()]
    assert texts == ["a", "a < b", "", "& b", "x" * 90]
