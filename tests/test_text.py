import base64
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.codec import with_base64_text
from tidemill.functions.text import SPACE_CHARS, clip, clip_tail, duration_text, preview
from tidemill.operators import pages


def texts(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(row) for row in df.select("i", *columns).orderBy("i").drop("i").collect()]


def test_preview(spark):
    values = ["x" * 500, "x" * 501, None, "", " a\xa0\t\n b ", " c\x1cd"]
    got = [row[0] for row in texts(spark, values, preview(F.col("v")))]
    assert got == ["x" * 500, "x" * 500 + "...", "", "", "a b", "c d"]


def test_space_characters_are_those_of_str():
    assert set(SPACE_CHARS) == {chr(code) for code in range(0x110000) if chr(code).isspace()}


def test_clips_count_code_points(spark):
    got = texts(spark, ["é😀abc", "x" * 8_001], clip(F.col("v"), 2), clip_tail(F.col("v"), 3), F.length(clip(F.col("v"), 8_000)))
    assert got == [("é😀", "abc", 5), ("xx", "xxx", 8_000)]


def test_durations(spark):
    df = spark.createDataFrame([(59.9,), (61.0,), (3600.0,), (0.0,), (90061.5,)], "s double")
    got = [row[0] for row in df.select(duration_text(F.col("s"))).collect()]
    assert got == ["59 s", "1 min 1 s", "1 h 0 min 0 s", "0 s", "25 h 1 min 1 s"]


def decoded(data):
    try:
        return base64.urlsafe_b64decode(data.encode()).decode("utf-8", "replace") if data else ""
    except Exception:
        return ""


def test_base64_decoding_equals_the_standard_library(spark):
    draw = random.Random(5)
    values = ["".join(draw.choices("YWJjeQ==-_+/ !é", k=draw.randint(0, 14))) for _ in range(20_000)]
    values += [base64.urlsafe_b64encode(draw.randbytes(draw.randint(0, 30))).decode() for _ in range(3_000)]
    values += ["YWJ", "YW=", "Y===", "YWJj==", "YW==YWJj", "Yf9i", None, base64.b64encode(b"z" * 300_000).decode()]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in with_base64_text(df, "v", "text").collect():
        assert row.text == decoded(row.v), row.v


CASES = [
    ("<p>a</p><script>var t=\"</p>\";</script><p>b</p>", "a b"),
    ("x<style>p{}</style><noscript>n</noscript><!-- c -->y", "x y"),
    ("<p>&amp;lt;</p>", "&lt;"),
    ("a < b <i>c</i>", "a < b c"),
    ('<a title="x>y">z</a>', "z"),
    ("<div> </div><b>a</b>", "a"),
    ("<p>one\n  two</p>", "one\n  two"),
    ("<!DOCTYPE html><p>&eacute;&hellip;&#8217;&#233;&nbsp;</p>", "é…’é"),
    ("AT&T &copy 2020 &unknown;", "AT&T © 2020 &unknown"),
    ("<script>never closed", ""),
    ("<p it's>isn't</p>", "isn't"),
    ("<noscript>a<noscript>b</noscript>c</noscript>d", "d"),
    ('<a x="<script>">k</a><script>s</script>l', "k l"),
    ("u<template>t</template><ruby>k<rt>v</rt></ruby>", "u k"),
    ("\x01<p>a</p>", "\x01 a"),
    ("<p>a</p><![foo[x]]>b", None),
    ("a<![if gte mso 9]>w<![endif]>c", "a w c"),
    ("<p>a</p>&#" + "9" * 5_000 + ";b", None),
    ("<p>a</p>&#99999999;b", "a \ufffdb"),
    ("<p>open <b>and <i>open", "open and open"),
    ("<a " + "x=1 " * 1_000 + ">long tag</a>" + " " * 50_000 + "<p>" + " " * 50_000 + "end", "long tag end"),
    ("", ""),
    (None, ""),
]


def test_page_text_cases(spark):
    df = spark.createDataFrame([(i, html) for i, (html, _) in enumerate(CASES)], "i int, html string")
    got = [row.page_text for row in pages.pages_to_text(df).orderBy("i").collect()]
    assert got == [text for _, text in CASES]


def test_scores(spark):
    df = spark.createDataFrame([("a", s) for s in (3, 2, 3, 2, 1)] + [("b", int(i < 3)) for i in range(16)], "k string, score int")
    got = {row.k: row[1:] for row in pages.score_rollup(df, ["k"]).collect()}
    assert got == {"a": (11, 15, 73.3), "b": (3, 48, 6.2)}
    arrays = spark.createDataFrame([([3, 2, 3, 2, 1],), ([],)], "s array<int>")
    summaries = [row[0][:] for row in arrays.select(pages.score_summary(F.col("s"))).collect()]
    assert summaries == [(11, 15, 73.3), (0, 0, None)]


def test_score_validation(spark):
    rows = [("a", "3"), ("a", "0"), ("a", "4"), ("a", "-1"), ("a", "1.5"), ("a", "x"), ("a", None), ("b", "2.0")]
    df = spark.createDataFrame(rows, "k string, score string")
    valid, rejected = pages.validate_scores(df)
    assert sorted(row.score for row in valid.collect()) == [0, 2, 3]
    assert sorted((row.score or "", row.cause) for row in rejected.collect()) == [
        ("", "missing score"), ("-1", "out of range"), ("1.5", "not a whole number"),
        ("4", "out of range"), ("x", "not a whole number"),
    ]
    five = spark.createDataFrame([("a", n % 4) for n in range(5)] + [("b", 1)], "k string, score int")
    valid, rejected = pages.validate_scores(five, keys=["k"], per_entity=len(pages.CRITERIA))
    assert valid.count() == 5 and rejected.first().cause == "wrong number of scores"
    nameless = spark.createDataFrame([(None, 1), (None, 2)], "k string, score int")
    assert pages.validate_scores(nameless, keys=["k"], per_entity=5)[1].count() == 2
    with pytest.raises(ValueError, match="keys"):
        pages.validate_scores(five, per_entity=5)
