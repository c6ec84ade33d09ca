"""Column helpers for clipping, whitespace and short display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character str.isspace() accepts. Java's own \s stops at ASCII.
SPACE_CHARS = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ),
    )
)
# That set and the characters str.splitlines() breaks at, as insides of
# regex classes. Patterns start with (?U), whose single Unicode test
# behind \s is several times faster than a list of characters.
SPACE = r"\s\x1c-\x1f"
LINE_BREAK = r"\n-\r\x1c-\x1e\x85\x{2028}\x{2029}"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clip(text: Column, length: int) -> Column:
    """The first ``length`` code points."""
    return F.substring(text, 1, length)


def clip_tail(text: Column, length: int) -> Column:
    """The last ``length`` code points."""
    return F.right(text, F.lit(length))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Every whitespace run becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))


def shorten(text: Column, length: int) -> Column:
    """``text`` unchanged up to ``length``, else its head followed by three dots."""
    return F.when(F.length(text) > length, F.concat(clip(text, length), F.lit("..."))).otherwise(text)


def preview(text: Column, length: int = 500) -> Column:
    """One-line preview; NULL reads as empty."""
    return shorten(collapse_space(blank_if_null(text)), length)


def duration_text(seconds: Column) -> Column:
    """Whole seconds as ``h``/``min``/``s`` text, leading zero units left out."""
    whole = F.floor(seconds).cast("long")
    hours = F.floor(whole / 3600).cast("long")
    minutes = F.floor(whole % 3600 / 60).cast("long")
    tail = F.concat((whole % 60).cast("string"), F.lit(" s"))
    with_minutes = F.concat(minutes.cast("string"), F.lit(" min "), tail)
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h "), with_minutes))
        .when(minutes > 0, with_minutes)
        .otherwise(tail)
    )
