"""Line deduplication by a suffix array over line ids, with DataFrame functions alone.

Every line of every text is a suffix of the sequence of line ids. Suffixes are ranked by prefix
doubling: the rank by 2n lines is the rank of the pair of ranks by n lines, n lines apart. A rank is
the place in the sorted order of the pairs, which range partitioning finds without one sort task.
Suffixes of equal rank are an interval of the suffix array with a longest common prefix of at least
that many lines. Suffixes alone in their interval cannot repeat and leave; the members of an interval
after the first start later copies.

A run of ``min_lines`` lines or more counts by itself, a shorter one by its words. So prefixes are ranked by every
length up to ``min_lines`` (a sum of powers of two), and no further: each window of ``min_lines`` lines of a longer
repeated run is such a copy itself, and copies that touch or overlap make up the maximal run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.store import stored

PLACE = ("_id", "_print", "_line")


def _place() -> Column:
    """Order of a line in the corpus; rows without id come last."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_print"), F.col("_line"))


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """Suffixes with the order-preserving rank of their pair and the first place that has it; lone ones are left out."""
    intervals = stored(
        pairs.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
        .filter("n > 1")
        .drop("n")
        .repartitionByRange("a", "b")
        .sortWithinPartitions("a", "b")
        .withColumn("rank", F.monotonically_increasing_id()),
        name,
    )
    return pairs.join(intervals, ["a", "b"])


def _joined(left: DataFrame, right: DataFrame, apart: int) -> DataFrame:
    """The rank of each suffix by ``left``, that by ``right`` of the one ``apart`` lines further on, and the words of both."""
    here = left.select(*PLACE, F.col("rank").alias("a"), "words")
    there = right.select(
        F.col("_id").alias("_id2"), F.col("_print").alias("_print2"), (F.col("_line") - apart).alias("_line2"),
        F.col("rank").alias("b"), F.col("words").alias("_words2"),
    )
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_print") == F.col("_print2")) & (F.col("_line") == F.col("_line2"))
    return here.join(there, same).select(*PLACE, "a", "b", (F.col("words") + F.col("_words2")).alias("words"))


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = 3,
    min_chars: int = 300,
    min_words: int = 51,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed`` and ``kept`` (the text without removed lines), after the columns to ``carry``.

    Lines are what line breaks split; they compare as they are. A line is removed where it lies in a run of lines
    that also starts earlier in the corpus and has ``min_lines`` lines or ``min_words`` words (parted by ASCII white
    space), or is one line of ``min_chars`` characters. Earlier means a smaller id (NULL ids last; rows with one id by a hash of their text) or
    the same row and an earlier line. Everything is judged on the input. Rows equal in id and text count as one
    and keep the same. A NULL text has no lines and stays NULL; an empty text is one empty line; a text that
    loses all lines is empty. Other columns are left out unless carried.

    A line that many rows share is aggregated before it is shuffled, and the join back to it may be split;
    a row's own lines come together in one task, never those of a group of rows.
    """
    # Under names that are not used inside.
    carried = {name: f"_carried{number}" for number, name in enumerate(carry)}
    source = df.select(
        *[F.col(name).alias(alias) for name, alias in carried.items()], F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    ).withColumn("_print", F.xxhash64("_text"))
    line = F.col("_content")
    lines = stored(
        source.select("_id", "_print", F.posexplode(F.split("_text", "\n")).alias("_line", "_content"))
        # Two hashes make 128 bits; a row that is there twice gives its lines once.
        .select(
            *PLACE, F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"),
            F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"), (F.length(line) >= min_chars).alias("long"),
        )
        .dropDuplicates(list(PLACE)),
        "lines",
    )
    by_length = {1: _ranked(lines, "intervals-1")}
    for length in range(2, min_lines + 1):
        half = 1 << (length - 1).bit_length() - 1
        by_length[length] = _ranked(_joined(by_length[half], by_length[length - half], half), f"intervals-{length}")
    gone = None
    for length, ranked in by_length.items():
        counts = F.lit(True) if length >= min_lines else F.col("words") >= min_words
        if length == 1:
            counts |= F.col("long")
        late = ranked.filter((F.col("first") < _place()) & counts)
        copies = late.select("_id", "_print", F.explode(F.sequence("_line", F.col("_line") + (length - 1))).alias("_line"))
        gone = copies if gone is None else gone.union(copies)
    removed = (
        gone.groupBy("_id", "_print")
        .agg(F.array_sort(F.collect_set("_line")).alias("_gone"))
        .select(F.col("_id").alias("_id2"), F.col("_print").alias("_print2"), "_gone")
    )
    # The lines alone are shuffled; a text is its lines joined again.
    texts = source.withColumn("_lines", F.split("_text", "\n")).drop("_text")
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_print") == F.col("_print2"))
    # The lines between one removed line and the next, put together.
    before, after = F.concat(F.array(F.lit(-1)), "_gone"), F.concat("_gone", F.array(F.size("_lines")))
    between = F.zip_with(before, after, lambda a, b: F.slice("_lines", a + 2, b - a - 1))
    return texts.join(removed, same, "left").select(
        *[F.col(alias).alias(name) for name, alias in carried.items()],
        F.col("_id").alias("doc_id"),
        F.when(F.col("_lines").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(F.flatten(between)), "\n").alias("kept"),
    )
