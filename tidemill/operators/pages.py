"""Web pages: clean text and rollups of 0-3 quality scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.markup import INLINE, PAGE_DROPPED, with_markup_text
from tidemill.functions.text import clip

# The score range, the usual criteria and the longest text handed on.
MAX_SCORE = 3
CRITERIA = (
    "srozumitelnost produktu",
    "úplnost informací",
    "možnost nákupu",
    "důvěryhodnost",
    "podpora rozhodování zákazníka",
)
PAGE_TEXT_CHARS = 8_000


def pages_to_text(
    df: DataFrame,
    html_col: str = "html",
    out_col: str = "page_text",
    dropped: Sequence[str] = PAGE_DROPPED,
    layout: str = INLINE,
    max_chars: int | None = None,
) -> DataFrame:
    """Add the text of each page; ``max_chars`` clips it, the default keeps it whole."""
    with_text = with_markup_text(df, html_col, out_col, dropped, layout)
    return with_text if max_chars is None else with_text.withColumn(out_col, clip(F.col(out_col), max_chars))


def _summary(total: Column, count: Column) -> tuple[Column, Column, Column]:
    maximum = (count * MAX_SCORE).cast("bigint")
    # Half-even, as Python rounds; NULL when there are no scores.
    percentage = F.bround(F.try_divide(total.cast("double"), maximum) * 100, 1)
    return total.cast("bigint").alias("total"), maximum.alias("maximum"), percentage.alias("percentage")


def score_rollup(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Total, maximum and percentage of the scores of each entity."""
    sums = df.groupBy(*keys).agg(F.sum(score).alias("_total"), F.count(score).alias("_count"))
    return sums.select(*keys, *_summary(F.coalesce("_total", F.lit(0)), F.col("_count")))


def score_summary(scores: Column) -> Column:
    """The same rollup of an array column, as a struct."""
    total = F.aggregate(scores, F.lit(0).cast("bigint"), lambda sum_, score: sum_ + score)
    return F.struct(*_summary(total, F.size(scores)))


def validate_scores(
    df: DataFrame, score: str = "score", keys: Sequence[str] = (), per_entity: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with a whole score in range, and the others with a ``cause``.

    ``per_entity`` also turns away every row of an entity (``keys``) that has another
    number of scores.
    """
    number = F.col(score).try_cast("decimal(38,9)")
    cause = (
        F.when(F.col(score).isNull(), "missing score")
        .when(number.isNull() | (number != F.floor(number)), "not a whole number")
        .when(~number.between(0, MAX_SCORE), "out of range")
    )
    judged = df.withColumn("cause", cause)
    if per_entity is not None:
        if not keys:
            raise ValueError("per_entity needs the keys of an entity")
        # Counted per key and joined back, so a hot key is never one window.
        other = (
            df.groupBy(*keys).agg(F.count("*").alias("_scores")).filter(F.col("_scores") != per_entity)
            .select(*[F.col(key).alias(f"_of_{key}") for key in keys], F.lit(True).alias("_other"))
        )
        same = [judged[key].eqNullSafe(other[f"_of_{key}"]) for key in keys]
        judged = (
            judged.join(other, same, "left").drop(*[f"_of_{key}" for key in keys])
            .withColumn("cause", F.coalesce("cause", F.when(F.col("_other"), "wrong number of scores")))
            .drop("_other")
        )
    valid = judged.filter(F.col("cause").isNull()).drop("cause").withColumn(score, number.cast("int"))
    return valid, judged.filter(F.col("cause").isNotNull())
