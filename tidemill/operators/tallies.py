"""Label counts that are kept up to date from changes, in place of counting all messages again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.actions import AI_LABELS
from tidemill.sources.folders import exists
from tidemill.sources.versions import current, publish

DELTAS = "label string, day date, delta bigint"


def label_deltas(changes: DataFrame) -> DataFrame:
    """``label``, ``day``, ``delta`` of a change set (ts, labels_before, labels_after), one row for each label and day.

    A new message has no labels before, a deleted one none after (NULL or empty). A label counts once a
    message, however often it is there.
    """
    none = F.array().cast("array<string>")
    before, after = F.coalesce("labels_before", none), F.coalesce("labels_after", none)

    def signed(labels, sign: int):
        return F.transform(labels, lambda label: F.struct(label.alias("label"), F.lit(sign).cast("bigint").alias("delta")))

    steps = F.concat(signed(F.array_except(after, before), 1), signed(F.array_except(before, after), -1))
    return (
        changes.select(F.col("ts").cast("date").alias("day"), F.inline(steps))
        .groupBy("label", "day").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
    )


def record(changes: DataFrame, folder: str, batch: int) -> None:
    """Take down what a batch changed; the batch written again replaces itself. Batches are numbered from 0."""
    label_deltas(changes).write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch}")


def _rows(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame]:
    """What has been folded (with ``upto``, the last batch in it), and the deltas of later batches."""
    deltas = spark.read.schema(f"{DELTAS}, batch bigint").parquet(f"{folder}/deltas")
    if not exists(spark, f"{folder}/folded/pointers"):
        return None, deltas
    base = spark.read.schema(f"{DELTAS}, upto bigint").parquet(current(spark, f"{folder}/folded"))
    upto = base.agg(F.max("upto")).first()[0]
    return base, deltas.filter(F.col("batch") > (-1 if upto is None else upto))


def tallies(spark: SparkSession, folder: str) -> DataFrame:
    """``label``, ``day``, ``messages``: how many messages of each day have each label now."""
    base, later = _rows(spark, folder)
    rows = later.select("label", "day", "delta")
    if base is not None:
        rows = rows.unionByName(base.select("label", "day", "delta"))
    return rows.filter("label IS NOT NULL").groupBy("label", "day").agg(F.sum("delta").alias("messages")).filter("messages <> 0")


def fold(spark: SparkSession, folder: str) -> None:
    """Add all deltas into one small table, so that reading does not grow with the number of batches.

    The new table takes the place of the old one as a whole and says up to which batch it goes; a batch up to
    there that is written again afterwards is left out. Fold when no batch is under way.
    """
    base, later = _rows(spark, folder)
    last = spark.read.schema(f"{DELTAS}, batch bigint").parquet(f"{folder}/deltas").agg(F.max("batch")).first()[0]
    if last is None:
        return
    summed = tallies(spark, folder).select("label", "day", F.col("messages").alias("delta"), F.lit(last).cast("bigint").alias("upto"))
    # The mark stays when all counts are 0.
    mark = spark.createDataFrame([(None, None, 0, last)], f"{DELTAS}, upto bigint")
    publish(spark, f"{folder}/folded", lambda target: summed.unionByName(mark).coalesce(1).write.parquet(target))


def label_counts(spark: SparkSession, folder: str, labels: Sequence[str] = AI_LABELS) -> DataFrame:
    """(label, message_count) for each of ``labels``, as ``label_stats`` counts them from the messages."""
    asked = spark.createDataFrame([(label,) for label in labels], "label string")
    found = tallies(spark, folder).groupBy("label").agg(F.sum("messages").alias("message_count"))
    return asked.join(found, "label", "left").select("label", F.coalesce("message_count", F.lit(0)).alias("message_count"))
