"""Substring search that reads only the blocks of messages that may hold the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import blank_if_null

GRAM = 3
BLOCK_ROWS = 50_000
BUCKETS = 64
COLUMNS = ("sender", "recipient", "subject")
# Ends each text in the index, so that its last characters begin grams as well. A text asked for never holds it.
END = "\x00"


def _grams(text: Column) -> Column:
    """The different runs of three characters of a text and its end."""
    padded = F.concat(text, F.lit(END * (GRAM - 1)))
    starts = F.sequence(F.lit(1), F.length(text))
    grams = F.transform(starts, lambda at: F.substr(padded, at, F.lit(GRAM)))
    return F.array_distinct(F.when(F.length(text) > 0, grams).otherwise(F.array().cast("array<string>")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(messages: DataFrame, folder: str, order: Sequence[str], columns: Sequence[str] = COLUMNS, block_rows: int = BLOCK_ROWS) -> None:
    """Write ``messages`` in blocks of about ``block_rows`` and, for each column and run of three characters, the blocks that have it.

    Rows that are near in ``order`` share a block, so texts that come in bursts are in few blocks. A posting is one
    row for each column, gram and block: never longer than there are blocks, whatever the number of messages.
    """
    count = messages.count()
    blocks = max(1, -(-count // block_rows))
    placed = messages.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id())
    placed.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/messages")
    stored = messages.sparkSession.read.parquet(f"{folder}/messages")
    lowered = [F.struct(F.lit(column).alias("field"), _grams(F.lower(blank_if_null(F.col(column)))).alias("grams")) for column in columns]
    postings = (
        stored.select("block", F.inline(F.array(*lowered))).select("block", "field", F.explode("grams").alias("gram")).distinct()
        .withColumn("bucket", _bucket(F.col("gram")))
    )
    (
        postings.repartition("field", "bucket").sortWithinPartitions("field", "bucket", "gram", "block")
        .write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{folder}/postings")
    )


def blocks_with(spark: SparkSession, folder: str, column: str, text: str) -> list[int]:
    """Blocks that may hold a message whose ``column`` contains ``text``, in any case; all that do are among them."""
    wanted = text.lower()
    postings = spark.read.schema("gram string, block int, field string, bucket int").parquet(f"{folder}/postings").filter(F.col("field") == column)
    if len(wanted) >= GRAM:
        grams = sorted({wanted[at : at + GRAM] for at in range(len(wanted) - GRAM + 1)})
        asked = spark.createDataFrame([(gram,) for gram in grams], "gram string")
        buckets = sorted(row[0] for row in asked.select(_bucket(F.col("gram"))).distinct().collect())
        found = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams)).groupBy("block").agg(F.count_distinct("gram").alias("grams"))
        hits = found.filter(F.col("grams") == len(grams))
    else:
        # Every place in a text begins a gram.
        hits = postings.filter(F.startswith(F.col("gram"), F.lit(wanted))).select("block").distinct()
    return sorted(row["block"] for row in hits.select("block").collect())


def search_index(spark: SparkSession, folder: str, **texts: str) -> DataFrame:
    """Messages whose columns contain the given texts, in any case; an empty text is in every message.

    Only blocks that have all grams of all texts are read, and what is read is tested. A message is read more than
    it need be, never one less.
    """
    messages = spark.read.parquet(f"{folder}/messages")
    candidates: set[int] | None = None
    for column, text in texts.items():
        if text and END not in text:
            found = set(blocks_with(spark, folder, column, text))
            candidates = found if candidates is None else candidates & found
        messages = messages.filter(F.contains(F.lower(blank_if_null(F.col(column))), F.lit(text.lower())))
    if candidates is not None:
        messages = messages.filter(F.col("block").isin(sorted(candidates)))
    return messages.drop("block")
