"""Ids that were dealt with before, in buckets that a Bloom filter each tells to be worth reading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.folders import exists

HASHES = 5
WORD = 64


@dataclass(frozen=True)
class Ledger:
    """A ledger of ids under ``folder``.

    ``ids/run=<n>/attempt=<a>/bucket=<b>`` holds the ids themselves, ``filters`` in the same folders the words of
    the bucket's filter that have a bit set: one row a word, so filters of many runs are merged by ``bit_or``. A
    run is written by overwriting its folder. ``buckets`` and ``bits`` of a bucket's filter stay as they were when
    the ledger was begun; about ten bits an id keep a lookup of new ids from most buckets. Fewer bits cost reading,
    never a wrong answer.
    """

    folder: str
    buckets: int = 64
    bits: int = 1 << 20

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def marks(self, key: Column) -> Column:
        """The words and bits that an id sets in the filter of its bucket."""
        first, second = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)).bitwiseOR(F.lit(1))
        # Sums of two hashes in place of further hashes; wrapping is as good as any value.
        places = [F.pmod(F.shiftright(first, 1) + F.shiftright(second, 8) * n, F.lit(self.bits)) for n in range(HASHES)]

        def mark(place: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % WORD).cast("int"))
            return F.struct(F.floor(place / WORD).cast("int").alias("word"), bit.alias("bit"))

        return F.array(*map(mark, places))

    def record(self, ids: DataFrame, run: int, attempt: int = 0) -> None:
        """Add the ids (a column ``id``) of a run; NULL is no id. A run written again replaces what it wrote."""
        at = f"run={run}/attempt={attempt}"
        keyed = ids.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id")).distinct()
        placed = keyed.withColumn("bucket", self.bucket(F.col("id")))
        # One file a bucket, split only by the writer's own limits.
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/ids/{at}")
        stored = placed.sparkSession.read.schema("id string, bucket int").parquet(f"{self.folder}/ids/{at}")
        words = (
            stored.select("bucket", F.inline(self.marks(F.col("id"))))
            .groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits"))
        )
        words.repartition("bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/filters/{at}")

    def _read(self, spark: SparkSession, part: str, columns: str, before: int | None, buckets: list[int]) -> DataFrame:
        rows = spark.read.schema(f"{columns}, run int, attempt int, bucket int").parquet(f"{self.folder}/{part}")
        rows = rows.filter(F.col("bucket").isin(buckets))
        return rows if before is None else rows.filter(F.col("run") < before)

    def known(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """Those of ``ids`` (a column ``id``) that runs before ``before`` recorded, each once.

        Reads the filters of the buckets that the ids fall into, and the ids of those buckets alone where some id has
        all its bits set. What is collected is at most one number a bucket.
        """
        spark = ids.sparkSession
        asked = ids.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id")).distinct()
        asked = asked.withColumn("bucket", self.bucket(F.col("id")))
        if not exists(spark, f"{self.folder}/ids"):
            return asked.select("id").limit(0)
        mine = sorted(row[0] for row in asked.select("bucket").distinct().collect())
        words = self._read(spark, "filters", "word int, bits bigint", before, mine).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        marked = asked.select("id", "bucket", F.inline(self.marks(F.col("id")))).distinct()
        wanted = marked.groupBy("id", "bucket").agg(F.count("*").alias("wanted"))
        hit = marked.join(words, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        hit = hit.groupBy("id", "bucket").agg(F.count("*").alias("hits"))
        maybe = hit.join(wanted, ["id", "bucket"]).filter("hits = wanted").select("id", "bucket")
        hot = sorted(row[0] for row in maybe.select("bucket").distinct().collect())
        held = self._read(spark, "ids", "id string", before, hot)
        return maybe.select("id").join(held.select("id"), "id", "left_semi")

    def unknown(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """``rows`` whose ``id`` no run before recorded; rows without id stay."""
        return rows.join(self.known(rows, before), "id", "left_anti")
