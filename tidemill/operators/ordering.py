"""Row numbers and neighbouring rows that stay distributed on one huge group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import checkpoint_folder

CHUNK_ROWS = 32_768
# A group is cut into at most so many stretches.
CHUNKS = 64


def with_row_numbers(df: DataFrame, order: Sequence[str], out_col: str) -> DataFrame:
    """Add 1..n in ``order``, a total order, without one global sort task.

    The range-partitioned rows are checkpointed, so the two passes below, and a task
    rerun after an executor is lost, see the same partitions.
    """
    checkpoint_folder(df.sparkSession)
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    # One row per partition.
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(out_col, F.col("_start") + F.col("_row") + 1)
        .drop("_part", "_row", "_start")
    )


def with_preceding(
    df: DataFrame,
    group: str,
    position: str,
    tie: str,
    value: Column,
    count: int,
    out_col: str,
    include_current: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add an array of ``value`` over the ``count`` rows that end at this one.

    Rows of a ``group`` are ordered by ``position`` (a number or time, NULLs first) and ``tie``. Without
    ``include_current`` the array holds the ``count`` rows before this one. A row whose value is NULL takes its
    place among them and is left out of the array; rows whose group is NULL are a group.

    A group of more than ``chunk_rows`` rows is cut at quantiles of its positions, found by a sketch that is
    merged from parts, and each stretch is a window partition of its own, so no task gets a whole large
    group. NULL positions stay in the first stretch. The last rows of a stretch are handed to the next one as extra rows. The plan is the same for
    every size and runs nothing when it is built. Rows that share one position are not cut apart.
    """
    behind = count - 1 if include_current else count
    ahead = 0 if include_current else -1
    shares = [part / CHUNKS for part in range(1, CHUNKS)]
    # Groups that are cut alone, at most one for ``chunk_rows`` rows: few enough to send to all tasks.
    cuts = df.groupBy(group).agg(
        F.when(F.count("*") > chunk_rows, F.array_distinct(F.percentile_approx(position, shares, 10 * CHUNKS))).alias("_cuts")
    ).withColumnRenamed(group, "_group").filter(F.col("_cuts").isNotNull())
    chunk = F.when(F.col("_cuts").isNotNull() & F.col(position).isNotNull(), F.size(F.filter("_cuts", lambda cut: cut < F.col(position)))).otherwise(0)
    chunked = (
        df.withColumn("_value", F.struct(value.alias("of"))).join(F.broadcast(cuts), F.col(group).eqNullSafe(F.col("_group")), "left")
        .withColumn("_chunk", chunk.cast("long")).withColumn("_split", F.col("_cuts").isNotNull()).drop("_group", "_cuts")
    )
    # The filter on row_number is applied before the shuffle as well.
    last_first = Window.partitionBy(group, "_chunk").orderBy(F.desc_nulls_last(position), F.desc(tie))
    ends = (
        chunked.filter("_split")
        .select(group, "_chunk", position, tie, "_value")
        .withColumn("_rank", F.row_number().over(last_first))
        .filter(F.col("_rank") <= behind)
    )
    # At most ``behind`` rows a stretch.
    along = Window.partitionBy(group).orderBy("_chunk", position, tie)
    handed_over = (
        ends.withColumn("_handed", F.collect_list("_value").over(along.rowsBetween(-behind, -1)))
        .withColumn("_from", F.lag("_chunk").over(along))
        .filter(F.col("_from") < F.col("_chunk"))
        .select(group, "_chunk", F.posexplode("_handed").alias("_nth", "_value"))
        .withColumn("_own", F.lit(0))
    )
    rows = chunked.drop("_split").withColumn("_nth", F.lit(0)).withColumn("_own", F.lit(1))
    in_order = Window.partitionBy(group, "_chunk").orderBy("_own", "_nth", position, tie)
    return (
        rows.unionByName(handed_over, allowMissingColumns=True)
        .withColumn("_value", F.collect_list("_value").over(in_order.rowsBetween(-behind, ahead)))
        .filter(F.col("_own") == 1)
        .withColumn(out_col, F.transform(F.filter("_value", lambda x: x["of"].isNotNull()), lambda x: x["of"]))
        .drop("_value", "_chunk", "_nth", "_own")
    )
