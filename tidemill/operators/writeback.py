"""Changes written back to stored tables: only the partitions that hold changed rows are written again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.actions import apply_actions

SLICES = 64


def slice_of(key: str, slices: int = SLICES) -> Column:
    """A row's slice by its key, for tables without a natural partition."""
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def store(df: DataFrame, folder: str, partition: str) -> None:
    """Write a table in one folder for each value of ``partition``, in place of what was there."""
    df.repartition(partition).write.mode("overwrite").partitionBy(partition).parquet(folder)


def _among(partition: str, values: list) -> Column:
    known = [value for value in values if value is not None]
    test = F.col(partition).isin(known) if known else F.lit(False)
    return test | F.col(partition).isNull() if None in values else test


def _name_of(value: object) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def rewrite(
    table: DataFrame, folder: str, partition: str, keys: DataFrame, on: str, change: Callable[[DataFrame], DataFrame]
) -> list:
    """Write the partitions of ``folder`` again that hold one of ``keys`` (a column ``on``); their values.

    ``table`` is ``folder`` as read. ``change`` gets the rows of those partitions and returns them as they shall be, with
    the same columns. Other partitions are neither read, but for their keys, nor written: their files stay. A
    partition is a number or plain word. Its values are collected, of which there are as many as folders.

    The partitions are exchanged one after the other when all have been written; what was lost on the way is put
    right by doing it again, as long as ``change`` does the same when repeated. One writer at a time.
    """
    held = table.select(on, partition).join(keys.select(on).distinct(), on, "left_semi")
    touched = [row[0] for row in held.select(partition).distinct().collect()]
    if not touched:
        return []
    changed = change(table.filter(_among(partition, touched))).select(table.columns)
    left = {row[0] for row in changed.select(partition).distinct().collect()}
    changed.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    for value in touched:
        if value not in left:
            # A partition that lost all its rows would be passed over.
            none = table.drop(partition).limit(0)
            none.write.mode("overwrite").parquet(f"{folder}/{partition}={_name_of(value)}")
    return touched


def relabel_stored(table: DataFrame, folder: str, partition: str, plan: DataFrame) -> list:
    """Make the planned label changes (id, add_labels, remove_labels) in a stored table of messages."""
    planned = plan.filter((F.size(F.coalesce("add_labels", F.array())) > 0) | (F.size(F.coalesce("remove_labels", F.array())) > 0))
    return rewrite(table, folder, partition, planned, "id", lambda rows: apply_actions(rows, planned))


def delete_stored(tables: list[tuple[DataFrame, str, str, str]], keys: DataFrame) -> list[list]:
    """Delete the rows with ``keys`` (a column ``id``) from stored tables (as read, folder, partition, key column).

    Tables that refer to others come first, so that no row ever refers to one that is gone.
    """

    def gone(on: str) -> DataFrame:
        return keys.select(F.col("id").alias(on)).distinct()

    return [
        rewrite(table, folder, partition, gone(on), on, lambda rows, on=on: rows.join(gone(on), on, "left_anti"))
        for table, folder, partition, on in tables
    ]
