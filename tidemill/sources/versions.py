"""Folders that are replaced as a whole: written aside, then named the current one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemill.sources.folders import exists

POINTER = "number bigint, version string"


def _last(spark: SparkSession, root: str) -> tuple[int, str | None]:
    if not exists(spark, f"{root}/pointers"):
        return 0, None
    row = spark.read.schema(POINTER).parquet(f"{root}/pointers").agg(F.max(F.struct("number", "version")).alias("last")).first()
    return (row["last"]["number"], row["last"]["version"]) if row["last"] else (0, None)


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that was published last."""
    _, version = _last(spark, root)
    if version is None:
        raise ValueError(f"nothing has been published under {root}")
    return f"{root}/versions/{version}"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder, then make it the current one; its path.

    The pointer is one row in a file of its own, which the writer's commit puts in place by one rename. If
    ``write`` fails, or the driver is lost before that, readers go on with the version before. What a failed
    write left and older versions stay until their owner clears them, so queries that began on an older version
    end on it. One writer at a time.
    """
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    write(folder)
    number = _last(spark, root)[0] + 1
    spark.createDataFrame([(number, version)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return folder
