"""Intermediate tables in the shared folder, so that a lost executor costs no more than its tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemill.session import checkpoint_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    The folder is new for each call and stays until whoever owns the shared folder clears it:
    the result of an operator reads it when it is used.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/tidemill-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
