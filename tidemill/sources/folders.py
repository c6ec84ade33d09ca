"""Folders in whatever store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.utils import AnalysisException


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, full or empty."""
    try:
        spark.read.text(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True
