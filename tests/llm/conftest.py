import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import CLASHING, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    extra = ", ".join(f"{name} string" for name in CLASHING)
    rows = [(*row, *["?"] * len(CLASHING)) for row in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
