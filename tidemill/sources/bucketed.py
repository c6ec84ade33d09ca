"""Tables that are dealt into buckets by their keys once, so that joins on them shuffle nothing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame

BUCKETS = 64


def save_bucketed(tables: Mapping[str, tuple[DataFrame, str]], folder: str, buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """Write each table (rows, key) in ``buckets`` sorted by its key, and read it back as a table of the catalog.

    Tables with the same number of buckets join on these keys, and group by them, without an exchange. A table that is
    joined by two keys is written twice, the second time with that key alone. The files lie under ``folder``; the
    catalog names are new ones and last as long as the catalog does. Rows come to a bucket's task before they are
    written, so that there is one file a bucket; a key that a third of all rows share makes one large file.
    """
    saved = {}
    for name, (df, key) in tables.items():
        table = f"{name}_{uuid.uuid4().hex}"
        (
            df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            .option("path", f"{folder}/{name}").saveAsTable(table)
        )
        saved[name] = df.sparkSession.table(table)
    return saved
