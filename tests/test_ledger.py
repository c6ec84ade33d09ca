"""The ledger of ids: exact answers, whatever the filters say, from the buckets that may hold them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.streaming.ledger import Ledger


def ids(spark, names):
    return spark.createDataFrame([(name,) for name in names], "id string")


def answer(df):
    return sorted(row["id"] for row in df.collect())


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_answers_are_exact_with_many_or_few_bits(spark, tmp_path, bits):
    ledger = Ledger(str(tmp_path / "l"), buckets=8, bits=bits)
    asked = ids(spark, [f"m{n}" for n in range(0, 400, 3)] + [None, "", "m3", "m3"])
    assert answer(ledger.known(asked)) == []
    ledger.record(ids(spark, [f"m{n}" for n in range(100)] + [None]), 0)
    ledger.record(ids(spark, [f"m{n}" for n in range(50, 200)] + [""]), 1)
    ledger.record(ids(spark, []), 2)
    assert answer(ledger.known(asked)) == sorted(["", *(f"m{n}" for n in range(0, 200, 3))])
    assert answer(ledger.known(asked, before=1)) == sorted(f"m{n}" for n in range(0, 100, 3))
    left = [row["id"] for row in ledger.unknown(asked).collect()]
    assert sorted(map(str, left)) == sorted(["None", *(f"m{n}" for n in range(201, 400, 3))])


def test_a_run_written_again_replaces_what_it_wrote(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), buckets=4)
    ledger.record(ids(spark, ["a", "b"]), 0)
    ledger.record(ids(spark, ["b", "c"]), 0)
    assert answer(ledger.known(ids(spark, ["a", "b", "c"]))) == ["b", "c"]
    ledger.record(ids(spark, []), 0)
    assert answer(ledger.known(ids(spark, ["a", "b", "c"]))) == []


def test_other_buckets_are_not_read(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), buckets=64)
    ledger.record(ids(spark, [f"m{n}" for n in range(3000)]), 0)
    asked = ids(spark, ["m5", "m77", *(f"new{n}" for n in range(40))])
    needed = {row[0] for row in ids(spark, ["m5", "m77"]).select(ledger.bucket(F.col("id"))).collect()}
    # Files of all other buckets are no Parquet any more: reading one would fail.
    for path in Path(ledger.folder).glob("ids/*/*/bucket=*/*.parquet"):
        if int(path.parent.name.removeprefix("bucket=")) not in needed:
            path.write_bytes(b"not to be read")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert answer(ledger.known(asked)) == ["m5", "m77"]


def test_filters_of_other_buckets_are_not_read(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "l"), buckets=64)
    ledger.record(ids(spark, [f"m{n}" for n in range(3000)]), 0)
    needed = {row[0] for row in ids(spark, ["m5"]).select(ledger.bucket(F.col("id"))).collect()}
    for path in Path(ledger.folder).glob("filters/*/*/bucket=*/*.parquet"):
        if int(path.parent.name.removeprefix("bucket=")) not in needed:
            path.write_bytes(b"not to be read")
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert answer(ledger.known(ids(spark, ["m5"]))) == ["m5"]
