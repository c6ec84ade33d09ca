"""Steps that failed on large tables: what they send to the driver, and how they are cut up."""

import datetime
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.functions import markup
from tidemill.operators import bodies, loading, pricing
from tidemill.plans.mail import MAIL
from tidemill.plans.sales import SALES


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("priced", [pricing.price_as_of, pricing.price_as_of_long_history])
def test_periods_are_not_broadcast(priced, spark):
    day = datetime.date(2024, 5, 1)
    facts = spark.createDataFrame([(1, day), (1, datetime.date(2020, 1, 1)), (2, day), (3, day), (None, day)], "motor_id bigint, day date")
    years = F.explode(F.sequence(F.lit(2023), F.lit(2025)))
    prices = spark.range(1, 3).select(F.col("id").alias("motor_id"), years.alias("year")).select(
        "motor_id", F.make_date("year", F.lit(1), F.lit(1)).alias("valid_from"),
        F.when(F.col("year") < 2025, F.make_date("year", F.lit(12), F.lit(31))).alias("valid_to"), F.col("year").alias("list_price"),
    )
    found = priced(facts, prices, "day")
    assert "Broadcast" not in physical(found) and "SortMergeJoin" in physical(found)
    rows = sorted((tuple(row) for row in found.select("motor_id", "day", "list_price").collect()), key=repr)
    assert rows == sorted([(1, day, 2024), (1, datetime.date(2020, 1, 1), None), (2, day, 2024), (3, day, None), (None, day, None)], key=repr)


def test_dimensions_are_not_broadcast(spark):
    staged = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3), (None, 4), ("a", 5)], "code string, n int")
    dimension = spark.range(10, 30, 10).select("id", F.when(F.col("id") == 10, "a").otherwise("b").alias("name"))
    found = loading.resolve_keys(staged, dimension, {"code": "name"}, "id", "key")
    assert "Broadcast" not in physical(found)
    assert sorted(tuple(row) for row in found.select("n", "key").collect()) == [(1, 10), (2, 20), (5, 10)]


def test_reloaded_tables_are_not_broadcast(spark, small):
    assert "BroadcastHashJoin" not in physical(SALES.queries["mart_reload"](spark, small))


@pytest.mark.parametrize("name", ["triage_stream", "triage_stream_resumed", "triage_given_up"])
def test_documents_in_several_files_are_streamed(name, spark, small, tmp_path):
    def outcome(folder):
        return sorted((tuple(row) for row in MAIL.queries[name](spark, str(folder)).collect()), key=repr)

    for table in ("documents", "labels"):
        rows = spark.read.parquet(f"{small}/{table}.parquet").limit(60)
        rows.coalesce(1).write.parquet(f"{tmp_path}/one/{table}")
        next((tmp_path / "one" / table).glob("part-*")).rename(tmp_path / "one" / f"{table}.parquet")
        spark.read.parquet(f"{tmp_path}/one/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/many/{table}.parquet")
    assert outcome(tmp_path / "many") == outcome(tmp_path / "one") != []


def test_emails_are_judged_without_joining_them_to_themselves(spark, small):
    plan = physical(MAIL.queries["email_triage"](spark, small))
    # Bodies are joined to their messages; nothing but the cuts of very large groups meets a whole table otherwise.
    assert not re.search(r"SortMergeJoin [^\n]*, Inner", plan) and plan.count("BroadcastExchange") == 2


def test_pages_are_read_in_slices(monkeypatch):
    monkeypatch.setattr(markup, "BATCH_BYTES", 100)
    pages = pa.array([b"<p>a</p>" * n for n in (1, 0, 40, 3, 9, 12)] + [None, b"x"], pa.binary())
    slices = [some.to_pylist() for some in markup._sliced(pages)]
    assert [page for some in slices for page in some] == pages.to_pylist() and len(slices) > 3
    assert all(len(some) == 1 or sum(len(page or b"") for page in some) <= 100 for some in slices)
    assert list(markup._sliced(pages.slice(0, 0))) == []


def test_rejects_are_found_without_their_texts(spark):
    parts = spark.createDataFrame(
        [("a", [], "multipart/mixed", None), ("a", [0, 0], "text/plain", "YQ=="), ("b", [0], "text/plain", "YQ=="), ("c", [], "text/plain", "YQ=="),
         ("c", [], "text/plain", "Yg=="), ("d", [], None, None), ("d", [0], None, None), ("d", [0, 1], "text/plain", "YQ=="), ("d", [1, 0, 0], "text/plain", "YQ=="), (None, [], "text/plain", "YQ==")],
        "message_id string, path array<int>, mime_type string, data string",
    )
    found = bodies.part_rejects(parts)
    assert "unbase64" not in physical(found)
    assert sorted((tuple(row) for row in found.collect()), key=repr) == sorted(
        [("a", [0, 0], bodies.PARENT_MISSING), ("b", [0], bodies.ROOT_MISSING), ("c", [], bodies.REPEATED), ("d", [1, 0, 0], bodies.PARENT_MISSING), (None, [], bodies.NO_ID)], key=repr
    )
