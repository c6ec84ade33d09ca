"""Stored tables: whole versions, and changes that touch no more files than they must."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.operators import integrity, loading, writeback
from tidemill.sources import versions
from tidemill.sources.bucketed import save_bucketed
from tidemill.sources.sales import ForeignKey


def files(folder):
    return {str(path.relative_to(folder)) for path in Path(folder).rglob("*.parquet")}


def rows(spark, folder, *names):
    return sorted((tuple(row) for row in spark.read.parquet(folder).select(*names).collect()), key=repr)


def test_a_version_shows_when_it_is_whole(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="nothing has been published"):
        versions.current(spark, root)

    def write(count, fail=False):
        def both(folder):
            spark.range(count).write.parquet(f"{folder}/a")
            if fail:
                raise RuntimeError("on the way")
            spark.range(count).write.parquet(f"{folder}/b")

        return both

    versions.publish(spark, root, write(3))
    first = versions.current(spark, root)
    with pytest.raises(RuntimeError, match="on the way"):
        versions.publish(spark, root, write(5, fail=True))
    assert versions.current(spark, root) == first
    assert [spark.read.parquet(f"{first}/{name}").count() for name in "ab"] == [3, 3]
    versions.publish(spark, root, write(7))
    assert spark.read.parquet(f"{versions.current(spark, root)}/b").count() == 7
    # A query on the version before still ends.
    assert spark.read.parquet(f"{first}/a").count() == 3
    # A pointer that is not in place yet is none.
    (tmp_path / "pointers" / "_temporary" / "0").mkdir(parents=True)
    (tmp_path / "pointers" / "_temporary" / "0" / "part-9.parquet").write_bytes(b"half")
    assert spark.read.parquet(f"{versions.current(spark, root)}/b").count() == 7


@pytest.fixture()
def messages(spark, tmp_path):
    folder = str(tmp_path / "messages")
    df = spark.range(100).select(
        F.col("id").cast("string").alias("id"), F.array(F.lit("INBOX")).alias("labels"), F.when(F.col("id") < 90, (F.col("id") % 9).cast("int")).alias("slice")
    )
    writeback.store(df, folder, "slice")
    return folder


def test_untouched_files_keep_their_names(spark, messages):
    plan = spark.createDataFrame(
        [("3", ["AI"], ["INBOX"]), ("12", ["AI"], None), ("4", [], []), ("5", None, None), ("95", ["AI"], []), ("nobody", ["AI"], [])],
        "id string, add_labels array<string>, remove_labels array<string>",
    )
    before = files(messages)
    wanted = {n: ["INBOX"] for n in range(100)} | {3: ["AI"], 12: ["INBOX", "AI"], 95: ["INBOX", "AI"]}
    for _ in range(2):
        touched = writeback.relabel_stored(spark.read.parquet(messages), messages, "slice", plan)
        assert sorted(touched, key=repr) == [3, None]
        assert dict((int(n), labels) for n, labels in rows(spark, messages, "id", "labels")) == wanted
    kept = {name for name in before if not name.startswith(("slice=3/", "slice=__HIVE"))}
    assert len(kept) == 8 and kept <= files(messages)
    assert not (before - kept) & files(messages)
    assert writeback.relabel_stored(spark.read.parquet(messages), messages, "slice", plan.filter("id = 'nobody'")) == []


def test_other_slices_are_read_for_their_keys_alone(spark, messages):
    seen = []

    def change(found):
        seen.append({row[0] for row in found.select("slice").distinct().collect()})
        return found.withColumn("labels", F.array(F.lit("seen")))

    keys = spark.createDataFrame([("7",)], "id string")
    writeback.rewrite(spark.read.parquet(messages), messages, "slice", keys, "id", change)
    assert seen == [{7}]
    assert spark.read.parquet(messages).filter("labels[0] = 'seen'").count() == 10


def test_a_slice_that_loses_all_rows_is_empty_afterwards(spark, tmp_path):
    orders, items = str(tmp_path / "orders"), str(tmp_path / "items")
    writeback.store(spark.createDataFrame([(n, 2000 + n // 4) for n in range(12)], "id long, order_year int"), orders, "order_year")
    lines = spark.range(60).select((F.col("id") % 12).alias("order_id"), F.col("id").alias("line")).withColumn("slice", writeback.slice_of("order_id", 5))
    writeback.store(lines, items, "slice")
    keys = spark.createDataFrame([(4,), (5,), (6,), (7,), (9,), (9,), (77,), (None,)], "id long")
    tables = [(spark.read.parquet(items), items, "slice", "order_id"), (spark.read.parquet(orders), orders, "order_year", "id")]
    assert sorted(writeback.delete_stored(tables, keys)[1]) == [2001, 2002]
    assert [row[0] for row in rows(spark, orders, "id")] == [0, 1, 10, 11, 2, 3, 8]
    assert {row[0] for row in rows(spark, items, "order_id")} == {0, 1, 2, 3, 8, 10, 11}
    assert spark.read.parquet(items).count() == 35
    # Doing it again, as after a broken run, changes nothing.
    tables = [(spark.read.parquet(items), items, "slice", "order_id"), (spark.read.parquet(orders), orders, "order_year", "id")]
    assert writeback.delete_stored(tables, keys) == [[], []]


def test_joins_on_bucket_keys_shuffle_nothing(spark, tmp_path):
    orders = spark.range(500).select("id", (F.col("id") % 9).alias("customer_id"))
    items = spark.range(2000).select((F.col("id") % 600).alias("order_id"), F.col("id").alias("line"))
    saved = save_bucketed({"orders": (orders, "id"), "items": (items, "order_id")}, str(tmp_path), 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        followed = loading.resolve_keys(saved["items"], saved["orders"], {"order_id": "id"}, "customer_id", "customer_id")
        checked = integrity.check_constraints(saved, [ForeignKey("items", "order_id", "orders")])
        for df, exchanges in ((followed, 0), (checked, 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Join" in plan and plan.count("Exchange") == exchanges
            # The one exchange adds up one number a task, above the join.
            assert "Exchange" not in plan[plan.index("Join"):]
        assert followed.count() == sum(1 for n in range(2000) if n % 600 < 500)
        assert checked.first()["violations"] == sum(1 for n in range(2000) if n % 600 >= 500)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
