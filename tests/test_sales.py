import datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from sales_fixture import build_mart

from tidemill.operators import integrity, loading, pricing, sales_reports
from tidemill.sources.sales import (
    interleaved,
    SALES_CONSTRAINTS,
    SALES_SCHEMAS,
    list_tables,
    load_sales,
    run_sql,
    visible,
    write_layout,
)


@pytest.fixture(scope="module")
def mart(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("mart"))
    for name, df in build_mart(spark).items():
        typed = df.select(*(F.col(f.name).cast(f.dataType) for f in SALES_SCHEMAS[name]))
        typed.write.parquet(f"{folder}/{name}")
    return load_sales(spark, folder)


def pairs(df):
    return [tuple(row) for row in df.collect()]


def test_control_counts(mart):
    assert dict(pairs(integrity.row_counts(mart))) == {
        "motors": 15, "customers": 10, "orders": 20, "order_items": 38, "motor_prices": 45, "inventory": 15,
    }


def test_ids_are_dense_in_insert_order(mart):
    assert [row.id for row in mart["orders"].orderBy("id").collect()] == list(range(1, 21))
    assert mart["orders"].filter("id = 12").first().order_number == "ORD-2025-007"


def test_delivered_quantity_of_a_model(mart):
    sold = sales_reports.delivered_qty(mart, "DS4-132-AA", "2026-01-01", "2026-06-30")
    assert pairs(sold) == [(35,)]
    assert pairs(sales_reports.delivered_qty(mart, "no such model", "2026-01-01", "2026-06-30")) == [(0,)]


def test_order_dates_are_inclusive(mart):
    assert pairs(sales_reports.delivered_qty(mart, "DS4-132-AA", "2026-01-08", "2026-01-08")) == [(15,)]


def test_status_and_dates_reach_the_scan(mart):
    sold = sales_reports.delivered_by(mart, "model", "2026-01-01", "2026-06-30")
    plan = sold._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(order_status,DELIVERED)", "GreaterThanOrEqual(order_date,2026-01-01)"):
        assert pushed in plan


def test_best_sellers_ignore_the_cancelled_order_and_break_ties_by_name(mart):
    assert pairs(sales_reports.top_products(mart, 7)) == [
        ("DS4-132-AA", 70), ("DS4-132-DD", 22), ("DSD2-100-BO", 19), ("DSD2-100-LO", 19),
        ("DST3-135-DD", 18), ("DS4-132-FF", 15), ("DS4-100-AA", 14),
    ]


def test_customers_by_ordered_quantity(mart):
    top = [(row.customer_number, row.ordered_quantity) for row in sales_reports.top_customers(mart, 5).collect()]
    assert top == [("CUST-001", 60), ("CUST-002", 57), ("CUST-007", 46), ("CUST-004", 24), ("CUST-003", 23)]
    open_only = sales_reports.top_customers(mart, 1, status="OPEN").first()
    assert (open_only.customer_number, open_only.ordered_quantity) == ("CUST-007", 28)


def test_stock(mart):
    assert pairs(sales_reports.stock(mart, "DS4-132-AA")) == [("DS4-132-AA", "Brno", 30, 12)]
    assert sales_reports.stock(mart).count() == 15


@pytest.mark.parametrize("long_history", [False, True])
def test_price_periods_are_closed_and_the_last_is_open(spark, mart, long_history):
    days = ["2023-12-31", "2024-01-01", "2024-12-31", "2025-01-01", "2025-12-31", "2026-01-01", "2030-05-05"]
    facts = spark.createDataFrame([(2, datetime.date.fromisoformat(day)) for day in days], "motor_id long, day date")
    if long_history:
        priced = pricing.price_as_of_long_history(facts, mart["motor_prices"], "day")
    else:
        priced = pricing.price_as_of(facts, mart["motor_prices"], "day")
    got = [row.list_price for row in priced.orderBy("day").collect()]
    assert got == [None, *map(Decimal, ("3250", "3250", "3400", "3400", "3550", "3550"))]
    assert len(priced.columns) == len(set(priced.columns))


def test_facts_of_any_year_are_priced(spark, mart):
    facts = spark.createDataFrame([(2, datetime.date(9031, 1, 1)), (2, None), (None, datetime.date(2024, 1, 1))], "motor_id long, day date")
    priced = pricing.price_as_of_long_history(facts, mart["motor_prices"], "day").collect()
    assert sorted(str(row.list_price) for row in priced) == ["3550.00", "None", "None"]


def test_overlapping_prices_all_match(spark):
    prices = spark.createDataFrame(
        [(1, "2024-01-01", "2024-06-30", 1), (1, "2024-06-01", None, 2), (1, "2024-07-01", "2024-05-01", 3)],
        "motor_id long, valid_from string, valid_to string, list_price int",
    ).withColumns({name: F.col(name).cast("date") for name in ("valid_from", "valid_to")})
    facts = spark.createDataFrame([(1, datetime.date(2024, 6, 15))], "motor_id long, day date")
    for priced in (
        pricing.price_as_of(facts, prices, "day"),
        pricing.price_as_of_long_history(facts, prices, "day"),
    ):
        assert sorted(row.list_price for row in priced.collect()) == [1, 2]


def test_declared_constraints_hold(mart):
    checks = integrity.check_constraints(mart, SALES_CONSTRAINTS)
    assert checks.count() == len(SALES_CONSTRAINTS)
    assert checks.filter("violations > 0").count() == 0


def test_broken_constraints_are_counted(mart):
    orders = mart["orders"]
    broken = {
        **mart,
        "order_items": mart["order_items"].unionByName(
            mart["order_items"].limit(1).withColumn("order_id", F.lit(999).cast("bigint")).withColumn("id", F.lit(99).cast("bigint"))
        ),
        "orders": orders.unionByName(orders.filter("id = 3").withColumn("id", F.lit(21).cast("bigint"))),
        "motors": mart["motors"].withColumn("model", F.when(F.col("id") > 2, F.col("model"))),
    }
    found = integrity.check_constraints(broken, SALES_CONSTRAINTS).filter("violations > 0")
    assert {(row.rule, row.table_name, row.violations) for row in found.collect()} == {
        ("foreign key order_id to orders", "order_items", 1),
        ("unique order_number", "orders", 1),
        ("not null model", "motors", 2),
    }


def test_defaults_fill_omitted_columns_only(spark):
    given = spark.createDataFrame([(1, None)], "id long, currency string")
    row = loading.with_defaults(given, "orders").first()
    assert row.currency is None
    assert row.created_at is not None
    assert loading.with_defaults(spark.createDataFrame([(1,)], "id long"), "orders").first().currency == "EUR"


def test_unmatched_natural_keys_are_dropped(spark, mart):
    staged = spark.createDataFrame([("CUST-001", 1), ("nobody", 2), (None, 3)], "customer_number string, n int")
    resolved = loading.resolve_keys(staged, mart["customers"], {"customer_number": "customer_number"}, "id", "customer_id")
    assert pairs(resolved) == [(1, 1)]


def test_unlisted_values_map_to_null(spark):
    mapping = spark.createDataFrame([("a", 1)], "model string, stock int")
    mapped = loading.map_values(spark.createDataFrame([("a",), ("b",)], "model string"), "model", mapping, ["stock"])
    assert sorted(pairs(mapped)) == [("a", 1), ("b", None)]


def test_deleting_orders_takes_their_items_along(spark, mart):
    keys = spark.createDataFrame([(1,), (12,)], "id long")
    orders, items = integrity.delete_orders(mart["orders"], mart["order_items"], keys)
    assert orders.count() == 18
    assert items.count() == 35


def test_deleting_a_referenced_customer_is_refused(spark, mart):
    children = {"orders": (mart["orders"], "customer_id")}
    with pytest.raises(ValueError, match="orders.customer_id"):
        integrity.delete_restricted(mart["customers"], spark.createDataFrame([(1,)], "id long"), children)
    none_used = spark.createDataFrame([(77,)], "id long")
    assert integrity.delete_restricted(mart["customers"], none_used, children).count() == 10


def test_free_sql(spark, mart):
    spark.range(3).createOrReplaceTempView("orders")
    total = run_sql(spark, "SELECT sum(delivered_quantity) AS n FROM order_items", mart)
    assert total.first().n == mart["order_items"].agg(F.sum("delivered_quantity")).first()[0]
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT no_such_column FROM motors", mart)
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT 1 FROM sales", mart)
    assert spark.table("orders").count() == 3
    assert not spark.catalog.tableExists("motors")
    spark.catalog.dropTempView("orders")


def test_table_listing(spark, mart):
    with visible(spark, mart):
        names = [row.table_name for row in list_tables(spark).collect()]
    assert names == sorted(names) and set(SALES_SCHEMAS) <= set(names)


def test_reload_is_repeatable_and_keeps_references(spark, mart, tmp_path):
    order = {
        "motors": ["model"], "customers": ["customer_number"], "orders": ["order_number"],
        "order_items": ["order_id", "motor_id"], "motor_prices": ["motor_id", "valid_from"], "inventory": ["motor_id"],
    }
    keys = {parent: mart[parent].select(F.col("id").alias("_old"), natural) for parent, natural in
            (("motors", "article_number"), ("customers", "customer_number"), ("orders", "order_number"))}
    staged = dict(mart)
    for child, columns in loading.REFERENCES.items():
        for column, (parent, _) in columns.items():
            staged[child] = staged[child].join(keys[parent], F.col(column) == F.col("_old")).drop("_old", column)

    def sold(tables):
        items = tables["order_items"].join(tables["motors"].select(F.col("id").alias("motor_id"), "article_number"), "motor_id")
        placed = tables["orders"].join(tables["customers"].select(F.col("id").alias("customer_id"), "customer_number"), "customer_id")
        items = items.join(placed.select(F.col("id").alias("order_id"), "customer_number"), "order_id")
        return sorted(tuple(row) for row in items.groupBy("article_number", "customer_number").agg(F.sum("quantity")).collect())

    for _ in range(2):
        loading.reload(staged, str(tmp_path), order)
    again = load_sales(spark, str(tmp_path))
    assert again["order_items"].agg(F.min("id"), F.max("id"), F.count("*")).first()[:] == (1, 38, 38)
    assert again["orders"].filter("id = 1").first().order_number == "ORD-2024-001"
    assert again["motors"].filter("id = 1").first().model == "DS2-200-AA"
    assert sold(again) == sold(mart)


def test_free_sql_is_a_query_over_the_mart(spark, mart):
    spark.range(3).createOrReplaceTempView("other")
    assert run_sql(spark, "SELECT count(*) AS n FROM motors -- all\n;", mart).first().n == 15
    for text in ("DROP VIEW other", "SELECT * FROM other", "INSERT INTO motors SELECT 1", "SELECT * FROM parquet.`/tmp`"):
        with pytest.raises(Exception):  # noqa: B017
            run_sql(spark, text, mart)
    assert spark.table("other").count() == 3
    spark.catalog.dropTempView("other")


def test_free_sql_reaches_nothing_but_the_mart(spark, mart):
    spark.range(3).createOrReplaceGlobalTempView("shared")
    spark.sql("CREATE DATABASE IF NOT EXISTS beside")
    spark.range(3).write.mode("overwrite").saveAsTable("beside.saved")
    spark.range(3).write.mode("overwrite").saveAsTable("saved")
    try:
        for text in (
            "SELECT * FROM global_temp.shared",
            "SELECT * FROM saved",
            "SELECT * FROM saved AS motors",
            "SELECT * FROM spark_catalog.default.saved",
            "SELECT * FROM motors WHERE id IN (SELECT id FROM beside.saved)",
            "SELECT (SELECT max(id) FROM saved) AS n",
            "WITH orders AS (SELECT id FROM saved) SELECT m.id FROM motors m JOIN orders USING (id)",
            "SELECT m.* FROM motors m WHERE EXISTS (SELECT 1 FROM `global_temp`.`shared` s WHERE s.id = m.id)",
            "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS n",
            "SELECT java_method('java.lang.System', 'getProperty', 'user.home') AS n",
            "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS n",
            "SELECT `reflect`('java.lang.System', 'getProperty', r'\\') AS n, 'x' AS m",
            "SELECT id FROM motors WHERE reflect('java.lang.System', 'getProperty', 'user.home') IS NOT NULL",
        ):
            with pytest.raises((ValueError, AnalysisException)):
                run_sql(spark, text, mart)
        assert run_sql(spark, "SELECT 'saved' AS n, max(m.id) AS id FROM motors AS m WHERE m.id IN (SELECT motor_id FROM inventory)", mart).first()[:] == ("saved", 15)
        # A mart read from saved tables is still one.
        own = {**mart, "motors": spark.table("beside.saved")}
        assert run_sql(spark, "SELECT count(*) AS n FROM motors", own).first().n == 3
    finally:
        spark.sql("DROP DATABASE beside CASCADE")
        spark.sql("DROP TABLE saved")
        spark.catalog.dropGlobalTempView("shared")


def test_csv_source_uses_the_given_schema(spark, mart, tmp_path):
    for name, df in mart.items():
        df.write.option("header", True).csv(f"{tmp_path}/{name}")
    again = load_sales(spark, str(tmp_path), "csv")
    assert again["motors"].dtypes == mart["motors"].dtypes
    assert sorted(pairs(again["motor_prices"])) [:3] == sorted(pairs(mart["motor_prices"]))[:3]


def test_layout_prunes_by_order_year(spark, mart, tmp_path):
    write_layout(mart, str(tmp_path))
    orders = spark.read.parquet(f"{tmp_path}/orders")
    assert orders.count() == 20
    plan = orders.filter("order_year = 2025")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(order_year" in plan


def rows_read(df):
    """Rows in the row groups that a scan reads."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    spark.conf.set("spark.sql.parquet.filterPushdown", "true")
    try:
        df = df.select("*")
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")


def test_five_lookups_read_few_row_groups(spark, mart, tmp_path):
    count = 24_000
    mixed = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    orders = spark.range(count).select(
        "id", (mixed % 2_000).alias("customer_id"), F.date_add(F.lit("2024-01-01").cast("date"), (mixed % 366).cast("int")).alias("order_date"),
    )
    items = spark.range(2 * count).select("id", (F.col("id") % count).alias("order_id"), (mixed % 1_500).alias("motor_id"))
    motors = spark.range(count).select(
        "id", F.concat(F.lit("F"), (mixed % 7).cast("string")).alias("motor_family"), F.concat(F.lit("M"), F.hex(mixed)).alias("model"),
    )
    tables = {**mart, "orders": orders, "order_items": items, "motors": motors}
    groups = {"parquet.block.size": "2048", "parquet.page.size": "512", "parquet.page.size.row.check.min": "64", "parquet.block.row.count.limit": "250"}
    write_layout(tables, str(tmp_path), groups)

    def read(name, where):
        found = spark.read.parquet(f"{tmp_path}/{name}")
        return rows_read(found.filter(where)) / found.count(), found.filter(where).count()

    model = motors.filter("id = 77").first().model
    wanted = {
        ("motors", f"model = '{model}'"): 0.05,
        ("motors", "motor_family = 'F3'"): 0.3,
        ("orders", "order_date = DATE '2024-05-17'"): 0.35,
        ("orders", "customer_id = 1234"): 0.2,
        ("order_items", "motor_id = 333"): 0.35,
    }
    shares = {lookup: read(*lookup) for lookup in wanted}
    assert all(share < wanted[lookup] and rows > 0 for lookup, (share, rows) in shares.items()), shares
    # Both columns of a box at once.
    assert read("orders", "customer_id BETWEEN 100 AND 120 AND order_date < DATE '2024-02-01'")[0] < 0.12


def test_boxes_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None), (None, None, None)], "a int, b int, c date")
    assert [row[0] for row in df.select(interleaved(df, ["a", "b", "c"])).collect()] is not None
    assert df.limit(0).select(interleaved(df.limit(0), ["a", "c"])).collect() == []


def test_row_numbers_stay_dense_over_many_partitions(spark):
    df = spark.range(10_000).select(((F.col("id") * 7919) % 10_007).alias("k"), "id").repartition(13)
    numbered = loading.assign_ids(df.withColumnRenamed("id", "tie"), ["k", "tie"])
    assert numbered.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (1, 10_000, 10_000)
    ranked = [row.id for row in numbered.orderBy("k", "tie").collect()]
    assert ranked == list(range(1, 10_001))
