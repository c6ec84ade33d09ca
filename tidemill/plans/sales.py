"""Named sales queries over the star tables, each with the SQL another engine checks it by."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import integrity, loading, pricing, sales_reports, writeback
from tidemill.plans.registry import Registry
from tidemill.session import checkpoint_folder
from tidemill.sources.bucketed import save_bucketed
from tidemill.sources.sales import (
    ForeignKey,
    NotNull,
    Unique,
    load_sales,
    run_sql,
    write_layout,
)
from tidemill.sources.star import read_table, share_of, star_mart
from tidemill.sources.versions import current

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

STAR_CONSTRAINTS = (
    Unique("orders", ("o_orderkey",)),
    Unique("customer", ("c_custkey",)),
    Unique("part", ("p_partkey",)),
    Unique("lineitem", ("l_orderkey", "l_linenumber")),
    Unique("documents", ("doc_id",)),
    NotNull("orders", "o_custkey"),
    NotNull("orders", "o_orderdate"),
    NotNull("lineitem", "l_orderkey"),
    NotNull("lineitem", "l_partkey"),
    NotNull("lineitem", "l_quantity"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("documents", "doc_id", "labels", "doc_id"),
)

MART = """
WITH motors AS (
  SELECT p_partkey AS id, 'MTR-' || p_partkey AS article_number, p_brand || '/' || p_partkey AS model,
         p_brand AS motor_family FROM part),
mart_orders AS (
  SELECT o_orderkey AS id, 'ORD-' || o_orderkey AS order_number, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'OPEN' ELSE 'CONFIRMED' END AS order_status
  FROM orders),
order_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS motor_id, CAST(l_quantity AS INT) AS quantity,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) ELSE 0 END AS delivered_quantity,
         CAST(l_shipdate AS DATE) AS ship_date
  FROM lineitem),
motor_prices AS (
  SELECT p_partkey AS motor_id, make_date(y, 1, 1) AS valid_from,
         CASE WHEN y < 2001 THEN make_date(y, 12, 31) END AS valid_to,
         CAST((CAST(round(p_retailprice * 100) AS BIGINT) * (100 + 5 * (y - 1995)) + 50) // 100 * 0.01
              AS DECIMAL(12,2)) AS list_price
  FROM part, range(1995, 2002) years(y)),
inventory AS (
  SELECT p_partkey AS motor_id, 'Hall ' || (p_partkey % 3) AS warehouse, p_size AS quantity_available,
         CAST(p_partkey % 7 AS INT) AS quantity_reserved FROM part)
"""

SALES = Registry()


@SALES.named("row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.row_counts({name: read_table(spark, folder, name) for name in TABLES})


def _constraint_sql() -> str:
    parts = []
    for constraint in STAR_CONSTRAINTS:
        match constraint:
            case Unique(table, columns):
                keys = ", ".join(columns)
                rule = f"unique {keys}"
                count = f"count(*) - count(DISTINCT ({keys}))"
                source = f"{table} WHERE " + " AND ".join(f"{column} IS NOT NULL" for column in columns)
            case NotNull(table, column):
                rule, count, source = f"not null {column}", "count(*)", f"{table} WHERE {column} IS NULL"
            case ForeignKey(table, column, parent, parent_column):
                rule, count = f"foreign key {column} to {parent}", "count(*)"
                source = (
                    f"{table} c WHERE c.{column} IS NOT NULL AND NOT EXISTS"
                    f" (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column})"
                )
        parts.append(f"SELECT '{rule}' AS rule, '{table}' AS table_name, {count} AS violations FROM {source}")
    return " UNION ALL ".join(parts)


@SALES.named("constraint_checks", _constraint_sql())
def constraint_checks(spark, folder):
    names = ("orders", "customer", "part", "lineitem", "documents", "labels")
    return integrity.check_constraints({name: read_table(spark, folder, name) for name in names}, STAR_CONSTRAINTS)


@SALES.named(
    "references_in_buckets",
    """SELECT 'order_id' AS name, count(*) AS orphans, 0::BIGINT AS resolved FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)
    UNION ALL SELECT 'motor_id', count(*), 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)
    UNION ALL SELECT 'resolved', 0, sum(o_custkey)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0""",
)
def references_in_buckets(spark, folder):
    """References checked and followed over tables in buckets of their keys; some orders and motors are missing."""
    target = f"{checkpoint_folder(spark)}/buckets-{uuid.uuid4().hex}"
    mart = star_mart(spark, folder)
    saved = save_bucketed(
        {
            "orders": (mart["orders"].filter("id % 7 <> 0").select("id", "customer_id"), "id"),
            "items": (mart["order_items"].select("order_id", "motor_id", "quantity"), "order_id"),
            "items_by_motor": (mart["order_items"].select("motor_id"), "motor_id"),
            "motors": (mart["motors"].filter("id % 5 <> 0").select("id"), "id"),
        },
        target, 8,
    )
    checks = [
        integrity.check_constraints({"items": saved[items], "parents": saved[parents]}, [ForeignKey("items", key, "parents")])
        .select(F.lit(key).alias("name"), F.col("violations").alias("orphans"), F.lit(0).cast("bigint").alias("resolved"))
        for key, items, parents in (("order_id", "items", "orders"), ("motor_id", "items_by_motor", "motors"))
    ]
    followed = loading.resolve_keys(saved["items"], saved["orders"], {"order_id": "id"}, "customer_id", "customer_id")
    total = followed.agg(F.sum("customer_id").alias("resolved")).select(F.lit("resolved").alias("name"), F.lit(0).cast("bigint").alias("orphans"), "resolved")
    return reduce(DataFrame.unionByName, [*checks, total])


@SALES.named(
    "assign_ids",
    "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey FROM orders",
)
def assign_ids(spark, folder):
    orders = read_table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return loading.assign_ids(orders, ["o_orderdate", "o_orderkey"]).select("id", "o_orderkey")


@SALES.named(
    "with_defaults",
    """SELECT 'orders' AS table_name, 'EUR' AS filled, count(*) AS rows_filled FROM orders
    UNION ALL SELECT 'customers', 'true', count(*) FROM customer
    UNION ALL SELECT 'order_items', '0/0.00', count(*) FROM lineitem
    UNION ALL SELECT 'motor_prices', 'EUR', count(*) FROM part
    UNION ALL SELECT 'inventory', '0/0', count(*) FROM part
    UNION ALL SELECT 'motors', 'ACTIVE', count(*) FROM part
    UNION ALL SELECT 'motors with NULL', '', count(*) FROM part""",
)
def with_defaults(spark, folder):
    """Every default but the time of loading, on rows that omit the column; an explicit NULL stays."""
    mart = star_mart(spark, folder)
    part = read_table(spark, folder, "part").select(F.col("p_partkey").alias("motor_id"))
    omitted = {
        "orders": (mart["orders"].select("id"), ("currency",)),
        "customers": (mart["customers"].select("id"), ("active",)),
        "order_items": (mart["order_items"].select("order_id"), ("delivered_quantity", "discount_percent")),
        "motor_prices": (part, ("currency",)),
        "inventory": (part, ("quantity_available", "quantity_reserved")),
        "motors": (part, ("product_status",)),
        "motors with NULL": (part.withColumn("product_status", F.lit(None).cast("string")), ("product_status",)),
    }
    counts = []
    for name, (rows, columns) in omitted.items():
        filled = loading.with_defaults(rows, name.split()[0])
        text = F.concat_ws("/", *[F.col(column).cast("string") for column in columns])
        counts.append(filled.groupBy(text.alias("filled")).agg(F.count("*").alias("rows_filled")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, counts)


@SALES.named(
    "resolve_keys",
    MART + """SELECT o.id AS order_id, m.id AS motor_id, count(*) AS items, CAST(sum(i.quantity) AS BIGINT) AS quantity
    FROM order_items i JOIN mart_orders o ON 'ORD-' || i.order_id = o.order_number
    JOIN motors m ON 'MTR-' || i.motor_id = m.article_number GROUP BY 1, 2""",
)
def resolve_keys(spark, folder):
    mart = star_mart(spark, folder)
    staged = mart["order_items"].select(
        F.concat(F.lit("ORD-"), F.col("order_id").cast("string")).alias("order_number"),
        F.concat(F.lit("MTR-"), F.col("motor_id").cast("string")).alias("article_number"),
        "quantity",
    )
    with_order = loading.resolve_keys(staged, mart["orders"], {"order_number": "order_number"}, "id", "order_id")
    resolved = loading.resolve_keys(
        with_order, mart["motors"], {"article_number": "article_number"}, "id", "motor_id"
    )
    return resolved.groupBy("order_id", "motor_id").agg(
        F.count("*").alias("items"), F.sum("quantity").alias("quantity")
    )


@SALES.named(
    "expand_price_list",
    """SELECT p_partkey AS motor_id, s AS valid_from, e AS valid_to,
    CASE WHEN p_size <= 40 THEN CAST((c * f + 50) // 100 * 0.01 AS DECIMAL(12,2)) END AS list_price,
    CASE WHEN p_size <= 40 THEN CAST((c * (f - 30) + 50) // 100 * 0.01 AS DECIMAL(12,2)) END AS production_cost,
    'EUR' AS currency
    FROM (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part),
    (VALUES (DATE '2024-01-01', DATE '2024-12-31', 100), (DATE '2025-01-01', NULL, 150)) p(s, e, f)""",
)
def expand_price_list(spark, folder):
    """A list that prices parts up to size 40; the others come out without a price."""
    part = read_table(spark, folder, "part")
    motors = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("model"))
    percents = F.array(
        *(
            F.struct(F.lit(start).cast("date").alias("valid_from"), F.lit(percent).alias("percent"))
            for start, percent in (("2024-01-01", 100), ("2025-01-01", 150))
        )
    )
    retail, percent = F.col("p_retailprice"), F.col("period.percent")
    listed = (
        part.filter(F.col("p_size") <= 40)
        .select(F.col("p_partkey").alias("model"), "p_retailprice", F.explode(percents).alias("period"))
        .select(
            "model",
            "period.valid_from",
            share_of(retail, percent).alias("list_price"),
            share_of(retail, percent - 30).alias("production_cost"),
        )
    )
    return loading.expand_price_list(motors, listed, [("2024-01-01", "2024-12-31"), ("2025-01-01", None)])


@SALES.named(
    "delivered_qty",
    MART + """SELECT CAST(coalesce(sum(i.delivered_quantity), 0) AS BIGINT) AS delivered_quantity
    FROM order_items i JOIN mart_orders o ON i.order_id = o.id JOIN motors m ON i.motor_id = m.id
    WHERE o.order_status = 'DELIVERED' AND m.model = (SELECT max(model) FROM motors)
    AND o.order_date BETWEEN DATE '1996-01-01' AND DATE '1999-06-30'""",
)
def delivered_qty(spark, folder):
    mart = star_mart(spark, folder)
    # The last model by name, found within the query.
    last = mart["motors"].agg(F.max("model").alias("model"))
    only = {**mart, "motors": mart["motors"].join(last, "model", "left_semi")}
    return sales_reports.delivered_qty(only, None, "1996-01-01", "1999-06-30")


@SALES.named(
    "delivered_by_family",
    MART + """SELECT m.motor_family, CAST(sum(i.delivered_quantity) AS BIGINT) AS delivered_quantity
    FROM order_items i JOIN mart_orders o ON i.order_id = o.id JOIN motors m ON i.motor_id = m.id
    WHERE o.order_status = 'DELIVERED' AND o.order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
    GROUP BY 1""",
)
def delivered_by_family(spark, folder):
    return sales_reports.delivered_by(star_mart(spark, folder), "motor_family", "1997-01-01", "1997-12-31")


@SALES.named(
    "top_products",
    MART + """SELECT m.model, CAST(sum(i.delivered_quantity) AS BIGINT) AS delivered_quantity
    FROM order_items i JOIN mart_orders o ON i.order_id = o.id JOIN motors m ON i.motor_id = m.id
    WHERE o.order_status = 'DELIVERED' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_products(spark, folder):
    return sales_reports.top_products(star_mart(spark, folder), 10)


TOP_CUSTOMERS = MART + """SELECT c.c_name AS customer_number, 'Company of ' || c.c_name AS company_name,
    CAST(sum(i.quantity) AS BIGINT) AS ordered_quantity
    FROM order_items i JOIN mart_orders o ON i.order_id = o.id JOIN customer c ON o.customer_id = c.c_custkey
    {where} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10"""


@SALES.named("top_customers", TOP_CUSTOMERS.format(where=""))
def top_customers(spark, folder):
    return sales_reports.top_customers(star_mart(spark, folder), 10)


@SALES.named("top_customers_open", TOP_CUSTOMERS.format(where="WHERE o.order_status = 'OPEN'"))
def top_customers_open(spark, folder):
    return sales_reports.top_customers(star_mart(spark, folder), 10, status="OPEN")


@SALES.named(
    "stock",
    MART + """SELECT m.model, s.warehouse, CAST(sum(s.quantity_available) AS BIGINT) AS quantity_available,
    CAST(sum(s.quantity_reserved) AS BIGINT) AS quantity_reserved
    FROM inventory s JOIN motors m ON s.motor_id = m.id GROUP BY 1, 2""",
)
def stock(spark, folder):
    return sales_reports.stock(star_mart(spark, folder))


PRICE_AS_OF = MART + """SELECT i.motor_id, i.ship_date, p.valid_from, p.list_price, count(*) AS items,
    CAST(sum(i.quantity) AS BIGINT) AS quantity FROM order_items i LEFT JOIN motor_prices p ON p.motor_id = i.motor_id
    AND p.valid_from <= i.ship_date AND (p.valid_to IS NULL OR i.ship_date <= p.valid_to)
    GROUP BY 1, 2, 3, 4"""


def _per_price(priced: DataFrame) -> DataFrame:
    return priced.groupBy("motor_id", "ship_date", "valid_from", "list_price").agg(
        F.count("*").alias("items"), F.sum("quantity").alias("quantity")
    )


@SALES.named("price_as_of", PRICE_AS_OF)
def price_as_of(spark, folder):
    mart = star_mart(spark, folder)
    return _per_price(pricing.price_as_of(mart["order_items"], mart["motor_prices"], "ship_date"))


@SALES.named("price_as_of_long_history", PRICE_AS_OF)
def price_as_of_long_history(spark, folder):
    mart = star_mart(spark, folder)
    return _per_price(pricing.price_as_of_long_history(mart["order_items"], mart["motor_prices"], "ship_date"))


@SALES.named(
    "delete_orders",
    MART + """, kept AS (SELECT id, order_date FROM mart_orders WHERE order_status <> 'CONFIRMED')
    SELECT k.order_date, 'order' AS kind, count(*) AS rows_left FROM kept k GROUP BY 1
    UNION ALL
    SELECT i.ship_date, 'item', count(*) FROM order_items i
    WHERE i.order_id NOT IN (SELECT id FROM mart_orders WHERE order_status = 'CONFIRMED') GROUP BY 1""",
)
def delete_orders(spark, folder):
    mart = star_mart(spark, folder)
    keys = mart["orders"].filter(F.col("order_status") == "CONFIRMED").select("id")
    orders, items = integrity.delete_orders(mart["orders"], mart["order_items"], keys)
    per_day = orders.groupBy("order_date").agg(F.count("*").alias("rows_left"))
    per_ship_day = items.groupBy(F.col("ship_date").alias("order_date")).agg(F.count("*").alias("rows_left"))
    return per_day.withColumn("kind", F.lit("order")).unionByName(per_ship_day.withColumn("kind", F.lit("item")))


@SALES.named(
    "delete_refused",
    "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY'"
    " AND c_custkey IN (SELECT o_custkey FROM orders)",
)
def delete_refused(spark, folder):
    """Customers that cannot be deleted because an order refers to them."""
    mart = star_mart(spark, folder)
    keys = mart["customers"].filter(F.col("customer_segment") == "MACHINERY").select("id")
    return integrity.references(keys, mart["orders"], "customer_id")


FREE_SQL = """SELECT c.customer_segment, CAST(year(o.order_date) AS INT) AS order_year,
    CAST(sum(i.quantity) FILTER (WHERE o.order_status = 'DELIVERED') AS BIGINT) AS delivered,
    count(DISTINCT o.id) AS orders_placed
    FROM order_items i JOIN {orders} o ON o.id = i.order_id JOIN customers c ON c.id = o.customer_id
    WHERE c.customer_segment ILIKE 'm%' OR c.customer_segment = 'FURNITURE'
    GROUP BY ROLLUP (c.customer_segment, year(o.order_date))"""


@SALES.named(
    "free_sql",
    MART + ", customers AS (SELECT c_custkey AS id, c_mktsegment AS customer_segment FROM customer) "
    + FREE_SQL.format(orders="mart_orders"),
)
def free_sql(spark, folder):
    return run_sql(spark, FREE_SQL.format(orders="orders"), star_mart(spark, folder))


INSERT_ORDER = {
    "motors": ["article_number"],
    "customers": ["customer_number"],
    "orders": ["order_date", "order_number"],
    "order_items": ["order_id", "motor_id", "quantity", "delivered_quantity", "ship_date"],
    "motor_prices": ["motor_id", "valid_from"],
    "inventory": ["motor_id"],
}


def _staged(mart: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The mart with natural keys in place of foreign keys."""
    article = F.concat(F.lit("MTR-"), F.col("motor_id").cast("string")).alias("article_number")
    number = F.concat(F.lit("ORD-"), F.col("order_id").cast("string")).alias("order_number")
    customers = mart["customers"].select(F.col("id").alias("customer_id"), "customer_number").hint("merge")
    return {
        **mart,
        "orders": mart["orders"].join(customers, "customer_id").drop("customer_id"),
        "order_items": mart["order_items"].select("*", article, number).drop("order_id", "motor_id"),
        "motor_prices": mart["motor_prices"].select("*", article).drop("motor_id"),
        "inventory": mart["inventory"].select("*", article).drop("motor_id"),
    }


@SALES.named(
    "mart_reload",
    """SELECT 'motors' AS name, count(*) AS rows_loaded, count(*) AS total FROM part
    UNION ALL SELECT 'customers', count(*), count(*) FROM customer
    UNION ALL SELECT 'orders', count(*), count(*) FROM orders
    UNION ALL SELECT 'order_items', count(*), count(*) FROM lineitem
    UNION ALL SELECT 'motor_prices', 7 * count(*), 7 * count(*) FROM part
    UNION ALL SELECT 'inventory', count(*), count(*) FROM part
    UNION ALL SELECT 'MTR-' || l_partkey, count(*), CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) FROM lineitem GROUP BY 1
    UNION ALL SELECT c_name, count(*), CAST(sum(CAST(l_quantity AS INT)) AS BIGINT)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1
    UNION ALL SELECT 'MTR-' || p_partkey || ' in stock', 1, p_size FROM part""",
)
def mart_reload(spark, folder):
    """Reload all six tables by natural keys, then read them back and follow their new keys."""
    staged = _staged(star_mart(spark, folder))
    target = f"{checkpoint_folder(spark)}/mart-{uuid.uuid4().hex}"
    loading.reload(staged, target, INSERT_ORDER)
    loaded = load_sales(spark, target)
    counts = [
        df.agg(F.count("*").alias("rows_loaded"), F.max("id").alias("total")).withColumn("name", F.lit(name))
        for name, df in loaded.items()
    ]
    motors = loaded["motors"].select(F.col("id").alias("motor_id"), "article_number").hint("merge")
    customers = loaded["customers"].select(F.col("id").alias("customer_id"), "customer_number").hint("merge")
    buyers = loaded["orders"].select(F.col("id").alias("order_id"), "customer_id").join(customers, "customer_id").hint("merge")
    sums = [F.count("*").alias("rows_loaded"), F.sum("quantity").alias("total")]
    items = loaded["order_items"]
    counts += [
        items.join(motors, "motor_id").groupBy(F.col("article_number").alias("name")).agg(*sums),
        items.join(buyers, "order_id").groupBy(F.col("customer_number").alias("name")).agg(*sums),
        loaded["inventory"].join(motors, "motor_id").select(
            F.concat("article_number", F.lit(" in stock")).alias("name"),
            F.lit(1).cast("bigint").alias("rows_loaded"),
            F.col("quantity_available").cast("bigint").alias("total"),
        ),
    ]
    return reduce(DataFrame.unionByName, counts)


def _reload_sql(state: str, where: str) -> str:
    return f"""SELECT '{state}' AS state, 'motors' AS name, count(*) AS rows_loaded, count(*) AS total FROM part
    UNION ALL SELECT '{state}', 'customers', count(*), count(*) FROM customer
    UNION ALL SELECT '{state}', 'orders', count(*), count(*) FROM orders WHERE {where}
    UNION ALL SELECT '{state}', 'order_items', count(*), CAST(sum(CAST(l_quantity AS INT)) AS BIGINT)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where}
    UNION ALL SELECT '{state}', 'motor_prices', 7 * count(*), 7 * count(*) FROM part
    UNION ALL SELECT '{state}', 'inventory', count(*), CAST(sum(p_size) AS BIGINT) FROM part"""


@SALES.named(
    "mart_reload_failed",
    _reload_sql("after the failure", "year(o_orderdate) = 1995") + " UNION ALL " + _reload_sql("after the repair", "year(o_orderdate) <= 1996"),
)
def mart_reload_failed(spark, folder):
    """A load that breaks off after its third table leaves the one before whole; a repaired one replaces it whole."""
    root = f"{checkpoint_folder(spark)}/versions-{uuid.uuid4().hex}"
    mart = star_mart(spark, folder)

    def until(year):
        return _staged({**mart, "orders": mart["orders"].filter(F.year("order_date").between(1995 if year == 1995 else 0, year))})

    def loaded(state):
        tables = load_sales(spark, current(spark, root))
        shown = {"order_items": "quantity", "inventory": "quantity_available"}
        return [
            df.agg(F.count("*").alias("rows_loaded"), F.sum(shown[name]).alias("total") if name in shown else F.max("id").alias("total"))
            .select(F.lit(state).alias("state"), F.lit(name).alias("name"), "rows_loaded", "total")
            for name, df in tables.items()
        ]

    loading.reload_whole(until(1995), root, INSERT_ORDER)
    broken = until(1996)
    quantity = F.when(F.col("quantity") > 0, F.raise_error(F.lit("a row that cannot be loaded"))).otherwise(F.col("quantity")).cast("int")
    broken["order_items"] = broken["order_items"].withColumn("quantity", quantity)
    try:
        loading.reload_whole(broken, root, INSERT_ORDER)
    except PySparkException as failed:
        if "cannot be loaded" not in str(failed):
            raise
    before = loaded("after the failure")
    loading.reload_whole(until(1996), root, INSERT_ORDER)
    return reduce(DataFrame.unionByName, [*before, *loaded("after the repair")])


@SALES.named(
    "stored_orders_deleted",
    MART + """, kept AS (SELECT id, order_date FROM mart_orders
      WHERE NOT (order_status = 'CONFIRMED' AND year(order_date) IN (1995, 1997)) AND year(order_date) <> 1996)
    SELECT CAST(year(order_date) AS INT) AS year, 'order' AS kind, count(*) AS rows_left FROM kept GROUP BY 1
    UNION ALL SELECT CAST(year(ship_date) AS INT), 'item', count(*) FROM order_items WHERE order_id IN (SELECT id FROM kept) GROUP BY 1""",
)
def stored_orders_deleted(spark, folder):
    """Orders and their items deleted from stored tables; one year loses all its orders."""
    target = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    mart = star_mart(spark, folder)
    writeback.store(mart["orders"].withColumn("order_year", F.year("order_date")), f"{target}/orders", "order_year")
    writeback.store(mart["order_items"].withColumn("slice", writeback.slice_of("order_id", 8)), f"{target}/items", "slice")

    def read(name):
        return spark.read.parquet(f"{target}/{name}")

    doomed = ((F.col("order_status") == "CONFIRMED") & F.col("order_year").isin(1995, 1997)) | (F.col("order_year") == 1996)
    keys = read("orders").filter(doomed).select("id").checkpoint()
    writeback.delete_stored([(read("items"), f"{target}/items", "slice", "order_id"), (read("orders"), f"{target}/orders", "order_year", "id")], keys)
    orders = read("orders").groupBy(F.year("order_date").alias("year")).agg(F.count("*").alias("rows_left"))
    items = read("items").groupBy(F.year("ship_date").alias("year")).agg(F.count("*").alias("rows_left"))
    return orders.withColumn("kind", F.lit("order")).unionByName(items.withColumn("kind", F.lit("item")))


@SALES.named(
    "mart_layout",
    MART + """SELECT 'orders ' || year(order_date) AS name, order_status AS part, count(*) AS rows_read, sum(customer_id)::BIGINT AS total
    FROM mart_orders WHERE order_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2
    UNION ALL SELECT 'motors', motor_family, count(*), sum(id)::BIGINT FROM motors GROUP BY 2
    UNION ALL SELECT 'customers', c_mktsegment, count(*), sum(c_custkey)::BIGINT FROM customer GROUP BY 2
    UNION ALL SELECT 'order_items', CAST(quantity AS VARCHAR), count(*), sum(motor_id)::BIGINT FROM order_items GROUP BY 2
    UNION ALL SELECT 'motor_prices', CAST(valid_from AS VARCHAR), count(*), sum(motor_id)::BIGINT FROM motor_prices GROUP BY 2
    UNION ALL SELECT 'inventory', warehouse, count(*), sum(quantity_available)::BIGINT FROM inventory GROUP BY 2""",
)
def mart_layout(spark, folder):
    """All tables written in their layout and read back, orders for three years from their own folders."""
    mart = star_mart(spark, folder)
    for name in ("order_items", "motor_prices"):
        keys = ["order_id", "motor_id"] if name == "order_items" else ["motor_id", "valid_from"]
        mart[name] = mart[name].withColumn("id", F.xxhash64(*keys))
    mart["inventory"] = mart["inventory"].withColumn("id", F.col("motor_id"))
    target = f"{checkpoint_folder(spark)}/layout-{uuid.uuid4().hex}"
    write_layout(mart, target)
    orders = spark.read.parquet(f"{target}/orders").filter(F.col("order_year").between(1996, 1998))
    year = F.concat(F.lit("orders "), F.col("order_year").cast("string"))
    parts = [orders.select(year.alias("name"), F.col("order_status").alias("part"), F.col("customer_id").alias("value"))]
    shown = {
        "motors": ("motor_family", "id"), "customers": ("customer_segment", "id"), "order_items": ("quantity", "motor_id"),
        "motor_prices": ("valid_from", "motor_id"), "inventory": ("warehouse", "quantity_available"),
    }
    for name, (part, value) in shown.items():
        table = spark.read.parquet(f"{target}/{name}")
        parts.append(table.select(F.lit(name).alias("name"), F.col(part).cast("string").alias("part"), F.col(value).cast("bigint").alias("value")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("name", "part").agg(F.count("*").alias("rows_read"), F.sum("value").alias("total"))
