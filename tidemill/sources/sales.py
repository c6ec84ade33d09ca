"""The sales mart: six typed tables, their declared constraints, load and layout."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


KEY, INT, TEXT, FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
DAY, MOMENT = T.DateType(), T.TimestampNTZType()
RATING, MONEY, PERCENT = T.DecimalType(10, 2), T.DecimalType(12, 2), T.DecimalType(5, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Tables, columns and types of the mart. Keys are 64-bit here.
SALES_SCHEMAS = {
    "motors": _schema(
        id=KEY, article_number=TEXT, model=TEXT, motor_family=TEXT, description=TEXT,
        rated_power_kw=RATING, rated_speed_rpm=INT, rated_voltage_v=INT, rated_torque_nm=RATING,
        cooling_type=TEXT, product_status=TEXT, created_at=MOMENT,
    ),
    "customers": _schema(
        id=KEY, customer_number=TEXT, company_name=TEXT, country=TEXT, customer_segment=TEXT,
        active=FLAG, created_at=MOMENT,
    ),
    "orders": _schema(
        id=KEY, order_number=TEXT, customer_id=KEY, order_date=DAY, delivery_date=DAY,
        order_status=TEXT, currency=TEXT, created_at=MOMENT,
    ),
    "order_items": _schema(
        id=KEY, order_id=KEY, motor_id=KEY, quantity=INT, delivered_quantity=INT,
        unit_price=MONEY, discount_percent=PERCENT,
    ),
    "motor_prices": _schema(
        id=KEY, motor_id=KEY, valid_from=DAY, valid_to=DAY, list_price=MONEY,
        production_cost=MONEY, currency=TEXT,
    ),
    "inventory": _schema(
        id=KEY, motor_id=KEY, warehouse=TEXT, quantity_available=INT, quantity_reserved=INT,
        updated_at=MOMENT,
    ),
}

# What an omitted column takes.
NOW = "now"
SALES_DEFAULTS = {
    "motors": {"product_status": "ACTIVE", "created_at": NOW},
    "customers": {"active": True, "created_at": NOW},
    "orders": {"currency": "EUR", "created_at": NOW},
    "order_items": {"delivered_quantity": 0, "discount_percent": 0},
    "motor_prices": {"currency": "EUR"},
    "inventory": {"quantity_available": 0, "quantity_reserved": 0, "updated_at": NOW},
}


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    parent: str
    parent_column: str = "id"


# The constraints the mart declares.
SALES_CONSTRAINTS = (
    *(Unique(table, ("id",)) for table in SALES_SCHEMAS),
    Unique("motors", ("article_number",)),
    Unique("customers", ("customer_number",)),
    Unique("orders", ("order_number",)),
    *(NotNull(table, "id") for table in SALES_SCHEMAS),
    *(
        NotNull("motors", column)
        for column in (
            "article_number", "model", "motor_family",
            "rated_power_kw", "rated_speed_rpm", "rated_voltage_v",
        )
    ),
    NotNull("customers", "customer_number"),
    NotNull("customers", "company_name"),
    NotNull("orders", "order_number"),
    NotNull("orders", "customer_id"),
    NotNull("orders", "order_date"),
    NotNull("order_items", "order_id"),
    NotNull("order_items", "motor_id"),
    NotNull("order_items", "quantity"),
    NotNull("motor_prices", "motor_id"),
    NotNull("motor_prices", "valid_from"),
    NotNull("inventory", "motor_id"),
    ForeignKey("orders", "customer_id", "customers"),
    ForeignKey("order_items", "order_id", "orders"),
    ForeignKey("order_items", "motor_id", "motors"),
    ForeignKey("motor_prices", "motor_id", "motors"),
    ForeignKey("inventory", "motor_id", "motors"),
)


def load_sales(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The six tables from ``folder/<table>``, schema given, never inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return {name: reader.schema(schema).load(f"{folder}/{name}") for name, schema in SALES_SCHEMAS.items()}


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


_one_at_a_time = threading.RLock()


@contextmanager
def visible(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """The tables as the only views while a query is analysed; views they hide come back afterwards."""
    with _one_at_a_time:
        views = [table.name for table in spark.catalog.listTables() if table.isTemporary]
        hidden = {name: spark.table(name) for name in views}
        for name in views:
            spark.catalog.dropTempView(name)
        register_views(tables)
        try:
            yield
        finally:
            for name in tables:
                spark.catalog.dropTempView(name)
            for name, view in hidden.items():
                view.createOrReplaceTempView(name)


# How a plan shows a relation with a catalog or database in its name, and calls of Java methods.
QUALIFIED = re.compile(r"SubqueryAlias ((?:[^\s.]+\.)+[^\s.]+)\s*$", re.MULTILINE)
JAVA_CALL = re.compile(r"\b(?:try_)?(?:reflect|java_method)\(")


def _analysed(df: DataFrame) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query over the tables; unknown tables and columns, other views, files and all but queries fail at analysis.

    Saved tables and global views are refused, by whatever name, but for those that ``tables`` are read from
    themselves; so are calls of Java methods. The analysed plan is what counts, subqueries included; a text in the
    query that looks like such a call is refused with it.
    """
    with visible(spark, tables):
        files = spark.conf.get("spark.sql.runSQLOnFiles")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        try:
            # Only a query can stand in brackets.
            found = spark.sql(f"SELECT * FROM (\n{text.strip().rstrip(';')}\n)")
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", files)
    plan = _analysed(found)
    own = {name for table in tables.values() for name in QUALIFIED.findall(_analysed(table))}
    foreign = sorted(set(QUALIFIED.findall(plan)) - own)
    if foreign:
        raise ValueError(f"{', '.join(foreign)}: not among the tables of the mart")
    if JAVA_CALL.search(plan):
        raise ValueError("a query over the mart calls no Java methods")
    return found


def list_tables(spark: SparkSession) -> DataFrame:
    """Names of the tables a query can use, sorted."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name")).orderBy("table_name")


# Bits of the rank that each column has in an interleaved key.
RANK_BITS = 6


def _rank(number: Column, bounds: list) -> Column:
    """How many of the bounds lie below a number; 0 for NULL."""
    if not bounds:
        return F.lit(0)
    return F.when(number.isNotNull(), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound < number))).otherwise(0)


def interleaved(df: DataFrame, columns: Sequence[str]) -> Column:
    """A sort key under which rows near each other are near in all of ``columns`` (numbers or dates).

    Each column counts by its rank among 64 quantiles of ``df``, found by one mergeable sketch, and the bits of the
    ranks take turns, so a range of the key is a small box: its files have narrow ranges of every column.
    """
    numbers = [F.unix_date(name) if kind == "date" else F.col(name).cast("double") for name, kind in df.select(*columns).dtypes]
    shares = [part / (1 << RANK_BITS) for part in range(1, 1 << RANK_BITS)]
    found = df.agg(*(F.percentile_approx(number, shares, 2_000) for number in numbers)).first()
    key = F.lit(0).cast("bigint")
    for place, (number, bounds) in enumerate(zip(numbers, found, strict=True)):
        rank = _rank(number, sorted(set(bounds or [])))
        for bit in range(RANK_BITS):
            up = bit * len(numbers) + place
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint"), up))
    return key


def write_layout(tables: dict[str, DataFrame], folder: str, options: Mapping[str, str] | None = None) -> None:
    """Write the mart so that the five usual lookups prune: model, family, order date, customer, motor.

    Orders lie in one folder per order year; within it files and row groups are boxes of date and customer, those
    of the items boxes of motor and order. The other tables are sorted by their lookup columns. A heavy
    year or motor is cut into several ranges, not given to one task. Bloom filters of model and customer tell row
    groups without a value whose range covers it. ``options`` go to the Parquet writer.
    """
    orders = tables["orders"].withColumn("order_year", F.year("order_date"))
    items = tables["order_items"]
    boxes = {"orders": interleaved(orders, ["customer_id", "order_date"]), "order_items": interleaved(items, ["motor_id", "order_id"])}
    layouts = {
        "orders": (orders, ("order_year", "_box", "id"), ("customer_id",)),
        "order_items": (items, ("_box", "id"), ()),
        "motors": (tables["motors"], ("motor_family", "model", "id"), ("model",)),
        "customers": (tables["customers"], ("customer_number", "id"), ()),
        "motor_prices": (tables["motor_prices"], ("motor_id", "valid_from", "id"), ()),
        "inventory": (tables["inventory"], ("motor_id", "id"), ()),
    }
    for name, (df, keys, filtered) in layouts.items():
        # The id ends the keys so that one hot value can span several files.
        boxed = df.withColumn("_box", boxes[name]) if name in boxes else df
        ranged = boxed.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = ranged.drop("_box").write.mode("overwrite").options(**(options or {}))
        for column in filtered:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        if name == "orders":
            writer = writer.partitionBy("order_year")
        writer.parquet(f"{folder}/{name}")
