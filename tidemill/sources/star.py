"""The sales mart, seen through a star schema of orders, line items, parts and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1995, 2001


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def star_mart(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six mart tables as views of the star tables. Unused columns are pruned at the scan."""
    part = read_table(spark, folder, "part")
    customer = read_table(spark, folder, "customer")
    nation = read_table(spark, folder, "nation")
    motors = part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("MTR-"), F.col("p_partkey").cast("string")).alias("article_number"),
        F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("model"),
        F.col("p_brand").alias("motor_family"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("cooling_type"),
    )
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("customer_number"),
        F.concat(F.lit("Company of "), "c_name").alias("company_name"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("customer_segment"),
    )
    status = F.when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "O", "OPEN")
    orders = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_number"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        status.otherwise("CONFIRMED").alias("order_status"),
    )
    quantity = F.col("l_quantity").cast("int")
    order_items = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("motor_id"),
        quantity.alias("quantity"),
        F.when(F.col("l_linestatus") == "F", quantity).otherwise(0).alias("delivered_quantity"),
        F.col("l_shipdate").cast("date").alias("ship_date"),
    )
    inventory = part.select(
        F.col("p_partkey").alias("motor_id"),
        F.concat(F.lit("Hall "), (F.col("p_partkey") % 3).cast("string")).alias("warehouse"),
        F.col("p_size").alias("quantity_available"),
        (F.col("p_partkey") % 7).cast("int").alias("quantity_reserved"),
    )
    return {
        "motors": motors,
        "customers": customers,
        "orders": orders,
        "order_items": order_items,
        "motor_prices": star_prices(part),
        "inventory": inventory,
    }


def star_prices(part: DataFrame) -> DataFrame:
    """A yearly price per part, 5 % dearer each year, the last year open-ended."""
    years = F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))
    yearly = part.select("p_partkey", "p_retailprice", F.explode(years).alias("year"))
    percent = 100 + 5 * (F.col("year") - FIRST_YEAR)
    return yearly.select(
        F.col("p_partkey").alias("motor_id"),
        F.make_date("year", F.lit(1), F.lit(1)).alias("valid_from"),
        F.when(F.col("year") < LAST_YEAR, F.make_date("year", F.lit(12), F.lit(31))).alias("valid_to"),
        share_of(F.col("p_retailprice"), percent).alias("list_price"),
    )


def share_of(amount: Column, percent: Column | int) -> Column:
    """``percent`` of an amount in whole cents, half a cent rounded up, without binary fractions."""
    cents = F.round(amount * 100).cast("bigint") * percent
    whole = F.floor((cents.cast("decimal(20,0)") + 50) / 100)
    return (whole.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)")
