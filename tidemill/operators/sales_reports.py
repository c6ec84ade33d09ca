"""Sales questions over the mart. A sale is a delivered quantity on a delivered order."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIVERED = "DELIVERED"


def _delivered_items(
    mart: Mapping[str, DataFrame],
    start: str | None = None,
    end: str | None = None,
    motors: DataFrame | None = None,
) -> DataFrame:
    """Items of delivered orders, the order date within [start, end], of ``motors`` if given."""
    orders = mart["orders"].filter(F.col("order_status") == DELIVERED)
    if start is not None:
        orders = orders.filter(F.col("order_date") >= F.lit(start).cast("date"))
    if end is not None:
        orders = orders.filter(F.col("order_date") <= F.lit(end).cast("date"))
    items = mart["order_items"].select("order_id", "motor_id", "delivered_quantity")
    if motors is not None:
        items = items.join(motors.select(F.col("id").alias("motor_id")), "motor_id", "left_semi")
    return items.join(orders.select(F.col("id").alias("order_id")), "order_id")


def delivered_qty(mart: Mapping[str, DataFrame], model: str | None, start: str, end: str) -> DataFrame:
    """Delivered quantity of ``model`` (of all motors: None) in a closed range of order dates; 0 when none."""
    motors = mart["motors"] if model is None else mart["motors"].filter(F.col("model") == model)
    sold = _delivered_items(mart, start, end, motors)
    return sold.agg(F.coalesce(F.sum("delivered_quantity"), F.lit(0)).alias("delivered_quantity"))


def delivered_by(
    mart: Mapping[str, DataFrame], by: str = "model", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Delivered quantity per motor attribute.

    Summing per motor before the motor table is joined leaves at most one row per
    motor, however unevenly the sales are spread.
    """
    per_motor = _delivered_items(mart, start, end).groupBy("motor_id").agg(F.sum("delivered_quantity").alias("_sold"))
    named = per_motor.join(mart["motors"].select(F.col("id").alias("motor_id"), by), "motor_id")
    return named.groupBy(by).agg(F.sum("_sold").alias("delivered_quantity"))


def top_products(mart: Mapping[str, DataFrame], k: int, by: str = "model") -> DataFrame:
    """The ``k`` best sellers, ties in name order."""
    return delivered_by(mart, by).orderBy(F.desc("delivered_quantity"), by).limit(k)


def top_customers(mart: Mapping[str, DataFrame], k: int, status: str | None = None) -> DataFrame:
    """The ``k`` customers with the largest ordered quantity, whatever the order's status."""
    orders = mart["orders"]
    if status is not None:
        orders = orders.filter(F.col("order_status") == status)
    items = mart["order_items"].select("order_id", "quantity")
    placed = orders.select(F.col("id").alias("order_id"), "customer_id")
    per_customer = (
        items.join(placed, "order_id").groupBy("customer_id").agg(F.sum("quantity").alias("ordered_quantity"))
    )
    customers = mart["customers"].select(F.col("id").alias("customer_id"), "customer_number", "company_name")
    return (
        per_customer.join(customers, "customer_id")
        .select("customer_number", "company_name", "ordered_quantity")
        .orderBy(F.desc("ordered_quantity"), "customer_number")
        .limit(k)
    )


def stock(mart: Mapping[str, DataFrame], model: str | None = None) -> DataFrame:
    """Available and reserved quantity per motor model and warehouse."""
    motors = mart["motors"] if model is None else mart["motors"].filter(F.col("model") == model)
    per_motor = mart["inventory"].groupBy("motor_id", "warehouse").agg(
        F.sum("quantity_available").alias("_available"), F.sum("quantity_reserved").alias("_reserved")
    )
    return (
        per_motor.join(motors.select(F.col("id").alias("motor_id"), "model"), "motor_id")
        .groupBy("model", "warehouse")
        .agg(
            F.sum("_available").alias("quantity_available"),
            F.sum("_reserved").alias("quantity_reserved"),
        )
    )
