"""Prices valid on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _valid_on(day: Column, valid_from: Column, valid_to: Column) -> Column:
    """Closed interval; a NULL end is open."""
    return (valid_from <= day) & (valid_to.isNull() | (day <= valid_to))


def price_as_of(facts: DataFrame, prices: DataFrame, date_col: str, key: str = "motor_id") -> DataFrame:
    """Each fact with the price valid on its date; NULL where none is.

    The equality on ``key`` makes this a sort-merge join with the dates as a residual
    condition: periods that a plan makes out of few rows look small, so none are broadcast. A
    hot key is split by adaptive execution.
    """
    spans = prices.withColumnsRenamed({key: "_key"}).hint("merge")
    condition = (facts[key] == spans["_key"]) & _valid_on(
        facts[date_col], spans["valid_from"], spans["valid_to"]
    )
    return facts.join(spans, condition, "left").drop("_key")


def price_as_of_long_history(facts: DataFrame, prices: DataFrame, date_col: str, key: str = "motor_id") -> DataFrame:
    """``price_as_of`` for keys with very many periods.

    Closed periods are spread over the months they touch and the month joins the equality, so a
    fact meets only the prices of its own month. Open periods, few a key, join on the key alone, so
    there is no last day. Facts that neither finds keep NULL prices. A period counts once for each
    month, so its size is not to be seen in the plan, and no periods are broadcast.
    """
    month = F.trunc(F.col(date_col), "month")
    spans = prices.withColumnRenamed(key, "_key")
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc("valid_to", "month"), F.expr("interval 1 month"))
    # A period that ends before it begins holds no day.
    closed = spans.filter("valid_from <= valid_to").withColumn("_month", F.explode(months)).hint("merge")
    opened = spans.filter(F.col("valid_to").isNull()).hint("merge")
    day = facts[date_col]
    in_closed = (facts[key] == closed["_key"]) & (month == closed["_month"]) & _valid_on(day, closed["valid_from"], closed["valid_to"])
    in_opened = (facts[key] == opened["_key"]) & (opened["valid_from"] <= day)
    found = facts.join(closed, in_closed).drop("_key", "_month").unionByName(facts.join(opened, in_opened).drop("_key"))
    rest = facts.join(closed, in_closed, "left_anti").join(opened, in_opened, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)
