"""Constraint checks, control counts and deletes that keep references whole."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.sales import ForeignKey, NotNull, Unique

Constraint = NotNull | Unique | ForeignKey


def _violation_row(df: DataFrame, rule: str, table: str) -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table_name"),
        F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"),
    )


def _check_not_null(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """All columns of a table in one scan."""
    counts = df.agg(*(F.count_if(F.col(column).isNull()).alias(column) for column in columns))
    return counts.unpivot([], columns, "_column", "violations").select(
        F.concat(F.lit("not null "), F.col("_column")).alias("rule"),
        F.lit(table).alias("table_name"),
        "violations",
    )


def _check_unique(df: DataFrame, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each key; keys with a NULL never collide."""
    keys = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("_rows"))
    surplus = keys.agg(F.sum(F.col("_rows") - 1).alias("violations"))
    return _violation_row(surplus, f"unique {', '.join(columns)}", table)


def _check_foreign_key(tables: Mapping[str, DataFrame], key: ForeignKey) -> DataFrame:
    """Rows whose key has no parent. Counting per key first keeps a hot key to one row."""
    children = (
        tables[key.table].filter(F.col(key.column).isNotNull())
        .groupBy(F.col(key.column).alias("_key")).agg(F.count("*").alias("_rows"))
    )
    parents = tables[key.parent].select(F.col(key.parent_column).alias("_key"))
    orphans = children.join(parents, "_key", "left_anti").agg(F.sum("_rows").alias("violations"))
    return _violation_row(orphans, f"foreign key {key.column} to {key.parent}", key.table)


def check_constraints(tables: Mapping[str, DataFrame], constraints: Iterable[Constraint]) -> DataFrame:
    """(rule, table_name, violations) for every constraint."""
    not_null: dict[str, list[str]] = {}
    checks = []
    for constraint in constraints:
        match constraint:
            case NotNull(table, column):
                not_null.setdefault(table, []).append(column)
            case Unique(table, columns):
                checks.append(_check_unique(tables[table], table, columns))
            case ForeignKey():
                checks.append(_check_foreign_key(tables, constraint))
    checks += [_check_not_null(tables[table], table, columns) for table, columns in not_null.items()]
    return reduce(DataFrame.unionByName, checks)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def delete_orders(orders: DataFrame, items: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders without ``keys`` (a column ``id``) and the items left after the cascade."""
    doomed = keys.select("id")
    gone = doomed.withColumnRenamed("id", "order_id")
    return orders.join(doomed, "id", "left_anti"), items.join(gone, "order_id", "left_anti")


def references(keys: DataFrame, child: DataFrame, column: str) -> DataFrame:
    """The ``keys`` (a column ``id``) that ``child`` still refers to."""
    used = child.select(F.col(column).alias("id"))
    return keys.select("id").join(used, "id", "left_semi")


def delete_restricted(parent: DataFrame, keys: DataFrame, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Parent rows without ``keys``; refused while any child table refers to one of them."""
    for name, (child, column) in children.items():
        if not references(keys, child, column).isEmpty():
            raise ValueError(f"{name}.{column} still refers to rows to be deleted")
    return parent.join(keys.select("id"), "id", "left_anti")
