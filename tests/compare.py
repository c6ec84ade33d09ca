"""Run a named query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from tidemill.plans.sales import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    if isinstance(value, dict):
        return tuple((key, _plain(item)) for key, item in value.items())
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(names, records) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(record[i]) for i in order) for record in records), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, [tuple(row) for row in df.collect()])


def duckdb_rows(connection, sql: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    return sorted(names), rows(names, result.fetchall())


# Spark's name for each DuckDB type the queries return.
TYPE_NAMES = {
    "VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "VARCHAR[]": "array<string>", "INTEGER[]": "array<int>",
}


def type_mismatches(df, connection, sql: str) -> dict[str, tuple[str, str]]:
    described = {row[0]: row[1] for row in connection.execute(f"DESCRIBE {sql}").fetchall()}
    ours = dict(df.dtypes)
    theirs = {name: TYPE_NAMES.get(kind, kind.lower()) for name, kind in described.items()}
    return {name: (ours.get(name), kind) for name, kind in theirs.items() if ours.get(name) != kind}
