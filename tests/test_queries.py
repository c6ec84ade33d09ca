"""Every named query against its SQL in another engine."""

import compare
import pytest

import __spark_entry__ as entry

PLANS = (entry.SALES, entry.PAGES, entry.MAIL)
QUERIES = {name: build for plan in PLANS for name, build in plan.queries.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.oracles.items()}


@pytest.fixture(scope="module")
def connection(small):
    return compare.connect(small)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(name, spark, small, connection):
    df = QUERIES[name](spark, small)
    assert compare.spark_rows(df) == compare.duckdb_rows(connection, ORACLES[name])
    assert compare.type_mismatches(df, connection, ORACLES[name]) == {}


def test_entry(spark, small):
    assert entry.entry(spark).count() == 10
