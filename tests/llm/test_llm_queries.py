"""The named queries: against their SQL where there is one, else that every row comes back."""

import compare
import pytest

from tidemill.llm.queries import LLM


@pytest.fixture(scope="module")
def connection(small):
    return compare.connect(small)


@pytest.mark.parametrize("name", LLM.oracles)
def test_query_matches_sql(name, spark, small, connection):
    df = LLM.queries[name](spark, small)
    assert compare.spark_rows(df) == compare.duckdb_rows(connection, LLM.oracles[name])
    assert compare.type_mismatches(df, connection, LLM.oracles[name]) == {}


# A search without SQL; test_search.py has its recall.
SEARCHES = {"op12_nearest_vectors"}


@pytest.mark.parametrize("name", sorted(set(LLM.queries) - set(LLM.oracles) - SEARCHES))
def test_query_returns_each_document(name, spark, small, documents):
    rows = LLM.queries[name](spark, small).select("doc_id").collect()
    assert sorted(row[0] for row in rows) == sorted(row[0] for row in documents.select("doc_id").collect())
