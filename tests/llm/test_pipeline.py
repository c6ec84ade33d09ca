"""The pipeline stage by stage: what each keeps, against brute force on the rows it was given."""

import corpus_pipeline
import pytest
from cases import ODD
from test_dedup import expected_groups, expected_lines
from test_judgement import expected_hits

import __spark_entry__ as entry


def rows_of(df):
    return sorted(((row["doc_id"], row["text"]) for row in df.collect()), key=repr)


@pytest.fixture(scope="module")
def staged(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def test_columns_stay(staged):
    for df in staged[:-1]:
        assert df.columns == staged[0].columns
    assert staged[-1].columns == [*staged[0].columns, "ids", "n_pieces", "round_trip"]


def test_quality_stage(spark, small, staged):
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {doc for doc, _ in rows_of(staged[1])}
    clean = [doc for doc, quality in labels.items() if quality == 1]
    poor = [doc for doc, quality in labels.items() if quality == 0]
    assert sum(doc in kept for doc in clean) >= 0.97 * len(clean)
    assert sum(doc in kept for doc in poor) <= 0.15 * len(poor)


def test_line_stage(staged):
    wanted = [(doc, text) for doc, _, gone, text in expected_lines(rows_of(staged[1])) if not gone or text.strip(" ")]
    assert rows_of(staged[2]) == sorted(wanted, key=repr)
    assert all(row["n_chars"] == len(row["text"]) for row in staged[2].collect())


def test_near_copy_stage(staged):
    given = rows_of(staged[2])
    first = {doc for doc, _, group in expected_groups(given) if doc == group}
    assert rows_of(staged[3]) == [row for row in given if row[0] in first]


def test_near_copy_stage_tells_rows_of_one_id_apart(spark):
    other = " ".join(f"other{n}" for n in range(20))
    rows = [(1, "one text with a few words"), (1, other), (2, other), (2, other + " more"), (2, "short"), (None, other), (None, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, df, "")
    assert rows_of(kept) == sorted([(1, "one text with a few words"), (1, other), (2, other + " more"), (2, "short"), (None, other), (None, other)], key=repr)


def test_benchmark_stage(spark, small, staged):
    items = [(row["item_id"], row["text"]) for row in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    given = rows_of(staged[3])
    clean = {doc for doc, _, hit, _ in expected_hits(given, items) if not hit}
    assert rows_of(staged[4]) == [row for row in given if row[0] in clean]


def test_encoding_stage(staged):
    assert rows_of(staged[5]) == rows_of(staged[4])
    assert all(row["round_trip"] and row["n_pieces"] == len(row["ids"]) for row in staged[5].collect())


def test_run_is_the_stages(spark, small, staged):
    assert rows_of(entry.queries()["pipeline"](spark, small)) == rows_of(staged[5])


def test_odd_rows_pass_all_stages(spark, small, odd):
    docs = odd.withColumn("source", odd["lang"]).withColumn("n_chars", odd["doc_id"])
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns or set(docs.columns) == {*columns, "ids", "n_pieces", "round_trip"}
    rows = docs.collect()
    assert {row["doc_id"] for row in rows} <= {doc for doc, *_ in ODD}
    assert all(row["chunk"] == row["kept"] == row["score"] == "?" for row in rows)


def test_empty_table_passes_all_stages(spark, small):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.collect() == []
