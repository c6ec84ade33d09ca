"""Lexical and vector search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import LOWER, ODD
from pyspark.sql import functions as F

from tidemill.llm import hard_negatives as hard_negatives_module
from tidemill.llm import projected_search, reversed_search
from tidemill.llm.hard_negatives import hard_negatives
from tidemill.llm.queries import LLM
from tidemill.llm.reversed_search import search_items


def by_rank(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected_ranks(rows, items, k=10):
    counts = [Counter(terms(text)) for _, text, *_ in rows]
    full = sum(bool(count) for count in counts)
    length = sum(count.total() for count in counts)
    df = Counter(term for count in counts for term in count)
    out = []
    for item, text in set(items):
        ranked = []
        for (doc, *_), count in zip(rows, counts, strict=True):
            m = 25 + (75 * count.total() * full) // length if length else 0
            score = 0
            for term in terms(text):
                weight = math.floor(1000 * math.log((2 * full + 2) / (2 * df[term] + 1)))
                score += weight * ((10**9 * count[term]) // (1000 * count[term] + 8 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, at + 1, doc, -score) for at, (score, _, _, doc) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=repr)


ITEMS = [
    (1, " ".join(f"shared{n}" for n in range(5, 30))), (2, "One one ONE"), (3, None), (4, "..."), (None, "again again line"), (10, "again Again"),
    (11, "word1 word2 x7 x7"), (12, "a line of its own"), (13, "\u6f22\u5b57"), (14, "One"), (14, "z"), (14, "z"), (15, "again " * 14 + "words"), (16, "nowhere"),
]
RANKED = ("item_id", "rank", "doc_id", "score")


def test_ranks_of_odd_rows(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = expected_ranks(ODD, ITEMS, 3)
    assert by_rank(search_items(odd, items, k=3), *RANKED) == wanted
    # Items in many blocks, documents in many steps, terms in many pieces.
    monkeypatch.setattr(reversed_search, "CELLS", 16)
    assert by_rank(search_items(odd, items, k=3, block_bytes=40), *RANKED) == wanted


def test_ranks_of_documents(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = [(row["doc_id"], row["text"]) for row in documents.collect()]
    wanted = expected_ranks(rows, [tuple(row) for row in items.select("item_id", "text").collect()])
    assert by_rank(search_items(documents.repartition(5), items), *RANKED) == wanted


def test_ties_go_by_id(spark):
    rows = [(doc, "the same text of ties" if doc % 3 else "another text") for doc in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([("a", "same ties"), ("b", "another")], "name string, words string")
    found = search_items(df, items, item_col="name", item_text_col="words")
    assert by_rank(found, "item_id", "rank", "doc_id", "score") == expected_ranks(rows, [("a", "same ties"), ("b", "another")])


def test_large_sums_stay_exact():
    index = reversed_search.Index([0], [b"a " * 1_000_000]).weighted({0: 1}, 10**6, 10**7)
    block = reversed_search.split([b"a " * 1000])
    m = 25 + (75 * 1000 * 10**6) // 10**7
    assert index.scores(block)[0, 0] == 10**6 * int(index.weights[0]) * ((10**9 * 1000) // (1000 * 1000 + 8 * m))


def test_search_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search_items(none, items).collect() == []
    assert search_items(odd, items.filter(F.lit(False))).collect() == []
    assert search_items(odd.withColumn("text", F.lit("")), items).collect() == []


# Vectors.


def usable(vec, size):
    return vec is not None and len(vec) == size and all(x is not None and math.isfinite(x) for x in vec)


def expected_nearest(rows, every, k):
    size = Counter(len(vec) for _, vec in rows if vec and usable(vec, len(vec))).most_common(1)[0][0]
    rows = [(at, vec) for at, vec in rows if at is not None and usable(vec, size) and any(vec)]
    matrix = np.array([vec for _, vec in rows], np.float64)
    out = {}
    for at in {at for at, _ in rows if at % every == 0}:
        asked = min(vec for own, vec in rows if own == at)
        scores = (np.array(asked, np.float64) * matrix).sum(axis=1)
        found = sorted((-score, own) for score, (own, _) in zip(scores.tolist(), rows, strict=True) if own != at)
        out[at] = [(own, -score) for score, own in found[:k]]
    return out


def ranked_nearest(df):
    out = {}
    for row in df.orderBy("query_id", "rank").collect():
        out.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return out


def recall(found, wanted):
    assert set(found) == {at for at, near in wanted.items() if near}
    return sum(len(set(found[at]) & set(near)) for at, near in wanted.items() if near) / sum(map(len, wanted.values()))


VECTORS = "vec_id long, embedding array<float>, score string, cell string, label int"


def vector_rows(count=900, size=12, seed=3):
    """Clusters, copies, unequal lengths, and what takes no part."""
    chance = np.random.default_rng(seed)
    centres = chance.standard_normal((6, size)) * 3
    matrix = (centres[chance.integers(0, 6, count)] + chance.standard_normal((count, size))).astype(np.float32)
    matrix[count // 2 : count // 2 + 150] = matrix[7]
    rows = [(at, [float(x) for x in vec]) for at, vec in enumerate(matrix)]
    rows[1] = (1, None)
    rows[20] = (20, [0.0] * size)
    rows[21] = (21, [float("nan")] + [1.0] * (size - 1))
    rows[40] = (40, [float("inf")] + [1.0] * (size - 1))
    rows[41] = (41, [None] + [1.0] * (size - 1))
    rows[42] = (42, [])
    rows[43] = (43, [1.0, 2.0])
    rows[60] = (None, rows[60][1])
    return [*rows, rows[80], rows[81], (100, rows[5][1])]


def test_chi_square():
    assert abs(projected_search.chi_square(15.507313, 8) - 0.95) < 1e-6
    assert abs(projected_search.chi_square_point(0.9, 2) - -2 * math.log(0.1)) < 1e-9


def test_trees_hold_each_row_once():
    chance = np.random.default_rng(1)
    for points in (chance.standard_normal((1000, 4)), np.zeros((300, 4)), np.zeros((1, 4))):
        order, starts = projected_search.tree_order(points, 16)
        assert sorted(order.tolist()) == list(range(len(points)))
        assert np.diff([*starts, len(points)]).max() <= 16
    space = projected_search.Space(3, 1.0, 4, 0.9, 1).cut(chance.standard_normal((500, 4)), 8)
    cells = space.cells(points := chance.standard_normal((200, 4)))
    assert len(space.low) == 8 and (projected_search.to_boxes(points, space.low, space.high)[np.arange(200), cells] == 0).all()


def test_nearest_of_odd_vectors(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(at, vec, "?", "?", 1) for at, vec in rows], VECTORS).repartition(5)
    wanted = expected_nearest(rows, 20, 20)
    asks = F.col("vec_id") % 20 == 0
    # With all confidence the search is exact, scores included, however the rows are cut up.
    sure = {"confidence": 1 - 1e-15, "chunk_rows": 64}
    assert ranked_nearest(projected_search.nearest_rows(df, asks, **sure)) == wanted
    some = ranked_nearest(projected_search.nearest_rows(df, asks, chunk_rows=100, confidence=0.9))
    assert recall(some, wanted) >= 0.9
    assert all(len(near) == 20 for near in some.values())


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "", "", 1), (20, [3.0, 1.0], "", "", 1), (21, [3.0, 1.0], "", "", 1)], VECTORS)
    asks = F.col("vec_id") % 20 == 0
    assert ranked_nearest(projected_search.nearest_rows(df, asks)) == {0: [(20, 5.0), (21, 5.0)], 20: [(21, 10.0), (0, 5.0)]}
    assert projected_search.nearest_rows(df.limit(0), asks).collect() == []
    assert projected_search.nearest_rows(df.filter("vec_id = 0"), asks).collect() == []


def test_nearest_of_the_table(spark, small):
    rows = [(row["vec_id"], row["embedding"]) for row in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert recall(ranked_nearest(LLM.queries["op12_nearest_vectors"](spark, small)), expected_nearest(rows, 20, 20)) >= 0.9


# Hard negatives.


def expected_negatives(rows, every, scale=256, low=80):
    size = Counter(len(vec) for _, label, vec in rows if label is not None and vec and usable(vec, len(vec))).most_common(1)[0][0]
    rows = [(at, str(label), [math.floor(scale * x) for x in vec]) for at, label, vec in rows if at is not None and label is not None and usable(vec, size)]
    out = []
    for at in {at for at, *_ in rows if at % every == 0}:
        vec, label = min((vec, label) for own, label, vec in rows if own == at)
        scored = sorted((-sum(map(int.__mul__, vec, other)), own, other_label) for own, other_label, other in rows if own != at)
        for positive in [row for row in scored if row[2] == label][:5]:
            score = -positive[0]
            near = [row for row in scored if row[2] != label and low * score <= -100 * row[0] <= 100 * score]
            out += [(at, positive[1], nth + 1, own, score, -other) for nth, (other, own, _) in enumerate(near[:5])]
    return sorted(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_negatives_of_odd_vectors(spark):
    rows = [(at, None if at == 50 else (at or 0) % 4, vec) for at, vec in vector_rows(700, 10, 9)]
    df = spark.createDataFrame([(at, vec, "?", "?", label) for at, label, vec in rows], VECTORS).repartition(5)
    wanted = expected_negatives(rows, 10)
    assert len(wanted) > 300
    asks = F.col("vec_id") % 10 == 0
    assert sorted(map(tuple, hard_negatives(df, asks).select(*NEGATIVES).collect())) == wanted
    assert sorted(map(tuple, hard_negatives(df, asks, chunk_rows=32, count_directions=3).select(*NEGATIVES).collect())) == wanted


def test_negatives_of_labels_as_text(spark):
    rows = [(0, "a", [1.0, 0.5]), (1, "a", [1.0, 0.25]), (2, "b", [0.9, 0.5]), (3, "b", [1.0, 0.25]), (4, "c", [-1.0, 0.0]), (100, "c", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "name long, kind string, numbers array<double>")
    found = hard_negatives(df, F.col("name") % 100 == 0, "name", "kind", "numbers").select(*NEGATIVES).collect()
    assert sorted(map(tuple, found)) == expected_negatives(rows, 100)
    assert hard_negatives(df.limit(0), F.lit(True), "name", "kind", "numbers").collect() == []
    assert hard_negatives(df.filter("kind = 'c'"), F.lit(True), "name", "kind", "numbers").collect() == []


def test_large_components_are_exact_or_left_out(spark):
    rows = [(at, at % 2, [float(x) for x in vec]) for at, vec in enumerate(np.random.default_rng(5).integers(-100_000, 100_000, (60, 6)))]
    rows.append((60, 1, [1e30] * 6))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = hard_negatives(df, F.col("vec_id") % 10 == 0).select(*NEGATIVES).collect()
    assert sorted(map(tuple, found)) == expected_negatives(rows[:60], 10)


def test_bounds_hold_and_prune():
    chance = np.random.default_rng(2)
    axes = hard_negatives_module.directions(chance.integers(-50, 50, (40, 6)).astype(float), 5)

    def side(rows):
        angles = hard_negatives_module.angles_to(rows, axes)
        lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (rows, angles)]
        names = ["id", "label", "vec", "angles"]
        return hard_negatives_module.Side(pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(["x"] * len(rows)), *lists], names), 6)

    rows = np.vstack([chance.integers(-50, 50, (80, 6)), np.outer(range(20), axes[0] * 40).round()]).astype(float)
    low, high = hard_negatives_module.score_bounds(side(rows), side(rows))
    exact = rows @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low)[-5:, -5:].max() < 0.2 * exact[-5:, -5:].max()
