"""Segments of any length get their other choices, whichever way they are found."""

import random

import pytest

from tidemill.llm import sentencepiece_codec
from tidemill.llm.piece_lattice import Vocabulary
from tidemill.llm.queries import tokenizer_file
from tidemill.llm.sentencepiece_codec import Encoder, encode_pieces


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_file())


def test_long_strings_have_the_same_best_paths(vocabulary):
    chance = random.Random(3)
    strings = ["".join(chance.choice("theinxab漢é▁"[: chance.randint(2, 12)]) for _ in range(chance.randint(1, 200))) for _ in range(60)]
    best = vocabulary.best(strings)
    for at, string in enumerate(strings):
        found = vocabulary.n_best_of_long(string, 4)
        assert found == vocabulary.n_best(string, 4)
        assert best.gaps[at] == (found[0][0] - found[1][0] if len(found) > 1 else float("inf"))


def test_choices_do_not_depend_on_the_length(monkeypatch):
    texts = [text.encode() for text in ("the thing", "in" * 40, "a " + "hexe" * 30 + " then", "", "x")]
    whole = Encoder(tokenizer_file(), 3, long_choices=True).encode(texts)
    monkeypatch.setattr(sentencepiece_codec, "LONG", 8)
    cut = Encoder(tokenizer_file(), 3, long_choices=True).encode(texts)
    assert cut[3] == whole[3] and all((a == b).all() for a, b in zip(cut[:3], whole[:3], strict=True))


def test_long_stretches_have_other_choices(spark):
    df = spark.createDataFrame([(1, "in" * 1_500), (2, "x" * 20_000)], "doc_id long, text string")
    rows = encode_pieces(df, tokenizer_file(), n=3, decode=True, carry=["text"]).collect()
    assert [len(row["others"]) for row in rows] == [2, 2]
    assert all(row["decoded"] == row["text"] and row["score"] >= row["others"][0]["score"] >= row["others"][1]["score"] for row in rows)


def test_pipeline_searches_the_next_best(spark, monkeypatch):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "the next thing", "en"), (2, None, "en"), (3, "a▁b", "en")], "doc_id long, text string, lang string")
    rows = {row["doc_id"]: row["round_trip"] for row in corpus_pipeline.encoded(spark, df, "").collect()}
    assert rows == {1: True, 2: True, 3: False}
    asked = []
    encode = corpus_pipeline.encode_pieces
    monkeypatch.setattr(corpus_pipeline, "encode_pieces", lambda *a, **b: asked.append(b["n"]) or encode(*a, **b))
    corpus_pipeline.encoded(spark, df, "")
    assert asked == [corpus_pipeline.BEST] and asked[0] > 1


def test_others_decode_to_the_same():
    encoder = Encoder(tokenizer_file(), 4, long_choices=True)
    ids, _, _, others = encoder.encode([b"the next thing"])
    assert len(others[0]) == 3 and sentencepiece_codec._same_texts(encoder.vocabulary, ids, others[0])
    others[0][1]["changes"][0]["ids"] = [int(ids[0])] * 9
    assert not sentencepiece_codec._same_texts(encoder.vocabulary, ids, others[0])


def test_edges_are_not_sorted(vocabulary, monkeypatch):
    """Paths of many strings come from passes over places, without a sort of all edges."""
    chance = random.Random(11)
    strings = ["".join(chance.choice("theinxab漢é▁") for _ in range(size)) for size in [1, 40, 3, 200, 3, 17, 1]]
    wanted = [vocabulary.n_best_of_long(string, 2) for string in strings]

    def refuse(*_, **__):
        raise AssertionError("sorted")

    monkeypatch.setattr("numpy.lexsort", refuse)
    found = vocabulary.best(strings)
    for at, ways in enumerate(wanted):
        assert found.ids[found.starts[at] : found.starts[at + 1]].tolist() == list(ways[0][1]) and found.scores[at] == ways[0][0]
        assert found.gaps[at] == (ways[0][0] - ways[1][0] if len(ways) > 1 else float("inf"))


def test_known_segments_are_not_decoded_again(monkeypatch):
    encoder = Encoder(tokenizer_file(), 1)
    first = encoder.encode([b"the next thing"])[0].tolist()
    monkeypatch.setattr(sentencepiece_codec, "_named", lambda segment: 1 / 0)
    assert encoder.encode([b"the next thing"])[0].tolist() == first
