"""Token counts, piece segmentation and language-model scores against the library and brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from cases import LOWER, ODD, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm.lm_scores import lm_scores
from tidemill.llm.maxent import EDGE, SLOTS, MaxEnt
from tidemill.llm.piece_lattice import Vocabulary
from tidemill.llm.queries import tokenizer_file
from tidemill.llm.sentencepiece_codec import Encoder, decode_pieces, encode_pieces
from tidemill.llm.token_counts import SegmentCounter, token_counts

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(tokenizer_file())


def by_id(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


TEXT = st.text(alphabet=st.sampled_from(list("ab the.\n\t  ▁<s>é漢\x00　\xa0\r\U0001f600")), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_counts_are_the_librarys(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    counter = _counter()
    assert counter.counts([text.encode() for text in texts]).tolist() == [len(model.encode(text)) for text in texts]


def _counter(made=[]):  # noqa: B006
    if not made:
        made.append(SegmentCounter(tokenizer_file(), remember=200))
    return made[0]


def test_counts_of_odd_rows(odd, none, library):
    found = by_id(token_counts(odd, tokenizer_file()), "doc_id", "n_bytes", "n_tokens")
    assert found == sorted(((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in ODD), key=repr)
    assert token_counts(none, tokenizer_file()).collect() == []


def test_counts_of_documents(documents, library):
    found = by_id(token_counts(documents, tokenizer_file()), "doc_id", "n_tokens")
    assert found == sorted(((row["doc_id"], len(library.encode(row["text"]))) for row in documents.collect()), key=repr)


def every_path(vocabulary, text):
    if not text:
        return [(0.0, ())]
    out = []
    for size in range(1, min(len(text), vocabulary.longest) + 1):
        number = vocabulary.pieces.get(text[:size], -1)
        if number >= 0 or size == 1:
            score = float(vocabulary.scores[number]) if number >= 0 else vocabulary.fallback
            ids = (number,) if number >= 0 else tuple(vocabulary.bytes[list(text[0].encode())].tolist())
            out += [(score + more, ((number, ids), *rest)) for more, rest in every_path(vocabulary, text[size:])]
    return out


def ranked(vocabulary, text):
    paths = sorted(every_path(vocabulary, text), key=lambda path: (-path[0], tuple(number for number, _ in reversed(path[1]))))
    return [(score, tuple(i for _, ids in steps for i in ids)) for score, steps in paths]


def test_n_best_paths(vocabulary):
    chance = random.Random(2)
    strings = ["".join(chance.choice("▁thein漢é") for _ in range(chance.randint(1, 9))) for _ in range(150)]
    best = vocabulary.best(strings)
    for at, string in enumerate(strings):
        wanted = ranked(vocabulary, string)
        assert vocabulary.n_best(string, 5) == wanted[:5]
        assert tuple(best.ids[best.starts[at] : best.starts[at + 1]].tolist()) == wanted[0][1]
        assert best.gaps[at] == (wanted[0][0] - wanted[1][0] if len(wanted) > 1 else math.inf)


def test_long_strings_have_the_same_best_path(vocabulary):
    chance = random.Random(7)
    strings = ["".join(chance.choice("theinxab漢é▁"[: chance.randint(2, 12)]) for _ in range(chance.randint(1, 300))) for _ in range(60)]
    best = vocabulary.best(strings)
    for at, string in enumerate(strings):
        ids, score = vocabulary.best_of_long(string)
        assert ids == best.ids[best.starts[at] : best.starts[at + 1]].tolist() and score == best.scores[at]


def test_very_long_stretches(vocabulary, library):
    encoder = Encoder(tokenizer_file(), 3)
    texts = ["x" * 200_000, "a " + "漢" * 5_000 + " b", "short"]
    ids, starts, _, others = encoder.encode([text.encode() for text in texts])
    assert [library.decode(ids[a:b].tolist()) for a, b in zip(starts[:-1], starts[1:], strict=True)] == texts
    assert [len(other) for other in others][0] == 0 and len(others[2]) == 2


def apply(ids, changes):
    for change in sorted(changes, key=lambda change: -change["start"]):
        ids = ids[: change["start"]] + list(change["ids"]) + ids[change["stop"] :]
    return tuple(ids)


def test_n_best_of_texts(vocabulary):
    encoder = Encoder(tokenizer_file(), 5)
    texts = ["a the b", "in\nthe", "the the", "t e\n\nn", "he  in", "x"]
    ids, starts, scores, others = encoder.encode([text.encode() for text in texts])
    for at, text in enumerate(texts):
        wanted = ranked(vocabulary, "▁" + text.replace(" ", "▁"))
        own = ids[starts[at] : starts[at + 1]].tolist()
        assert tuple(own) == wanted[0][1]
        found = [(scores[at], tuple(own))] + [(other["score"], apply(own, other["changes"])) for other in others[at]]
        assert [score for score, _ in found] == [score for score, _ in wanted[:5]]
        every = {path: score for score, path in wanted}
        assert all(every[path] == score for score, path in found) and len({path for _, path in found}) == len(found)


def test_codec_of_odd_rows(odd, none, library):
    model = tokenizer_file()
    encoded = encode_pieces(odd, model, n=3, carry=["ids", "text"]).toDF("was", "text", "doc_id", "ids", "score", "others")
    rows = decode_pieces(encoded, model, out_col="was").collect()
    assert sorted(((row["doc_id"], row["text"]) for row in rows), key=repr) == sorted(((d, t) for d, t, _ in ODD), key=repr)
    for row in rows:
        plain = (row["text"] or "").replace("▁", " ")
        assert row["was"] == plain
        assert library.decode(row["ids"]) == plain
    empty = encode_pieces(none, model)
    assert empty.collect() == [] and decode_pieces(empty, model).collect() == []


def test_decoding_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [355])], "n int, ids array<int>")
    assert sorted((row["n"], row["decoded"] is None) for row in decode_pieces(df, tokenizer_file()).collect()) == [(1, True), (2, False), (3, False)]


def expected_base(rows, learnt):
    tokens = [(doc, words((text or "").translate(LOWER)) + [None], learn) for (doc, text, *_), learn in zip(rows, learnt, strict=True)]
    counts = Counter(token for _, split, learn in tokens for token in split if learn)
    total, distinct = sum(counts.values()), len(counts)
    return sorted(
        (
            (d, len(s), sum(counts[t] > 0 for t in s), total, sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in s))
            for d, s, _ in tokens
        ),
        key=repr,
    )


def same(found, wanted):
    assert [row[:4] for row in found] == [row[:4] for row in wanted]
    np.testing.assert_allclose([row[4] for row in found], [row[4] for row in wanted], rtol=1e-9)


def test_scores_of_odd_rows(odd, none):
    names = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
    learn = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(True))
    same(by_id(lm_scores(odd, learn), *names), expected_base(ODD, [d is None or d % 2 == 0 for d, *_ in ODD]))
    same(by_id(lm_scores(odd, F.lit(False)), *names), expected_base(ODD, [False] * len(ODD)))
    assert lm_scores(none, F.lit(True)).collect() == []


def test_model_beats_counts_on_held_out_texts(documents):
    rows = lm_scores(documents, F.col("doc_id") % 5 != 1).filter("doc_id % 5 = 1").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_model_is_a_distribution():
    chance = np.random.default_rng(3)
    top = [(int(key) & ~(SLOTS - 1), 50 - n) for n, key in enumerate(chance.integers(1, 1 << 62, 40))]
    rare = chance.integers(0, 30, SLOTS)
    model = MaxEnt.start(top, rare, np.minimum(rare, 9), 12)
    tokens = chance.integers(0, EDGE, 5000)
    one, two = np.concatenate(([EDGE], tokens[:-1])), np.concatenate(([EDGE, EDGE], tokens[:-2]))
    before = model.score(tokens, one, two).sum()
    seen = (np.zeros(len(model.by_class), np.float32), np.zeros(len(model.by_slot), np.float32))
    for _ in range(3):
        model.learn(tokens, one, two, seen)
    assert model.score(tokens, one, two).sum() > before
    every = np.arange(EDGE)
    share = np.exp(model.score(every, np.full(EDGE, 7), np.full(EDGE, 9)))
    assert abs(share.sum() - 1) < 1e-4
