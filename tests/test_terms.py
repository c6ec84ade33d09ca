"""The automaton over many terms against plain substring tests."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.functions import terms as terms_module
from tidemill.functions.terms import Automaton
from tidemill.operators import rules


def plain(terms, texts):
    return [[terms.index(term) for term in dict.fromkeys(terms) if term in (text or "")] for text in texts]


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("size", [1, 7, 256])
def test_terms_are_all_found(seed, size, monkeypatch):
    monkeypatch.setattr(terms_module, "PIECE", size)
    monkeypatch.setattr(terms_module, "SLICE", 64 if seed % 2 else 4 << 20)
    chance = random.Random(seed)
    letters = ["a", "b", "\u010d", "\U0001f600", " "]
    terms = ["".join(chance.choices(letters, k=chance.randrange(1, 6))) for _ in range(chance.randrange(1, 40))]
    texts = ["".join(chance.choices(letters + ["x"], k=chance.choice((0, 1, 5, 300)))) for _ in range(30)] + [None]
    automaton = Automaton(terms)
    found = automaton.terms_of(pa.array(texts, pa.string()))
    assert [sorted(row) for row in found.to_pylist()] == [sorted(row) for row in plain(terms, texts)]
    # A part of a longer array, as Arrow hands on slices.
    assert automaton.terms_of(pa.array(texts, pa.string()).slice(3, 9)).to_pylist() == found.to_pylist()[3:12]


def test_nothing_to_find():
    assert Automaton([]).terms_of(pa.array(["a", None, ""])).to_pylist() == [[], [], []]
    assert Automaton(["a"]).terms_of(pa.array([], pa.string())).to_pylist() == []
    assert Automaton(["a"]).terms_of(pa.array([None, None], pa.string())).to_pylist() == [[], []]
    with pytest.raises(ValueError, match="empty term"):
        Automaton(["a", ""])


def test_steps_do_not_grow_with_the_terms():
    text = pa.array(["some words of a text " * 200])
    few, many = Automaton(["words"]), Automaton(["words", *(f"{n:06d}x" for n in range(20_000))])
    assert many.table.shape[0] > 10_000 and many.longest == 7
    assert few.terms_of(text).to_pylist() == many.terms_of(text).to_pylist() == [[0]]


def test_rules_agree_with_the_case(spark):
    chance = random.Random(4)
    parts = [term for rule in rules.MAIL_RULES for part in (*rule.require, *rule.exclude) for term in part.terms] + ["x", "y"]

    def text(most):
        return None if chance.random() < 0.1 else " ".join(chance.choice(parts).upper() for _ in range(chance.randrange(most)))

    rows = [(str(n), text(2), text(3), text(5), chance.choice(["", "l", None]), "") for n in range(4000)]
    df = spark.createDataFrame(rows, "id string, sender string, subject string, body string, list_unsubscribe string, list_id string")
    names = ["id", "category", "reason", "rule_id"]
    wanted = sorted(map(tuple, rules.classify(df).select(*names).collect()))
    assert sorted(map(tuple, rules.classify_by_vocabulary(df).select(*names).collect())) == wanted
    assert len({row[3] for row in wanted}) == 9


def test_case_is_folded(spark):
    df = spark.createDataFrame([("NOV\u00c1 Zpr\u00e1va",), (None,)], "text string")
    found = rules.find_terms(df, ["nov\u00e1", "ZPR", "nothing", "nov\u00e1"], ["text"])
    assert [row["found_text"] for row in found.orderBy(F.col("text").isNull()).collect()] == [[0, 1], []]
