"""The model's steps give the same bits as plain ones over whole batches, and the words dealt the same counts."""

import types
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemill.llm import lm_scores, maxent
from tidemill.llm.maxent import BATCH, CLASSES, EDGE, RATE, SLOTS, MaxEnt
from tidemill.llm.wordstream import Block, from_planes, mix


def started(chance):
    top = [(int(key) & ~(SLOTS - 1), 50 - n) for n, key in enumerate(chance.integers(1, 1 << 62, 40))]
    rare = chance.integers(0, 30, SLOTS)
    return MaxEnt.start(top, rare, np.minimum(rare, 9), 12)


def log_softmax(table, rows):
    total = table[rows[0]]
    for row in rows[1:]:
        total += table[row]
    total -= total.max(axis=1, keepdims=True)
    return total - np.log(np.exp(total).sum(axis=1, keepdims=True))


def plain_steps(model, tokens, one, two, seen):
    for at in range(0, len(tokens), BATCH):
        part = slice(at, at + BATCH)
        classes, slots = tokens[part] // SLOTS, tokens[part] % SLOTS
        rows = model._rows(model.features(one[part], two[part]), classes)
        for table, row, wanted, squares in ((model.by_class, rows[0], classes, seen[0]), (model.by_slot, rows[1], slots, seen[1])):
            slope = np.exp(log_softmax(table, row))
            slope[np.arange(len(wanted)), wanted] -= 1
            for feature in row[1:]:
                order = np.argsort(feature, kind="stable")
                touched, first = np.unique(feature[order], return_index=True)
                step = np.add.reduceat(slope[order], first, axis=0)
                squares[touched] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                table[touched] -= RATE * step / np.sqrt(squares[touched] + 1.0)[:, None]


def unseen(model):
    return np.zeros(len(model.by_class), np.float32), np.zeros(len(model.by_slot), np.float32)


def test_steps_add_up_only_what_comes_often(monkeypatch):
    chance = np.random.default_rng(8)
    added = []

    def reduceat(values, *rest, **more):
        added.append(len(values))
        return np.add.reduceat(values, *rest, **more)

    class Counting(types.SimpleNamespace):
        def __getattr__(self, name):
            return getattr(np, name)

    # Frequent and rare tokens before, so that features come once, twice and often.
    size = 3 * BATCH + 77
    tokens, one, two = chance.integers(0, EDGE, size), np.minimum(chance.zipf(1.2, size), EDGE), np.minimum(chance.zipf(1.1, size), EDGE)
    model, plain = started(np.random.default_rng(3)), started(np.random.default_rng(3))
    own, other = unseen(model), unseen(plain)
    monkeypatch.setattr(maxent, "np", Counting(add=types.SimpleNamespace(reduceat=reduceat)))
    for _ in range(2):
        model.learn(tokens, one, two, own)
    monkeypatch.undo()
    for _ in range(2):
        plain_steps(plain, tokens, one, two, other)
    assert (model.by_class == plain.by_class).all() and (model.by_slot == plain.by_slot).all()
    assert all((a == b).all() for a, b in zip(own, other, strict=True))
    # Two passes of six sums a token, had all of them been added up so.
    assert sum(added) < 0.7 * 12 * size
    rows = model._rows(model.features(one[:BATCH], two[:BATCH]), tokens[:BATCH] // SLOTS)
    each = np.arange(BATCH)
    wanted = log_softmax(model.by_class, rows[0])[each, tokens[:BATCH] // SLOTS]
    wanted = wanted + log_softmax(model.by_slot, rows[1])[each, tokens[:BATCH] % SLOTS]
    assert (model.score(tokens[:BATCH], one[:BATCH], two[:BATCH]) == wanted).all()
    assert model.by_class.shape[1] == CLASSES


def test_words_dealt_once_with_their_counts(monkeypatch):
    texts = ["B a b é x1 漢a", None, "", "a A zé", "c\tb  a"]
    learn = [True, True, False, False, True]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array(learn)], ["doc_id", "text", "learn"])
    mixed = []
    monkeypatch.setattr(lm_scores, "mix", lambda values: mixed.append(len(values)) or mix(values))
    (sent,) = lm_scores._send(3)(7, batch)
    keys = np.concatenate([from_planes(data.as_py(), 8) for data in sent.column("keys")])
    counts = np.concatenate([from_planes(data.as_py(), 4) for data in sent.column("counts")])
    words = Block([(text or "").encode() for text in texts], lower=True)
    every = lm_scores.word_keys(words)
    wanted = Counter(dict.fromkeys(every.tolist(), 0))
    wanted.update(key for key, owner in zip(every.tolist(), words.owner.tolist(), strict=True) if learn[owner])
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == wanted and len(keys) == len(wanted)
    for bucket, data in zip(sent.column("bucket").to_pylist(), sent.column("keys"), strict=True):
        own = from_planes(data.as_py(), 8)
        assert (np.diff(own.astype(object)) > 0).all() and (mix(own) % np.uint64(3) == bucket).all()
    assert sent.column("bucket").to_pylist() == sorted(sent.column("bucket").to_pylist())
    # Buckets are worked out for distinct words alone.
    assert mixed == [len(keys)]


def test_shape_of_a_word_is_its_last_letter_beyond_ascii():
    words = Block([t.encode() for t in ("abc éa bé", "x", "a漢b é")])
    shapes = (lm_scores.word_keys(words) & np.uint64(SLOTS - 1)).tolist()
    wanted = []
    for word in "abc éa bé x a漢b é".split():
        wide = [byte for byte in word.encode() if byte > 127]
        wanted.append(16 + wide[-1] % 16 if wide else word.encode()[-1] % 16)
    assert shapes == wanted
