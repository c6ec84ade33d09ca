"""A quality classifier from weak labels.

Simple labellers vote good, bad or not at all on every text. Expectation-maximisation over the counts
of vote patterns estimates how often each labeller is right, without any gold label, and gives each
pattern a posterior. The posteriors of a bounded sample of texts train a linear scorer over hashed
features (character shapes, and bins of repetition), which then judges every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.wordstream import Block, as_bytes, groups_of, mix, sized, window_hashes

GOOD, BAD, NONE = 0, 1, 2
# Fixed values of the labellers: the measure, what is good up to here, what is bad from here.
LABELLERS = (
    ("marked_words", 0.02, 0.10),
    ("upper", 0.15, 0.35),
    ("not_letters", 0.25, 0.36),
    ("same_as_last", 0.03, 0.15),
    ("repeated_words", 0.15, 0.40),
    ("exclaimed", 0.02, 0.10),
    ("few_different", 0.55, 0.75),
    ("odd_length", 0.50, 1.00),
    ("words_of_marks", 0.02, 0.10),
)
_LEAST_WORDS = 12
# Repeats say little about a text that a heading fills by half.
_LEAST_TO_REPEAT = 64
_MARKS = b"#*$%&|<>{}[]=~^\\_"
_IS_MARK = bytes(byte in _MARKS for byte in range(256))

SHAPES = 40
GRAM = 4
FEATURES = 1 << 14
BINS = 8
SAMPLE = 4_000
THRESHOLD = 0.5


def measures(texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of values for each text, in the order of the labellers, and the number of words."""
    block = Block(texts)
    data, words = block.data, block.counts
    many = np.maximum(words, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[block.offsets[1:]] - sums[block.offsets[:-1]] if len(texts) else sums[:0]

    marks = np.concatenate(([0], np.cumsum(np.frombuffer(block.bytes.translate(_IS_MARK), np.uint8))))
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data > 127)
    solid = np.concatenate(([0], np.cumsum(letters | ((data >= 48) & (data <= 57)))))
    hashes = block.hashes()
    again = np.zeros(len(block), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (block.owner[1:] == block.owner[:-1])
    salt = block.owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(block.inside(8))
    keys = mix(window_hashes(hashes, 8)[at] + salt[at])
    order = np.argsort(keys)
    twice = np.zeros(len(at), bool)
    if len(at):
        sizes = np.diff(np.append(groups_of(keys[order]), len(keys)))
        twice[order] = np.repeat(sizes > 1, sizes)
    # Different words in stretches of 32, as long texts repeat more words than short ones.
    stretch = ((np.arange(len(block)) - block.first[block.owner]) // 32).astype(np.uint64)
    seen = mix(hashes + salt + stretch * np.uint64(0xD1342543DE82EF95))
    place = np.argsort(seen)
    new = np.zeros(len(block), bool)
    new[place[groups_of(seen[place])]] = True
    size = np.maximum(per_text(~block.gap), 1)
    mean = per_text((~block.gap) & ((data & 0xC0) != 0x80)) / many
    exclaimed = data[block.ends - 1] == ord("!") if len(block) else np.zeros(0, bool)
    return np.stack(
        [
            block.per_text(marks[block.ends] > marks[block.starts]) / many,
            per_text(upper) / np.maximum(per_text(letters), 1),
            1 - per_text(letters) / size,
            block.per_text(again) / many,
            block.per_text(block.cover(at[twice], 8)) / many,
            block.per_text(exclaimed) / many,
            1 - block.per_text(new) / many,
            np.abs(mean - 6) / 5,
            block.per_text(solid[block.ends] == solid[block.starts]) / many,
        ],
        axis=1,
    ), words


def votes(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Patterns of votes as numbers to base 3; a text of few words is judged by its characters alone."""
    pattern = np.zeros(len(values), np.int64)
    for number, (name, good, bad) in enumerate(LABELLERS):
        vote = np.where(values[:, number] <= good, GOOD, np.where(values[:, number] >= bad, BAD, NONE))
        silent = words == 0
        if name not in ("upper", "not_letters", "odd_length"):
            silent = words < (_LEAST_TO_REPEAT if name == "repeated_words" else _LEAST_WORDS)
        pattern = pattern * 3 + np.where(silent, NONE, vote)
    return pattern


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Probability that a text with each pattern is bad; and for each class, labeller and vote its probability."""
    size = len(LABELLERS)
    vote = np.stack([patterns // 3 ** (size - 1 - number) % 3 for number in range(size)], axis=1)
    spoken = np.maximum((vote != NONE).sum(axis=1), 1)
    # To start with, labellers are right more often than not and one vote of badness in four is telling.
    share = np.clip(((vote == BAD).sum(axis=1) / spoken) * 4, 0.05, 0.95)
    table = np.zeros((2, size, 3))
    for _ in range(rounds):
        prior = np.clip((share * counts).sum() / counts.sum(), 0.001, 0.6)
        for bad, weight in ((GOOD, (1 - share) * counts), (BAD, share * counts)):
            # Labellers are built to be specific and each to see some of what is bad: that weighs as much as a
            # fixed number of votes, so the counts of a larger table outweigh it.
            belief = (ACCIDENTS if bad == GOOD else SIGHT) * BELIEF
            for number in range(size):
                table[bad, number] = np.bincount(vote[:, number], weight, 3) + 1.0 + belief
        table /= table.sum(axis=2, keepdims=True)
        # A vote that is not cast says nothing.
        heard = np.where(vote == NONE, 0.0, np.log(table[1, np.arange(size), vote]) - np.log(table[0, np.arange(size), vote]))
        share = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + heard.sum(axis=1), -30, 30)))
    return share, table


@cache
def shape_table() -> np.ndarray:
    """Class of each byte: upper, lower, digit, white space, a byte beyond ASCII, or one for each ASCII mark."""
    table = np.zeros(256, np.int64)
    marks = [byte for byte in range(33, 127) if not chr(byte).isalnum()]
    table[marks] = 5 + np.arange(len(marks))
    table[65:91], table[97:123], table[48:58] = 1, 2, 3
    table[[0x20, *range(0x09, 0x0E)]] = 4
    table[128:] = 2
    return table


@cache
def feature_table() -> np.ndarray:
    """Hashed feature of each run of four shapes."""
    return (mix(np.arange(SHAPES**GRAM, dtype=np.uint64)) % np.uint64(FEATURES)).astype(np.int32)


def shape_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The feature of the run of shapes that ends at each byte, and the text of each byte."""
    shapes = np.minimum(shape_table()[block.data], SHAPES - 1).astype(np.int32)
    owner = np.repeat(np.arange(len(block.counts), dtype=np.int32), np.diff(block.offsets))
    codes = shapes.copy()
    for back in range(1, GRAM):
        # White space comes before each text, whatever lies there in the block.
        before = np.full_like(shapes, shape_table()[0x20])
        before[back:] = np.where(owner[back:] == owner[:-back], shapes[:-back], before[back:])
        codes += before * SHAPES**back
    return feature_table()[codes], owner


def bin_features(values: np.ndarray) -> np.ndarray:
    """Hashed features of the measures, each in one of a few bins."""
    bins = np.clip((values * BINS).astype(np.int64), 0, BINS - 1)
    names = np.arange(values.shape[1]) * BINS + bins + SHAPES**GRAM
    return (mix(names.astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64)


BIN_WEIGHT = 0.25
# Prior shares of votes (good, bad, none) for good and for bad texts.
ACCIDENTS = np.array([0.968, 0.002, 0.03])
SIGHT = np.array([0.65, 0.3, 0.05])
# Votes that a prior share counts as, for each labeller and class, whatever the table's size.
BELIEF = 400


def _patterns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in sized(batches, "text"):
        values, words = measures(as_bytes(batch, "text"))
        total += np.bincount(votes(values, words), minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "often"])


def _sampled(chances: dict[int, float]):
    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            texts = as_bytes(batch, "text")
            values, words = measures(texts)
            grams, owner = shape_features(Block(texts))
            extra = bin_features(values)
            target = [chances[p] for p in votes(values, words).tolist()]
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            names, shares = [], []
            for number in range(len(texts)):
                found, often = np.unique(grams[edges[number] : edges[number + 1]], return_counts=True)
                names.append(np.concatenate((found, extra[number])).astype(np.int32).tolist())
                shares.append(np.concatenate((often / often.sum(), np.full(extra.shape[1], BIN_WEIGHT))).astype(np.float32).tolist())
            keep = [number for number in range(len(texts)) if words[number]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] * len(keep), pa.int32()),
                    pa.array([names[k] for k in keep], pa.list_(pa.int32())),
                    pa.array([shares[k] for k in keep], pa.list_(pa.float32())),
                    pa.array([target[k] for k in keep], pa.float64()),
                ],
                ["model", "names", "shares", "target"],
            )

    return features


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression by gradient descent with adapted steps."""
    names = np.concatenate([row[0] for row in rows])
    shares = np.concatenate([row[1] for row in rows])
    owner = np.repeat(np.arange(len(rows)), [len(row[0]) for row in rows])
    weights, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    # Both classes count alike.
    balance = np.where(target > 0.5, 0.5 / max(1.0, (target > 0.5).sum()), 0.5 / max(1.0, (target <= 0.5).sum()))
    for _ in range(rounds):
        score = np.bincount(owner, shares * weights[names], len(rows)) + weights[-1]
        slope = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) * balance
        step = np.append(np.bincount(names, shares * slope[owner], FEATURES), slope.sum())
        step[:-1] += 1e-6 * weights[:-1]
        squares += step**2
        weights -= 0.5 * step / np.sqrt(squares)
    return weights


def _fit(table: pa.Table) -> pa.Table:
    # In an order of their own, whatever task each came from.
    found = sorted(zip(table.column("target").to_pylist(), table.column("names").to_pylist(), table.column("shares").to_pylist(), strict=True))
    rows = [(np.array(names, np.int64), np.array(shares)) for _, names, shares in found]
    weights = fit(rows, np.array([target for target, *_ in found]))
    return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def _judge(weights: np.ndarray, chances: dict[int, float], threshold: float):
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            texts = as_bytes(batch, "text")
            values, words = measures(texts)
            grams, owner = shape_features(Block(texts))
            size = np.bincount(owner, minlength=len(texts))
            score = np.bincount(owner, weights[grams], len(texts)) / np.maximum(size, 1)
            score += BIN_WEIGHT * weights[bin_features(values)].sum(axis=1) + weights[-1]
            bad = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            good = np.where(words > 0, 1 - bad, 0.0)
            weak = np.array([1 - chances[p] for p in votes(values, words).tolist()])
            carried = [batch.column(k) for k in range(2, batch.num_columns)]
            names = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays(
                [*carried, batch.column(0), pa.array(np.where(words > 0, weak, 0.0)), pa.array(good), pa.array(good >= threshold)],
                [*names, "doc_id", "weak_score", "score", "kept"],
            )

    return judge


def classify_quality(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``weak_score``, ``score`` (0 to 1, higher is better) and ``kept``, after the columns to ``carry``.

    ``weak_score`` is one minus the posterior of the text's votes, ``score`` that of the linear scorer and
    ``kept`` whether it reaches ``threshold``. Votes of all texts are counted, at most 3^9 patterns; the
    scorer is fitted on about ``sample`` rows chosen by a hash of id and text, in one task, whatever the table's size
    and however its rows are dealt out; rows equal in both count once there. NULL
    texts and texts without words have score 0 and are not kept. A table without such a sample keeps
    what has words. Repeated rows are judged alike; other columns are left out unless carried.
    """
    fields = [df.schema[name] for name in carry]
    source = df.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("text"), *[F.col(name).alias(f"_{name}") for name in carry])
    counted = source.select("text").mapInArrow(_patterns, "pattern bigint, often bigint").groupBy("pattern").agg(F.sum("often").alias("often")).collect()
    patterns = np.array([row[0] for row in counted], np.int64)
    often = np.array([row[1] for row in counted], np.float64)
    share, _ = posteriors(patterns, often) if len(patterns) else (np.zeros(0), None)
    chances = dict(zip(patterns.tolist(), share.tolist(), strict=True))
    part = min(1.0, sample / max(1.0, often.sum()))
    mark = F.xxhash64(F.col("_doc_id").cast("string"), "text")
    picked = F.pmod(mark, F.lit(1 << 40)) < int(part * (1 << 40))
    rows = (
        source.filter(picked).select("text", mark.alias("mark")).dropDuplicates(["mark"]).select("text").mapInArrow(_sampled(chances), "model int, names array<int>, shares array<float>, target double")
        .groupBy("model").applyInArrow(_fit, "weights array<double>").collect()
    )
    weights = np.array(rows[0][0]) if rows else np.append(np.zeros(FEATURES), -1.0)
    types = [source.schema[f"_{name}"].dataType.simpleString() for name in carry]
    id_type = source.schema["_doc_id"].dataType.simpleString()
    schema = ", ".join([*[f"`_{name}` {kind}" for name, kind in zip(carry, types, strict=True)], f"doc_id {id_type}", "weak_score double, score double, kept boolean"])
    judged = source.mapInArrow(_judge(weights, chances, threshold), schema)
    return judged.select(*[F.col(f"`_{field.name}`").alias(field.name) for field in fields], "doc_id", "weak_score", "score", "kept")
