"""Language-model scores of texts: exact counts over the corpus and a hashed maximum-entropy model.

Counts of all words meet in buckets and go back to the chunks that hold the words; no table of
words is collected. The model has a fixed size: it is sent to the tasks, each updates it along the
gradient of its own texts, and the updates are averaged block by block in rounds until every text to learn from was
used once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.chunks import bucket_count, dealt, each_chunk, stored_chunks, unpack, with_answers
from tidemill.llm.maxent import EDGE, FREQUENT, SLOTS, MaxEnt
from tidemill.llm.store import stored
from tidemill.llm.wordstream import Block, as_bytes, from_planes, groups_of, mix, to_planes

ROUNDS = 3
# Floats in a row of an update; rows added up by one task.
PART = 1 << 16
FAN_IN = 64


def word_keys(block: Block) -> np.ndarray:
    """59 bits of a word's hash and, below, five of its shape: its last letter beyond ASCII, or else its last letter."""
    if not len(block):
        return np.zeros(0, np.uint64)
    beyond = block.data > 127
    # Where the last letter beyond ASCII up to each word's end is.
    last = np.append(np.flatnonzero(beyond), -1)[np.cumsum(beyond, dtype=np.int32)[block.ends - 1] - 1]
    wide = last >= block.starts
    shape = np.where(wide, 16 + block.data[np.maximum(last, 0)] % 16, block.data[block.ends - 1] % 16)
    return (block.hashes() & ~np.uint64(SLOTS - 1)) | shape.astype(np.uint64)


class _Tokens:
    """The tokens of a chunk: the words of each text and then its end."""

    def __init__(self, batch: pa.RecordBatch):
        self.block = Block(as_bytes(batch, "text"), lower=True)
        self.keys = word_keys(self.block)
        self.learn = np.asarray(batch.column(2).cast(pa.bool_())).astype(bool)

    def sequence(self, model: MaxEnt) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, the token before, the one before that, and the text of each."""
        counts = self.block.counts
        owner = np.repeat(np.arange(len(counts)), counts + 1)
        tokens = np.zeros(len(owner), np.int64)
        is_word = np.ones(len(owner), bool)
        is_word[np.cumsum(counts + 1) - 1] = False
        tokens[is_word] = model.tokens_of(self.keys)
        one, two = np.full(len(tokens), EDGE), np.full(len(tokens), EDGE)
        same = owner[1:] == owner[:-1]
        one[1:] = np.where(same, tokens[:-1], EDGE)
        two[1:] = np.where(same, one[:-1], EDGE)
        return tokens, one, two, owner


def _send(buckets: int):
    def send(chunk: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(batch)
        if not len(tokens.keys):
            return
        learnt = tokens.learn[tokens.block.owner].astype(np.uint64)
        order = np.argsort(tokens.keys)
        keys = tokens.keys[order]
        first = groups_of(keys)
        keys, often = keys[first], np.add.reduceat(learnt[order], first)
        # The words of a chunk are in the order of their keys; only the distinct ones are dealt.
        bucket = (mix(keys) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        yield dealt(bucket[order], chunk, {"keys": (keys[order], 8), "counts": (often[order], 4)})

    return send


def _totals(table: pa.Table) -> pa.Table:
    """Counts of a bucket's words for each chunk that has them, and a row (chunk NULL) of what the model starts from."""
    packed = [from_planes(keys.as_py(), 8) for keys in table.column("keys")]
    lengths = np.array([len(keys) for keys in packed])
    keys = np.concatenate(packed)
    counts = np.concatenate([from_planes(data.as_py(), 4) for data in table.column("counts")]).astype(np.int64)
    order = np.argsort(keys)
    first = groups_of(keys[order])
    total = np.add.reduceat(counts[order], first)
    every = np.empty(len(keys), np.int64)
    every[order] = np.repeat(total, np.diff(np.append(first, len(keys))))
    ends = np.cumsum(lengths)
    back = [to_planes(every[a:b].view(np.uint64), 6) for a, b in zip(ends - lengths, ends, strict=True)]
    names = keys[order][first]
    shape = (names & np.uint64(SLOTS - 1)).astype(np.int64)
    known = total > 0
    best = np.flatnonzero(known)
    best = best[np.lexsort((names[best], -total[best]))][:FREQUENT]
    rows = len(lengths)
    none = [None] * rows
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "keys": pa.array([*table.column("keys").to_pylist(), None], pa.binary()),
            "counts": pa.array([*back, None], pa.binary()),
            "tokens": pa.array([*none, np.bincount(shape, total, SLOTS).astype(np.int64).tolist()], pa.list_(pa.int64())),
            "words": pa.array([*none, np.bincount(shape[known], minlength=SLOTS).tolist()], pa.list_(pa.int64())),
            "top": pa.array(
                [*none, [{"key": k, "often": n} for k, n in zip(names[best].view(np.int64).tolist(), total[best].tolist(), strict=True)]],
                pa.list_(pa.struct([("key", pa.int64()), ("often", pa.int64())])),
            ),
        }
    )


def _by_shape(counted: DataFrame, name: str) -> np.ndarray:
    rows = counted.select(F.posexplode(name).alias("shape", "n")).groupBy("shape").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SLOTS, np.int64)
    for row in rows:
        out[row["shape"]] = row["n"]
    return out


def _update(sent):
    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        model = MaxEnt(start.keys, start.tokens, start.rare_tokens, start.rare_words, start.by_class.copy(), start.by_slot.copy())
        seen = (np.zeros(len(model.by_class), np.float32), np.zeros(len(model.by_slot), np.float32))
        used = 0
        for batch in batches:
            for payload in batch.column(1):
                rows = _Tokens(unpack(payload.as_py()))
                tokens, one, two, owner = rows.sequence(model)
                chosen = rows.learn[owner]
                model.learn(tokens[chosen], one[chosen], two[chosen], seen)
                used += int(chosen.sum())
        if used:
            change = np.concatenate(((model.by_class - start.by_class).ravel(), (model.by_slot - start.by_slot).ravel())) * np.float32(used)
            task = TaskContext.get().partitionId()
            for part, at in enumerate(range(0, len(change), PART)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([task]), pa.array([used]), pa.array([change[at : at + PART].tobytes()], pa.binary())],
                    ["part", "task", "used", "change"],
                )

    return update


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(data.as_py(), np.float32).astype(np.float64) for data in table.column("change"))
    used = sum(table.column("used").to_pylist())
    return pa.table(
        {
            "part": table.column("part").slice(0, 1),
            "task": table.column("task").slice(0, 1),
            "used": pa.array([used]),
            "change": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def _train(chunks: DataFrame, model: MaxEnt, rounds: int) -> MaxEnt:
    spark = chunks.sparkSession
    schema = "part bigint, task bigint, used bigint, change binary"
    for number in range(rounds):
        own = chunks.filter(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == number).select("chunk", "payload")
        sent = spark.sparkContext.broadcast(model)
        changes = own.mapInArrow(_update(sent), schema)
        tasks = own.rdd.getNumPartitions()
        while tasks > 1:
            # Parts of FAN_IN tasks are added by one task, and their sums again.
            changes = changes.withColumn("task", F.col("task").cast("long") / FAN_IN).withColumn("task", F.floor("task"))
            changes = changes.groupBy("part", "task").applyInArrow(_add, schema)
            tasks = -(-tasks // FAN_IN)
        rows = sorted(changes.collect(), key=lambda row: row["part"])
        sent.unpersist()
        if rows:
            change = np.concatenate([np.frombuffer(row["change"], np.float32) / np.float32(row["used"]) for row in rows])
            cut = model.by_class.size
            model = MaxEnt(
                model.keys, model.tokens, model.rare_tokens, model.rare_words,
                model.by_class + change[:cut].reshape(model.by_class.shape), model.by_slot + change[cut:].reshape(model.by_slot.shape),
            )
    return model


def _score(sent):
    def score(batch: pa.RecordBatch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        model, total, distinct, texts = sent.value
        rows = _Tokens(batch)
        block = rows.block
        tokens, one, two, owner = rows.sequence(model)
        counts = np.full(len(tokens), texts, np.int64)
        if len(rows.keys):
            keys = np.concatenate([from_planes(data.as_py(), 8) for data in answers.column("keys")])
            often = np.concatenate([from_planes(data.as_py(), 6) for data in answers.column("counts")]).view(np.int64)
            order = np.argsort(keys)
            is_word = np.ones(len(tokens), bool)
            is_word[np.cumsum(block.counts + 1) - 1] = False
            counts[is_word] = often[order][np.searchsorted(keys[order], rows.keys)]
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        full = (model.score(tokens, one, two) + model.rare(tokens, counts)) / np.log(10)
        size = len(block.counts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(block.counts.astype(np.int64) + 1),
                pa.array(np.bincount(owner, counts > 0, size).astype(np.int64)),
                pa.array(np.full(size, total, np.int64)),
                pa.array(np.bincount(owner, base, size)),
                pa.array(np.bincount(owner, full, size)),
            ],
            ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return score


def lm_scores(
    df: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for each row.

    Tokens are words (lower-cased in A-Z, split at ASCII white space) and one end a text; NULL and empty texts
    have the end alone. The rows where ``learn_from`` holds are counted, and learnt from. ``base_score`` is the
    log10 probability by smoothed counts (half added, one more word for what is unseen), ``score`` that of the
    model; ``n_known`` counts tokens seen in the rows learnt from. With none of those, every token is unseen.
    Repeated rows stay and count again; other columns are left out, whatever their names.

    Words are told apart by 64-bit keys. All counts are exact over all texts; keys go to their bucket once
    a chunk, so a word that every text has sends one key a chunk.
    """
    source = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn_from, F.lit(False)).alias("learn")
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    chunks = stored_chunks(source)
    texts = source.filter("learn").count()
    counted = stored(
        each_chunk(chunks, _send(bucket_count(chunks)), "bucket bigint, chunk bigint, keys binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(
            _totals,
            "chunk bigint, keys binary, counts binary, tokens array<bigint>, words array<bigint>, top array<struct<key:bigint,often:bigint>>",
        ),
        "counted",
    )
    start = counted.filter("chunk IS NULL")
    tokens, words = _by_shape(start, "tokens"), _by_shape(start, "words")
    best = start.select(F.explode("top").alias("top")).select("top.key", "top.often").orderBy(F.desc("often"), "key").limit(FREQUENT)
    top = [(row[0], row[1]) for row in best.collect()]
    total, distinct = int(tokens.sum()) + texts, int(words.sum()) + bool(texts)
    # What the frequent words leave to each shape.
    shapes = np.array([key & (SLOTS - 1) for key, _ in top], np.int64)
    often = np.array([count for _, count in top], np.int64)
    model = MaxEnt.start(
        top, tokens - np.bincount(shapes, often, SLOTS).astype(np.int64), words - np.bincount(shapes, minlength=SLOTS), texts
    )
    model = _train(chunks, model, rounds)
    sent = df.sparkSession.sparkContext.broadcast((model, total, distinct, texts))
    answers = counted.filter("chunk IS NOT NULL").select("chunk", "keys", "counts")
    schema = f"doc_id {id_type}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return with_answers(chunks, answers, _score(sent), schema)
