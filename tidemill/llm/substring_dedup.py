"""Exact substring deduplication by fixed-block anchors.

Every text is cut into blocks of words that do not overlap; their hashes are the index. A run of
``window`` words in another text holds a whole block of ``(window + 1) // 2`` words, wherever it
starts, so probing the index with every rolling window of that size finds all of it. Hits are then
extended: only the runs of ``window`` words around a hit are compared, over the whole corpus, and
the repeats that touch or overlap grow together to maximal ones. Comparison is by the least id
that has a run, never by pairs of texts, so copies by the thousand cost no more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.chunks import bucket_count, dealt, each_chunk, stored_chunks, with_answers
from tidemill.llm.wordstream import Block, as_bytes, from_planes, groups_of, is_in, to_planes, window_hashes

KEY_BITS = 40
SALT = 0x2545F4914F6CDD1D
# Ids are sent with the sign bit turned, so that they compare as unsigned numbers.
SIGN = np.uint64(1 << 63)


def _anchor_keys(words: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """Bucket and key of each rolling window, in one number."""
    hashes = window_hashes(words, size)
    low = hashes & np.uint64((1 << KEY_BITS) - 1)
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(KEY_BITS)) | low


class _Rows:
    """The words of a chunk, and the ids of its rows."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column(0).cast(pa.int64())
        self.ids = ids
        self.known = np.asarray(ids.is_valid())
        self.order = np.asarray(ids.fill_null(0)).view(np.uint64) ^ SIGN
        self.block = Block(as_bytes(batch, "text"))
        self.words = self.block.hashes()

    def usable(self, size: int) -> np.ndarray:
        """Windows inside one text that has an id."""
        inside = self.block.inside(size)
        return inside & self.known[self.block.owner[: len(inside)]]


def _probe(size: int, buckets: int):
    def probe(chunk: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = _Rows(batch)
        at = np.flatnonzero(rows.usable(size))
        if not len(at):
            return
        owner = rows.block.owner[at].astype(np.int64)
        anchor = (at - rows.block.first[owner]) % size == 0
        keys = _anchor_keys(rows.words, size, buckets)[at]
        order = np.argsort(keys)
        keys, owner, anchor = keys[order], owner[order], anchor[order]
        first = groups_of(keys)
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        flags = np.maximum.reduceat(anchor, first) * np.uint64(2) + several
        keys = keys[first]
        low = (keys & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(2) | flags.astype(np.uint64)
        yield dealt(keys >> np.uint64(KEY_BITS), chunk, {"keys": (low, 6)})

    return probe


def _live(table: pa.Table) -> pa.Table:
    """Keys that are an anchor somewhere and occur in two texts, for each chunk that has them."""
    packed = [from_planes(keys.as_py(), 6) for keys in table.column("keys")]
    lengths = np.array([len(keys) for keys in packed])
    values = np.concatenate(packed)
    keys = values >> np.uint64(2)
    order = np.argsort(keys)
    first = groups_of(keys[order])
    flags = values[order]
    anchor = np.maximum.reduceat(flags >> np.uint64(1) & np.uint64(1), first) > 0
    several = np.maximum.reduceat(flags & np.uint64(1), first) > 0
    sizes = np.diff(np.append(first, len(keys)))
    live = np.zeros(len(keys), bool)
    live[order] = np.repeat(anchor & (several | (sizes > 1)), sizes)
    ends = np.cumsum(lengths)
    found = [to_planes(keys[a:b][live[a:b]], 5) for a, b in zip(ends - lengths, ends, strict=True)]
    chosen = [row for row, data in enumerate(found) if data]
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(chosen, pa.int64())),
            "bucket": table.column("bucket").take(pa.array(chosen, pa.int64())),
            "keys": pa.array([found[row] for row in chosen], pa.binary()),
        }
    )


def _extend(window: int, size: int, buckets: int):
    def extend(batch: pa.RecordBatch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        if not answers.num_rows:
            return
        rows = _Rows(batch)
        live = np.sort(
            np.concatenate(
                [
                    from_planes(keys.as_py(), 5) | np.uint64(bucket.as_py() << KEY_BITS)
                    for bucket, keys in zip(answers.column("bucket"), answers.column("keys"), strict=True)
                ]
            )
        )
        hit = np.concatenate(([0], np.cumsum(is_in(_anchor_keys(rows.words, size, buckets), live) & rows.usable(size))))
        usable = rows.usable(window)
        around = np.arange(len(usable))
        at = np.flatnonzero(usable & (hit[around + window - size + 1] > hit[around]))
        if not len(at):
            return
        keys = window_hashes(rows.words, window)[at]
        bucket = window_hashes(rows.words, window, SALT)[at] % np.uint64(buckets)
        ids = rows.order[rows.block.owner[at]]
        order = np.lexsort((keys, bucket))
        keys, bucket, ids = keys[order], bucket[order], ids[order]
        first = np.union1d(groups_of(keys), groups_of(bucket))
        least = np.minimum.reduceat(ids, first) - SIGN
        chunk = answers.column("chunk")[0].as_py()
        yield dealt(bucket[first], chunk, {"keys": (keys[first], 8), "ids": (least, 8)})

    return extend


def _earlier(table: pa.Table) -> pa.Table:
    """For each chunk the keys that a smaller id has than any in the chunk."""
    packed = [from_planes(keys.as_py(), 8) for keys in table.column("keys")]
    lengths = np.array([len(keys) for keys in packed])
    keys = np.concatenate(packed)
    ids = np.concatenate([from_planes(data.as_py(), 8) for data in table.column("ids")]) ^ SIGN
    order = np.argsort(keys)
    first = groups_of(keys[order])
    least = np.empty(len(keys), np.uint64)
    least[order] = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.append(first, len(keys))))
    late = least < ids
    ends = np.cumsum(lengths)
    found = [to_planes(keys[a:b][late[a:b]], 8) for a, b in zip(ends - lengths, ends, strict=True)]
    chosen = [row for row, data in enumerate(found) if data]
    return pa.table(
        {"chunk": table.column("chunk").take(pa.array(chosen, pa.int64())), "keys": pa.array([found[row] for row in chosen], pa.binary())}
    )


def _remove(window: int):
    def remove(batch: pa.RecordBatch, answers: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _Rows(batch)
        block = rows.block
        at = np.flatnonzero(rows.usable(window))
        keys = window_hashes(rows.words, window)[at]
        ids = rows.order[block.owner[at]]
        known = [from_planes(data.as_py(), 8) for data in answers.column("keys")]
        late = is_in(keys, np.sort(np.concatenate(known))) if known else np.zeros(len(at), bool)
        if len(at):
            # Repeats within the chunk.
            order = np.argsort(keys)
            first = groups_of(keys[order])
            least = np.minimum.reduceat(ids[order], first)
            late[order] |= ids[order] > np.repeat(least, np.diff(np.append(first, len(keys))))
        gone = block.cover(at[late], window)
        begins = gone & ~np.concatenate(([False], gone[:-1]))
        begins[block.first[:-1][block.counts > 0]] |= gone[block.first[:-1][block.counts > 0]]
        ends = gone & ~np.concatenate((gone[1:], [False]))
        ends[block.first[1:][block.counts > 0] - 1] |= gone[block.first[1:][block.counts > 0] - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends)
        shift = block.first[block.owner[a]]
        offsets = np.searchsorted(a, block.first).astype(np.int32)
        spans = pa.ListArray.from_arrays(
            pa.array(offsets),
            pa.StructArray.from_arrays([pa.array(a - shift), pa.array(b - shift + 1)], ["start", "stop"]),
        )
        yield pa.RecordBatch.from_arrays(
            [
                rows.ids,
                pa.array(block.counts.astype(np.int64)),
                pa.array(block.per_text(gone).astype(np.int64)),
                pa.array([text.decode() for text in block.kept_texts(~gone)], pa.string()),
                spans,
            ],
            ["doc_id", "n_words", "n_removed", "kept", "removed"],
        )

    return remove


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words joined by a space) and ``removed`` for each row.

    A word is removed where a run of ``window`` words around it also starts in a row with a smaller id
    (a whole number); ``removed`` holds the maximal spans [start, stop) of such words. Runs are judged on
    the input. Words are what ASCII white space leaves. NULL or empty texts have no words and give an
    empty ``kept``; rows with NULL id lose nothing and take nothing. Rows that share an id do not take
    from each other. Other columns are left out, whatever their names.

    Texts are stored once in compressed chunks and shuffled twice in that form; blocks and rolling windows
    travel at about five bytes each, extended windows at about ten, and no task or driver gathers a group.
    """
    size = (window + 1) // 2
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = stored_chunks(source)
    buckets = bucket_count(chunks)
    probes = each_chunk(chunks, _probe(size, buckets), "bucket bigint, chunk bigint, keys binary")
    live = probes.groupBy("bucket").applyInArrow(_live, "chunk bigint, bucket bigint, keys binary")
    around = with_answers(
        chunks, live, _extend(window, size, buckets), "bucket bigint, chunk bigint, keys binary, ids binary",
        pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())]),
    )
    earlier = around.groupBy("bucket").applyInArrow(_earlier, "chunk bigint, keys binary")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:bigint,stop:bigint>>"
    return with_answers(chunks, earlier, _remove(window), schema)
