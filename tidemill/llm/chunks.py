"""Texts stored in compressed chunks, and values exchanged between chunks by key.

A chunk holds whole rows, a few megabytes of text, and has a number that is stored with it. Keys
of a chunk are dealt into buckets by their own bits; a bucket sees the keys of all chunks and
answers each chunk by its number. One row carries all keys of a chunk for a bucket, sorted and
packed, so a key costs a few bytes and no row. Equal keys of a chunk are sent once: a key that
every text holds reaches its bucket once a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.store import stored
from tidemill.llm.wordstream import Block, as_bytes, groups_of, sized, to_planes

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 2 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def stored_chunks(df: DataFrame, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Store ``df`` as ``chunk``, ``n_words``, ``payload``; a text over the size is a chunk of its own."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in sized(batches, text, chunk_bytes):
            words = len(Block(as_bytes(batch, text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([words]), pa.array([pack(batch)], pa.binary())], ["chunk", "n_words", "payload"]
            )
            number += 1

    return stored(df.mapInArrow(store, "chunk bigint, n_words bigint, payload binary"), "chunks")


def bucket_count(chunks: DataFrame) -> int:
    """So many buckets that the words of one fit a task."""
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    return -(-words // BUCKET_KEYS) or 1


def each_chunk(chunks: DataFrame, work: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on the number and rows of each chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0), batch.column(1), strict=True):
                yield from work(chunk.as_py(), unpack(payload.as_py()))

    return chunks.select("chunk", "payload").mapInArrow(run, schema)


def dealt(buckets: np.ndarray, chunk: int, packed: dict[str, tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """A row for each of the sorted ``buckets``, with the packed values that belong to it."""
    starts = groups_of(buckets)
    stops = [*starts[1:].tolist(), len(buckets)]
    columns = [
        pa.array([to_planes(values[a:b], width) for a, b in zip(starts.tolist(), stops, strict=True)], pa.binary())
        for values, width in packed.values()
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts].astype(np.int64)), pa.array(np.full(len(starts), chunk, np.int64)), *columns],
        ["bucket", "chunk", *packed],
    )


def with_answers(
    chunks: DataFrame,
    answers: DataFrame,
    work: Callable[[pa.RecordBatch, pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
    nothing: pa.Schema | None = None,
) -> DataFrame:
    """Run ``work`` on the rows of each chunk and on the answers (rows with its ``chunk``) to it.

    ``nothing`` is the schema of what ``work`` gives, if it may give nothing.
    """
    empty = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in answers.dtypes])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for payload in left.column("payload"):
            found += work(unpack(payload.as_py()), right if right.num_rows else empty.empty_table())
        return pa.Table.from_batches(found, nothing)

    return (
        chunks.select("chunk", "payload").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)
    )
