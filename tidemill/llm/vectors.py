"""Vectors in packed chunks that meet blocks of queries, shared by the vector searches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.chunks import pack, unpack

# Rows of a chunk, and queries that meet one at a time.
CHUNK_ROWS = 2048
BLOCK_QUERIES = 256
# Rows that an index is fitted on, at most; all rows are indexed.
SAMPLE_ROWS = 16_384


def usable(vec: Column) -> Column:
    """Neither NULL nor empty, all components finite numbers."""
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vec) > 0), F.lit(False))


def commonest_size(rows: DataFrame) -> int:
    """The size that most vectors of ``rows`` (vec) have, the larger at a tie; 0 without rows."""
    first = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def sample(rows: DataFrame, count: int, names: list[str]) -> list:
    """At most ``SAMPLE_ROWS`` of ``count`` rows, the same ones however the rows are dealt out."""
    mark = F.xxhash64("id", "vec")
    some = rows.filter(F.pmod(mark, F.lit(max(1, count))) < SAMPLE_ROWS) if count > SAMPLE_ROWS else rows
    return some.orderBy(mark, "id").limit(SAMPLE_ROWS).select(*names).collect()


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of one size as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def packed(
    rows: DataFrame, keys: list[str], most: int, arrange: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None
) -> DataFrame:
    """``keys`` and ``payload``: the other columns of at most ``most`` rows with these keys, in IPC form.

    Rows are dealt out by ``keys`` (whole numbers); however many share them, a task holds one payload at a time.
    """
    others = [name for name in rows.columns if name not in keys]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own: tuple[int, ...] = ()

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            payload = pack(arrange(whole) if arrange else whole)
            return pa.RecordBatch.from_arrays([*[pa.array([key]) for key in own], pa.array([payload], pa.binary())], [*keys, "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(k).to_numpy() for k in range(len(keys))])
            cuts = [0, *(np.flatnonzero((np.diff(values) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            rest = batch.select(others)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(values[:, a].tolist())
                if held and key != own:
                    yield out()
                    held = []
                own = key
                while a < b:
                    room = most - sum(part.num_rows for part in held)
                    held.append(rest.slice(a, min(room, b - a)))
                    a += room
                    if sum(part.num_rows for part in held) == most:
                        yield out()
                        held = []
        if held:
            yield out()

    schema = ", ".join([*[f"{key} bigint" for key in keys], "payload binary"])
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys).select(*[F.col(key).cast("long").alias(key) for key in keys], *others)
    return ordered.mapInArrow(run, schema)


def each_pair(
    pairs: DataFrame, work: Callable[[pa.RecordBatch, pa.RecordBatch | None], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Run ``work`` on both payloads of each row (``asked``, ``payload``; NULL where there is no chunk)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, payload in zip(batch.column(0), batch.column(1), strict=True):
                yield from work(unpack(asked.as_py()), unpack(payload.as_py()) if payload.is_valid else None)

    return pairs.select("asked", "payload").mapInArrow(run, schema)
