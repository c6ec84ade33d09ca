"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with exclusive-or and bit counts, tile against tile. A tile holds
fingerprints with the same bit counts of their two halves. Two fingerprints within the radius have
bit counts within the radius, so tile pairs further apart are never made, and within a pair of
tiles the bit counts of the quarters leave out blocks in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.store import stored
from tidemill.llm.wordstream import Block, as_bytes, sized

TILE = 1 << 16
PAIRS_AT_ONCE = 1 << 21


def fingerprints_of(texts: list[bytes | None], shingle: int, seed: int) -> np.ndarray:
    """64 bits a text: a bit is set where it is set in over half of the hashes of its word shingles."""
    block = Block(texts, lower=True)
    out = np.zeros(len(texts), np.uint64)
    if not len(block):
        return out
    data, ends = block.joined()
    whole = data.tobytes()
    stops = np.cumsum(block.ends - block.starts + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    # The last word of each shingle; a text of fewer words is one shingle.
    last = np.arange(len(block)) + shingle - 1
    text_end = block.first[1:][block.owner] - 1
    own = last <= text_end
    short = (block.counts < shingle) & (block.counts > 0)
    own[block.first[:-1][short]] = True
    last = np.minimum(last, text_end)[own]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[a:b], seed) for a, b in zip(starts[own].tolist(), stops[last].tolist(), strict=True)], dtype=np.uint64
    )
    owner = block.owner[own]
    filled = np.flatnonzero(block.counts)
    edges = np.searchsorted(owner, filled)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    totals = np.diff(np.append(edges, len(hashes)))
    out[filled] = np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``bits`` (the fingerprint as a signed number) for each row."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", 2 << 20):
            bits = fingerprints_of(as_bytes(batch, "text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(compute, f"doc_id {id_type}, bits bigint")


def _quarters(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two arrays whose values differ in at most ``radius`` bits."""
    found_left, found_right = [], []
    counts_left, counts_right = _quarters(left), _quarters(right)
    keys, inverse = np.unique(counts_left, axis=0, return_inverse=True) if len(left) else (counts_left, np.zeros(0, int))
    if len(left) * len(right) <= PAIRS_AT_ONCE:
        keys, inverse = [None], np.zeros(len(left), int)
    for number, key in enumerate(keys):
        rows = np.flatnonzero(inverse == number)
        near = np.arange(len(right)) if key is None else np.flatnonzero(np.abs(counts_right - key).sum(axis=1) <= radius)
        step = max(1, PAIRS_AT_ONCE // max(1, len(near)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            a, b = np.nonzero(np.bitwise_count(left[some, None] ^ right[None, near]) <= radius)
            found_left.append(some[a])
            found_right.append(near[b])
    if not found_left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_left), np.concatenate(found_right)


def forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``count`` nodes the least node that links (a, b) reach."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def links(bits: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all distinct ``bits`` within the radius, a forest for each pair of tiles.

    A dense group of g fingerprints thus gives fewer than g links a tile pair, never all its pairs.
    """

    def half(shift: int) -> Column:
        return F.bit_count(F.shiftrightunsigned(F.shiftleft("bits", 32 - shift), 32))

    celled = bits.select("bits", half(0).alias("hi"), half(32).alias("lo"))
    # At most 33 x 33 cells of counts, so these rows are few at any size.
    sizes = celled.groupBy("hi", "lo").count().select("hi", "lo", F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    tiles = stored(
        celled.join(F.broadcast(sizes), ["hi", "lo"])
        .withColumn("part", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
        .groupBy("hi", "lo", "part")
        .agg(F.collect_list("bits").alias("bits")),
        "tiles",
    )
    ahead = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x, y) >= (0, 0)]
    names = tiles.select("hi", "lo", "part")
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ahead])
    near = names.select("hi", "lo", "part", F.explode(steps).alias("by")).select(
        "hi", "lo", "part", (F.col("hi") + F.col("by.x")).alias("hi2"), (F.col("lo") + F.col("by.y")).alias("lo2")
    )
    other = tiles.select(*[F.col(name).alias(f"{name}2") for name in ("hi", "lo", "part", "bits")])
    pairs = (
        near.join(names.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("part").alias("part2")), ["hi2", "lo2"])
        .filter("hi < hi2 OR lo < lo2 OR part <= part2")
        .join(tiles, ["hi", "lo", "part"])
        .join(other, ["hi2", "lo2", "part2"])
        .select("bits", "bits2")
        .repartition(F.xxhash64("bits", "bits2"))
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                left = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                right = y.values.to_numpy(zero_copy_only=False).view(np.uint64)
                a, b = close_pairs(left, right, radius)
                nodes, at = np.unique(np.concatenate((left[a], right[b])), return_inverse=True)
                label = forest(len(nodes), at[: len(a)], at[len(a) :])
                linked = np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[linked].view(np.int64)), pa.array(nodes[label[linked]].view(np.int64))], ["a", "b"]
                )

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row.

    Words are lower-cased in A-Z and split at ASCII white space; shingles are joined by a space and count
    as often as they occur. A text of fewer words is one shingle, one without words (NULL, empty) has
    fingerprint zero and links like any other. Fingerprints link at ``radius`` or fewer differing bits;
    ``component_id`` is the least id reachable (ids must be ordered; NULL ids count only where a component
    has no other). Repeated rows keep their number. Other columns are left out, whatever their names.
    """
    marked = stored(fingerprints(df, id_col, text_col, shingle, seed), "fingerprints")
    distinct = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct.select("bits"), radius))
    rooted = distinct.join(roots, distinct.bits == roots.node, "left").withColumn("root", F.coalesce("root", "bits"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = rooted.join(named, "root").select("bits", "component_id")
    return marked.join(groups, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
