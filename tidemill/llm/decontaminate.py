"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item is a set of shingles. A text contains the window only if it has all of
them, so for exact containment one shingle is the necessary prefix: the rarest one in the corpus
under test. Texts are probed for these shingles alone; a hit gives one possible place for the
window (positional bound) that must lie within the text (length bound) and is then compared
byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.wordstream import NOT_ALNUM, Block, as_bytes, groups_of, is_in, sized, window_hashes

SHINGLE = 3
BLOCK_OF_ITEMS = 8 << 20


def split(texts: list[bytes | None]) -> Block:
    return Block(texts, lower=True, separators=NOT_ALNUM)


@dataclass
class Windows:
    """Distinct windows of some items, with the shingles that they can be found by."""

    texts: list[bytes]
    sizes: np.ndarray
    hashes: np.ndarray
    items: list[list[str]]
    # For each shingle size: hashes in order, and the windows and offsets that have them.
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(items: list[tuple[str, bytes | None]], size: int) -> Windows:
        block = split([text for _, text in items])
        words = block.hashes()
        data, ends = block.joined()
        whole = data.tobytes()
        stops = np.cumsum(block.ends - block.starts + 1)
        found: dict[bytes, int] = {}
        sizes, hashes, owners, rows = [], [], [], []
        for number, (item, _) in enumerate(items):
            a, b = int(block.first[number]), int(block.first[number + 1])
            width = min(size, b - a)
            for at in range(a, b - width + 1 if width else a):
                text = whole[stops[at - 1] if at else 0 : stops[at + width - 1] - 1]
                known = found.setdefault(text, len(found))
                if known == len(sizes):
                    sizes.append(width)
                    hashes.append(window_hashes(words[at : at + width], width)[0])
                    owners.append(set())
                    step = min(SHINGLE, width)
                    for offset, shingle in enumerate(window_hashes(words[at : at + width], step)):
                        rows.append((step, int(shingle), known, offset))
                owners[known].add(item)
        shingles = {}
        for step in sorted({row[0] for row in rows}):
            chosen = sorted(row[1:] for row in rows if row[0] == step)
            shingles[step] = (
                np.array([row[0] for row in chosen], np.uint64),
                np.array([row[1] for row in chosen], np.int64),
                np.array([row[2] for row in chosen], np.int64),
            )
        return Windows(
            list(found), np.array(sizes, np.int64), np.array(hashes, np.uint64), [sorted(owner) for owner in owners], shingles
        )

    def rarest(self, counts: dict[tuple[int, int], int]) -> Windows:
        """Only the rarest shingle of each window stays."""
        kept = {}
        for step, (hashes, windows, offsets) in self.shingles.items():
            often = np.array([counts.get((step, int(h)), 0) for h in hashes.view(np.int64)], np.int64)
            order = np.lexsort((offsets, often, windows))
            first = order[groups_of(windows[order])]
            first = first[np.argsort(hashes[first], kind="stable")]
            kept[step] = (hashes[first], windows[first], offsets[first])
        return Windows(self.texts, self.sizes, self.hashes, self.items, kept)


def _count(windows: Windows):
    distinct = {step: np.unique(hashes) for step, (hashes, _, _) in windows.shingles.items()}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {step: np.zeros(len(hashes), np.int64) for step, hashes in distinct.items()}
        for batch in sized(batches, "text"):
            block = split(as_bytes(batch, "text"))
            words = block.hashes()
            for step, known in distinct.items():
                hashes = window_hashes(words, step)[block.inside(step)]
                hit = hashes[is_in(hashes, known)]
                totals[step] += np.bincount(np.searchsorted(known, hit), minlength=len(known))
        for step, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), step, np.int32)), pa.array(distinct[step][seen].view(np.int64)), pa.array(total[seen])],
                ["step", "shingle", "often"],
            )

    return count


def find(block: Block, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Start word and window of every occurrence of a window in the texts of a block."""
    words = block.hashes()
    data, _ = block.joined()
    whole = data.tobytes()
    stops = np.cumsum(block.ends - block.starts + 1)
    starts_found, windows_found = [], []
    for step, (prefix, owners, offsets) in windows.shingles.items():
        hashes = window_hashes(words, step)
        at = np.flatnonzero(is_in(hashes, prefix))
        low = np.searchsorted(prefix, hashes[at], "left")
        often = np.searchsorted(prefix, hashes[at], "right") - low
        entry = np.repeat(low, often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
        start = np.repeat(at, often) - offsets[entry]
        window = owners[entry]
        size = windows.sizes[window]
        fits = (start >= 0) & (start + size <= len(block))
        start, window, size = start[fits], window[fits], size[fits]
        within = block.owner[start] == block.owner[start + size - 1]
        start, window, size = start[within], window[within], size[within]
        for width in np.unique(size):
            same = size == width
            begin, which = start[same], window[same]
            total = words[begin]
            # Equal hashes first, the bytes for what is left.
            runs = window_hashes(np.concatenate([words[begin + ahead] for ahead in range(width)]).reshape(width, -1).T.ravel(), int(width))[
                :: int(width)
            ] if len(begin) else total
            for s, w in zip(begin[runs == windows.hashes[which]].tolist(), which[runs == windows.hashes[which]].tolist(), strict=True):
                if whole[stops[s - 1] if s else 0 : stops[s + int(width) - 1] - 1] == windows.texts[w]:
                    starts_found.append(s)
                    windows_found.append(w)
    return np.array(starts_found, np.int64), np.array(windows_found, np.int64)


def _probe(windows: Windows, last: bool):
    item_names = sorted({item for owner in windows.items for item in owner})
    numbers = {item: number for number, item in enumerate(item_names)}
    owned = [np.array([numbers[item] for item in owner]) for owner in windows.items]

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text"):
            block = split(as_bytes(batch, "text"))
            start, window = find(block, windows)
            hit = block.cover(start, windows.sizes[window])
            masks = batch.column(2).to_pylist()
            if any(masks):
                before = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(masks, block.counts, strict=True)]
                hit |= np.concatenate(before).astype(bool)
            names = batch.column(3).to_pylist()
            carried, headers = [batch.column(k) for k in range(4, batch.num_columns)], batch.schema.names[4:]
            text = block.owner[start]
            for which in np.unique(text):
                new = np.unique(np.concatenate([owned[w] for w in np.unique(window[text == which])]))
                names[which] = sorted({*names[which], *(item_names[k] for k in new)})
            items = pa.array(names, pa.list_(pa.string()))
            if last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(block.counts.astype(np.int64)), pa.array(block.per_text(hit).astype(np.int64)), items, *carried],
                    ["doc_id", "n_words", "n_hit", "items", *headers],
                )
            else:
                edges = block.first.tolist()
                mask = [np.packbits(hit[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(mask, pa.binary()), items, *carried], ["doc_id", "text", "mask", "items", *headers]
                )

    return probe


def contaminated_words(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_OF_ITEMS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` and ``items`` (sorted item ids as strings) for each row, after the columns to ``carry``.

    A word (lower-cased in A-Z; digits, letters and all non-ASCII characters) is hit inside any
    occurrence of a window of ``window`` words of an item; an item of fewer words, but not none, is one
    window. NULL and empty texts have no words; items with NULL id or without words match nothing.
    Repeated rows and ids stay as they are; other columns are left out unless carried.

    Items are taken in blocks of about ``block_bytes`` (an item is never split); each block is sent to
    the tasks and the texts pass all blocks one after the other in one stage, with their hits so far.
    Before, one pass counts the shingles of the block in the texts. No shuffle of texts.
    """
    spark = df.sparkSession
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    keyed = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(name).alias(f"_{name}") for name in carry])
    types = {field.name: field.dataType.simpleString() for field in source.schema}
    tail = "".join(f", `_{name}` {types[f'_{name}']}" for name in carry)
    state = [F.lit(None).cast("binary").alias("mask"), F.array().cast("array<string>").alias("items")]
    out = source.select("doc_id", "text", *state, *[F.col(f"`_{name}`") for name in carry])
    for number in range(blocks):
        rows = keyed.filter(F.col("block") == number).select("item", F.col("text").cast("binary")).collect()
        windows = Windows.of([(row[0], bytes(row[1])) for row in rows], window)
        counted = (
            source.select("text").mapInArrow(_count(windows), "step int, shingle bigint, often bigint")
            .groupBy("step", "shingle").agg(F.sum("often").alias("often")).collect()
        )
        windows = windows.rarest({(row[0], row[1]): row[2] for row in counted})
        sent = spark.sparkContext.broadcast(windows)
        last = number == blocks - 1
        schema = (
            f"doc_id {types['doc_id']}, n_words bigint, n_hit bigint, items array<string>" if last
            else f"doc_id {types['doc_id']}, text string, mask binary, items array<string>"
        ) + tail
        out = out.mapInArrow(_from_broadcast(sent, last), schema)
    return out.select(*[F.col(f"`_{name}`").alias(name) for name in carry], "doc_id", "n_words", "n_hit", "items")


def _from_broadcast(sent, last: bool):
    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _probe(sent.value, last)(batches)

    return probe
