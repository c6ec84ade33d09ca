"""Ranked lexical search turned round: the items are indexed, the documents stream past."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.store import stored
from tidemill.llm.wordstream import NOT_ALNUM, Block, as_bytes, groups_of, sized

BLOCK_OF_ITEMS = 4 << 20
BLOCK_ITEMS = 4096
# Documents meet the index so many at once that their scores for all items fit this many cells.
CELLS = 1 << 21
# Heaps are merged in two levels, so that no task gets one item's heaps of all tasks.
SALTS = 64

# The constants of the score.
SCALE, LENGTH_SHARE, TF_SCALE, SATURATION = 1_000_000_000, 75, 1000, 8


def split(texts: list[bytes | None]) -> Block:
    """Terms of texts, lower-cased before they are parted: capitals are no separators."""
    return Block(texts, lower=True, separators=NOT_ALNUM)


class Index:
    """Items by the terms they hold: for each term the items and how often each has it."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        block = split(texts)
        self.hashes, term = np.unique(block.hashes(), return_inverse=True)
        pairs = Counter(zip(term.tolist(), block.owner.tolist(), strict=True))
        held = np.array(sorted((t, item, often) for (t, item), often in pairs.items()), np.int64).reshape(-1, 3)
        self.items, self.often = held[:, 1], held[:, 2]
        self.first = np.searchsorted(held[:, 0], np.arange(len(self.hashes) + 1))
        self.weights = np.zeros(len(self.hashes), np.int64)
        self.documents = self.length = 0

    def weighted(self, df: dict[int, int], documents: int, length: int) -> Index:
        """Take the counts over all documents: of terms, documents and all terms with repeats."""
        often = [df.get(term, 0) for term in range(len(self.hashes))]
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in often], np.int64)
        self.documents, self.length = documents, length
        return self

    def found(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of each term of the index that a document holds, by document and term."""
        hashes = block.hashes()
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), np.bool_)
        key = block.owner[known].astype(np.int64) * len(self.hashes) + at[known]
        key, count = np.unique(key, return_counts=True)
        width = max(1, len(self.hashes))
        return key // width, key % width, count.astype(np.int64)

    def scores(self, block: Block) -> np.ndarray:
        """Score of each document for each item."""
        table = np.zeros((len(block.counts), len(self.ids)), np.int64)
        doc, term, tf = self.found(block)
        if not len(doc):
            return table
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * block.counts[doc].astype(np.int64) * self.documents) // self.length
        gain = self.weights[term] * ((SCALE * tf) // (TF_SCALE * tf + SATURATION * m))
        often = np.diff(self.first)[term]
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(often) // CELLS)) + 1).tolist(), len(doc)]
        flat = table.reshape(-1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            many = often[a:b]
            ends = np.cumsum(many)
            place = np.repeat(self.first[term[a:b]] - (ends - many), many) + np.arange(many.sum())
            cell = np.repeat(doc[a:b] * len(self.ids), many) + self.items[place]
            value = np.repeat(gain[a:b], many) * self.often[place]
            if int(np.abs(value).sum(dtype=np.float64)) < 1 << 52:
                flat += np.bincount(cell, value, len(flat)).astype(np.int64)  # doubles hold such sums exactly
            else:
                np.add.at(flat, cell, value)
        return table


class Heaps:
    """The best documents of each item so far: scores, then ids."""

    def __init__(self, items: int, k: int, id_type: pa.DataType):
        self.k = k
        self.least = np.ones(items, np.int64)
        schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", id_type)])
        self.table = schema.empty_table()

    def update(self, scores: np.ndarray, ids: pa.Array) -> None:
        least = self.least
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        doc, item = np.nonzero(scores >= least)
        if not len(doc):
            return
        new = pa.table({"item": pa.array(item), "score": pa.array(scores[doc, item]), "doc_id": ids.take(pa.array(doc))})
        both = pa.concat_tables([self.table, new.cast(self.table.schema)])
        # NULL ids come last among equal scores.
        both = both.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        item = both.column("item").to_numpy()
        starts = groups_of(item)
        place = np.arange(len(item)) - np.repeat(starts, np.diff([*starts, len(item)]))
        self.table = both.filter(pa.array(place < self.k)).combine_chunks()
        full = item[place == self.k - 1]
        self.least[full] = both.column("score").to_numpy()[place == self.k - 1]


def _count(sent: Broadcast):
    """Documents with each term; under -1 the documents with any term, under -2 all terms."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        df = np.zeros(len(index.hashes), np.int64)
        documents = length = 0
        for batch in sized(batches, "text"):
            block = split(as_bytes(batch, "text"))
            df += np.bincount(index.found(block)[1], minlength=len(df))
            documents += int((block.counts > 0).sum())
            length += len(block)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((term, [-1, -2]))), pa.array(np.concatenate((df[term], [documents, length])))], ["term", "often"]
        )

    return count


def _best(sent: Broadcast, k: int, names: list[str]):
    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        heaps = None
        rows = max(1, CELLS // max(1, len(index.ids)))
        for batch in sized(batches, "text"):
            heaps = heaps or Heaps(len(index.ids), k, batch.column(0).type)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                heaps.update(index.scores(split(as_bytes(part, "text"))), part.column(0))
        for found in heaps.table.to_batches() if heaps else ():
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2), found.column(1)], names)

    return best


def _top(df: DataFrame, keys: list[str | Column], k: int) -> DataFrame:
    # The filter on row_number is applied before the shuffle as well.
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_items(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = 10,
    block_bytes: int = BLOCK_OF_ITEMS,
) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents of each item.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z. With N
    documents that have a term, L terms in all of them, n in one, df documents that hold a term and tf times in
    one: the term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's m is ``25 + 75 n N div L``, and its
    score sums weight times ``10^9 tf div (1000 tf + 8 m)`` over the item's terms, repeats included. Only scores
    above 0 are returned; equal scores are ranked by id, NULL ids last.

    NULL and empty texts have no terms: such documents are not counted, such items find nothing. Rows of ``items``
    that are equal in id and text are one item; with different texts they are items of their own under one id.
    Every row of ``documents`` is a document, repeated rows included. Other columns are left out, whatever their
    names. Terms are told apart by 64-bit hashes.

    Items are taken in blocks of about ``block_bytes`` of text and at most ``BLOCK_ITEMS`` of them (an item is never
    split); only a block's index is sent to the tasks, and the next one takes its place. A first pass over all
    documents counts the block's terms; in the second each task keeps a heap of ``k`` documents for each item, and
    the heaps are merged. Texts are not shuffled; a task returns at most ``k`` rows an item.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.filter(F.col(item_text_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    id_type, item_type = source.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    schema = T.StructType().add("item_id", item_type).add("rank", "integer").add("doc_id", id_type).add("score", "long")
    total, many = asked.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(-(-(total or 0) // block_bytes), -(-many // BLOCK_ITEMS))
    keyed = stored(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))), "items")
    results = []
    for number in range(blocks):
        rows = keyed.filter(F.col("block") == number).select("item_id", F.col("text").cast("binary")).collect()
        index = Index([row[0] for row in rows], [bytes(row[1]) for row in rows])
        sent = spark.sparkContext.broadcast(index)
        terms = source.select("text").mapInArrow(_count(sent), "term bigint, often bigint")
        counted = dict(terms.groupBy("term").agg(F.sum("often")).collect())
        sent.destroy()
        if not counted.get(-1):
            continue
        index.weighted(counted, counted[-1], counted[-2])
        sent = spark.sparkContext.broadcast(index)
        heaps = source.mapInArrow(
            _best(sent, k, ["item", "doc_id", "score"]), T.StructType().add("item", "long").add("doc_id", id_type).add("score", "long")
        )
        salted = _top(heaps.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["item", "salt"], k)
        ids = spark.createDataFrame(list(enumerate(index.ids)), T.StructType().add("item", "long").add("item_id", item_type))
        ranked = _top(salted, ["item"], k).join(F.broadcast(ids), "item")
        results.append(stored(ranked.select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "ranked"))
        sent.destroy()
    out = spark.createDataFrame([], schema)
    for result in results:
        out = out.union(result)
    return out
