"""Approximate nearest neighbours by stable projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.chunks import pack
from tidemill.llm.store import stored
from tidemill.llm.vectors import BLOCK_QUERIES, CHUNK_ROWS, commonest_size, each_pair, matrix, packed, sample, usable

PROJECTED = 12
CONFIDENCE = 0.95
LEAF_ROWS = 128
# Cells that the space is parted into for all chunks; further chunks of a cell are dealt by hash.
CELLS = 1024
# By so much may a fast product differ from the exact one, as a share of both lengths.
ROUNDING = 1e-9
# Of squared lengths, so that sums of them stay finite.
LARGEST = 1e300


def chi_square(x: float, degrees: int) -> float:
    """Share of a chi-square variable of even ``degrees`` up to ``x``."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_point(share: float, degrees: int) -> float:
    """Where ``chi_square`` reaches ``share``."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(middle, degrees) >= share else (middle, high)
    return high


class Space:
    """The projection, and the cells that a kd-tree over a sample of projected rows cuts the space into.

    The largest inner product is the least distance once each row has a further component that makes all rows as
    long as the longest, and the query is drawn out to that length with 0 there.
    """

    def __init__(self, size: int, longest: float, projected: int, confidence: float, seed: int):
        self.size, self.longest = size, longest
        self.axes = np.random.default_rng(seed).standard_normal((size + 1, projected))
        self.factor = chi_square_point(confidence, projected)
        self.low = np.full((1, projected), -np.inf)
        self.high = np.full((1, projected), np.inf)

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0, self.longest**2 - (rows**2).sum(axis=1)))
        return rows @ self.axes[:-1] + more[:, None] * self.axes[-1]

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        return (rows * (self.longest / np.linalg.norm(rows, axis=1))[:, None]) @ self.axes[:-1]

    def distance(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared distance of a row with that inner product to the query."""
        return np.maximum(0, 2 * self.longest**2 - 2 * self.longest * score / norm)

    def cut(self, points: np.ndarray, cells: int) -> Space:
        """Cut the cell with most of ``points`` at the median of its widest axis, again and again."""
        parts = [(points, self.low[0], self.high[0])]
        while len(parts) < cells:
            at = max(range(len(parts)), key=lambda k: len(parts[k][0]))
            own, low, high = parts[at]
            if len(own) < 2 or not (spread := own.max(axis=0) - own.min(axis=0)).any():
                break
            axis = int(spread.argmax())
            place = float(np.median(own[:, axis]))
            left = own[:, axis] < place
            if not left.any():
                break
            ceiling, floor = high.copy(), low.copy()
            ceiling[axis] = floor[axis] = place
            parts[at : at + 1] = [(own[left], low, ceiling), (own[~left], floor, high)]
        self.low, self.high = np.stack([part[1] for part in parts]), np.stack([part[2] for part in parts])
        return self

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for number in range(1, len(self.low)):
            out[((points >= self.low[number]) & (points < self.high[number])).all(axis=1)] = number
        return out


def to_boxes(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    total = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        x = points[:, axis, None]
        total += np.maximum(0, np.maximum(low[None, :, axis] - x, x - high[None, :, axis])) ** 2
    return total


def tree_order(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """A kd-tree: the order of the points by leaf, and where each leaf starts."""
    done, waiting = [], [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        if len(own) <= leaf:
            done.append(own)
            continue
        axis = int(np.ptp(points[own], axis=0).argmax())
        half = np.argpartition(points[own, axis], len(own) // 2)
        waiting += [own[half[len(own) // 2 :]], own[half[: len(own) // 2]]]
    sizes = np.array([len(own) for own in done])
    return np.concatenate(done), np.cumsum(sizes) - sizes


class Chunk:
    """Rows of a chunk by the leaves of their tree."""

    def __init__(self, batch: pa.RecordBatch, space: Space):
        self.ids = batch.column(0).to_numpy()
        self.rows = matrix(batch.column(1), space.size)
        points = space.of_rows(self.rows)
        leaf = batch.column(2).to_numpy()
        self.starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        self.stops = np.append(self.starts[1:], len(leaf))
        self.low = np.minimum.reduceat(points, self.starts)
        self.high = np.maximum.reduceat(points, self.starts)
        self.norms = np.linalg.norm(self.rows, axis=1)


def search(
    ids: np.ndarray, asked: np.ndarray, least: np.ndarray, chunk: Chunk, space: Space, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of a chunk for each query: its number, scores and ids.

    Each query takes the leaves by their distance in the projection. It stops before a leaf at distance p where
    a row nearer than the k-th best would have shown up within p with the confidence asked for: the chi-square
    share of (p / distance of the k-th best)^2. ``least``: k-th best scores that are known already.
    """
    norms = np.linalg.norm(asked, axis=1)
    boxes = to_boxes(space.of_queries(asked), chunk.low, chunk.high)
    order = np.argsort(boxes, axis=1, kind="stable")
    every = np.arange(len(asked))
    bound = least.copy()
    query, score, found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    active = np.ones(len(asked), np.bool_)
    for step in range(len(chunk.starts)):
        leaf = order[:, step]
        active &= boxes[every, leaf] < space.factor * space.distance(bound, norms)
        if not active.any():
            break
        new_query, new_row = [], []
        for number in np.unique(leaf[active]):
            who = np.flatnonzero(active & (leaf == number))
            part = slice(chunk.starts[number], chunk.stops[number])
            near = asked[who] @ chunk.rows[part].T
            slack = ROUNDING * norms[who, None] * chunk.norms[None, part]
            q, r = np.nonzero((near >= bound[who, None] - slack) & (chunk.ids[None, part] != ids[who, None]))
            new_query.append(who[q])
            new_row.append(r + chunk.starts[number])
        q, r = np.concatenate(new_query), np.concatenate(new_row)
        if not len(q):
            continue
        # One sum a pair, in one order wherever the pair is computed.
        exact = (asked[q] * chunk.rows[r]).sum(axis=1)
        query, score, found = np.append(query, q), np.append(score, exact), np.append(found, chunk.ids[r])
        by = np.lexsort((found, -score, query))
        query, score, found = query[by], score[by], found[by]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < k
        query, score, found = query[keep], score[keep], found[keep]
        full = place[keep] == k - 1
        bound[query[full]] = np.maximum(bound[query[full]], score[full])
    keep = score >= bound[query]
    return query[keep], score[keep], found[keep]


def nearest_rows(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    projected: int = PROJECTED,
    confidence: float = CONFIDENCE,
    chunk_rows: int = CHUNK_ROWS,
    seed: int = 12,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows found for each query.

    Nearest is the largest inner product, in double precision, components summed as numpy sums a row; equal
    products go by id. Queries are the rows where ``is_query`` holds, candidates all rows but those with the
    query's own id. Of several rows with one id each is a candidate; as a query the least vector asks. Vectors
    that are NULL, empty, zero or hold a NULL, infinite or missing number take no part, nor do rows without id,
    vectors of another size than most have, and those whose squared length is no double below ``LARGEST``. Ids are whole numbers. Other columns are left out.

    A neighbour is missed with a probability of at most 1 - ``confidence``. The plan: rows are projected on
    ``projected`` (an even number) normal directions and dealt to the cells of a kd-tree that is fitted on at most
    ``SAMPLE_ROWS`` rows; each cell is stored in chunks of ``chunk_rows``, each with a kd-tree of its own. Blocks of
    queries first meet a chunk of their own cell, which bounds their reach, then all chunks of the cells within
    reach; each query ends in a chunk by the stopping test. The work is at most queries times rows: on vectors
    without any structure about half of that, and blocks of queries are sent to each cell within their reach.
    """
    spark = df.sparkSession
    valid = df.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull())
    rows = valid.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = commonest_size(rows)
    rows = rows.filter(F.size("vec") == size)
    square = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = rows.withColumn("square", square).filter(f"square > 0 AND square < {LARGEST}").drop("square")
    count, longest = rows.agg(F.count("*"), F.sqrt(F.max(square))).first()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not count:
        return empty
    space = Space(size, longest, projected, confidence, seed)
    some = np.array([row[0] for row in sample(rows, count, ["vec"])], np.float64)
    space.cut(space.of_rows(some), min(CELLS, -(-count // chunk_rows)))
    shares = np.bincount(space.cells(space.of_rows(some)), minlength=len(space.low)) / len(some)
    salts = np.maximum(1, np.ceil(shares * count / chunk_rows)).astype(np.int64)
    kind = rows.schema["vec"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(space)

    def celled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            points = own.of_rows(matrix(batch.column(1), own.size))
            cell = own.cells(points)
            salt = batch.column(2).to_numpy() % salts[cell]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(salt), batch.column(0), batch.column(1)], ["cell", "salt", "id", "vec"])

    def treed(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, starts = tree_order(sent.value.of_rows(matrix(batch.column(1), sent.value.size)))
        leaf = np.zeros(len(order), np.int64)
        leaf[starts[1:]] = 1
        batch = batch.take(pa.array(order))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.cumsum(leaf))], ["id", "vec", "leaf"])

    mark = F.xxhash64("id", "vec").bitwiseAND(F.lit((1 << 62) - 1))
    placed = rows.select("id", "vec", mark.alias("mark")).mapInArrow(celled, f"cell bigint, salt bigint, id bigint, vec {kind}")
    index = stored(packed(placed, ["cell", "salt"], chunk_rows, treed), "projected")

    def homed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            cell = own.cells(own.of_queries(matrix(batch.column(1), own.size)))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], ["cell", "id", "vec"])

    asking = rows.filter("asks").groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(homed, f"cell bigint, id bigint, vec {kind}")
    blocks = packed(asking, ["cell"], BLOCK_QUERIES).withColumnRenamed("payload", "asked")

    def bounded(asked: pa.RecordBatch, payload: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        """The block with the k-th best scores of its own cell and the cells within reach."""
        own = sent.value
        ids, rows_ = asked.column(0).to_numpy(), matrix(asked.column(1), own.size)
        least = np.full(len(ids), -np.inf)
        if payload is not None:
            query, score, _ = search(ids, rows_, least.copy(), Chunk(payload, own), own, k)
            full = np.flatnonzero(np.bincount(query, minlength=len(ids)) >= k)
            lowest = np.full(len(ids), np.inf)
            np.minimum.at(lowest, query, score)
            least[full] = lowest[full]
        reach = own.factor * own.distance(least, np.linalg.norm(rows_, axis=1))
        within = to_boxes(own.of_queries(rows_), own.low, own.high) < reach[:, None]
        for cell in np.flatnonzero(within.any(axis=0)).tolist():
            near = np.flatnonzero(within[:, cell])
            part = pa.RecordBatch.from_arrays(
                [asked.column(0).take(pa.array(near)), asked.column(1).take(pa.array(near)), pa.array(least[near])], ["id", "vec", "least"]
            )
            yield pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([pack(part)], pa.binary())], ["cell", "asked"])

    # One chunk of each cell; which one doesn't matter to the result, as the bound is only a lower one.
    heads = index.filter("salt = 0").groupBy("cell").agg(F.min_by("payload", F.length("payload")).alias("payload"))
    reaching = stored(each_pair(blocks.join(heads, "cell", "left"), bounded, "cell bigint, asked binary"), "reach")

    def searched(asked: pa.RecordBatch, payload: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        own = sent.value
        ids, rows_, least = asked.column(0).to_numpy(), matrix(asked.column(1), own.size), asked.column(2).to_numpy()
        query, score, found = search(ids, rows_, least, Chunk(payload, own), own, k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

    hits = each_pair(reaching.join(index, "cell"), searched, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
