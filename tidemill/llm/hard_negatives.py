"""Hard negatives by angular triangle filtering and exact integer scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.chunks import pack, unpack
from tidemill.llm.store import stored
from tidemill.llm.vectors import CHUNK_ROWS, commonest_size, each_pair, matrix, packed, sample, usable

DIRECTIONS = 8
BLOCK_ANCHORS = 128
# Rows of a chunk are bounded and scored so many at once.
STEP_ROWS = 512
# Integer components beyond this size take no part: sums over vectors of up to 8192 of them fit 64 bits.
LARGEST = 1 << 25
# Angles and their cosines are wrong by less than this.
ROUNDING = 1e-6


def directions(rows: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors, each the row of a sample farthest in angle from all before it."""
    lengths = np.linalg.norm(rows, axis=1)
    units = rows[lengths > 0] / lengths[lengths > 0, None]
    if not len(units):
        return np.eye(1, rows.shape[1])
    mean = units.mean(axis=0)
    first = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-9 else units[0]
    chosen = [first]
    nearest = np.abs(units @ first)
    while len(chosen) < count and nearest.min() < 1 - 1e-9:
        chosen.append(units[int(nearest.argmin())])
        nearest = np.maximum(nearest, np.abs(units @ chosen[-1]))
    return np.stack(chosen)


def angles_to(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a zero row counts as square to all."""
    lengths = np.linalg.norm(rows, axis=1)
    cosines = (rows @ axes.T) / np.where(lengths > 0, lengths, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


class Side:
    """Anchors or rows: ids, labels, integer vectors, lengths and the stored angles as cosines and sines."""

    def __init__(self, batch: pa.RecordBatch, size: int):
        self.ids = batch.column("id").to_numpy()
        self.labels = np.zeros(len(self.ids), np.int64)
        self.rows = matrix(batch.column("vec"), size)
        self.lengths = np.linalg.norm(self.rows, axis=1)
        angles = matrix(batch.column("angles"), len(batch.column("angles")[0]))
        self.cosines, self.sines = np.cos(angles), np.sin(angles)

    def part(self, at: slice | np.ndarray) -> Side:
        out = object.__new__(Side)
        for name, value in self.__dict__.items():
            setattr(out, name, value[at])
        return out


def both_sides(asked: pa.RecordBatch, payload: pa.RecordBatch, size: int) -> tuple[Side, Side]:
    """Anchors and rows with the labels of the anchors as numbers, -1 for others."""
    anchors, rows = Side(asked, size), Side(payload, size)
    names = pc.unique(asked.column("label"))
    anchors.labels = pc.index_in(asked.column("label"), names).to_numpy()
    rows.labels = pc.index_in(payload.column("label"), names).fill_null(-1).to_numpy()
    return anchors, rows


def score_bounds(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each pair can have.

    With angles s and t to a direction, two vectors are at least abs(s - t) and at most s + t apart, or 2 pi less
    that; so their cosine lies between cos(s + t) and cos(s - t), for each direction.
    """
    low = np.full((len(a.ids), len(b.ids)), -1.0)
    high = np.ones_like(low)
    for axis in range(a.cosines.shape[1]):
        even = np.multiply.outer(a.cosines[:, axis], b.cosines[:, axis])
        odd = np.multiply.outer(a.sines[:, axis], b.sines[:, axis])
        np.maximum(low, even - odd, out=low)
        np.minimum(high, even + odd, out=high)
    lengths = np.multiply.outer(a.lengths, b.lengths)
    return (low - ROUNDING) * lengths - 1, (high + ROUNDING) * lengths + 1


def scores(a: Side, b: Side, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position and exact integer score of each pair to score."""
    i, j = np.nonzero(which)
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    # By the lengths, no partial sum of doubles leaves the whole numbers.
    exact = a.lengths.max() * b.lengths.max() < 1 << 52
    if exact and len(i) * 8 > which.size:
        return i, j, (a.rows @ b.rows.T)[i, j].astype(np.int64)
    kind = np.float64 if exact else np.int64
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 14):
        x, y = a.rows[i[at : at + (1 << 14)]], b.rows[j[at : at + (1 << 14)]]
        out[at : at + (1 << 14)] = (x.astype(kind) * y.astype(kind)).sum(axis=1).astype(np.int64)
    return i, j, out


class Best:
    """The highest scores of each key so far, equal ones by id."""

    def __init__(self, keys: int, most: int, least: np.ndarray):
        self.most, self.least = most, least
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[key]
        if not good.any():
            return
        key, score, ids = np.append(self.key, key[good]), np.append(self.score, score[good]), np.append(self.id, ids[good])
        by = np.lexsort((ids, -score, key))
        key, score, ids = key[by], score[by], ids[by]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        keep = place < self.most
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = place[keep] == self.most - 1
        self.least[self.key[full]] = self.score[full]


def best_alike(anchors: Side, rows: Side, least: np.ndarray, most: int) -> Best:
    """The highest scores of each anchor among other rows of its label."""
    best = Best(len(anchors.ids), most, least)
    for at in range(0, len(rows.ids), STEP_ROWS):
        step = rows.part(slice(at, at + STEP_ROWS))
        which = (anchors.labels[:, None] == step.labels) & (anchors.ids[:, None] != step.ids)
        which &= score_bounds(anchors, step)[1] >= best.least[:, None]
        i, j, score = scores(anchors, step, which)
        best.add(i, score, step.ids[j])
    return best


def best_within(anchors: Side, rows: Side, floor: np.ndarray, ceiling: np.ndarray, most: int) -> Best:
    """The highest scores between ``floor`` and ``ceiling`` (anchors x windows) among rows of other labels.

    A window without use has its floor above its ceiling. The key is anchor times windows plus window.
    """
    windows = floor.shape[1]
    best = Best(floor.size, most, floor.ravel().copy())
    for at in range(0, len(rows.ids), STEP_ROWS):
        step = rows.part(slice(at, at + STEP_ROWS))
        low, high = score_bounds(anchors, step)
        apart = anchors.labels[:, None] != step.labels
        least = best.least.reshape(floor.shape)
        which = np.zeros_like(apart)
        for window in range(windows):
            which |= (high >= least[:, window, None]) & (low <= ceiling[:, window, None])
        i, j, score = scores(anchors, step, which & apart)
        for window in range(windows):
            inside = score <= ceiling[i, window]
            best.add(i[inside] * windows + window, score[inside], step.ids[j[inside]])
    return best


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str | Column = "label",
    vec_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    count_directions: int = DIRECTIONS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components become ``floor(scale * x)``; a score is the integer inner product with the anchor, higher ones come
    first and equal ones by id. An anchor's positives are its first other rows of the same label, a pair's negatives the
    first rows of other labels with ``low_percent * positive <= 100 * negative <= 100 * positive``, ranked from 1 (none
    where the positive's score is below 0, as no score is within).

    Anchors are the rows where ``is_anchor`` holds. Other rows are those with another id; of several rows with one
    id each is a candidate, as an anchor the least vector and label ask. Rows without id or label, with a vector that
    is NULL, empty or holds a NULL, infinite or missing number, with a vector of another size than most have or
    with an integer component beyond ``LARGEST`` take no part. Zero vectors do, with all scores 0. Ids are whole
    numbers. Other columns are left out, whatever their names.

    Directions are rows of a sample of at most ``SAMPLE_ROWS``. Every row is stored with its angles to them, in
    chunks of the rows next to a direction. Blocks of anchors meet the chunks of each direction whose rows can
    reach their scores by the ranges of these angles; within a chunk each pair gets a score bound, and only pairs
    whose bounds meet a window still open are scored. The work is at most anchors times rows, twice.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame(
        [], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    )
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    whole = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall("vec", lambda x: F.abs(x) <= LARGEST)
    rows = (
        df.filter(usable(F.col(vec_col)) & F.forall(vec_col, lambda x: F.abs(x) < LARGEST) & F.col(id_col).isNotNull() & label.isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), whole.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
        .filter(fits)
    )
    size = commonest_size(rows)
    if not size:
        return empty
    rows = rows.filter(F.size("vec") == size)
    axes = directions(np.array([row[0] for row in sample(rows, rows.count(), ["vec"])], np.float64), count_directions)
    sent = spark.sparkContext.broadcast(axes)

    def angled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(2), size)
            found = angles_to(vectors, sent.value)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.argmin(axis=1)), *batch.columns, pa.array(np.linalg.norm(vectors, axis=1)), lists],
                ["cell", "id", "label", "vec", "asks", "length", "angles"],
            )

    kinds = "cell bigint, id bigint, label string, vec array<bigint>, asks boolean, length double, angles array<double>"
    placed = stored(rows.mapInArrow(angled, kinds), "angles")
    many = len(axes)
    measures = [f(F.get("angles", F.lit(k))).alias(f"{name}{k}") for k in range(many) for name, f in (("low", F.min), ("high", F.max))]
    # One row a direction.
    ranges = {row["cell"]: row for row in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("length").alias("length"), *measures).collect()}
    cells = np.array(sorted(ranges))
    longest = np.array([ranges[cell]["length"] for cell in cells])
    nearest = np.array([[ranges[cell][f"low{k}"] for k in range(many)] for cell in cells])
    farthest = np.array([[ranges[cell][f"high{k}"] for k in range(many)] for cell in cells])
    salts = F.element_at(F.create_map(*[F.lit(int(x)) for cell in cells for x in (cell, -(-ranges[cell]["rows"] // chunk_rows))]), F.col("cell").cast("int"))
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("id", "vec"), salts))
    index = stored(packed(salted.select("cell", "salt", "id", "label", "vec", "angles"), ["cell", "salt"], chunk_rows), "angular")

    def reachable(anchors: Side, angles: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which directions hold rows whose scores can come up to ``least`` (anchors x cells)."""
        apart = np.maximum(0, np.maximum(nearest[None] - angles[:, None], angles[:, None] - farthest[None])).max(axis=2)
        high = (np.cos(apart) + ROUNDING) * anchors.lengths[:, None]
        # With a negative cosine the shortest row is the best, whose length may be 0.
        return np.where(high > 0, high * longest, 0) + 1 >= least[:, None]

    def sent_on(asked: pa.RecordBatch, within: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        for number in np.flatnonzero(within.any(axis=0)).tolist():
            near = pa.array(np.flatnonzero(within[:, number]))
            part = asked.take(near)
            part = pa.RecordBatch.from_arrays([*part.columns, pa.array(least).take(near)], [*part.schema.names, "least"])
            yield pa.RecordBatch.from_arrays([pa.array([int(cells[number])]), pa.array([pack(part)], pa.binary())], ["cell", "asked"])

    asking = placed.filter("asks").groupBy("id").agg(F.min(F.struct("vec", "label", "cell", "angles")).alias("own")).select(
        F.col("own.cell").alias("cell"), "id", "own.label", "own.vec", "own.angles"
    )
    anchors = packed(asking, ["cell"], BLOCK_ANCHORS).withColumnRenamed("payload", "asked")
    nothing = np.iinfo(np.int64).min

    def bounded(asked: pa.RecordBatch, payload: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        own = Side(asked, size)
        least = np.full(len(own.ids), nothing)
        if payload is not None:
            best_alike(*both_sides(asked, payload, size), least, positives)
        yield from sent_on(asked, reachable(own, matrix(asked.column("angles"), many), least), least)

    heads = index.filter("salt = 0").groupBy("cell").agg(F.min_by("payload", F.length("payload")).alias("payload"))
    reaching = stored(each_pair(anchors.join(heads, "cell", "left"), bounded, "cell bigint, asked binary"), "alike")

    def alike(asked: pa.RecordBatch, payload: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        own, rows = both_sides(asked, payload, size)
        best = best_alike(own, rows, asked.column("least").to_numpy().copy(), positives)
        yield pa.RecordBatch.from_arrays([pa.array(own.ids[best.key]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "positive_id", "score"])

    hits = each_pair(reaching.join(index, "cell"), alike, "anchor_id bigint, positive_id bigint, score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    chosen = stored(hits.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives), "positives")

    # At most ``positives`` rows an anchor.
    pairs = chosen.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("pairs"))
    paired = asking.join(pairs, "id").select("cell", "id", "label", "vec", "angles", F.col("pairs.score").alias("pairs"))

    def windows_of(asked: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ceiling = np.full((asked.num_rows, positives), nothing)
        for at, values in enumerate(asked.column("pairs").to_pylist()):
            ceiling[at, : len(values)] = values
        floor = -(-(low_percent * np.where(ceiling == nothing, 1, ceiling)) // 100)
        return np.where((ceiling == nothing) | (floor > ceiling), np.iinfo(np.int64).max, floor), ceiling

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                asked = unpack(payload.as_py())
                least = windows_of(asked)[0].min(axis=1)
                own = Side(asked, size)
                within = reachable(own, matrix(asked.column("angles"), many), least) & (least < np.iinfo(np.int64).max)[:, None]
                yield from sent_on(asked, within, least)

    wide = packed(paired, ["cell"], BLOCK_ANCHORS).select("payload").mapInArrow(routed, "cell bigint, asked binary")

    def unlike(asked: pa.RecordBatch, payload: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        own, rows = both_sides(asked, payload, size)
        best = best_within(own, rows, *windows_of(asked), negatives)
        nth = pa.array((best.key % positives + 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.ids[best.key // positives]), nth, pa.array(best.id), pa.array(best.score)], ["anchor_id", "nth", "negative_id", "negative_score"]
        )

    found = each_pair(stored(wide, "windows").join(index, "cell"), unlike, "anchor_id bigint, nth int, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.join(chosen.withColumnRenamed("score", "positive_score"), ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
