"""SentencePiece encoding with N-best segmentations, and decoding.

No piece spans the start of a word or a line break, so a text's lattice falls into those of its
segments. Equal segments of a batch are solved once. The N best segmentations of a text differ from
the best in a few segments; only those where the second choice costs least can be among them, and
only these get an N-best search of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.piece_lattice import MARK, Paths, Vocabulary
from tidemill.llm.wordstream import as_bytes, groups_of, sized

SPACE, NEWLINE = 0x20, 0x0A
BATCH_BYTES = 1 << 20
IDS_AT_ONCE = 1 << 18
REMEMBERED = 250_000
# A segment, a stretch without spaces and line breaks, of more characters is solved by itself, node by node.
LONG = 2048
# Characters of such segments whose choices are kept.
LONG_REMEMBERED = 1 << 20
CHANGE = "array<struct<score:double,changes:array<struct<start:int,stop:int,ids:array<int>>>>>"
_CHANGE = pa.list_(
    pa.struct(
        [
            ("score", pa.float64()),
            ("changes", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))]))),
        ]
    )
)


def cut(texts: Sequence[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Number of the distinct segment at each place, the distinct segments, and the first place of each text."""
    marked = [b" " + text.replace(MARK.encode(), b" ") if text else b"" for text in texts]
    joined = b"".join(marked)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    begins = np.concatenate(([0], np.cumsum(lengths)))
    if not joined:
        return np.zeros(0, np.int64), [], np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(joined, np.uint8)
    space, line = data == SPACE, data == NEWLINE
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts |= line
    starts[1:] |= line[:-1]
    starts[begins[:-1][lengths > 0]] = True
    at = np.flatnonzero(starts)
    offsets = np.append(at, len(data)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(at, begins)


def _named(segment: bytes) -> str:
    return segment.decode("utf-8").replace(" ", MARK)


def _choices(gaps: np.ndarray, lists, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """Cost and changes (place, rank) of the ``n`` - 1 cheapest ways to leave the best, cheapest first, then by the changes."""
    if n < 2 or not len(gaps):
        return []
    near = np.lexsort((np.arange(len(gaps)), gaps))[: n - 1]
    near = np.sort(near[np.isfinite(gaps[near])]).tolist()
    ranks = [lists(place) for place in near]
    heap = []
    for k, place in enumerate(near):
        if len(ranks[k]) > 1:
            heap.append((ranks[k][0] - ranks[k][1], [(place, 1)], k))
    heapq.heapify(heap)
    found = []
    while heap and len(found) < n - 1:
        cost, changes, k = heapq.heappop(heap)
        found.append((cost, changes))
        place, rank = changes[-1]
        if rank + 1 < len(ranks[k]):
            heapq.heappush(heap, (cost + ranks[k][rank] - ranks[k][rank + 1], [*changes[:-1], (place, rank + 1)], k))
        for later in range(k + 1, len(near)):
            if len(ranks[later]) > 1:
                heapq.heappush(heap, (cost + ranks[later][0] - ranks[later][1], [*changes, (near[later], 1)], later))
    return found


class Encoder:
    """Encodes texts; segments solved once are kept for later texts while they fit ``REMEMBERED``.

    ``long_choices``: other choices are looked for in segments of more than ``LONG`` characters, as in all others.
    """

    def __init__(self, model_file: str, n: int, long_choices: bool = False):
        self.vocabulary = Vocabulary(model_file)
        self.n = n
        self.long_choices = long_choices and n > 1
        self.searched: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.searched_long: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        nothing = np.zeros(0)
        self.solved = Paths(np.zeros(0, np.int32), np.zeros(1, np.int64), nothing, nothing)

    @staticmethod
    def _joined(paths: Paths, more: list[tuple[Sequence[int], float, float]]) -> Paths:
        """Paths with those of long segments."""
        if not more:
            return paths
        ends = paths.starts[-1] + np.cumsum([len(ids) for ids, _, _ in more])
        return Paths(
            np.concatenate((paths.ids, *[np.array(ids, np.int64) for ids, _, _ in more])),
            np.concatenate((paths.starts, ends)),
            np.concatenate((paths.scores, [score for _, score, _ in more])),
            np.concatenate((paths.gaps, [gap for _, _, gap in more])),
        )

    def _of_long(self, segment: str) -> tuple[Sequence[int], float, float]:
        """Ids and score of the best path of a long segment, and how far the second is behind."""
        if not self.long_choices:
            return *self.vocabulary.best_of_long(segment), np.inf
        found = self._search(segment)
        return found[0][1], found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf

    def _solve(self, segments: list[bytes]) -> np.ndarray:
        """Place of each segment among the solved ones."""
        if len(self.known) > REMEMBERED:
            self._forget()
        rows = np.array(list(map(self.known.get, segments, repeat(-1))), np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            names = [_named(segments[at]) for at in new.tolist()]
            long = np.fromiter(map(len, names), np.int64, len(names)) > LONG
            chosen = np.concatenate((np.flatnonzero(~long), np.flatnonzero(long)))
            short = len(names) - int(long.sum())
            names, new = [names[at] for at in chosen.tolist()], new[chosen]
            known, found = self.solved, self._joined(self.vocabulary.best(names[:short]), [self._of_long(s) for s in names[short:]])
            rows[new] = np.arange(len(known.scores), len(known.scores) + len(new))
            self.known.update(zip([segments[at] for at in new.tolist()], rows[new].tolist(), strict=True))
            self.solved = Paths(
                np.concatenate((known.ids, found.ids.astype(np.int32))),
                np.concatenate((known.starts, found.starts[1:] + known.starts[-1])),
                np.concatenate((known.scores, found.scores)),
                np.concatenate((known.gaps, found.gaps)),
            )
        return rows

    def _search(self, segment: str) -> list[tuple[float, tuple[int, ...]]]:
        if len(segment) > LONG:
            if segment not in self.searched_long:
                if sum(map(len, self.searched_long)) > LONG_REMEMBERED:
                    self.searched_long = {}
                self.searched_long[segment] = self.vocabulary.n_best_of_long(segment, self.n)
            return self.searched_long[segment]
        if len(self.searched) > REMEMBERED // 5:
            self.searched = {}
        if segment not in self.searched:
            self.searched[segment] = self.vocabulary.n_best(segment, self.n)
        return self.searched[segment]

    def encode(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
        """Ids of all texts, where each text starts, the scores, and the other choices of each text."""
        places, segments, first = cut(texts)
        if not segments:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(len(texts)), [[] for _ in texts]
        rows = self._solve(segments)[places]
        paths = self.solved
        sizes = np.diff(paths.starts)[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = paths.ids[np.repeat(paths.starts[rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        sums = np.concatenate(([0.0], np.cumsum(paths.scores[rows])))
        scores = sums[first[1:]] - sums[first[:-1]]
        others: list[list[dict]] = []
        gaps = paths.gaps[rows]
        for number in range(len(texts)):
            a, b = int(first[number]), int(first[number + 1])
            lists = lambda place, a=a: [score for score, _ in self._search(_named(segments[places[a + place]]))]
            others.append(
                [
                    {
                        "score": float(scores[number]) - cost,
                        "changes": [
                            {
                                "start": int(ends[a + place] - ends[a]),
                                "stop": int(ends[a + place + 1] - ends[a]),
                                "ids": list(self._search(_named(segments[places[a + place]]))[rank][1]),
                            }
                            for place, rank in changes
                        ],
                    }
                    for cost, changes in _choices(gaps[a:b], lists, self.n)
                ]
            )
        return ids, ends[first], scores, others


def _texts_of(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of ids that lie one after the other, some for each text."""
    data, begin, size = vocabulary.text_table
    texts, at = [], 0
    cuts = [*groups_of((np.cumsum(counts) - counts) // IDS_AT_ONCE).tolist(), len(counts)]
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        own = counts[first:last]
        part = ids[at : at + int(own.sum())]
        at += len(part)
        ends = np.concatenate(([0], np.cumsum(size[part])))
        flat = data[np.repeat(begin[part] - ends[:-1], size[part]) + np.arange(ends[-1])].tobytes()
        edges = ends[np.concatenate(([0], np.cumsum(own)))].tolist()
        # The space that encoding put before the text goes.
        texts += [flat[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return texts


def _same_texts(vocabulary: Vocabulary, ids: np.ndarray, others: list[dict]) -> bool:
    """Whether all other choices of a text decode to the same bytes as its ids."""
    texts = vocabulary.text
    return all(
        b"".join(texts[k] for k in change["ids"]) == b"".join(texts[k] for k in ids[change["start"] : change["stop"]].tolist())
        for other in others
        for change in other["changes"]
    )


def encode_pieces(
    df: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 1,
    carry: Sequence[str] = (),
    decode: bool = False,
) -> DataFrame:
    """``doc_id``, ``ids`` (the best segmentation), ``score`` and ``others``, after the columns to ``carry``.

    A text starts with the mark for a space and spaces become marks, as the model file has it; characters
    without a piece become bytes. The best segmentation has the highest sum of piece scores, and at equal
    sums the least ids read from the end. ``others`` holds the next ``n`` - 1 in order (at equal scores by the
    place of their changes), each as changes of ``ids``: ids [start, stop) give way to others. ``decode`` adds
    ``decoded``, what the ids decode to, and ``others_decode``, whether all the others decode to the same, in the same pass. NULL and empty texts have no ids. The mark itself counts as a
    space, so a text with it does not come back as it was. A model whose pieces span spaces or line breaks is
    refused. Repeated rows stay; no shuffle.
    """
    others = [name for name in carry if name != text_col]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in sized(batches, "text", BATCH_BYTES):
            encoder = encoder or Encoder(model_file, n, long_choices=True)
            ids, starts, scores, more = encoder.encode(as_bytes(batch, "text"))
            columns = [*[batch.column(k) for k in range(2, batch.num_columns)], *([batch.column(1)] if text_col in carry else [])]
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            columns += [batch.column(0), lists, pa.array(scores), pa.array(more, _CHANGE)]
            if decode:
                columns.append(pa.array(_texts_of(encoder.vocabulary, ids, np.diff(starts)), pa.string()))
                pairs = zip(starts[:-1], starts[1:], more, strict=True)
                columns.append(pa.array([_same_texts(encoder.vocabulary, ids[a:b], other) for a, b, other in pairs], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names)

    source = df.select(F.col(id_col).alias("_doc_id"), F.col(text_col).alias("text"), *[F.col(name).alias(f"_{name}") for name in others])
    kinds = [field.dataType.simpleString() for field in source.schema]
    fields = [(f"_{name}", kind) for name, kind in zip(others, kinds[2:], strict=True)]
    fields += [(f"_{text_col}", "string")] if text_col in carry else []
    fields += [("doc_id", kinds[0]), ("ids", "array<int>"), ("score", "double"), ("others", CHANGE)]
    fields += [("decoded", "string"), ("others_decode", "boolean")] if decode else []
    names = [name for name, _ in fields]
    out = source.mapInArrow(encode, ", ".join(f"`{name}` {kind}" for name, kind in fields))
    results = [name for name in names if not name.startswith("_")]
    return out.select(*[F.col(f"`_{name}`").alias(name) for name in carry], *results)


def decode_pieces(df: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``out_col``; NULL ids give NULL, none give an empty text.

    Bytes that are no UTF-8 become U+FFFD. ``out_col`` takes the place of a column of that name.
    """
    kept = [name for name in df.columns if name != out_col]

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(model_file)
            column = batch.column(batch.schema.get_field_index(ids_col))
            counts = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
            texts = _texts_of(vocabulary, np.asarray(column.flatten()), counts)
            decoded = pa.array(texts, pa.string(), mask=np.asarray(column.is_null()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], decoded], [*kept, out_col])

    types = {field.name: field.dataType.simpleString() for field in df.schema}
    return df.mapInArrow(decode, ", ".join([*[f"`{name}` {types[name]}" for name in kept], f"`{out_col}` string"]))
