"""Token counts of whole texts by a SentencePiece model, without keeping the tokens.

Batches are balanced by bytes and a text is split at safe boundaries: places that no piece of
the vocabulary spans, so that merges on both sides never meet. Equal segments are encoded once
a batch; only lengths leave the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.wordstream import as_bytes, sized

MARK = "▁"
SPACE, NEWLINE = 0x20, 0x0A


class SegmentCounter:
    """Counts of tokens, kept for segments seen before while they fit ``remember``."""

    def __init__(self, model_file: str, remember: int = 400_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.remember = remember
        self.known: dict[bytes, int] = {}
        self.safe = self._is_safe()

    def _is_safe(self) -> bool:
        """Whether no piece goes on past a space or touches a line break, as the splits assume."""
        size = self.model.get_piece_size()
        pieces = (self.model.id_to_piece(i) for i in range(size) if not self.model.is_control(i))
        whole = all(MARK not in piece.lstrip(MARK) and "\n" not in piece and " " not in piece for piece in pieces)
        plain = self.model.encode("a\n\nb  c ", out_type=str)
        return whole and self.model.decode(self.model.encode("x  y\n z ")) == "x  y\n z " and plain[0][0] == MARK

    def _encode(self, segments: list[bytes]) -> list[int]:
        """A segment starts with the space or line break before it, or else starts its text."""
        texts, less = [], []
        for segment in segments:
            if segment[0] == SPACE:
                texts.append(segment[1:].decode())
                less.append(0)
            else:
                texts.append(segment.decode())
                less.append(1)
        # A segment of one space is only the mark that the model puts before a text.
        found = self.model.encode([text or "a" for text in texts], num_threads=1)
        return [1 if not text else len(ids) - cut for text, ids, cut in zip(texts, found, less, strict=True)]

    def counts(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.safe:
            return np.array([len(ids) for ids in self.model.encode([(t or b"").decode() for t in texts], num_threads=1)], np.int64)
        lengths = np.fromiter((len(text) + 1 if text else 0 for text in texts), np.int64, len(texts))
        if not lengths.sum():
            return np.zeros(len(texts), np.int64)
        # A text starts with the mark for a space, as the model has it; it takes the mark itself for one.
        joined = b"".join([b" " + text for text in texts if text])
        if MARK.encode() in joined:
            flat = [b" " + text.replace(MARK.encode(), b" ") for text in texts if text]
            lengths[lengths > 0] = [len(text) for text in flat]
            joined = b"".join(flat)
        data = np.frombuffer(joined, np.uint8)
        space, line = data == SPACE, data == NEWLINE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut |= line
        # A line break, and what follows one that is no space, starts a segment of its own.
        begins = np.concatenate(([0], np.cumsum(lengths)))
        cut[begins[:-1][lengths > 0]] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(data)).astype(np.int32)
        segments = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
        coded = segments.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [segment for segment in distinct if segment not in self.known]
        fresh = dict(zip(new, self._encode(new), strict=True))
        each = np.array([fresh[s] if s in fresh else self.known[s] for s in distinct], np.int64)
        if len(self.known) + len(fresh) > self.remember:
            self.known = {}
        self.known.update(list(fresh.items())[: self.remember])
        sums = np.concatenate(([0], np.cumsum(each[np.asarray(coded.indices)])))
        edges = np.searchsorted(at, begins)
        return sums[edges[1:]] - sums[edges[:-1]]


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` for each row.

    ``model_file`` is the path of a SentencePiece model that every executor has. The counts are those
    the library gives for the whole text without begin and end. NULL and empty texts have no tokens.
    Ids are passed on as they are (NULL, repeated); other columns are left out, whatever their names.
    A model whose pieces span spaces or line breaks is asked for whole texts instead. No shuffle.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in sized(batches, "text"):
            counter = counter or SegmentCounter(model_file)
            tokens = counter.counts(as_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], ["doc_id", "n_bytes", "n_tokens"])

    source = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
