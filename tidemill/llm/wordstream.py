"""Words of many texts at once, as numpy arrays inside a task.

A block holds the texts of one batch as one byte array. A word is a maximal run of bytes that
are no separators, which for UTF-8 is the same as a maximal run of such characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

WHITE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _separators(which: bytes) -> bytes:
    return bytes(byte in which for byte in range(256))


SEPARATORS = {which: _separators(which) for which in (WHITE, NOT_ALNUM)}

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, count: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64; kept between blocks."""
    have = _powers.get(base)
    if have is None or len(have) < count:
        have = np.full(max(count, BLOCK_BYTES + 4096), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if count <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[:count]


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


class Block:
    """The words of a list of texts (bytes; None counts as empty)."""

    def __init__(self, texts: Sequence[bytes | None], lower: bool = False, separators: bytes = WHITE):
        joined = b"\n".join([text or b"" for text in texts]) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        gap = np.frombuffer(joined.translate(SEPARATORS[separators]), dtype=np.bool_)
        if not texts:
            joined, gap = b"", gap[:0]
        self.bytes = joined
        self.data = np.frombuffer(joined, dtype=np.uint8)
        self.gap = gap
        edges = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(text) if text else 0 for text in texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, from the bytes alone."""
        if not len(self):
            return np.zeros(0, np.uint64)
        sums = np.cumsum(np.take(_CODES, self.data) * _powers_of(_STEP, len(self.data)))
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        return mix((sums[self.ends - 1] - before) * _powers_of(_BACK, len(self.data))[self.starts])

    def inside(self, size: int) -> np.ndarray:
        """For each word that starts ``size`` words of the block, whether they are of one text."""
        if len(self) < size:
            return np.zeros(0, np.bool_)
        return self.owner[: len(self) - size + 1] == self.owner[size - 1 :]

    def cover(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Which words lie in a window of ``size`` words at one of ``starts``."""
        steps = np.zeros(len(self) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.subtract.at(steps, starts + size, 1)
        return np.cumsum(steps)[:-1] > 0

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, for each text."""
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def joined(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words followed by one space each, only those to ``keep``; the end of each text in it."""
        chosen = ~self.gap
        chosen[self.ends] = True
        data = self.data[chosen]
        sizes = self.ends - self.starts + 1
        data[np.cumsum(sizes) - 1] = 0x20
        if keep is not None:
            data = data[np.repeat(keep, sizes)]
            sizes = np.where(keep, sizes, 0)
        return data, np.concatenate(([0], np.cumsum(sizes)))[self.first]

    def kept_texts(self, keep: np.ndarray) -> list[bytes]:
        data, ends = self.joined(keep)
        whole = data.tobytes()
        return [whole[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def window_hashes(words: np.ndarray, size: int, multiplier: int = 0xD1342543DE82EF95) -> np.ndarray:
    """64 bits for each run of ``size`` consecutive values."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for ahead in range(1, size):
        total *= np.uint64(multiplier)
        total += words[ahead : ahead + count]
    return mix(total)


def groups_of(ordered: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), np.bool_)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def to_planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte, so that sorted values compress."""
    return values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def pieces(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text, a longer text alone."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.binary_length(column).fill_null(0))
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [*groups_of(part).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def sized(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut and put together to about ``limit`` bytes of text each."""
    waiting: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        for piece in pieces(batch, text, limit):
            column = piece.column(piece.schema.get_field_index(text))
            size = int(pc.sum(pc.binary_length(column)).as_py() or 0)
            if waiting and held + size > limit:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
            waiting.append(piece)
            held += size
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
