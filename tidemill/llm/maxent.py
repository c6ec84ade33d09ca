"""A hashed maximum-entropy model of the next word, with a class-factored softmax.

The probability of a token is that of its class, times that of its slot in the class, each a softmax
over weights of the features of the two tokens before: either alone (the second is a skip feature)
and both together, hashed into tables of fixed size. Frequent tokens have a slot of their own; the
last class holds the others, a slot for each shape of word, and within a shape they follow their counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tidemill.llm.wordstream import groups_of, mix

CLASSES = 32
SLOTS = 32
# Token 0 is the end of a text; the last class is for other words.
FREQUENT = (CLASSES - 1) * SLOTS - 1
RARE = CLASSES - 1
CLASS_ROWS = 1 << 13
SLOT_ROWS = 1 << 14
BATCH = 4096
RATE = 0.08
EDGE = CLASSES * SLOTS


@dataclass
class MaxEnt:
    keys: np.ndarray
    tokens: np.ndarray
    rare_tokens: np.ndarray
    rare_words: np.ndarray
    by_class: np.ndarray = field(repr=False)
    by_slot: np.ndarray = field(repr=False)

    @staticmethod
    def start(top: list[tuple[int, int]], rare_tokens: np.ndarray, rare_words: np.ndarray, ends: int) -> MaxEnt:
        """A model of the counts alone. ``top``: key and count of frequent words, most frequent first."""
        counts = np.full(CLASSES * SLOTS, 1e-3)
        counts[0] += ends
        counts[1 : len(top) + 1] += [often for _, often in top]
        counts[RARE * SLOTS :] += rare_tokens + 0.5 * (rare_words + 1)
        counts = counts.reshape(CLASSES, SLOTS)
        by_class = np.zeros((1 + CLASS_ROWS, CLASSES), np.float32)
        by_class[0] = np.log(counts.sum(axis=1) / counts.sum())
        by_slot = np.zeros((CLASSES + SLOT_ROWS, SLOTS), np.float32)
        by_slot[:CLASSES] = np.log(counts / counts.sum(axis=1, keepdims=True))
        keys = np.array([key for key, _ in top], np.int64).view(np.uint64)
        order = np.argsort(keys)
        return MaxEnt(keys[order], order + 1, rare_tokens, rare_words, by_class, by_slot)

    def tokens_of(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words: of their own, or of their shape (the low five bits of the key)."""
        shape = (keys & np.uint64(SLOTS - 1)).astype(np.int64) + RARE * SLOTS
        if not len(self.keys):
            return shape
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.tokens[at], shape)

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Hashes of the features after the tokens ``one`` and, before it, ``two``."""
        one, two = one.astype(np.uint64), two.astype(np.uint64)
        pair = one * np.uint64(4 * EDGE) + two
        return mix(np.stack((one + np.uint64(1 << 40), two + np.uint64(1 << 41), pair + np.uint64(1 << 42))))

    def _rows(self, features: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = (features % np.uint64(CLASS_ROWS)).astype(np.int64) + 1
        second = (mix(features + classes.astype(np.uint64)) % np.uint64(SLOT_ROWS)).astype(np.int64) + CLASSES
        return np.concatenate((np.zeros((1, first.shape[1]), np.int64), first)), np.concatenate((classes[None], second))

    @staticmethod
    def _shares(table: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the weights less the greatest of each context, and the logarithm of what their exponentials add up to."""
        total = table.take(rows[0], axis=0)
        for row in rows[1:]:
            total += table.take(row, axis=0)
        # The greatest by halves (rows are powers of two wide); a reduction over so short an axis costs several times more.
        most = total.reshape(-1)
        while len(most) > len(total):
            most = np.maximum(most[0::2], most[1::2])
        total -= most[:, None]
        return total, np.log(np.exp(total).sum(axis=1, keepdims=True))

    def score(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class and slot."""
        out = np.zeros(len(tokens))
        for at in range(0, len(tokens), BATCH):
            part = slice(at, at + BATCH)
            classes, slots = tokens[part] // SLOTS, tokens[part] % SLOTS
            rows = self._rows(self.features(one[part], two[part]), classes)
            each = np.arange(len(classes))
            of_class, of_slot = self._shares(self.by_class, rows[0]), self._shares(self.by_slot, rows[1])
            out[part] = (of_class[0][each, classes] - of_class[1][:, 0]) + (of_slot[0][each, slots] - of_slot[1][:, 0])
        return out

    @staticmethod
    def _summed(slope: np.ndarray, feature: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the rows of ``slope`` for each value of ``feature`` (all below ``rows``), and those values in order."""
        order = np.argsort(feature.astype(np.min_scalar_type(rows)), kind="stable")
        ordered = feature[order]
        first = groups_of(ordered)
        sizes = np.diff(np.append(first, len(ordered)))
        # Most values come once or twice.
        step = slope.take(order[first], axis=0)
        twice = np.flatnonzero(sizes == 2)
        step[twice] += slope.take(order[first[twice] + 1], axis=0)
        often = np.flatnonzero(sizes > 2)
        if len(often):
            starts = np.cumsum(sizes[often]) - sizes[often]
            step[often] = np.add.reduceat(slope.take(order[np.repeat(sizes > 2, sizes)], axis=0), starts, axis=0)
        return step, ordered[first]

    def learn(self, tokens: np.ndarray, one: np.ndarray, two: np.ndarray, seen: tuple[np.ndarray, np.ndarray]) -> None:
        """Gradient steps over small batches; ``seen`` holds the squared gradients of each row so far."""
        for at in range(0, len(tokens), BATCH):
            part = slice(at, at + BATCH)
            classes, slots = tokens[part] // SLOTS, tokens[part] % SLOTS
            rows = self._rows(self.features(one[part], two[part]), classes)
            each = np.arange(len(classes))
            for table, row, wanted, squares in ((self.by_class, rows[0], classes, seen[0]), (self.by_slot, rows[1], slots, seen[1])):
                slope, logs = self._shares(table, row)
                slope -= logs
                np.exp(slope, out=slope)
                slope[each, wanted] -= 1
                # The count weights stay: what they say is exact.
                for feature in row[1:]:
                    step, touched = self._summed(slope, feature, len(table))
                    squares[touched] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                    table[touched] = table.take(touched, axis=0) - RATE * step / np.sqrt(squares[touched] + 1.0)[:, None]

    def rare(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of a word within its shape; 0 for tokens with a slot of their own."""
        shape = tokens - RARE * SLOTS
        own = shape < 0
        shape = np.maximum(shape, 0)
        share = (counts + 0.5) / (self.rare_tokens[shape] + 0.5 * (self.rare_words[shape] + 1))
        return np.where(own, 0.0, np.log(share))
