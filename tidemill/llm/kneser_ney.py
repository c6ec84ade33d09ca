"""Modified Kneser-Ney models over character classes, kept in sorted hash arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemill.llm.letters import CLASSES
from tidemill.llm.wordstream import groups_of, mix

ORDER = 4


def _sums(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    first = groups_of(codes[order])
    return codes[order][first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def discounts(counts: np.ndarray) -> np.ndarray:
    """What a count of 0, 1, 2 and of 3 or more gives up."""
    return discounts_of([int((counts == k).sum()) for k in range(1, 5)])


def discounts_of(n: list[int]) -> np.ndarray:
    """``discounts`` from how many counts are 1, 2, 3 and 4."""
    share = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [0.0]
    for k in range(1, 4):
        value = k - (k + 1) * share * n[k] / n[k - 1] if n[k - 1] else 0.5 * k
        found.append(min(max(value, 0.05), k - 0.05))
    return np.array(found)


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    return mix(codes.astype(np.uint64) * np.uint64(ORDER + 2) + np.uint64(order))


@dataclass
class KneserNey:
    """Hashes of n-grams in order with log probabilities, and of contexts with back-off weights."""

    grams: np.ndarray
    scores: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(codes: np.ndarray, counts: np.ndarray, order: int = ORDER, classes: int = CLASSES) -> KneserNey:
        """From distinct ``order``-gram codes (most recent class last) and how often each occurs."""
        tables = {order: (codes.astype(np.int64), counts.astype(np.float64))}
        for size in range(order - 1, 0, -1):
            # How many different classes stand before it.
            longer, _ = tables[size + 1]
            tables[size] = _sums(longer % classes**size, np.ones(len(longer)))
        all_grams, all_scores, all_contexts, all_weights = [], [], [], []
        lower: tuple[np.ndarray, np.ndarray] | None = None
        for size in range(1, order + 1):
            grams, seen = tables[size]
            cut = discounts(seen)[np.minimum(seen, 3).astype(int)]
            context = grams // classes
            names, total = _sums(context, seen)
            _, given = _sums(context, cut)
            weight = given / total
            at = np.searchsorted(names, context)
            if lower is None:
                below = np.full(len(grams), 1 / classes)
            else:
                below = lower[1][np.searchsorted(lower[0], grams % classes ** (size - 1))]
            share = (seen - cut) / total[at] + weight[at] * below
            lower = (grams, share)
            all_grams.append(hashed(grams, size))
            all_scores.append(np.log(share))
            all_contexts.append(hashed(names, size))
            all_weights.append(np.log(weight))
        grams, scores = np.concatenate(all_grams), np.concatenate(all_scores)
        contexts, weights = np.concatenate(all_contexts), np.concatenate(all_weights)
        by_gram, by_context = np.argsort(grams), np.argsort(contexts)
        return KneserNey(grams[by_gram], scores[by_gram].astype(np.float32), contexts[by_context], weights[by_context].astype(np.float32))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

    def score(self, codes: np.ndarray, order: int = ORDER, classes: int = CLASSES) -> np.ndarray:
        """Natural log probability of the last class of each code after the others."""
        total = np.zeros(len(codes))
        left = np.arange(len(codes))
        for size in range(order, 0, -1):
            part = codes[left] % classes**size
            at, found = self._find(self.grams, hashed(part, size))
            total[left[found]] += self.scores[at[found]]
            left, part = left[~found], part[~found]
            at, found = self._find(self.contexts, hashed(part // classes, size))
            total[left[found]] += self.weights[at[found]]
        total[left] += np.log(1 / classes)
        return total
