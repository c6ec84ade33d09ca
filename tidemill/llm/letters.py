"""Characters of many texts as small class numbers, for models over characters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

import numpy as np

CLASSES = 40
WHITE, DIGIT, STOP, SYMBOL, OTHER = 26, 27, 28, 29, 30
_STOPS = ".,;:!?'\"()-"


@cache
def class_table() -> np.ndarray:
    """Class of each code point: a letter a-z, white space, digit, sentence mark, other ASCII, or one of ten for the rest."""
    points = np.arange(0x110000)
    table = (OTHER + points % (CLASSES - OTHER)).astype(np.uint8)
    table[:128] = SYMBOL
    table[ord("a") : ord("z") + 1] = np.arange(26)
    table[ord("A") : ord("Z") + 1] = np.arange(26)
    table[ord("0") : ord("9") + 1] = DIGIT
    table[[ord(mark) for mark in _STOPS]] = STOP
    table[[0x20, *range(0x09, 0x0E)]] = WHITE
    return table


@cache
def plain_table() -> np.ndarray:
    """What stands for each code point in the context of others: white space, digits, marks and other ASCII are one each."""
    table = np.arange(0x110000, dtype=np.uint32)
    kinds = class_table()[:128]
    for kind in (WHITE, DIGIT, STOP, SYMBOL):
        table[:128][kinds == kind] = np.flatnonzero(kinds == kind)[0]
    return table


def code_points(texts: Sequence[str | None], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, each text after ``gap`` line breaks; where each text starts; how long it is."""
    lowered = [(text or "").lower() for text in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    space = "\n" * gap
    points = np.frombuffer((space + space.join(lowered)).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(lengths + gap) - lengths
    return points, starts, lengths


def shares_in_class(counts: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """All characters in order, and by language the log probability of each among the characters of its class.

    ``counts`` has the code points of each language and how often each occurs. Witten-Bell: a class of T characters
    in a language leaves T occurrences to what all languages together have.
    """
    alphabet = np.unique(np.concatenate([np.zeros(0, np.uint32), *(points for points, _ in counts.values())]))
    kind = class_table()[alphabet]
    own = {lang: np.zeros(len(alphabet)) for lang in counts}
    for lang, (points, often) in counts.items():
        own[lang][np.searchsorted(alphabet, points)] = often
    whole = sum(own.values(), np.zeros(len(alphabet)))
    base = whole / np.bincount(kind, whole, CLASSES)[kind]
    shares = {}
    for lang, often in own.items():
        held = np.bincount(kind, often, CLASSES)[kind]
        left = np.where(held > 0, np.bincount(kind, often > 0, CLASSES)[kind], 1)
        shares[lang] = np.log((often + left * base) / (held + left))
    return alphabet, shares
