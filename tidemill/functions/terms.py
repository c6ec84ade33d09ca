"""Which terms of a vocabulary of any size occur in texts: one pass over the bytes, whatever the number of terms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Texts are stepped over side by side in pieces of this many bytes, which overlap by the longest term.
PIECE = 256
SLICE = 4 << 20


class Automaton:
    """The Aho-Corasick automaton over the UTF-8 bytes of terms, with all transitions in one table.

    Bytes that no term has share one class. ``own`` is the term that ends in a state (-1: none), ``shorter`` the
    next state whose term ends there as well (0: none).
    """

    def __init__(self, terms: Sequence[str]):
        if "" in terms:
            raise ValueError("an empty term is in every text")
        words = [term.encode() for term in terms]
        used = sorted(set(b"".join(words)))
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.longest = max(map(len, words), default=1)
        below: list[dict[int, int]] = [{}]
        own = [-1]
        self.same: dict[int, list[int]] = {}
        for number, word in enumerate(words):
            state = 0
            for byte in word:
                kind = int(self.classes[byte])
                if kind not in below[state]:
                    below[state][kind] = len(below)
                    below.append({})
                    own.append(-1)
                state = below[state][kind]
            if own[state] < 0:
                own[state] = number
            self.same.setdefault(own[state], []).append(number)
        self.table = np.zeros((len(below), self.width), np.int32)
        self.own = np.array(own, np.int64)
        self.shorter = np.zeros(len(below), np.int64)
        back = np.zeros(len(below), np.int64)
        waiting = [0]
        for state in waiting:
            # Where the longest proper end of what was read leads, unless a term goes on here.
            self.table[state] = self.table[back[state]]
            for kind, child in below[state].items():
                back[child] = self.table[back[state], kind] if state else 0
                self.table[state, kind] = child
                waiting.append(child)
            end = back[state]
            self.shorter[state] = end if self.own[end] >= 0 else self.shorter[end]
        self.ends = (self.own >= 0) | (self.shorter > 0)

    def found(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and term of each term that occurs in a text (bytes from start to stop), in this order, each once."""
        sizes = stops - starts
        count = np.maximum(1, -(-sizes // PIECE))
        text = np.repeat(np.arange(len(sizes)), count)
        at = starts[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        length = np.minimum(stops[text] - at, PIECE + self.longest - 1)
        order = np.argsort(-length, kind="stable")
        text, at, length = text[order], at[order], length[order]
        kinds = self.classes[data]
        flat, state = self.table.ravel(), np.zeros(len(at), np.int64)
        owners, states = [], []
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for step, many in enumerate(active.tolist()):
            now = flat.take(state[:many] * self.width + kinds[at[:many] + step])
            state[:many] = now
            hit = np.flatnonzero(self.ends[now])
            if len(hit):
                owners.append(text[hit])
                states.append(now[hit])
        if not owners:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(owners) * len(self.own) + np.concatenate(states))
        owner, state = pairs // len(self.own), pairs % len(self.own)
        texts, terms = [], []
        while len(state):
            ends = self.own[state] >= 0
            texts.append(owner[ends])
            terms.append(self.own[state[ends]])
            owner, state = owner[self.shorter[state] > 0], self.shorter[state[self.shorter[state] > 0]]
        many = 1 + max(map(max, self.same.values()))
        pairs = np.unique(np.concatenate(texts) * many + np.concatenate(terms))
        return pairs // many, pairs % many

    def terms_of(self, texts: pa.Array) -> pa.Array:
        """For each text the sorted numbers of the terms in it; none for NULL."""
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lists = np.zeros(len(texts) + 1, np.int64)
        numbers = []
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
            begin, end = offsets[first], offsets[last]
            text, term = self.found(data[begin:end], offsets[first:last] - begin, offsets[first + 1 : last + 1] - begin)
            lists[first + 1 : last + 1] = np.bincount(text, minlength=last - first)
            numbers.append(term)
            first = last
        every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        # Of terms given more than once the first stands for all.
        return pa.ListArray.from_arrays(pa.array(np.cumsum(lists).astype(np.int32)), pa.array(every.astype(np.int32)))


def finder(spark: SparkSession, terms: Sequence[str]):
    """A function of a text column: the sorted numbers of the different ``terms`` that occur in it.

    A term given twice has the number of its first place. The automaton is built here, once, and sent to the
    executors once; it takes about 4 bytes for each byte of the terms and kind of byte in them, so a vocabulary is
    to be measured in hundreds of thousands of terms at most. NULL holds no term.
    """
    sent = spark.sparkContext.broadcast(Automaton(terms))

    @F.arrow_udf("array<int>")
    def find(texts: pa.Array) -> pa.Array:
        return sent.value.terms_of(texts)

    def column(text: Column) -> Column:
        return find(text)

    return column
