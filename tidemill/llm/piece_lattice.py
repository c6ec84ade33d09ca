"""Best and N-best segmentations of many short strings over a SentencePiece vocabulary.

The lattice of a string has a node between characters and an edge for each piece. Forward Viterbi
scores of all strings are computed side by side: characters and nodes lie by their place in the string,
at each place the longest strings first, so that one step is a few operations on whole arrays. N-best search runs backward from the end and is
led by the forward scores, which say exactly what the rest is worth at best (A-star). A path is
better by its score, and at equal scores by its ids read from the end.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np

from tidemill.llm.wordstream import mix

MARK = "▁"
_STEP = 0x9E3779B97F4A7C15
# Buckets of the table of beginnings, by the first bits of their keys.
_BUCKET_BITS = 18


class Paths:
    """The best path of each of some strings: ids one after the other, where each starts, its score and how far the second is behind."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, scores: np.ndarray, gaps: np.ndarray):
        self.ids, self.starts, self.scores, self.gaps = ids, starts, scores, gaps


class Vocabulary:
    """Pieces of a SentencePiece model file with their scores; characters without a piece fall back to bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(number) for number in range(size)]
        special = [model.is_control(n) or model.is_unknown(n) or model.is_unused(n) or model.is_byte(n) for n in range(size)]
        self.bytes = np.array([model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)])
        usable = [number for number in range(size) if not special[number]]
        self.pieces = {names[number]: number for number in usable}
        self.scores = np.array([model.get_score(number) for number in range(size)], np.float64)
        self.longest = max((len(name) for name in self.pieces), default=1)
        self.fallback = float(self.scores[usable].min() if usable else 0.0) - 10.0
        inside = [name for name in self.pieces if MARK in name.lstrip(MARK) or "\n" in name or " " in name]
        if inside:
            raise ValueError(f"pieces span spaces or line breaks: {inside[:3]}")
        self.text = [
            bytes([names[n] and int(names[n][3:5], 16)]) if model.is_byte(n) else b"" if special[n] else names[n].replace(MARK, " ").encode()
            for n in range(size)
        ]
        # Every beginning of a piece: its id if it is a piece itself, and whether a longer piece begins so.
        self.longer = longer = {name[:size] for name in self.pieces for size in range(1, len(name))}
        names = [*self.pieces, *longer.difference(self.pieces)]
        keys = self._hashes(names)
        order = np.argsort(keys)
        # The last entry is no beginning; it stops the walk from the first of a bucket.
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.numbers = np.append(np.array([self.pieces.get(name, -1) for name in names], np.int64)[order], -1)
        self.goes_on = np.append(np.array([name in longer for name in names], np.bool_)[order], False)
        buckets = np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)
        self.bucket = np.searchsorted(self.keys, buckets)

    @cached_property
    def text_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces, where each starts and how many it has."""
        sizes = np.array([len(text) for text in self.text], np.int64)
        return np.frombuffer(b"".join(self.text), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def _hashes(names: list[str]) -> np.ndarray:
        out = []
        for name in names:
            total = 0
            for at, character in enumerate(name):
                total += (ord(character) + 1) * pow(_STEP, at, 1 << 64)
            out.append(total % (1 << 64))
        return mix(np.array(out, np.uint64))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first entry that is no less than each key."""
        place = self.bucket[keys >> np.uint64(64 - _BUCKET_BITS)]
        late = np.flatnonzero(self.keys[place] < keys)
        while len(late):
            place[late] += 1
            late = late[self.keys[place[late]] < keys[late]]
        return place

    def _edges(self, points: np.ndarray, ahead: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, start, id (-1 for bytes) and score of the edges, shortest first, each length in the order of ``points``.

        ``ahead``: how far on the next character of the same string is; ``last``: which characters end their string.
        """
        codes = points.astype(np.uint64) + np.uint64(1)
        at = tip = np.arange(len(points))
        sums = codes
        for length in range(1, self.longest + 1):
            keys = mix(sums)
            place = self._find(keys)
            known = self.keys[place] == keys
            number = np.where(known, self.numbers[place], -1)
            # A character without a piece is an edge all the same.
            found = slice(None) if length == 1 else np.flatnonzero(number >= 0)
            number_found = number[found]
            yield length, at[found], number_found, np.where(number_found >= 0, self.scores[number_found], self.fallback)
            on = np.flatnonzero(known & self.goes_on[place] & ~last[tip])
            if not len(on):
                break
            at, tip = at[on], tip[on]
            tip = tip + ahead[tip]
            sums = sums[on] + codes[tip] * np.uint64(pow(_STEP, length, 1 << 64))

    def best(self, strings: list[str]) -> Paths:
        """The best path of each string (none is empty)."""
        if not strings:
            return Paths(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), np.zeros(0))
        count = len(strings)
        sizes = np.fromiter(map(len, strings), np.int64, count)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        # How many strings have a character at each place, and where those begin.
        places = int(sizes[0])
        wide = np.searchsorted(-sizes, -np.arange(places + 1))
        base = np.concatenate(([0], np.cumsum(wide[:-1])))
        place = np.repeat(np.arange(places), wide[:-1])
        row = np.arange(len(place)) - base[place]
        begin = np.cumsum(sizes) - sizes
        flat = np.frombuffer("".join([strings[k] for k in order.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = flat[begin[row] + place]
        # Nodes: the starts of all strings, then one after each character.
        first_node = np.concatenate(([0], count + base[:-1]))
        nodes = count + len(points)
        last_nodes = first_node[sizes] + np.arange(count)
        edges = []
        for length, start, number, score in self._edges(points, wide[place], place + 1 == sizes[row]):
            bounds = np.searchsorted(start, base).tolist()
            node, target = first_node[place[start]] + row[start], first_node[place[start] + length] + row[start]
            edges.append((length, bounds, node, target, number, score, np.empty(len(start)), row[start]))
        forward, chosen, width = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        forward[:count] = 0.0
        for at in range(places):
            for length, bounds, node, target, number, score, total, _ in edges:
                a, b = bounds[at], bounds[at + 1]
                if a == b:
                    continue
                worth, to, own = forward[node[a:b]] + score[a:b], target[a:b], number[a:b]
                total[a:b] = worth
                have = forward[to]
                # Of equal ones the least id.
                pick = np.flatnonzero((worth > have) | ((worth == have) & (own < chosen[to])))
                to = to[pick]
                forward[to], chosen[to], width[to] = worth[pick], own[pick], length
        # Along the best paths, from the ends.
        taken = np.zeros(nodes, np.int64)
        node, at, live, rounds, steps = last_nodes.copy(), sizes.copy(), np.arange(count), [], np.zeros(count, np.int64)
        while len(live):
            here = node[live]
            taken[here] = width[here]
            before = at[live] - width[here]
            rounds.append((live, chosen[here], base[before] + live))
            steps[live] += 1
            at[live], node[live] = before, first_node[before] + live
            live = live[before > 0]
        each = np.empty(count, np.int64)
        each[order] = steps
        ends = np.cumsum(each)[order]
        number, point = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.uint32)
        for back, (live, ids, start) in enumerate(rounds, 1):
            spot = ends[live] - back
            number[spot], point[spot] = ids, points[start]
        # Backward scores, for the best path through each edge that the best path leaves out.
        backward, second = np.full(nodes, -np.inf), np.full(count, -np.inf)
        backward[last_nodes] = 0.0
        for at in reversed(range(places)):
            for _, bounds, node, target, _, score, _, _ in edges:
                a, b = bounds[at], bounds[at + 1]
                if a < b:
                    here = node[a:b]
                    backward[here] = np.maximum(backward[here], score[a:b] + backward[target[a:b]])
        for length, _, _, target, _, _, total, owner in edges:
            np.maximum.at(second, owner, np.where(taken[target] == length, -np.inf, total + backward[target]))
        scores, gaps = np.empty(count), np.empty(count)
        best = forward[last_nodes]
        scores[order], gaps[order] = best, best - second
        ids, counts = self._expand(number, point, np.repeat(np.arange(count), each), count)
        return Paths(ids, np.concatenate(([0], np.cumsum(counts))), scores, gaps)

    def best_of_long(self, string: str) -> tuple[list[int], float]:
        """Ids and score of the best path of one long string, node by node in memory of a few numbers a character."""
        size = len(string)
        forward, chosen = array("d", [-np.inf]) * (size + 1), array("l", [-2]) * (size + 1)
        width = array("b", [0]) * (size + 1)
        forward[0] = 0.0
        for at in range(size):
            for length in range(1, min(self.longest, size - at) + 1):
                name = string[at : at + length]
                number = self.pieces.get(name, -1)
                if number >= 0 or length == 1:
                    total = forward[at] + (float(self.scores[number]) if number >= 0 else self.fallback)
                    to = at + length
                    if total > forward[to] or (total == forward[to] and number < chosen[to]):
                        forward[to], chosen[to], width[to] = total, number, length
                if name not in self.longer:
                    break
        path, at = [], size
        while at:
            path.append(chosen[at] if chosen[at] >= 0 else (string[at - 1],))
            at -= width[at]
        ids: list[int] = []
        for step in reversed(path):
            ids += [step] if isinstance(step, int) else self.bytes[list(step[0].encode("utf-8", "surrogatepass"))].tolist()
        return ids, forward[size]

    def n_best_of_long(self, string: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``n_best`` of a long string: the ``n`` best ways to each node, node by node in memory of a few numbers a character and way.

        Ways to a node that end with the same piece come from the same node, where they are in order already.
        """
        size, ring = len(string), self.longest + 1
        scores, numbers = array("d", [-np.inf]) * ((size + 1) * n), array("l", [-2]) * ((size + 1) * n)
        widths, ranks = array("l", [0]) * ((size + 1) * n), array("l", [0]) * ((size + 1) * n)
        coming: list[list[tuple[float, int, int, int]]] = [[] for _ in range(ring)]
        own = [0.0]
        scores[0] = 0.0
        for at in range(size + 1):
            if at:
                ways = sorted(coming[at % ring])[:n]
                coming[at % ring] = []
                own = [-way[0] for way in ways]
                for rank, (cost, number, before, length) in enumerate(ways, at * n):
                    scores[rank], numbers[rank], ranks[rank], widths[rank] = -cost, number, before, length
            for length in range(1, min(self.longest, size - at) + 1):
                name = string[at : at + length]
                number = self.pieces.get(name, -1)
                if number >= 0 or length == 1:
                    score = float(self.scores[number]) if number >= 0 else self.fallback
                    coming[(at + length) % ring] += [(-(total + score), number, rank, length) for rank, total in enumerate(own)]
                if name not in self.longer:
                    break
        found = []
        for rank in range(len(own)):
            path, at, way = [], size, rank
            while at:
                place = at * n + way
                path.append(numbers[place])
                at, way = at - widths[place], ranks[place]
            found.append((scores[size * n + rank], self._flat(string, tuple(path))))
        return found

    def _expand(self, number: np.ndarray, point: np.ndarray, who: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the bytes of characters that have no piece; how many each string has."""
        lone = number < 0
        width = np.where(lone, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1).astype(np.int64)
        out = np.repeat(number, width)
        if lone.any():
            at = (np.cumsum(width) - width)[lone]
            raw = "".join(map(chr, point[lone].tolist())).encode("utf-8", "surrogatepass")
            spots = np.repeat(at, width[lone]) + np.arange(len(raw)) - np.repeat(np.cumsum(width[lone]) - width[lone], width[lone])
            out[spots] = self.bytes[np.frombuffer(raw, np.uint8)]
        return out, np.bincount(who, width, size).astype(np.int64)

    def n_best(self, string: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths of a string, score and ids, by backward A-star search."""
        size = len(string)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for at in range(size):
            for length in range(1, min(self.longest, size - at) + 1):
                number = self.pieces.get(string[at : at + length], -1)
                if number >= 0 or length == 1:
                    score = float(self.scores[number]) if number >= 0 else self.fallback
                    into[at + length].append((at, number, score))
                    forward[at + length] = max(forward[at + length], forward[at] + score)
        heap: list[tuple[float, tuple[int, ...], int, float]] = [(-forward[size], (), size, 0.0)]
        found = []
        while heap and len(found) < n:
            worth, path, at, behind = heapq.heappop(heap)
            if at == 0:
                found.append((-worth, self._flat(string, path)))
                continue
            for start, number, score in into[at]:
                total = behind + score
                heapq.heappush(heap, (-(total + forward[start]), (*path, number), start, total))
        return found

    def _flat(self, string: str, path: tuple[int, ...]) -> tuple[int, ...]:
        """Ids in order, from a path read from the end."""
        names = {number: len(piece) for piece, number in self.pieces.items()} if not hasattr(self, "_sizes") else self._sizes
        self._sizes = names
        out: list[int] = []
        at = 0
        for number in reversed(path):
            if number >= 0:
                out.append(number)
                at += names[number]
            else:
                out += self.bytes[list(string[at].encode("utf-8", "surrogatepass"))].tolist()
                at += 1
        return tuple(out)
