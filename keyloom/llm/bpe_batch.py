"""BPE merges of many short texts at a time, on arrays.

Each text is one row of symbols. A round merges in every row the best-scored adjacent pair, the leftmost of equals, which is the
order in which one text alone is merged; rows without a pair left are done. Pairs are looked up in a hash table of all ways to
split a piece in two.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max  # the cost of a pair that is no piece
ROWS = 8192  # texts in one go, so that the arrays stay small
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    def __init__(self, ranks: dict[str, float], ids: dict[str, int]):
        """ranks: what merging to each piece costs. ids: the pieces' ids."""
        names = [*sorted({c for p in ranks for c in p}), *(p for p in ranks if len(p) > 1)]
        number = {s: i for i, s in enumerate(names, 1)}  # 0: any other character, which is in no piece
        self.ids = np.array([-1, *(ids.get(s, -1) for s in names)], np.int64)
        self.chars = np.zeros(0x110000, np.int32)
        for c in {c for p in ranks for c in p}:
            self.chars[ord(c)] = number[c]
        order = {r: i for i, r in enumerate(sorted(set(ranks.values())))}
        pairs = [(a, b, order[r], number[p]) for p, r in ranks.items() for k in range(1, len(p)) if (a := number.get(p[:k])) and (b := number.get(p[k:]))]
        left, right, cost, joined = np.array(pairs, np.int64).reshape(-1, 4).T
        self.symbols = len(names) + 1
        bits = max(4 * len(pairs), 2).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.costs, self.joined = np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, np.int32)
        key = left * self.symbols + right
        at, rest = self._home(key), np.arange(len(key))
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            self.keys[at[free]] = key[free]
            rest = rest[self.keys[at[rest]] != key[rest]]
            at[rest] = at[rest] + 1 & self.mask
        self.costs[at], self.joined[at] = cost, joined

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * FACTOR >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, symbol) of each pair; cost NONE if it is no piece."""
        key = left.astype(np.int64) * self.symbols + right
        at = self._home(key)
        held = self.keys[at]
        rest = np.flatnonzero((held != key) & (held >= 0))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            held = self.keys[at[rest]]
            rest = rest[(held != key[rest]) & (held >= 0)]
        # a search that ends elsewhere ends at a free place, which holds NONE
        return self.costs[at], self.joined[at]

    def split(self, texts: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, source widths, number of ids in each text) of the pieces of all texts in order; an id is -1 if the piece has none.

        starts: for each text the source place of each of its characters and of its end, all in one.
        """
        codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        n, width = len(texts), int(size.max()) + 2
        base = np.arange(n) * width
        # a row: an empty place, the characters, an empty place that holds the end of the source
        where = np.repeat(base + 1 - np.cumsum(size + 1) + size + 1, size + 1) + np.arange(len(codes))
        symbol, source = np.zeros(n * width, np.int32), np.zeros(n * width, np.int64)
        symbol[where], source[where] = self.chars[codes], starts
        last = base + 1 + size
        symbol[last] = 0
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        cost, joined = np.full(n * width, NONE, np.int32), np.zeros(n * width, np.int32)
        first = where[symbol[where] > 0]
        cost[first], joined[first] = self._find(symbol[first], symbol[first + 1])
        here = np.ones(n * width, bool)
        live, rows = np.arange(n), cost.reshape(n, width)
        while len(live):
            at = base[live] + rows[live].argmin(1)
            some = cost[at] < NONE
            live, at = live[some], at[some]
            gone, made = after[at], joined[at]
            right, left = after[gone], before[at]
            symbol[at], after[at], before[right] = made, right, at
            here[gone], cost[gone] = False, NONE
            new = np.concatenate([left, at])
            cost[new], joined[new] = self._find(symbol[new], np.concatenate([made, symbol[right]]))
        here[base] = here[last] = False
        pieces = where[here[where]]
        counts = np.bincount(pieces // width, minlength=n)
        return self.ids[symbol[pieces]], source[after[pieces]] - source[pieces], counts
