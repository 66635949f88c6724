"""An FM-index over a sequence of numbers: wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

from fleetbooks.llm.common import ragged


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; stops as soon as all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    step = 1
    while True:
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, text[order][1:] != text[order][:-1]))
        if n < 2 or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        text = rank * (n + 1) + after
        order = np.argsort(text, kind="stable")
        step *= 2


class Ranks:
    """How often a symbol occurs before a place: a wavelet matrix."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((shift, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def before(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(place), place
        for shift, ones, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def at(self, place: np.ndarray) -> np.ndarray:
        found = np.zeros_like(place)
        for _, ones, zeros in self.levels:
            bit = ones[place + 1] - ones[place]
            found = found * 2 + bit
            place = np.where(bit == 1, zeros + ones[place], place - ones[place])
        return found


class FMIndex:
    """Index of stretches of symbols 1 .. ``top``; no match crosses two stretches.

    Between stretches stands the symbol 0. Every ``sample``-th place and each
    start of a stretch keeps its position, so a walk back from a match to a kept
    position never leaves the stretch.
    """

    def __init__(self, text: np.ndarray, begins: np.ndarray, top: int, sample: int = 8) -> None:
        n, m = len(text), len(begins)
        where = np.arange(n) + np.searchsorted(begins, np.arange(n), "right")
        whole = np.zeros(n + m, np.int64)
        whole[where] = text
        marks = np.flatnonzero(whole == 0)
        apart = whole + m
        apart[marks] = np.arange(len(marks))  # all stretches end differently
        order = suffix_array(apart)
        last = whole[order - 1]
        self.ranks = Ranks(last, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=top + 1))])
        self.n = n + m
        kept = np.arange(n + m) % sample == 0
        kept[np.minimum(marks + 1, n + m - 1)] = True
        self.kept = kept[order]
        self.slot = np.cumsum(self.kept) - 1
        self.positions = order[self.kept]
        self.source = np.zeros(n + m, np.int64)
        self.source[where] = np.arange(n)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of suffixes that begin with each phrase (a row of the table,
        filled up with 0 at its front), all phrases one symbol back at a time."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            go = (c > 0) & (low < high)
            c = c[go]
            low[go], high[go] = (self.first[c] + self.ranks.before(c, x[go]) for x in (low, high))
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which phrase, and where in the text, for every row of the ranges."""
        which = np.repeat(np.arange(len(low)), np.maximum(high - low, 0))
        rows = ragged(low, np.maximum(high - low, 0))
        found = np.zeros(len(rows), np.int64)
        open_, walked = np.arange(len(rows)), 0
        while len(open_):
            done = self.kept[rows]
            found[open_[done]] = self.positions[self.slot[rows[done]]] + walked
            open_, rows = open_[~done], rows[~done]
            c = self.ranks.at(rows)
            rows = self.first[c] + self.ranks.before(c, rows)
            walked += 1
        return which, self.source[found]
