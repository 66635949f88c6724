"""Words of many texts at once, as places and 64-bit hashes."""

from __future__ import annotations

import numpy as np

from fleetbooks.llm.common import mixed

BASE = np.uint64(0x9E3779B97F4A7C55)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64, for i below ``n``."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


class Hasher:
    """Hashes of any stretches of a byte string, from one running sum.

    A polynomial modulo 2**64: stretches of thousands of bytes can be made up that differ and have
    one hash. What must not depend on that compares the bytes, or a second hash, as well.
    """

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = powers(2 * len(data))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)])])

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[begin]) * self.down[begin])


def word_places(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of marked bytes, and how many runs each row has.

    ``starts`` has the places where rows begin, and the end; runs end with a row.
    """
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begin, end, np.diff(np.searchsorted(begin, starts))
