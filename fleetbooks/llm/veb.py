"""Complete binary trees in van Emde Boas layout, and Merkle trees stored so.

A tree of some levels is cut at half height: the top part is stored first, then
the parts below it from left to right, each of them in the same way. A walk from
a leaf to the root then stays within few pages or cache lines, whatever their size. Where a
node lies follows from its depth and number alone.
"""

from __future__ import annotations

import hashlib

import numpy as np

# Bytes of a node: a sha256 digest.
NODE = 32

# What a proof says of a level where a node has no sibling; else L or R, the side of
# the sibling, and its digest.
ALONE = "-"


def digest(*parts: bytes) -> bytes:
    """sha256 of the parts' lowercase hex text, one after the other."""
    return hashlib.sha256("".join([p.hex() for p in parts]).encode()).digest()


class Layout:
    """Addresses of the nodes of a complete tree of ``levels`` levels, the root's being 0."""

    def __init__(self, levels: int) -> None:
        self.levels = levels
        # For each depth below the root: the depth where the tree that was cut just above it
        # begins, and the sizes of that tree's top part and of each part below the cut.
        self.since, self.top, self.below = ([0] * levels for _ in range(3))
        self._cut(0, levels)
        # The byte where each node begins, by depth and number.
        self.rows = [(self.address(d, np.arange(1 << d)) * NODE).tolist() for d in range(levels)]

    def _cut(self, depth: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        at = depth + upper
        self.since[at] = depth
        self.top[at], self.below[at] = (1 << upper) - 1, (1 << levels - upper) - 1
        self._cut(depth, upper)
        self._cut(at, levels - upper)

    def address(self, depth: int, number: np.ndarray | int) -> np.ndarray | int:
        """Where the nodes ``number`` (from 0, left to right) of ``depth`` lie."""
        if depth == 0:
            return number * 0
        since, top = self.since[depth], self.top[depth]
        return self.address(since, number >> depth - since) + top + (number & top) * self.below[depth]


_LAYOUTS: dict[int, Layout] = {}


def layout(levels: int) -> Layout:
    if levels not in _LAYOUTS:
        _LAYOUTS[levels] = Layout(levels)
    return _LAYOUTS[levels]


def height(nodes: int, most: int) -> int:
    """Levels above the leaves in a block of a run of ``nodes`` nodes."""
    return min(most, (nodes - 1).bit_length())


def _counts(leaves: int, levels: int) -> list[int]:
    """How many nodes each depth has."""
    return [-(-leaves >> levels - 1 - d) for d in range(levels)]


def grow(leaves: list[bytes], levels: int) -> bytes:
    """The tree over ``leaves``, which are one at least; places without a node hold zeros."""
    rows, counts = layout(levels).rows, _counts(len(leaves), levels)
    tree = bytearray(NODE * ((1 << levels) - 1))
    for at, leaf in zip(rows[-1], leaves):
        tree[at : at + NODE] = leaf
    for depth in range(levels - 2, -1, -1):
        below, have = rows[depth + 1], counts[depth + 1]
        for k, at in enumerate(rows[depth][: counts[depth]]):
            children = [tree[c : c + NODE] for c in below[2 * k : min(2 * k + 2, have)]]
            tree[at : at + NODE] = digest(*children)
    return bytes(tree)


def proofs(tree: bytes, leaves: int, levels: int, above: list[str]) -> list[list[str]]:
    """For each leaf what stands beside its way up, and then ``above``, the root's own."""
    rows, counts = layout(levels).rows, _counts(leaves, levels)
    # Each depth's nodes as their siblings name them.
    sides = []
    for depth in range(1, levels):
        hexes = [tree[at : at + NODE].hex() for at in rows[depth][: counts[depth]]]
        named = [("R" if k % 2 else "L") + x for k, x in enumerate(hexes)]
        sides.append(named + [ALONE])
    found = []
    for leaf in range(leaves):
        own = []
        for depth in range(levels - 1, 0, -1):
            side = sides[depth - 1]
            own.append(side[min((leaf >> levels - 1 - depth) ^ 1, len(side) - 1)])
        found.append(own + above)
    return found
