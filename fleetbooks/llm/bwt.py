"""Burrows-Wheeler transforms of many short texts, and their merge."""

from __future__ import annotations

import numpy as np


def _words(data: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on as one number; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def transforms(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform of each text by itself, laid end to end.

    Texts are symbols above 0 that end with one 0; ``begins`` has where they begin.
    Returns for every row (a suffix, in order within its text) its place, the symbol
    before it, and the row of the suffix one symbol longer.
    """
    n = len(data)
    text = np.zeros(n, np.uint16 if len(begins) < 1 << 16 else np.int64)
    text[begins[1:]] = 1
    text = np.cumsum(text, dtype=text.dtype)
    words = _words(data)
    order = np.argsort(words)
    order = order[np.argsort(text[order], kind="stable")]
    key = words[order]
    # Suffixes of a text that agree so far, and so do not reach its end, are told
    # apart by the ranks of what follows, each time twice as far on.
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (text[order][1:] != text[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    alone = new & np.append(new[1:], True)
    tied = np.flatnonzero(~alone)
    depth = 8
    while len(tied):
        suffix, group = order[tied], first[tied]
        key = rank[suffix + depth]
        inner = np.lexsort((key, group))
        suffix, group, key = suffix[inner], group[inner], key[inner]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        first[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[suffix] = first[tied]
        tied = tied[~(new & np.append(new[1:], True))]
        depth *= 2
    row = rank
    row[order] = np.arange(n)
    begin = np.zeros(n, bool)
    begin[begins] = True
    begin = begin[order]
    return order, np.where(begin, 0, data[order - 1]).astype(np.uint8), np.where(begin, -1, row[order - 1])


def repeats(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all strings of ``length`` symbols that occur more than once, and for
    each the number of its interval; intervals are numbered in order.

    The transforms of the texts are merged by refining their interleave: it begins
    as one after the other, and each round deals the rows out by the two symbols
    before them, which orders the suffixes two symbols longer. Rows that agreed so
    far and get the same symbols stay in one block, so when the rounds have gone
    through ``length`` symbols, a block is an interval of the merged transform with
    that common prefix. A row alone in its block cannot become part of a repeat any
    more, nor can what lies before it; it leaves. So do, from the start, rows from
    which no full string can be reached.
    """
    order, before, longer = transforms(data, begins)
    ends = np.append(begins[1:], len(data)) - 1
    text = np.searchsorted(begins, order, "right") - 1
    rows = np.flatnonzero((order >= begins[text] + length) & (order <= ends[text])).astype(np.int32)
    longer = longer.astype(np.int32)
    two = before[longer].astype(np.uint16) << 8 | before
    second = longer[longer]
    block = np.zeros(len(rows), np.int32)
    for done in range(length % 2, length + 1, 2):
        if not done:
            continue
        # An odd length begins with one symbol alone.
        symbol, onward = (before.take(rows), longer) if done == 1 else (two.take(rows), second)
        deal = np.argsort(symbol, kind="stable")
        rows, block, symbol = onward.take(rows.take(deal)), block.take(deal), symbol.take(deal)
        new = np.ones(len(rows), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        if done % 8 < 2 or done == length:
            alone = new & np.append(new[1:], True)[: len(new)]
            if alone.any():
                rows, new = rows[~alone], new[~alone]
        block = np.cumsum(new, dtype=np.int32)
        if not len(rows):
            break
    return order[rows], block
