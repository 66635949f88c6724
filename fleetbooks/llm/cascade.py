"""A cascade of Bloom filters: exact membership over a known universe of keys.

Level 1 holds the listed keys. Some keys that are not listed pass it all the same;
level 2 holds these. Some listed keys pass level 2; level 3 holds those, and so on in
turn until no key passes wrongly. The first level that a key does not pass tells on
which side it is: an odd level not listed, an even one listed; a key that passes all
levels is of the last level's side. Every key of the two sides that the cascade was
built from gets its right answer. About any other key it may err.

Keys are columns ``a`` and ``b``, two 64-bit hashes. Two keys with the same 128 bits
could not be told apart; such a cascade never ends, and the build raises an error.
Spark marks the bits of a level; the driver gets one row per 64 bits of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import mixed, written

# False positives of a level after the first: the size that costs the fewest bits in all.
LATER = 0.5
MOST_LEVELS = 100
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hashes(key: Column) -> list[Column]:
    """The 128 bits that stand for a key."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b")]


# A Bloom filter: its number, which gives it hash functions of its own, how many bits it has
# and how many of them a key sets, and the bits. Plain values, as they are broadcast.
Level = tuple[int, int, int, np.ndarray]
Cascade = list[Level]


def size(keys: int, rate: float) -> tuple[int, int]:
    """Bits, and bits a key sets, of a filter that lets through ``rate`` of other keys."""
    bits = max(64, math.ceil(-keys * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-math.log2(rate)))


def _places(number: int, bits: int, probes: int, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """For each probe the bit that every key has there."""
    salt = np.full(1, number, np.uint64) * _STEP
    first, step = mixed(a + salt), mixed(b ^ mixed(salt)) | np.uint64(1)
    for k in range(probes):
        yield (first + np.uint64(k) * step) % np.uint64(bits)


def passed(level: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys a filter lets through."""
    *shape, words = level
    found = np.ones(len(a), bool)
    for at in _places(*shape, a, b):
        found &= (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def is_listed(levels: Cascade, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which keys are listed; without levels none is."""
    answer = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for level in levels:
        left = left[passed(level, a[left], b[left])]
        answer[left] = level[0] % 2 == 1
    return answer


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``a`` and ``b`` of a batch as unsigned numbers."""
    return tuple(np.asarray(batch.column(c)).view(np.uint64) for c in ("a", "b"))


def _filled(number: int, bits: int, probes: int, keys: DataFrame) -> Level:
    """A filter with all ``keys`` in it."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_places(number, bits, probes, *_columns(batch)))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            here = np.uint64(1) << (at & np.uint64(63))
            both = np.bitwise_or.reduceat(here, first) if len(at) else here
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(both.view(np.int64))], ["word", "bits"])

    rows = keys.select("a", "b").mapInArrow(marked, "word long, bits long")
    rows = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return number, bits, probes, words


def _passing(level: Level, keys: DataFrame) -> DataFrame:
    """The keys that a filter lets through; columns as they are."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passed(shared.value, *_columns(batch))))

    return keys.mapInArrow(kept, keys.schema)


def first_rate(listed: int, others: int) -> float:
    """False positives of level 1 that make the whole cascade smallest."""
    return min(LATER, math.sqrt(LATER) * max(1, listed) / max(1, others))


def build(listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
    """A cascade that tells the keys ``listed`` from all other keys of ``universe``.

    Both have columns key, a, b; which keys are the same is told by ``key``, not by
    hashes. Repeated keys count once; listed keys that the universe lacks are kept.
    ``n_universe`` is about how many different keys there are: it sizes level 1 and
    changes no answer. The universe is read once, by level 1; what passes is as large as
    ``listed`` or so, and is written to the shared folder, as are the keys of all
    further levels.
    """
    held, other = listed.select("a", "b").distinct(), universe.select("key", "a", "b")
    found, n = [], held.count()
    while n:
        number = len(found) + 1
        if number > MOST_LEVELS:
            raise ValueError("a listed key has the same 128 bits as one that is not listed")
        rate = first_rate(n, n_universe) if number == 1 else LATER
        found.append(_filled(number, *size(n, rate), held))
        wrong = _passing(found[-1], other).distinct()
        if number == 1:
            wrong = wrong.join(listed.select("key"), "key", "left_anti").select("a", "b")
        # What passes wrongly is held by the next level; what this one held can pass that one wrongly.
        held, other = written(wrong, f"cascade-{number}"), held
        n = held.count()
    return found
