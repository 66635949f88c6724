"""A character language model from the corpus, and words read through a noisy channel."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import buffers, chunks, text_or_empty

# Characters fall in 32 classes: 0 is the gap between words, 1-26 are a-z, the
# other bytes of letters share the rest. The model counts four in a row.
CLASSES = 32
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = _CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 5
BACKOFF = 4.0


# Different words that a task holds before it passes their counts on.
HELD = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of all texts of a task, summed up."""
    seen: Counter[str] = Counter()

    def done() -> pa.RecordBatch:
        made = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(made, ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            seen.update(_WORD.findall(text.as_py().lower()))
            if len(seen) > HELD:
                yield done()
    yield done()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Four classes in a row in words that end with a gap, as often as the words occur."""
    counts = np.zeros(CLASSES**4)
    for batch in batches:
        data, starts = buffers(batch.column("word"))
        times = batch.column("n").to_numpy()
        for low, high in chunks(starts):
            now = _CLASS[data[starts[low] : starts[high]]]
            back = [now]
            for _ in range(3):  # nothing is seen across the start of a word
                far = np.roll(back[-1], 1)
                far[starts[low:high] - starts[low]] = 0
                back.append(np.where(back[-1] == 0, 0, far) if len(back) > 1 else far)
            key = ((back[3] * CLASSES + back[2]) * CLASSES + back[1]) * CLASSES + now
            weight = np.repeat(times[low:high], np.diff(starts[low : high + 1]))
            counts += np.bincount(key, weights=weight, minlength=CLASSES**4)
    spot = np.flatnonzero(counts)
    made = [pa.array(spot, pa.int32()), pa.array(counts[spot].astype(np.int64))]
    yield pa.RecordBatch.from_arrays(made, ["key", "n"])


def count(rows: DataFrame, text: str = "text") -> np.ndarray:
    """How often each four classes in a row occur in the words of all texts.

    The words of the corpus are counted first, then what they consist of: only
    different words are taken apart, and the table that leaves Spark has a fixed size.
    """
    words = rows.select(text_or_empty(text).alias("text")).mapInArrow(_words, "word string, n long")
    words = words.groupBy(F.concat("word", F.lit(" ")).alias("word")).agg(F.sum("n").alias("n"))
    found = words.mapInArrow(_counted, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**4)
    counts[found["key"]] = found["n"]
    return counts.reshape((CLASSES,) * 4)


def costs(counts: np.ndarray) -> np.ndarray:
    """-log of each class after three others; short contexts help out rare ones."""
    share = np.full(CLASSES, 1 / CLASSES)
    for order in (3, 2, 1, 0):
        seen = counts.sum(axis=tuple(range(order)))
        share = (seen + BACKOFF * share) / (seen.sum(axis=-1, keepdims=True) + BACKOFF)
    return -np.log(share).astype(np.float32)


def classes(text: str) -> list[int]:
    return _CLASS[np.frombuffer(text.encode(), np.uint8)].tolist()


# States up to which a step goes one by one; beyond, all states are arrays.
WIDE = 1_000
# Places whose steps are remembered together; of others only the costs before each so many.
BLOCK = 256


def read(lattice: list[list[tuple[str, float]]], cost: np.ndarray, beam: int | None = None) -> str:
    """The most likely text through a lattice (Viterbi): each place has readings,
    a string and what the channel takes for it. States are the last three classes;
    a gap forgets what was before it. Equal costs go to the first reading. All states
    are followed, unless ``beam`` says how many."""
    paths: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    for place in [*lattice, [(" ", 0.0)]]:
        after: dict[tuple[int, int, int], tuple[float, str]] = {}
        for state, (so_far, text) in paths.items():
            for reading, price in place:
                total, now = so_far + price, state
                for c in classes(reading):
                    if c or now[2]:
                        total += float(cost[now[0], now[1], now[2], c])
                    now = (now[1], now[2], c) if c else (0, 0, 0)
                if now not in after or total < after[now][0]:
                    after[now] = (total, text + reading)
        if beam is not None and len(after) > beam:
            after = dict(sorted(after.items(), key=lambda x: x[1])[:beam])
        if beam is None and len(after) > WIDE:
            return _read_wide(lattice, cost)
        paths = after
    return min(paths.values())[1].strip()


def _step(before: np.ndarray, place: list[tuple[str, float]], cost: np.ndarray) -> tuple[np.ndarray, ...]:
    """Costs of all states after a place, and the state before and the reading of each."""
    pairs = np.arange(CLASSES**2)
    after = np.full(CLASSES**3, np.inf)
    source, which = np.zeros(CLASSES**3, np.int16), np.zeros(CLASSES**3, np.int16)
    gap = cost[..., 0].astype(float)
    gap[..., 0] = 0.0
    for k, (reading, price) in enumerate(place):
        total, came = before + price, np.arange(CLASSES**3, dtype=np.int16)
        for c in classes(reading):
            far = total + (cost[..., c] if c else gap).reshape(-1)
            total, old = np.full(CLASSES**3, np.inf), came
            came = np.zeros(CLASSES**3, np.int16)
            if c:  # the best first class for each two that stay
                best = far.reshape(CLASSES, -1).argmin(axis=0) * CLASSES**2 + pairs
                total[pairs * CLASSES + c], came[pairs * CLASSES + c] = far[best], old[best]
            else:
                best = far.argmin()
                total[0], came[0] = far[best], old[best]
        better = total < after
        after[better], source[better], which[better] = total[better], came[better], k
    return after, source, which


def _read_wide(lattice: list[list[tuple[str, float]]], cost: np.ndarray) -> str:
    """As ``read``, with the costs of all states in an array."""
    places = [*lattice, [(" ", 0.0)]]
    total = np.full(CLASSES**3, np.inf)
    total[0] = 0.0
    begun, steps = [], []
    for k, place in enumerate(places):
        if k % BLOCK == 0:
            begun.append(total)
            steps = []
        total, *step = _step(total, place, cost)
        steps.append(step)
    state, found = 0, []  # the last place is a gap
    for block in reversed(range(len(begun))):
        own = places[block * BLOCK : (block + 1) * BLOCK]
        if block < len(begun) - 1:
            total, steps = begun[block], []
            for place in own:
                total, *step = _step(total, place, cost)
                steps.append(step)
        for place, (source, which) in zip(reversed(own), reversed(steps)):
            found.append(place[which[state]][0])
            state = int(source[state])
    return "".join(reversed(found)).strip()
