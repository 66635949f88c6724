"""Collocations: phrases that come often, and oftener than their parts would meet by chance.

Frequent phrases are mined by partitioning (SON). The corpus is dealt into
``SHARDS`` shards. A phrase with the wanted support in all of the corpus has, in one shard at
least, the support divided by the number of shards, so each shard is mined completely
at that lower support, and the union of what is frequent anywhere misses nothing. A last pass counts all of the
union exactly.

A shard is many tasks' rows, however large the corpus: it is mined by length, and a phrase is
counted only if the phrases of one word less inside it are in the union so far.
Mining goes by 64-bit hashes, and the union of a length is a bitmap of fixed size that all
tasks hold: equal hashes or bits let too many phrases through, never too few. The last
pass goes by the words themselves, and its counts are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbooks.llm.common import buffers, chunks, lowered, mixed, strings, text_or_empty, written
from fleetbooks.llm.words import Hasher, word_places

LONGEST = 5
SUPPORT = 100
SHARDS = 16
TOP = 2000
UNKNOWN = "und"

# Bits of the bitmap for each length (a power of two), 8 MB.
BITS = 26
# Bytes of text that are worked on at once, and different phrases a task sums up.
STEP = 1_600_000
HELD = 2_000_000
# How many parts the phrases of a language are dealt into, to be scored and ranked.
DEALT = 64

# Bytes that end a piece, bytes that part words.
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\v\f\r")] = True
GAPS = np.zeros(256, bool)
GAPS[list(b" \t")] = True

_ODD = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of some texts: bytes, language, piece and hash of each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, langs: np.ndarray, hasher: Hasher) -> None:
        inside = ~(ENDS | GAPS)[data]
        begin, end, counts = word_places(inside, starts)
        self.letters, self.lengths = data[inside], end - begin
        row = np.repeat(np.arange(len(counts)), counts)
        self.lang = langs[row]
        # Words of one piece have the same number of ends before them, and one row.
        self.piece = np.cumsum(ENDS[data])[begin] + row if len(begin) else begin
        self.hashes = hasher.of(hasher.sums(data), begin, end)
        self.n = len(begin)

    def phrases(self, unions: list[np.ndarray], upto: int, seeds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to ``upto``: places of the phrases that may be frequent, their hashes.

        ``unions`` has the bitmaps of the lengths mined so far; a phrase of a greater length is
        told by the phrases inside it alone.
        """
        own = mixed(self.hashes ^ seeds[self.lang])
        alive = np.ones(self.n, bool)
        for size in range(1, upto + 1):
            if size > 1:
                m = max(0, self.n - size + 1)
                alive = alive[:m] & alive[1 : m + 1] & (self.piece[:m] == self.piece[size - 1 : size - 1 + m])
                own = mixed(own[:m] * _ODD + self.hashes[size - 1 : size - 1 + m])
            if size <= len(unions):
                at = own >> np.uint64(64 - BITS)
                alive = alive & (unions[size - 1][at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield size, np.flatnonzero(alive), own


def _read(batch: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[list[str], np.ndarray, Words]]:
    """Words of a batch's texts, a step at a time, with its languages and their seeds."""
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in names], np.uint64)
    langs = np.asarray(coded.indices)
    data, starts = buffers(batch.column("text"))
    for low, high in chunks(starts, STEP):
        part = lowered(data[starts[low] : starts[high]])
        yield names, seeds, Words(part, starts[low : high + 1] - starts[low], langs[low:high], hasher)


class _Sums:
    """Counts by hash, at most ``HELD`` of them for long."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        found, counts = np.unique(hashes, return_counts=True)
        self.parts.append((found, counts))
        self.size += len(found)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        hashes, counts = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts, first) if len(first) else counts
        self.parts, self.size = [(hashes[first], sums)], len(first)
        return self.parts[0]


def _local(docs: DataFrame, unions: list[np.ndarray], sizes: tuple[int, ...], shards: int) -> DataFrame:
    """Counts of possible phrases of some sizes within each shard, as (shard, hash, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(unions)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's rows are of one shard; a repeated task has the same number.
        shard, hasher, sums = TaskContext.get().partitionId() % shards, Hasher(), _Sums()

        def out() -> pa.RecordBatch:
            hashes, counts = sums.merged()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hashes), shard, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts)],
                ["shard", "hash", "n"],
            )

        for batch in batches:
            for _, seeds, words in _read(batch, hasher):
                for size, places, hashes in words.phrases(shared.value, max(sizes), seeds):
                    if size in sizes:
                        sums.add(hashes[places])
            if sums.size > 2 * HELD:
                sums.merged()
                if sums.size > HELD:
                    yield out()
                    sums = _Sums()
        yield out()

    return docs.mapInArrow(counted, "shard int, hash long, n long")


def _union(counts: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the hashes that some shard has ``least`` times."""
    frequent = counts.groupBy("shard", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    at = F.shiftrightunsigned("hash", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    rows = frequent.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    words = np.zeros((1 << BITS) // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _counted(unions: list[np.ndarray], longest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact counts, within a step, of the phrases in the union, and as phrase '' of all words."""
    hasher = Hasher()
    for batch in batches:
        for names, seeds, words in _read(batch, hasher):
            if not words.n:
                continue
            coded = strings(words.letters, words.lengths).dictionary_encode()
            word, spelt = np.asarray(coded.indices).astype(np.int64), coded.dictionary
            langs, totals = np.unique(words.lang, return_counts=True)
            yield _rows(names, langs, pa.array([""] * len(langs)), 0, totals)
            # The number of the phrase that begins at a place: of shorter phrase and next word.
            number = words.lang.astype(np.int64)
            for size, places, _ in words.phrases(unions, longest, seeds):
                if not len(places):
                    break
                _, first, of, counts = np.unique(
                    number[places] * len(spelt) + word[places + size - 1],
                    return_index=True, return_inverse=True, return_counts=True,
                )
                number[places] = of
                at = places[first]
                spelling = [spelt.take(pa.array(word[at + k])) for k in range(size)]
                text = spelling[0] if size == 1 else pc.binary_join_element_wise(*spelling, " ")
                yield _rows(names, words.lang[at], text, size, counts)


def _rows(names: list[str], langs: np.ndarray, phrases: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    lang = pa.array(names, pa.string()).take(pa.array(langs))
    sizes = pa.array(np.full(len(langs), size, np.int32))
    return pa.RecordBatch.from_arrays([lang, phrases, sizes, pa.array(counts)], ["lang", "phrase", "size", "n"])


def frequent(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    support: int = SUPPORT,
    shards: int = SHARDS,
) -> DataFrame:
    """All phrases of 1 to ``longest`` words with ``support`` in their language: lang, phrase, size, n.

    A-Z are lowered; the bytes ``ENDS`` end a piece, ``GAPS`` part its words. A phrase lies in one piece; its words
    stand with one space between. Overlapping places count each. A row of size 0 and phrase ''
    has all words of the language. A null text is empty, a null language ``und``;
    repeated rows count each; other columns take no part.
    """
    if support < 1 or shards < 1:
        raise ValueError("support and shards are 1 at least")
    docs = docs.select(text_or_empty(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    least = -(-support // shards)
    unions: list[np.ndarray] = []
    for size in range(1, min(longest, 3) + 1):
        unions.append(_union(_local(docs, unions, (size,), shards), least))
    if longest > 3:
        # What is left by now is little; all greater lengths are mined, and kept, together.
        rest = _union(_local(docs, unions, tuple(range(4, longest + 1)), shards), least)
        unions += [rest] * (longest - 3)
    shared = docs.sparkSession.sparkContext.broadcast(unions)
    counts = docs.mapInArrow(
        lambda b: _counted(shared.value, longest, b), "lang string, phrase string, size int, n long"
    )
    counts = counts.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= support) | (F.col("size") == 0))


def _after(phrase: Column, words: Column) -> Column:
    """What follows the first ``words`` words."""
    first = F.call_function("substring_index", phrase, F.lit(" "), words)
    return F.substring(phrase, F.length(first) + 2, F.length(phrase))


def _part() -> Column:
    """The part of its language that a phrase is dealt into."""
    return F.pmod(F.xxhash64("phrase"), F.lit(DEALT)).cast("int")


def scored(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more with a, l, r, n and score, by the cut that scores lowest.

    ``counts`` as ``frequent`` gives them. Score is ``floor(1000 * a * n / (l * r))``, exact:
    the products have 38 digits. Of cuts with one score the first counts.
    """
    wide = "decimal(19,0)"
    phrases = counts.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k"))
    cuts = cuts.select("*", first.alias("first"), _after(F.col("phrase"), F.col("k")).alias("rest"))
    parts = counts.filter("size > 0").select("lang", "phrase", "n")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # Each language's total once for each part, so that no language is one task's.
    every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part")
    totals = counts.filter("size = 0").select("lang", "n", every)
    cuts = cuts.withColumn("part", _part()).join(totals, ["lang", "part"])
    score = F.expr(
        f"(cast(a as {wide}) * 1000 * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"
    ).cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("cut")
    found = cuts.groupBy("lang", "phrase", "size", "a").agg(lowest)
    return found.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def _covered(counts: DataFrame, share: int) -> DataFrame:
    """Phrases inside a longer one that has ``share`` percent of their places at least, as (lang, phrase).

    One word more is enough to look at: a longer phrase is never oftener than one inside it.
    """
    longer = counts.filter("size > 2").select("lang", "phrase", "size", F.col("n").alias("longer"))
    ends = F.array(
        F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("size") - 1), _after(F.col("phrase"), F.lit(1))
    )
    inside = longer.select("lang", F.explode(ends).alias("phrase"), "longer")
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = counts.filter("size > 1").join(inside, ["lang", "phrase"])
    return found.filter(100 * F.col("longer") >= share * F.col("n")).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    support: int = SUPPORT,
    top: int = TOP,
    share: int = 100,
    shards: int = SHARDS,
) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    ``frequent`` says what is counted, ``scored`` how. Phrases inside a longer frequent one
    with ``share`` percent of their places are left out. Ties go to the oftener, then to the
    phrase that is smaller by its bytes. Without documents, or frequent phrases, there is no row.
    """
    counts = written(frequent(docs, text, lang, longest, support, shards), "phrases")
    found = scored(counts).join(_covered(counts, share), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are the best of the best of its parts.
    dealt = Window.partitionBy("lang", _part()).orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(dealt)).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
