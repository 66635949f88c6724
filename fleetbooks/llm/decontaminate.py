"""Benchmark decontamination: which words of a document stand in a test phrase.

Test items are cut into windows of ``WINDOW`` words (a shorter item is one
window). Each batch of documents is a shard with its own FM-index over word
numbers: all windows are searched backwards through wavelet ranks, their
occurrences located by sampled positions, and overlapping spans merged.

A word that no test item has ends a stretch; the index is over all stretches that
are long enough for a window. Documents are never shuffled. The test set is cut into blocks of bounded size (``block_bytes``); each
block is broadcast and meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import blob_bytes, buffers, chunks, lists, lowered, ragged, text_or_empty, written
from fleetbooks.llm.fm_index import FMIndex
from fleetbooks.llm.words import Hasher, word_places

WINDOW = 13
BLOCK_BYTES = 8_000_000

# Fixed value: word bytes after lower-casing are 0-9, a-z and all above 7F.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def hashed_words(column: pa.Array, hasher: Hasher) -> Iterator[tuple[int, np.ndarray, ...]]:
    """For each chunk of rows: first row, words of each row, their hashes and places."""
    data, starts = buffers(column)
    for low, high in chunks(starts):
        part = lowered(data[starts[low] : starts[high]])
        here = starts[low : high + 1] - starts[low]
        begin, end, counts = word_places(WORD_BYTE[part], here)
        row = np.repeat(np.arange(len(counts)), counts)
        yield low, counts, hasher.of(hasher.sums(part), begin, end), begin - here[row], end - here[row]


def _within(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def phrases(ids: list[str], texts: list[str], window: int) -> dict | None:
    """The windows of a block of items, as plain arrays; None without words."""
    hasher, item, table = Hasher(), [], []
    for low, counts, hashes, _, _ in hashed_words(pa.array(texts, pa.string()), hasher):
        for row, own in enumerate(np.split(hashes, np.cumsum(counts)[:-1])):
            for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                cut = own[k : k + window]
                table.append(np.concatenate([np.zeros(window - len(cut), np.uint64), cut]))
                item.append(ids[low + row])
    if not table:
        return None
    unique, of = np.unique(np.stack(table), axis=0, return_inverse=True)
    vocabulary = np.unique(unique[unique > 0])
    numbers = np.where(unique > 0, np.searchsorted(vocabulary, unique) + 1, 0)
    lengths = (numbers > 0).sum(axis=1)
    names = sorted({i for i in item if i is not None})
    place = {name: k for k, name in enumerate(names)}
    pairs = sorted({(int(w), place[i]) for w, i in zip(of.ravel(), item) if i is not None})
    return {
        "vocabulary": vocabulary,
        "numbers": numbers,
        "lengths": lengths,
        "shortest": int(lengths.min()),
        "names": names,
        "pair_window": np.array([p[0] for p in pairs], np.int64),
        "pair_item": np.array([p[1] for p in pairs], np.int64),
    }


def _stretches(words: np.ndarray, row: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of stretches of known words that are long enough for a window."""
    spots = np.flatnonzero(words)
    if not len(spots):
        return spots, spots
    first = np.flatnonzero(np.append(True, (np.diff(spots) != 1) | (row[spots[1:]] != row[spots[:-1]])))
    runs = np.diff(np.append(first, len(spots)))
    begin = spots[first[runs >= shortest]]
    return begin, begin + runs[runs >= shortest]


# What a shard says of each document.
HITS = {
    "n_words": "long",
    "words": "array<long>",
    "begins": "array<long>",
    "ends": "array<long>",
    "items": "array<string>",
}


class Shard:
    """The stretches of one batch of documents, then the index over them."""

    def __init__(self, p: dict | None, rows: int) -> None:
        self.p = p
        self.n_words = np.zeros(rows, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, low: int, counts: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.n_words[low : low + len(counts)] = counts
        if self.p is None:
            return
        at, known = _within(self.p["vocabulary"], hashes)
        words = np.where(known, at + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        for a, b in zip(*_stretches(words, row, self.p["shortest"])):
            number = np.arange(a, b) - (np.cumsum(counts) - counts)[row[a]]
            self.parts.append((words[a:b].copy(), row[a:b] + low, number, begin[a:b].copy(), end[a:b].copy()))

    def hits(self) -> tuple[np.ndarray, ...]:
        """Row, number, begin and end of the hit words; row and item of the matches."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 6
        text, row, word, begin, end = (np.concatenate(x) for x in zip(*self.parts))
        begins = np.cumsum([0, *(len(part[0]) for part in self.parts)])[:-1]
        index = FMIndex(text, begins, len(self.p["vocabulary"]))
        window, place = index.locate(*index.search(self.p["numbers"]))
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + self.p["lengths"][window], -1)
        spot = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        pair = np.unique(row[place] * len(self.p["lengths"]) + window)
        of, w = np.divmod(pair, len(self.p["lengths"]))
        low = np.searchsorted(self.p["pair_window"], w)
        many = np.searchsorted(self.p["pair_window"], w, "right") - low
        which = np.repeat(np.arange(len(w)), many)
        at = ragged(low, many)
        match = np.unique(of[which] * (len(self.p["names"]) + 1) + self.p["pair_item"][at])
        match_row, item = np.divmod(match, len(self.p["names"]) + 1)
        return row[spot], word[spot], begin[spot], end[spot], match_row, item


def _hits(p: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its words, the hit ones by number and place, and the items."""
    hasher = Hasher()
    for batch in batches:
        rows = batch.num_rows
        shard = Shard(p, rows)
        for part in hashed_words(batch.column("text"), hasher):
            shard.add(*part)
        row, word, begin, end, match_row, item = shard.hits()
        sizes = np.bincount(row, minlength=rows)
        names = pa.array(p["names"] if p else [], pa.string()).take(pa.array(item, pa.int64()))
        keys = [c for c in batch.schema.names if c != "text"]
        made = [
            pa.array(shard.n_words),
            *(lists(x, sizes, pa.int64()) for x in (word, begin, end)),
            lists(names, np.bincount(match_row, minlength=rows), pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *made], [*keys, *HITS])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hit words of all blocks together: their number, and neighbours as one span."""
    for batch in batches:
        rows = batch.num_rows
        counts = np.diff(batch.column("words").offsets.to_numpy())
        row = np.repeat(np.arange(rows), counts)
        word, begin, end = (batch.column(c).flatten().to_numpy() for c in ("words", "begins", "ends"))
        order = np.lexsort((word, row))
        row, word, begin, end = (x[order] for x in (row, word, begin, end))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
        row, word, begin, end = (x[new] for x in (row, word, begin, end))
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)
        last = np.roll(first, -1)
        spans = pa.StructArray.from_arrays([pa.array(begin[first]), pa.array(end[last])], ["begin", "end"])
        made = [
            batch.column("id"),
            batch.column("n_words"),
            pa.array(np.bincount(row, minlength=rows)),
            lists(spans, np.bincount(row[first], minlength=rows), spans.type),
            batch.column("items"),
        ]
        yield pa.RecordBatch.from_arrays(made, ["id", "n_words", "n_hit", "spans", "items"])


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``id``, ``n_words``, ``n_hit``, ``items`` (sorted strings) and
    ``spans``, the runs of hit words as byte places in the UTF-8 text.

    A null text has no words, and an item without words no window. An item whose
    id is null still hits words, but is not listed; equal ids are one item. Every
    row gives one row, copies too, also where there are no documents or no items;
    columns besides id and text take no part. The number of blocks changes nothing.
    """
    rows = docs.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))
    asked = tests.select(F.col(test_id).cast("string").alias("item"), text_or_empty(test_text).alias("text"))
    blocks = max(1, -(-blob_bytes(asked, "item", "text") // block_bytes))
    if blocks > 1:
        rows = rows.withColumn("print", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = f"id {kind}, {'print long, ' if blocks > 1 else ''}" + ", ".join(f"{c} {t}" for c, t in HITS.items())
    found = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        made = phrases([r["item"] for r in block], [r["text"] for r in block], window)
        shared = docs.sparkSession.sparkContext.broadcast(made)
        own = rows.mapInArrow(lambda b, shared=shared: _hits(shared.value, b), out)
        found = own if found is None else found.unionByName(own)
    if blocks > 1:
        joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("words", "begins", "ends", "items")]
        # Each copy of a row came once for each block.
        copies = (F.count("*") / blocks).cast("int").alias("copies")
        found = found.groupBy("id", "print").agg(F.max("n_words").alias("n_words"), copies, *joined)
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    spans = "spans array<struct<begin: long, end: long>>"
    found = found.mapInArrow(_merged, f"id {kind}, n_words long, n_hit long, {spans}, items array<string>")
    items = F.array_sort(F.array_distinct("items")).alias("items")
    return found.select(F.col("id").alias(id), "n_words", "n_hit", items, "spans")


def clean(docs: DataFrame, tests: DataFrame, share: int = 20, **names: str) -> DataFrame:
    """The rows of ``docs`` of whose words less than one in ``share`` is hit, with all
    their columns. ``names`` are those of ``contamination``."""
    id, text = names.pop("id", "doc_id"), names.pop("text", "text")
    keyed = docs.select(F.struct(F.col(id), F.xxhash64(F.col(text))).alias("key"), F.struct("*").alias("row"))
    found = contamination(keyed.select("key", F.col(f"row.`{text}`").alias("text")), tests, "key", **names)
    bad = found.filter((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).select("key").distinct()
    return keyed.join(written(bad, "contaminated"), "key", "left_anti").select("row.*")
