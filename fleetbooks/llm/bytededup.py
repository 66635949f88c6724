"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every byte goes that lies in a string of ``LENGTH`` bytes which also begins earlier.

A corpus is cut so that equal strings come together: the smallest hash among the
grams of ``GRAM`` bytes in a string depends on the string alone, so runs of strings
with one such smallest hash (pieces) are dealt out by it. Equal pieces are summed up
first: within a task before the shuffle, then over all; every copy but the earliest
is repeated as a whole. A piece whose smallest hash no different piece shares, and
whose smallest gram stands in it once, holds nothing repeated. What is left, a part
of the corpus, goes on as bytes: each piece is a shard with a transform of its own,
and the shards of a bin are merged.

A hash with very many different pieces (a common passage in many surroundings) is
cut again by longer grams, which keeps surroundings apart, and if these are still too
many, string by string: equal strings are then summed up as equal pieces are, and no
group holds more than ``PIECES`` different pieces. Texts are shuffled by document to be
cut; order is by id and place, as text goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.bwt import repeats
from fleetbooks.llm.common import buffers, chunks, lists, ragged, text_or_empty, written
from fleetbooks.llm.words import Hasher

LENGTH = 100
GRAMS = (40, 92, 100)  # part of LENGTH, in percent of it; the last is a whole string
PIECES = 30_000  # different pieces under one hash before it is cut again
BIN = 500_000  # bytes that are merged together
HELD = 500_000  # pieces that a task sums up at once

SPAN = "id long, print long, a long, b long"


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` numbers in a row."""
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


class Cutter:
    """Cuts texts into pieces: runs of strings that have their smallest gram in common."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram, self.hasher = length, gram, Hasher()

    def cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, place in its text, number of strings, smallest hash and own hash of pieces,
        and whether the smallest gram stands in it more than once."""
        none = np.zeros(0, np.int64)
        if len(data) < self.length:
            return none, none, none, none, none, none
        sums = self.hasher.sums(data)
        n = len(data) - self.gram + 1
        grams = (sums[self.gram :] - sums[:n]) * self.hasher.down[:n]
        grams = (grams ^ grams >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        width = self.length - self.gram + 1
        low = _lowest(grams, width)
        # Strings must not cross from one text to the next.
        whole = np.zeros(len(low) + 1, np.int32)
        sizes = np.diff(starts)
        long_ = sizes >= self.length
        np.add.at(whole, starts[:-1][long_], 1)
        np.add.at(whole, starts[1:][long_] - self.length + 1, -1)
        whole = np.cumsum(whole[:-1]) > 0
        new = np.ones(len(low), bool)
        if width > 1:  # whole strings are pieces of their own, so that equal ones are summed up
            new[1:] = low[1:] != low[:-1]
        edges = starts[:-1][starts[:-1] < len(low)]
        new[edges] = True
        begin = np.flatnonzero(new & whole)
        stop = np.append(new | ~whole, True)
        after = np.flatnonzero(stop)
        end = after[np.searchsorted(after, begin, "right")]
        own = self.hasher.of(sums, begin, end + self.length - 1)
        row = np.searchsorted(starts, begin, "right") - 1
        # Places that are the smallest of some string; two equal ones in a row stand in
        # one piece if no string lies between them: that of the string up to the second.
        high = ~_lowest(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~low, np.full(width - 1, ~np.uint64(0))]), width)
        least = np.flatnonzero(high == grams)
        pair = (grams[least[1:]] == grams[least[:-1]]) & (np.diff(least) <= width)
        p, q = least[:-1][pair], least[1:][pair]
        text = np.searchsorted(starts, p, "right") - 1
        one = (text == np.searchsorted(starts, q + self.gram - 1, "right") - 1) & long_[text]
        q, text = q[one], text[one]
        inside = np.clip(q - width + 1, starts[text], starts[text + 1] - self.length)
        inner = np.zeros(len(begin), bool)
        if width > 1:
            inner[np.searchsorted(begin, inside, "right") - 1] = True
        return row, begin - starts[row], end - begin, low[begin].view(np.int64), own.view(np.int64), inner


def _spans(id: np.ndarray, print: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents in order, those that touch made one."""
    order = np.lexsort((a, print, id))
    id, print, a, b = (x[order] for x in (id, print, a, b))
    if not len(a):
        return id, print, a, b
    doc = np.ones(len(a), bool)
    doc[1:] = (id[1:] != id[:-1]) | (print[1:] != print[:-1])
    # The furthest end so far in each document.
    number = np.cumsum(doc) - 1
    far = int(b.max()) + 1
    reach = np.maximum.accumulate(b + number * far) - number * far
    new = doc.copy()
    new[1:] |= a[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
    return id[new], print[new], a[new], reach[last]


# Rows of pieces and spans. Pieces are dealt by their smallest hash, and have kind 0, or
# 3 if they may repeat something within themselves; then 0 if they are wanted, and 2 if
# they must be cut again. Spans to remove have kind 1 and are dealt by their place.
COLUMNS = ["kind", "group", "own", "id", "print", "a", "b"]


def _rows(kind: int | np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    made = [np.broadcast_to(np.int8(kind), len(columns[0])) if np.isscalar(kind) else kind.astype(np.int8), *columns]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in made], COLUMNS)


FOUND = "kind byte, group long, own long, " + SPAN


def _earliest(pieces: list[np.ndarray], length: int) -> Iterator[pa.RecordBatch]:
    """Of equal pieces of a task the earliest as a piece, the others as spans."""
    group, own, id, print, a, n, inner = (np.concatenate(x) for x in zip(*pieces))
    both = group.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ own.view(np.uint64)
    order = np.argsort(both, kind="stable")
    both = both[order]
    again = np.zeros(len(both) + 1, bool)
    again[1:-1] = both[1:] == both[:-1]
    single = order[~again[:-1] & ~again[1:]]
    rest = order[again[:-1] | again[1:]]
    rest = rest[np.lexsort((a[rest], print[rest], id[rest], own[rest], group[rest]))]
    same = lambda *xs: np.append(False, np.logical_and.reduce([x[rest][1:] == x[rest][:-1] for x in xs]))
    copy = same(group, own) if len(rest) else np.zeros(0, bool)
    row = same(group, own, id, print, a) if len(rest) else copy  # a row that came twice
    keep = np.concatenate([single, rest[~copy]])
    yield _rows(np.where(inner[keep], 3, 0), group[keep], own[keep], id[keep], print[keep], a[keep], n[keep])
    gone = rest[copy & ~row]
    i, p, x, y = _spans(id[gone], print[gone], a[gone], a[gone] + n[gone] + length - 1)
    place = (i * 31 + p + x * 1_000_003).astype(np.int64)
    yield _rows(1, place, np.zeros(len(i), np.int64), i, p, x, y)


def _cut(length: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of texts (``id``, ``print``, ``at``, ``bytes``), summed up within the task."""
    cutter, held, size = Cutter(length, gram), [], 0
    for batch in batches:
        data, starts = buffers(batch.column("bytes"))
        id, print, at = (batch.column(c).to_numpy() for c in ("id", "print", "at"))
        for low, high in chunks(starts, 300_000):
            row, a, n, group, own, inner = cutter.cut(data[starts[low] : starts[high]], starts[low : high + 1] - starts[low])
            row = row + low
            held.append((group, own, id[row], print[row], at[row] + a, n, inner))
            size += len(row)
            if size >= HELD:
                yield from _earliest(held, length)
                held, size = [], 0
    if held:
        yield from _earliest(held, length)


def _told(most: int, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by group, own hash and place: spans of later copies (kind 1), and
    the earliest of pieces that share a group, as kind 0, or 2 if these are too many.

    A group waits for its end, or until it is known to be large.
    """
    held = [np.zeros(0, np.int8), *(np.zeros(0, np.int64) for _ in COLUMNS[1:])]
    large: int | None = None  # a group of which part has gone on as large
    last: tuple | None = None  # the last hash that part had

    def done(part: list[np.ndarray], waits: bool) -> Iterator[pa.RecordBatch]:
        nonlocal large, last
        kind, group, own, id, print, a, b = part
        if not len(kind):
            return
        piece = kind != 1
        yield _rows(1, *(x[~piece] for x in (group, own, id, print, a, b)))
        inner, group, own, id, print, a, n = (x[piece] for x in (kind == 3, group, own, id, print, a, b))
        if not len(group):
            return
        same = np.zeros(len(group), bool)
        same[1:] = (group[1:] == group[:-1]) & (own[1:] == own[:-1])
        same[0] = last is not None and last[:2] == (group[0], own[0])
        row = same.copy()  # a row that came twice
        row[1:] &= (id[1:] == id[:-1]) & (print[1:] == print[:-1]) & (a[1:] == a[:-1])
        row[0] = same[0] and last[2:] == (id[0], print[0], a[0])
        gone = same & ~row
        spans = _spans(id[gone], print[gone], a[gone], a[gone] + n[gone] + length - 1)
        none = np.zeros(len(spans[0]), np.int64)
        yield _rows(1, none, none, *spans)
        first = ~same
        _, of = np.unique(group, return_inverse=True)
        count = np.bincount(of, weights=first)[of]
        big = count > most
        if large is not None:
            big |= group == large
        for out, want in ((0, first & ~big & ((count > 1) | inner)), (2, first & big)):
            yield _rows(out, group[want], own[want], id[want], print[want], a[want], n[want])
        if waits:
            large, last = int(group[-1]), (group[-1], own[-1], id[-1], print[-1], a[-1])
        else:
            large, last = None, None

    for batch in batches:
        held = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, COLUMNS)]
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[1], held[1][-1]))
        if cut:
            yield from done([x[:cut] for x in held], False)
            held = [x[cut:] for x in held]
        if len(np.unique(held[2])) > 2 * most:
            yield from done(held, True)
            held = [x[:0] for x in held]
    yield from done(held, False)


def _bytes(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wanted pieces (``group``, place and number of strings, in lists) as bytes."""
    for batch in batches:
        data, starts = buffers(batch.column("bytes"))
        counts = np.diff(batch.column("a").offsets.to_numpy())
        group, a, n = (batch.column(c).flatten().to_numpy() for c in ("group", "a", "n"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        sizes = n + length - 1
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for low, high in chunks(ends):
            cut = data[ragged(starts[row[low:high]] + a[low:high], sizes[low:high])]
            offsets = (ends[low : high + 1] - ends[low]).astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(cut)])
            keys = [batch.column(c).take(pa.array(row[low:high])) for c in ("id", "print")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[low:high]), *keys, pa.array(a[low:high]), made], ["group", "id", "print", "at", "bytes"]
            )


def _merged(length: int, table: pa.Table) -> pa.Table:
    """Spans of the strings in the pieces of a bin that begin earlier in it as well."""
    table = table.combine_chunks()
    id, print, at = (table.column(c).to_numpy() for c in ("id", "print", "at"))
    order = np.lexsort((at, print, id))  # places in the bin go as in the corpus
    id, print, at = id[order], print[order], at[order]
    pieces = table.column("bytes").to_pylist()
    data = np.frombuffer(b"".join(pieces[k] + b"\xff" for k in order), np.uint8) + np.uint8(1)
    sizes = np.array([len(pieces[k]) + 1 for k in order])
    begins = np.cumsum(sizes) - sizes
    place, block = repeats(data, begins, length)
    if len(place):
        first = np.minimum.reduceat(place, np.flatnonzero(np.append(True, block[1:] != block[:-1])))
        place = place[place != first[block - 1]]
    piece = np.searchsorted(begins, place, "right") - 1
    a = at[piece] + place - begins[piece]
    made = _spans(id[piece], print[piece], a, a + length)
    return pa.table([pa.array(x) for x in made], names=["id", "print", "a", "b"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, and its removed spans."""
    for batch in batches:
        data, starts = buffers(batch.column("bytes"))
        counts = np.diff(batch.column("a").offsets.to_numpy())
        a, b = (batch.column(c).flatten().to_numpy() for c in ("a", "b"))
        row = np.repeat(np.arange(batch.num_rows), counts)
        row, _, a, b = _spans(row, np.zeros(len(row), np.int64), a, b)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, starts[row] + a, 1)
        np.add.at(edge, starts[row] + b, -1)
        keep = np.cumsum(edge[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(keep)])[starts].astype(np.int32)
        kept = pa.Array.from_buffers(
            pa.binary(), batch.num_rows, [None, pa.py_buffer(left), pa.py_buffer(data[keep])]
        )
        sizes, removed = np.diff(starts), np.diff(starts) - np.diff(left)
        spans = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["begin", "end"])
        spans = lists(spans, np.bincount(row, minlength=batch.num_rows), spans.type)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes), pa.array(removed), spans, kept], ["id", "n_bytes", "n_removed", "spans", "kept"]
        )


def _wanted(docs: DataFrame, found: DataFrame, kind: int, length: int) -> DataFrame:
    """Pieces of one kind as bytes: ``group``, ``id``, ``print``, ``at``, ``bytes``."""
    own = found.filter(F.col("kind") == kind).groupBy("id", "print")
    own = own.agg(*(F.collect_list(c).alias(x) for c, x in (("group", "group"), ("a", "a"), ("b", "n"))))
    # A left join, as the one at the end: Spark then shuffles the texts once for both.
    joined = docs.join(own, ["id", "print"], "left").filter(F.col("a").isNotNull())
    return joined.mapInArrow(
        lambda batches: _bytes(length, batches), "group long, id long, print long, at long, bytes binary"
    )


def repeated(docs: DataFrame, length: int, pieces: int = PIECES) -> DataFrame:
    """Spans (``id``, ``print``, ``a``, ``b``) to remove from ``docs`` (``id``, ``print``, ``bytes``)."""
    texts = docs.withColumn("at", F.lit(0).cast("long"))
    spans, cold = None, None
    for share in GRAMS:
        gram = max(1, length * share // 100)
        most = pieces if gram < length else 1 << 62  # a whole string is the only one in its group
        cut = texts.mapInArrow(lambda b, gram=gram: _cut(length, gram, b), FOUND)
        cut = cut.repartition("group").sortWithinPartitions("group", "own", "id", "print", "a")
        found = written(cut.mapInArrow(lambda b, most=most: _told(most, length, b), FOUND), "pieces")
        own, few = found.filter("kind = 1").select("id", "print", "a", "b"), _wanted(docs, found, 0, length)
        size = found.filter("kind = 0").agg(F.coalesce(F.sum(F.col("b") + length), F.lit(0)).alias("n")).first()["n"]
        few = few.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-size // BIN)))))
        few = few.withColumn("gram", F.lit(gram))
        spans = own if spans is None else spans.unionByName(own)
        cold = few if cold is None else cold.unionByName(few)
        if gram == length or found.filter("kind = 2").isEmpty():
            break
        texts = _wanted(docs, found, 2, length).select("id", "print", "at", F.col("bytes").alias("bytes"))
    merged = cold.groupBy("gram", "bin").applyInArrow(lambda t: _merged(length, t), SPAN)
    return spans.unionByName(merged)


def without_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, pieces: int = PIECES
) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``spans`` (the removed runs as byte places)
    and ``kept``, the bytes left.

    Strings are judged on the input and do not cross documents; overlaps count, a
    string may also begin earlier in its own document. A null text is empty. Ids are
    whole numbers; a missing one counts as the smallest. Of rows with one id and
    different texts, a hash of the text decides which is earlier; rows equal in id
    and text are one document, and each gives a row. Other columns take no part.
    """
    least = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id).cast("long"), least).alias("id"), text_or_empty(text).alias("bytes"))
    seen = rows.agg(F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    single = F.lit(0).cast("long") if seen["n"] == seen["d"] else F.xxhash64("bytes")
    rows = rows.withColumn("print", single).select("id", "print", "bytes")
    # A row that came twice is one document, not a copy of itself.
    once = rows if seen["n"] == seen["d"] else rows.dropDuplicates(["id", "print"])
    lost = repeated(once, length, pieces).groupBy("id", "print")
    lost = lost.agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    none = F.array().cast("array<long>")
    found = rows.join(lost, ["id", "print"], "left")
    found = found.withColumns({c: F.coalesce(c, none) for c in ("a", "b")})
    out = "id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary"
    found = found.mapInArrow(_kept, out)
    whole = F.when(F.col("id") != least, F.col("id")).cast(docs.schema[id].dataType)
    return found.select(whole.alias(id), "n_bytes", "n_removed", "spans", "kept")
