"""SimHash near copies by Golay-code fuzzy hashing.

A fingerprint has 64 bits in three segments, each filled up to a 23-bit word.
With at most 4 bits of difference, at least two segments differ in 2 bits or
less, and two words that near have a codeword within 4 bits in common. So the
keys of a fingerprint are, for each two segments, the numbers of such codewords
of both (84 keys in the mean); what shares a key is compared bit by bit.

Equal fingerprints are one node from the start. A key with more than ``BLOCK``
fingerprints is cut finer: by a codeword of the third segment, if that differs in 2
bits or less, and else by the value of one of the other two, which then do not both
differ. What is still large is dealt out as pairs of blocks of about ``BLOCK``. Within
a key only a tree of links leaves the task, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import buffers, chunks, mixed, text_or_empty, written
from fleetbooks.llm.components import components
from fleetbooks.llm.golay import Golay

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # lowest bit and width
PAIRS = ((0, 1), (0, 2), (1, 2))
BLOCK = 1000
MOST_BITS = 4


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=begin[1:])
    last = begin[min(shingle, len(words)) :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begin.tolist(), last.tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``id`` and ``print`` (64 bits as a long) of each row.

    A-Z are lower-cased, words are parted by ASCII white space. Shingles count as
    often as they occur; a text of fewer words is one shingle, one without words
    (null, empty, blank) has fingerprint 0. Every row gives one row.
    """
    rows = rows.select(F.col(id).alias("id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, prints = batch.column("text"), np.zeros(batch.num_rows, np.int64)
            data, starts = buffers(column)
            for low, high in chunks(starts):
                for k in range(low, high):
                    prints[k] = fingerprint(data[starts[k] : starts[k + 1]].tobytes(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints)], ["id", "print"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, print long")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [((bits >> np.uint64(k)) & np.uint64((1 << width) - 1)).astype(np.int64) for k, width in SEGMENTS]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            prints = np.asarray(batch.column("print")[low : low + 2000])
            near = [golay.near(word) for word in _segments(prints)]
            made = []
            for kind, (a, b) in enumerate(PAIRS):
                left, right = near[a][:, :, None], near[b][:, None, :]
                key = (kind << 24 | left << 12 | right)
                row, i, j = np.nonzero((left >= 0) & (right >= 0))
                made.append((key[row, i, j], prints[row]))
            key, own = (np.concatenate(x) for x in zip(*made))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "print"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large keys under keys that say more."""
    golay = Golay()
    for batch in batches:
        key, prints = (np.asarray(batch.column(c)) for c in ("key", "print"))
        words = np.stack(_segments(prints))
        each = np.arange(len(key))
        one, other = np.array(PAIRS)[key >> 24].T
        near = golay.near(words[3 - one - other, each])
        row, place = np.nonzero(near >= 0)
        more = [(row, 0, near[row, place]), (each, 1, words[one, each]), (each, 2, words[other, each])]
        made = [(mixed(key[r].astype(np.uint64) << np.uint64(2) | np.uint64(k)) ^ v.astype(np.uint64), r) for r, k, v in more]
        finer = mixed(np.concatenate([x for x, _ in made])).view(np.int64)
        own = prints[np.concatenate([r for _, r in made])]
        yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(own)], ["key", "print"])


def _tree(key: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is joined by pairs with one key and few different bits."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.arange(len(key) - 1)
    step = 1
    while len(at):  # places that have a partner ``step`` further on
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= bits]
        left.append(near)
        right.append(near + step)
        step += 1
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(len(key))
    while True:
        old = root.copy()
        np.minimum.at(root, b, root[a])
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (old == root).all():
            break
    own = np.flatnonzero(root != np.arange(len(key)))
    return root[own], own


def _links(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; the last key of a batch waits for the next."""
    key, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def done(cut: int) -> pa.RecordBatch:
        a, b = _tree(key[:cut], prints[:cut], bits)
        pairs = np.unique(np.stack([prints[:cut][a], prints[:cut][b]]).view(np.int64), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    for batch in batches:
        key = np.concatenate([key, np.asarray(batch.column("key"))])
        prints = np.concatenate([prints, np.asarray(batch.column("print")).view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if cut:
            yield done(cut)
            key, prints = key[cut:], prints[cut:]
    if len(key):
        yield done(len(key))


def _large(keys: DataFrame, block: int) -> DataFrame:
    """Keys with more than ``block`` fingerprints, and how many blocks that makes."""
    counts = keys.groupBy("key").count().filter(F.col("count") > block)
    return written(counts.select("key", F.ceil(F.col("count") / block).alias("n")), "large-keys")


def _blocks(keys: DataFrame, block: int) -> DataFrame:
    """``keys`` with every large key in pairs of blocks, each under a key of its own."""
    parted = keys.join(_large(keys, block), "key", "left")
    own = F.pmod(F.xxhash64("print"), F.col("n"))
    other = F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1)))
    parted = parted.select("key", "n", "print", own.alias("own"), other.alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return parted.select(F.when(F.col("n").isNull(), F.col("key")).otherwise(pair).alias("key"), "print")


def links(prints: DataFrame, bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that join all different fingerprints of ``prints`` (column
    ``print``) which chains of pairs with at most ``bits`` different bits join."""
    if not 0 <= bits <= MOST_BITS:
        raise ValueError(f"at most {MOST_BITS} bits: more could differ in two segments by over 2")
    different = written(prints.select("print").distinct(), "prints")
    # A small table with many keys to come: more tasks than its files have blocks.
    different = different.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = different.mapInArrow(_keys, "key long, print long")
    large = _large(keys, block).select("key")
    parted = keys.join(large, "key", "left_anti")
    if not large.isEmpty():
        finer = keys.join(large, "key", "left_semi").mapInArrow(_finer, "key long, print long")
        parted = parted.unionByName(_blocks(written(finer, "finer-keys"), block))
    parted = parted.repartition("key").sortWithinPartitions("key")
    return parted.mapInArrow(lambda b: _links(bits, b), "a long, b long")


def hexed(print: Column) -> Column:
    return F.lpad(F.lower(F.hex(print)), 16, "0")


def near_copies(
    rows: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = MOST_BITS
) -> DataFrame:
    """Per row: ``id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id that chains of links reach, its own included.

    Two rows are linked if their fingerprints differ in at most ``bits`` bits;
    texts without words have fingerprint 0 and are linked like any other. Rows
    without an id are linked as well, and get the smallest id there is, or null.
    Repeated rows come out as often as they came in.
    """
    prints = written(fingerprints(rows, id, text, shingle), "fingerprints")
    roots = written(components(links(prints, bits)), "roots")
    rooted = prints.join(roots, prints["print"] == roots["node"], "left")
    rooted = written(rooted.select("id", "print", F.coalesce("root", "print").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "components")
    found = rooted.join(least, "root")
    return found.select(F.col("id").alias(id), hexed(F.col("print")).alias("fingerprint"), "component_id")


def one_of_each(
    rows: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = MOST_BITS
) -> DataFrame:
    """Of each group that ``near_copies`` links the row with the smallest id, with all its
    columns. A missing id is the smallest; of rows with one id, a hash of the text
    decides, and of rows equal in both one stays."""
    keyed = rows.select(
        F.struct(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("print")).alias("key"),
        text_or_empty(text).alias("text"),
        F.struct("*").alias("row"),
    )
    found = written(near_copies(keyed.select("key", "text"), "key", "text", shingle, bits), "groups")
    stays = written(found.filter("key = component_id").groupBy("key").count(), "stays")
    kept = keyed.join(stays, "key").select("key", "count", "row")
    if not stays.filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key"])
    return kept.select("row.*")
