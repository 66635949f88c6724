"""URL rules by a cascade of Bloom filters.

A rule is a host, the beginning of a path, and a verdict. It fits a URL whose host is
the rule's or ends in ``.`` and the rule's, if the path begins with the rule's. Where
several fit, the longest (host and path together) wins, and of two as long the one
with the longer host. So the rules that could fit a URL have keys cut from the URL
alone: the last so many labels of its host and the first so many characters of its
path, for each pair of numbers that some rule has (its shape). The keys of all URLs are the universe.
A cascade over it says which are rules, a second one, over the rules alone, which of
these block. URLs are not joined with rules and never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm import cascade
from fleetbooks.llm.cascade import Cascade, is_listed
from fleetbooks.llm.common import written

ALLOW, BLOCK = "allow", "block"

# Bytes of cascades that are sent to all executors at once. Longer lists are dealt
# into parts by hash, each of which meets all URLs.
PART_BYTES = 8_000_000

OUT = ("host", "path", "rule", "verdict")

# What A-Z become.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) after the first ``://``, and path without query and fragment.

    Both are empty if the URL is null or has no ``://``.
    """
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lowered(host), F.regexp_extract(tail, "^[^?#]*", 0)


def labels(host: Column) -> Column:
    """How many labels a host has; an empty one has none."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    return F.when(host == "", 0).otherwise(dots + 1)


class Rules(NamedTuple):
    """What ``fit`` learns: shapes, and for each part of the rules which keys are rules, and which block."""

    shapes: list[tuple[int, int]]
    parts: list[tuple[Cascade, Cascade]]


def _keys(shapes: list[tuple[int, int]]) -> Column:
    """The keys of ``host`` and ``path`` as (length, host's length, key), longest first."""
    host, path = F.col("host"), F.col("path")
    if not shapes:
        return F.expr("cast(array() as array<struct<n: int, size: int, key: string>>)")
    known = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(n).alias("n")) for m, n in shapes])
    own = F.filter(known, lambda s: (s["m"] <= F.col("labels")) & (s["n"] <= F.length(path)))

    def key(s: Column) -> Column:
        ending = F.call_function("substring_index", host, F.lit("."), -s["m"])
        text = F.concat(ending, F.substring(path, F.lit(1), s["n"]))
        return F.struct(F.length(text).alias("n"), F.length(ending).alias("size"), text.alias("key"))

    return F.sort_array(F.transform(own, key), asc=False)


def _cut(rows: DataFrame, url: str, shapes: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with host, path and ``__keys``."""
    host, path = host_and_path(F.col(url))
    # A generator of one row: host and path are worked out once, not once for each use.
    once = F.inline(F.array(F.struct(host.alias("host"), path.alias("path"))))
    kept = [F.col(c) for c in rows.columns if c not in OUT]
    rows = rows.select(*kept, once).withColumn("labels", labels(F.col("host")))
    return rows.select(*kept, "host", "path", _keys(shapes).alias("__keys"))


def fit(rules: DataFrame, rows: DataFrame, url: str = "url", part_bytes: int = PART_BYTES) -> Rules:
    """Cascades of ``rules`` (host, path, verdict) over the keys of all ``rows``.

    Left out are rules with a verdict that is neither allow nor block, and rules that no
    URL can meet: without a host, or with signs in host or path that end these.
    A null path counts as empty: the whole host. Hosts are lowered.
    Of the same rule twice, block wins. The driver holds the shapes, and the bits of all
    parts, about 20 a rule; no URL, key or rule gets there.
    """
    host, path = lowered(F.col("host").cast("string")), F.coalesce(F.col("path").cast("string"), F.lit(""))
    rules = rules.filter(F.col("verdict").isin(ALLOW, BLOCK) & host.rlike("^[^/?#]+$") & path.rlike("^(/[^?#]*)?$"))
    rules = rules.select(
        F.concat(host, path).alias("key"),
        F.struct(labels(host).alias("m"), F.length(path).alias("n")).alias("shape"),
        (F.col("verdict") == BLOCK).alias("block"),
    )
    rules = written(rules.groupBy("key", "shape").agg(F.max("block").alias("block")), "rules")
    shapes = sorted(tuple(r["shape"]) for r in rules.select("shape").distinct().collect())
    rules = rules.select("key", *cascade.hashes(F.col("key")), "block")
    keys = _cut(rows.select(url), url, shapes).select(F.explode("__keys").alias("k")).select(F.col("k")["key"].alias("key"))
    keys = keys.select("key", *cascade.hashes(F.col("key")))

    total, size = rules.count(), keys.agg(F.approx_count_distinct("a").alias("n")).first()["n"]
    # Level 1, and ten bits a rule for the levels after it and the second cascade.
    bits, _ = cascade.size(total, cascade.first_rate(total, size))
    n_parts = -(-(bits + 10 * total) // (8 * part_bytes))
    parts = []
    for k in range(n_parts if total else 0):
        here = F.pmod("b", F.lit(n_parts)) == k
        own = rules.filter(here)
        listed = cascade.build(own, keys.filter(here), size // n_parts)
        parts.append((listed, cascade.build(own.filter("block"), own, own.count())))
    return Rules(shapes, parts)


def _first_listed(part: tuple[Cascade, Cascade], k: int, n_parts: int, a: pa.Array, b: pa.Array) -> pa.Array:
    """For each list of keys twice the place of the first that is a rule, and 1 more if it blocks."""
    lengths = np.asarray(a.value_lengths())
    a, b = (np.asarray(x.flatten()) for x in (a, b))
    own = np.flatnonzero(b % n_parts == k)
    a, b = a.view(np.uint64)[own], b.view(np.uint64)[own]
    hit = np.flatnonzero(is_listed(part[0], a, b))
    blocks = is_listed(part[1], a[hit], b[hit])
    row = np.repeat(np.arange(len(lengths)), lengths)[own[hit]]
    row, first = np.unique(row, return_index=True)
    place = own[hit[first]] - (np.cumsum(lengths) - lengths)[row]
    found, known = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    found[row], known[row] = 2 * place + blocks[first], True
    return pa.array(found, mask=~known)


def _hashed(half: int) -> Column:
    return F.transform("__keys", lambda x: cascade.hashes(x["key"])[half])


def judge(rows: DataFrame, rules: Rules, url: str = "url", otherwise: str = ALLOW) -> DataFrame:
    """``rows`` with ``host``, ``path``, the ``rule`` that decides (host and path), and ``verdict``.

    Where no rule fits, ``rule`` is null and ``verdict`` is ``otherwise``: a URL that is
    exactly known not to be listed. ``rows`` must be those that ``fit`` saw, or some of them. Every row gives one row, copies
    too; one without host (null, empty, no ``://``) meets no rule. Columns of ``rows`` that
    are called like the four new ones give way to them; others are kept as they are.
    """
    spark = rows.sparkSession
    rows = _cut(rows, url, rules.shapes)
    kept = [F.col(c) for c in rows.columns if c != "__keys"]
    n_parts, best = len(rules.parts), F.expr("cast(null as struct<n: int, size: int, key: string, block: boolean>)")
    rows = rows.withColumn("__best", best)
    for k, part in enumerate(rules.parts):
        shared = spark.sparkContext.broadcast(part)
        first = F.arrow_udf(lambda a, b, k=k, s=shared: _first_listed(s.value, k, n_parts, a, b), "long")
        rows = rows.withColumn("__at", first(_hashed(0), _hashed(1)))
        one = F.get("__keys", F.shiftright("__at", 1).cast("int"))
        hit = F.struct(*[one[c].alias(c) for c in ("n", "size", "key")], (F.col("__at") % 2 == 1).alias("block"))
        rows = rows.withColumn("__best", F.greatest("__best", F.when(F.col("__at").isNotNull(), hit)))
        rows = rows.select(*kept, "__keys", "__best")
        if k + 1 < n_parts:
            # One part's filters at a time in a worker.
            rows = written(rows, f"judged-{k}")
    told = F.when(F.col("__best")["block"], BLOCK).when(~F.col("__best")["block"], ALLOW).otherwise(otherwise)
    return rows.select(*kept, F.col("__best")["key"].alias("rule"), told.alias("verdict"))
