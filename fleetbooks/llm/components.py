"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.llm.common import written


def _starred(pairs: DataFrame) -> DataFrame:
    """Each ``a`` with its smallest partner ``m``; both tables are read from files, so
    that Spark can split the join where one ``a`` has very many partners."""
    pairs = written(pairs, "pairs")
    least = written(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
    return pairs.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is joined with, for all nodes of
    ``links`` (columns ``a`` and ``b``) that are not the smallest themselves.

    Alternates two steps until nothing changes: every node's larger neighbours
    move to its smallest neighbour, then its smaller ones do. Both sum up a node's
    neighbours before the shuffle, and the number of rounds grows with the
    logarithm of the longest chain. A node linked with itself, repeated links and
    nulls take no part; no links give no rows.
    """
    links = links.select("a", "b").filter("a != b")
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _starred(both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = _starred(large.filter("a != b").distinct())
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(small.select("a", F.col("m").alias("b")))
        links = written(moved.filter("a != b").distinct(), "links")
