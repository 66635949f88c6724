"""A Merkle manifest of a dataset: one digest for all of it, and a proof for each row.

Every row is a leaf. The leaves of a group (a language) stand in order; two by two they
are hashed, then the results, until one node is left, and the groups' last nodes
likewise. The tree of a group of any size is made of aligned subtrees of at most
``2 ** HEIGHT`` leaves: a subtree is one row of a table, its nodes in van Emde Boas
layout, and the roots of these blocks are the leaves of the next round. Proofs are read the other way, from the
last round's subtrees down, by the same addresses.

No task holds more than one block's leaves at a time. A row's place in its group comes
from a range partitioning (a group of any size is spread) and one count for each
partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbooks.llm.common import written
from fleetbooks.llm.veb import NODE, grow, height, proofs

HEIGHT = 8

# The columns of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# monotonically_increasing_id: the partition's number, and 33 bits for the row's.
_BITS = 33


def leaf(fields: Sequence[Column]) -> Column:
    """sha256 (lowercase hex) of all fields, one after the other: ``-`` for null, else bytes, ``:``, value."""

    def told(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[told(c) for c in fields]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to (hex)."""

    def up(node: Column, step: Column) -> Column:
        side, other = F.substring(step, 1, 1), F.substring(step, 2, 2 * NODE)
        both = F.when(side == "L", F.concat(other, node)).when(side == "R", F.concat(node, other)).otherwise(node)
        return F.sha2(both, 256)

    return F.aggregate(proof, leaf, up)


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, within the group, by ``order``, nulls first) and ``n``, the group's rows.

    Rows that are alike in ``order`` take places in any order. ``group`` is never null.
    """
    rows = written(rows.withColumn("nth", F.monotonically_increasing_id()), "leaves")
    # A number of the row ends the order, so that alike rows are spread too.
    keys = [group, *order, "nth"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nth")
    rows = written(rows.withColumn("spot", F.monotonically_increasing_id()), "ordered")
    part, offset = F.shiftright("spot", _BITS), F.col("spot").bitwiseAND((1 << _BITS) - 1)
    rows = rows.select("*", part.alias("part"), offset.alias("offset")).drop("spot")
    counts = rows.groupBy(group, "part").agg(F.count(F.lit(1)).alias("here"), F.min("offset").alias("first"))
    # One row for each partition that has rows of the group.
    own = Window.partitionBy(group)
    before = F.sum("here").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        group, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("since"), F.sum("here").over(own).alias("n")
    )
    found = rows.join(counts, [group, "part"])
    return found.withColumn("place", F.col("offset") + F.col("since")).drop("part", "offset", "since")


def _grown(digests: pa.Array, n: pa.Array) -> pa.Array:
    blocks = zip(digests.to_pylist(), n.to_pylist(), strict=True)
    return pa.array([grow(own, height(many, HEIGHT) + 1) for own, many in blocks], pa.binary())


def _proofs(tree: pa.Array, leaves: pa.Array, n: pa.Array, above: pa.Array) -> pa.Array:
    blocks = zip(*(x.to_pylist() for x in (tree, leaves, n, above)), strict=True)
    found = [proofs(own, k, height(many, HEIGHT) + 1, up) for own, k, many, up in blocks]
    return pa.array(found, pa.list_(pa.list_(pa.string())))


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The subtrees of all rounds as tables; ``nodes``: grp, place, n, digest (binary), row (any struct).

    Each has grp, block, n (the group's nodes in that round), members (place, digest, row in
    order), tree (the block's nodes in van Emde Boas layout) and root.
    """
    grown = F.arrow_udf(_grown, "binary")
    rounds, most = [], nodes.agg(F.max("n").alias("n")).first()["n"]
    while most:
        member = F.struct("place", "digest", "row")
        blocks = nodes.groupBy("grp", "n", F.shiftright("place", HEIGHT).alias("block")).agg(
            F.sort_array(F.collect_list(member)).alias("members")
        )
        blocks = blocks.withColumn("tree", grown(F.col("members")["digest"], F.col("n")))
        blocks = written(blocks.withColumn("root", F.substring("tree", 1, NODE)), f"subtrees-{len(rounds)}")
        rounds.append(blocks)
        if most <= 1 << HEIGHT:
            break
        most = -(-most >> HEIGHT)
        more = F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT)
        none = F.struct(F.lit(None).cast("boolean").alias("none"))
        nodes = blocks.select("grp", F.col("block").alias("place"), more.alias("n"), F.col("root").alias("digest"), none.alias("row"))
    return rounds


def proven(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf of a forest with its proof; ``tops``: grp, above (the last node's own proof), top (any).

    Columns grp, place, digest, row, proof, top.
    """
    read = F.arrow_udf(_proofs, "array<array<string>>")
    above = tops.select("grp", F.lit(0).cast("long").alias("block"), "above", "top")
    for blocks in reversed(rounds):
        found = blocks.select("grp", "block", "n", "members", "tree").join(above, ["grp", "block"])
        found = found.withColumn("proofs", read(F.col("tree"), F.size("members"), F.col("n"), F.col("above")))
        found = found.select("grp", "top", F.inline(F.arrays_zip("members", "proofs")))
        found = found.select("grp", "members.*", F.col("proofs").alias("proof"), "top")
        above = found.select("grp", F.col("place").alias("block"), F.col("proof").alias("above"), "top")
    return found


def _last(rounds: list[DataFrame]) -> DataFrame:
    """Each group's last node as (grp, digest)."""
    return rounds[-1].select("grp", F.col("root").alias("digest"))


def manifest(
    rows: DataFrame,
    id: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """For each row ``id``, the columns ``carry`` (orderable), leaf, subroot, root (hex) and ``proof``.

    A proof has one step for each level from the leaf to the root: ``L`` or ``R``, the side of the
    sibling, and its digest in hex, or ``-`` where a node has none. Leaves of a group
    stand by ``id``, null first, then by leaf; rows that are alike in both are
    each a leaf. Groups stand by their UTF-8 bytes, null first, which is not the empty one. Without rows there is no
    root and no row. Columns that are not named take no part. Subtrees are left in the shared folder.
    """
    carry = carry or {}
    made = leaf([F.col(c) for c in fields])
    kept = F.struct(F.col(id).alias("id"), *[c.alias(f"c{k}") for k, c in enumerate(carry.values())])
    # Null before all others, in one column that is never null.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")
    leaves = rows.select(grp, F.unhex(made).alias("digest"), kept.alias("row"), F.col(id).alias("id"))
    leaves = placed(leaves, "grp", ["id", "digest"]).drop("id")
    rounds = forest(leaves)
    if not rounds:
        hexes = [F.lit("").alias(c) for c in ("leaf", "subroot", "root")]
        steps = F.array().cast("array<string>").alias("proof")
        return rows.select(F.col(id), *[c.alias(k) for k, c in carry.items()], *hexes, steps).limit(0)

    # The groups' last nodes are the leaves of one more group.
    ends = _last(rounds).select(F.lit("").alias("grp"), "digest", F.struct("grp").alias("row"), F.col("grp").alias("of"))
    upper = forest(placed(ends, "grp", ["of"]).drop("of"))
    root = _last(upper).first()["digest"].hex()
    none = F.array().cast("array<string>")
    tops = proven(upper, _last(upper).select("grp", none.alias("above"), F.lit(None).cast("binary").alias("top")))
    tops = written(tops.select("row.grp", F.col("proof").alias("above"), F.col("digest").alias("top")), "groups")
    found = proven(rounds, tops)
    hexed = [F.lower(F.hex(c)).alias(name) for c, name in (("digest", "leaf"), ("top", "subroot"))]
    named = [F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(carry)]
    return found.select(F.col("row.id").alias(id), *named, *hexed, F.lit(root).alias("root"), "proof")
