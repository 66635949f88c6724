"""The Merkle manifest against a plain tree; the layout against its definition."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetbooks.llm import merkle, veb

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return H("".join(told))


def plain_tree(leaves):
    """Root of a run of nodes, and the (side, sibling) steps of each leaf."""
    steps, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            steps[k].append(("R" if other > i else "L") + nodes[other] if other < len(nodes) else "-")
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], steps


def plain_manifest(docs):
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append((row[0], plain_leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, uppers = plain_tree([trees[g][0] for g in order])
    return sorted(
        (
            (id, leaf, trees[g][0], root, tuple(own + upper))
            for g, upper in zip(order, uppers)
            for (id, leaf), own in zip(groups[g], trees[g][1])
        ),
        key=str,
    )


def found(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in df.collect()), key=str)


def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return made.selectExpr("*", "1 AS grp", "2 AS place", "3 AS n", "'x' AS digest", "'y' AS root", "4 AS part").repartition(5)


def recursive(levels, offset=0, node=(0, 0)):
    """(depth, number) -> address, by storing top and bottoms one after the other."""
    if levels == 1:
        return {node: offset}
    upper = levels // 2
    made = recursive(upper, offset, node)
    at = offset + (1 << upper) - 1
    for k in range(1 << upper):
        child = (node[0] + upper, (node[1] << upper) + k)
        made |= recursive(levels - upper, at, child)
        at += (1 << levels - upper) - 1
    return made


@pytest.mark.parametrize("levels", range(1, 11))
def test_addresses(levels):
    layout = veb.Layout(levels)
    want = recursive(levels)
    assert sorted(want.values()) == list(range((1 << levels) - 1))
    assert {(d, k): layout.address(d, k) for d in range(levels) for k in range(1 << d)} == want


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 8, 13, 16])
def test_one_tree(leaves):
    own = [hashlib.sha256(bytes([k])).digest() for k in range(leaves)]
    levels = veb.height(leaves, 8) + 1
    tree = veb.grow(own, levels)
    root, steps = plain_tree([x.hex() for x in own])
    assert tree[:32].hex() == root and len(tree) == 32 * (2**levels - 1)
    assert veb.proofs(tree, leaves, levels, ["up"]) == [s + ["up"] for s in steps]


@pytest.mark.parametrize("height, seed", [(1, 1), (2, 2), (3, 3), (8, 4)])
def test_against_a_plain_tree(spark, monkeypatch, height, seed):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    draw = random.Random(seed)
    langs = [None, "", "-", "en", "=x", "\u00e9", "\U0001f600", "\uffee", *[f"l{k}" for k in range(draw.randint(1, 9))]]
    rows = [
        (draw.choice([None, -5, k, k, k]), draw.choice([None, "", "web"]), draw.choice(langs + ["en"] * 20),
         draw.choice([None, 0, 2**63 - 1]), draw.choice([None, "", "a:b", "\u00e9" * k, "x" * 100_000]))
        for k in range(300)
    ]
    rows += rows[:40]
    assert found(merkle.manifest(docs(spark, rows))) == plain_manifest(rows)


@pytest.mark.parametrize("rows", [1, 2, 256, 257, 513])
def test_sizes_around_a_block(spark, rows):
    made = [(k, None, "en", k, str(k)) for k in range(rows)]
    df = merkle.manifest(docs(spark, made))
    assert found(df) == plain_manifest(made)
    folded = df.select((merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r["ok"] for r in folded.collect())


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    made = [(k, None, f"l{k % 3}", k, str(k)) for k in range(50)]
    other = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64))
    df = merkle.manifest(docs(spark, made), carry={"shown": other})
    got = df.select("doc_id", (merkle.folded(F.coalesce("shown", "leaf"), F.col("proof")) == F.col("root")).alias("ok"))
    assert all(r["ok"] == (r["doc_id"] % 7 != 0) for r in got.collect())


def test_no_rows(spark):
    df = merkle.manifest(docs(spark, []), carry={"kept": F.col("n_chars")})
    assert df.columns == ["doc_id", "kept", "leaf", "subroot", "root", "proof"] and df.collect() == []


def test_many_copies_of_one_row(spark):
    made = [(7, "s", "en", 1, "same")] * 700 + [(k, "s", "en", 1, "own") for k in range(20)]
    assert found(merkle.manifest(docs(spark, made))) == plain_manifest(made)
