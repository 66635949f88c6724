"""Nearest neighbours by an adaptive dimension scan within inverted lists.

A bounded sample (``SAMPLE`` vectors) gives the centres of the lists, and how many
lists a query must probe so that ``RECALL`` of its neighbours in the sample are
found; it goes on where these lists hold too few ids. Every vector is put in the list of its nearest centre. In a probed list,
rotated vectors are scanned in blocks of columns: after each block, a hypothesis
test on the distance so far drops candidates that are too far with near certainty,
and only the rest go on. What remains is measured on the original vectors.

A list is dealt out in parts of about ``PART`` vectors and ``QUERIES`` queries, so that
no task holds a whole list; each part gives at most ``k`` ids for a query, each with its
nearest row. Rows equal in id and vector are made one before they are put in lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbooks.llm.common import written

SAMPLE = 20_000
RECALL = 0.98
LISTS = 1024
PART = 4096
QUERIES = 2048
COLUMNS = 16
# Of the hypothesis test: larger drops fewer candidates by mistake.
EPSILON = 2.1


def usable(vector: str) -> Column:
    """Neither null nor zero nor empty, and all components finite."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0)


def _centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    draw = np.random.default_rng(7)
    centres = sample[draw.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        of = _squares(sample, centres).argmin(axis=1)
        counts = np.bincount(of, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, sample)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled][:, None]
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold ``recall`` of the ``k`` nearest of some sampled vectors."""
    asked = sample[:: max(1, len(sample) // 500)]
    of = _squares(sample, centres).argmin(axis=1)
    near = np.argsort(_squares(asked, sample), axis=1, kind="stable")[:, 1 : k + 1]
    place = np.argsort(np.argsort(_squares(asked, centres), axis=1, kind="stable"), axis=1)
    need = np.sort(np.take_along_axis(place, of[near], axis=1).ravel())
    return int(need[min(len(need) - 1, int(recall * len(need)))]) + 1 if len(need) else len(centres)


def fit(rows: DataFrame, k: int, sample: int = SAMPLE, recall: float = RECALL) -> dict[int, dict]:
    """Centres, probes and rotation for each number of dimensions in ``rows`` (columns
    ``id`` and ``v``), the centres as seen from the sample's mean."""
    models = {}
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    for d, n in sorted(sizes.items()):
        drawn = rows.filter(F.size("v") == d).orderBy(F.xxhash64("id", "v"), "id").limit(sample)
        x = _matrix(drawn.select("v").toArrow().column("v"), d)
        # Distances are worked out from products, which must not be large against them.
        mean = x.mean(axis=0)
        x = x - mean
        centres = _centres(x, max(1, min(LISTS, int(n**0.5), len(x) // 20)))
        turn = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
        models[d] = {"mean": mean, "centres": centres, "probes": _probes(x, centres, k, recall), "turn": turn}
    return models


def _sizes(filed: DataFrame, models: dict, unique: bool) -> None:
    """Puts into ``models`` how many ids each list holds that no list before it has."""
    first = filed if unique else filed.groupBy("d", "id").agg(F.min("list").alias("list"))
    for model in models.values():
        model["ids"] = np.zeros(len(model["centres"]), np.int64)
    for r in first.groupBy("d", "list").agg(F.count("*").alias("n")).collect():
        models[r["d"]]["ids"][r["list"]] = r["n"]


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _probed(far: np.ndarray, probes: int, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and list: the nearest ``probes`` lists, and on until they hold ``least`` ids."""
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(ids[order], axis=1) - ids[order]
    query, place = np.nonzero((np.arange(far.shape[1]) < probes) | (before < least))
    return query, order[query, place]


def _routed(models: dict, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its list or, if lists must hold ``least`` ids, with every list that it probes."""
    for batch in batches:
        sizes = np.diff(batch.column("v").offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            own = batch.take(pa.array(np.flatnonzero(sizes == d)))
            for low in range(0, own.num_rows, 2000):
                part = own.slice(low, 2000)
                far = _squares(_matrix(part.column("v"), d) - models[d]["mean"], models[d]["centres"])
                if least:
                    row, lists = _probed(far, models[d]["probes"], models[d]["ids"], least)
                    part = part.take(pa.array(row))
                else:
                    lists = far.argmin(axis=1)
                where = [pa.array(np.full(part.num_rows, d), pa.int32()), pa.array(lists, pa.int32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *where], ["id", "v", "d", "list"])


def _best(a: np.ndarray, id: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Of pairs of query and row the nearest for each query and id, by query and distance."""
    order = np.lexsort((far, id, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order[1:]] != a[order[:-1]]) | (id[order[1:]] != id[order[:-1]])
    order = order[new]
    return order[np.lexsort((id[order], far[order], a[order]))]


def scan(
    queries: np.ndarray, rows: np.ndarray, turn: np.ndarray, k: int, ids: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and row that may be among the ``k`` nearest, by partial distances.
    Rows with one of ``ids`` take one of the ``k`` places together."""
    d = rows.shape[1]
    q, x = queries @ turn, rows @ turn
    best = np.full((len(q), k), np.inf)
    # The ids that hold the places; only needed where one may come again.
    several = ids is not None and len(np.unique(ids)) < len(ids)
    holds = np.zeros((len(q), k), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(x), 512):
        block = x[low : low + 512]
        so_far = _squares(q[:, :COLUMNS], block[:, :COLUMNS])
        limit = best[:, -1]
        a, b = np.nonzero(so_far <= _bound(limit, COLUMNS, d)[:, None])
        so_far = so_far[a, b]
        for col in range(COLUMNS, d, COLUMNS):
            step = q[a, col : col + COLUMNS] - block[b, col : col + COLUMNS]
            so_far = so_far + (step * step).sum(axis=1)
            stay = so_far <= _bound(limit, min(col + COLUMNS, d), d)[a]
            a, b, so_far = a[stay], b[stay], so_far[stay]
        found.append((a, b + low))
        if several:
            old, place = np.nonzero(best < np.inf)
            a = np.concatenate([old, a])
            near, far = np.concatenate([holds[old, place], ids[b + low]]), np.concatenate([best[old, place], so_far])
            top = _best(a, near, far)
            rank = np.arange(len(top)) - np.searchsorted(a[top], a[top])
            top, rank = top[rank < k], rank[rank < k]
            best[a[top], rank], holds[a[top], rank] = far[top], near[top]
            continue
        # The k smallest so far of each query, the new ones put behind the old.
        order = np.lexsort((so_far, a))
        rank = np.arange(len(a)) - np.searchsorted(a[order], a[order])
        new = np.full((len(q), k), np.inf)
        top = order[rank < k]
        new[a[top], rank[rank < k]] = so_far[top]
        best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _bound(limit: np.ndarray, seen: int, d: int) -> np.ndarray:
    """The largest squared distance over ``seen`` columns that the test lets pass."""
    slack = 1.0 if seen >= d else (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / d
    return limit * slack * (1 + 1e-9) + 1e-12


def _searched(models: dict, k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The nearest rows of one part of a list (``left``) for its queries (``right``)."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not left.num_rows or not right.num_rows:
        return kind.empty_table()
    d = left.column("d")[0].as_py()
    x, q = _matrix(left.column("v"), d), _matrix(right.column("v"), d)
    ids, asked = (t.column("id").to_numpy() for t in (left, right))
    # One id more than k, as a query meets itself in its own list.
    mean = models[d]["mean"]
    a, b = scan(q - mean, x - mean, models[d]["turn"], k + 1, ids)
    other = asked[a] != ids[b]
    a, b = a[other], b[other]
    score = np.zeros(len(a))
    for low in range(0, len(a), 100_000):
        step = q[a[low : low + 100_000]] - x[b[low : low + 100_000]]
        score[low : low + 100_000] = np.sqrt((step * step).sum(axis=1))
    order = _best(a, ids[b], score)
    a, b, score = a[order], b[order], score[order]
    top = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pa.table([asked[a[top]], ids[b[top]], score[top]], schema=kind)


def _dealt(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides under part numbers: a list has parts of its rows times parts of its queries."""
    count = lambda df, size: df.groupBy("d", "list").agg(F.ceil(F.count("*") / size).cast("int"))
    parts = count(rows, PART).toDF("d", "list", "rp").join(count(queries, QUERIES).toDF("d", "list", "qp"), ["d", "list"])
    found = []
    for df, own, other in ((rows, "rp", "qp"), (queries, "qp", "rp")):
        df = df.join(F.broadcast(parts), ["d", "list"])  # LISTS rows for each number of dimensions
        df = df.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.col(own)))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        r, q = ("own", "other") if own == "rp" else ("other", "own")
        found.append(df.select("id", "v", "d", "list", F.col(r).cast("int").alias("r"), F.col(q).cast("int").alias("q")))
    return found[0], found[1]


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    sample: int = SAMPLE,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, the Euclidean distance
    on the original vectors in double precision, of the ``k`` nearest rows found.

    Fewer rows than ``k`` are all found. Equal distances go to the smaller id. Rows
    with the query's id are never its neighbours. Vectors that are not ``usable``
    or have no id take no part, on either side; a vector is compared with those of
    as many dimensions. Repeated rows of an id count once, with their smallest
    distance. Empty tables give no rows.
    """
    pick = [F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")]
    rows, queries = (df.filter(F.col(id).isNotNull() & usable(vector)).select(*pick) for df in (rows, queries))
    seen = rows.agg(F.count("id").alias("n"), F.countDistinct("id").alias("d")).first()
    unique = seen["n"] == seen["d"]
    if not unique:  # copies of a row tell nothing new
        rows = written(rows.dropDuplicates(["id", "v"]), "vectors")
    models = fit(rows, k, sample, recall)
    context = rows.sparkSession.sparkContext
    queries = queries.filter(F.size("v").isin(list(models)))
    kind = "id long, v array<double>, d int, list int"
    lists = context.broadcast(models)
    filed = rows.mapInArrow(lambda b: _routed(lists.value, 0, b), kind)
    _sizes(filed, models, unique)
    shared = context.broadcast(models)
    # The query's own id may be one of them.
    asked = queries.mapInArrow(lambda b: _routed(shared.value, k + 1, b), kind)
    filed, asked = _dealt(filed, asked)
    key = ["d", "list", "r", "q"]
    found = filed.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(
        lambda left, right: _searched(shared.value, k, left, right), "query_id long, vec_id long, score double"
    )
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
