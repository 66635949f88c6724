"""Ordering, key lists and the hot-key join shared by the reports."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetbooks.functions.predicates import any_cell_contains, contains_text

# What one task should have of one key in a fan-out join: result rows, and rows
# of either side. Keys above are split.
PAIRS_PER_PIECE = 10_000_000
ROWS_PER_PIECE = 1_000_000


# Different days of a list that are broadcast, some 40 bytes each.
MOST_DAYS = 200_000


def _tie_break(df: DataFrame, used: Iterable[str], everything: bool) -> list[Column]:
    rest = [c for c in df.columns if c not in set(used)]
    if not everything:
        rest = [c for c in rest if c == "id"]
    return [F.col(c).asc_nulls_last() for c in rest]


def newest_first(df: DataFrame, *dates: str, total: bool = False) -> DataFrame:
    """Descending with NULL first, as the reports list dates and amounts.

    Ties go by ``id`` so that one hot date can still be spread over many sort
    partitions; ``total=True`` breaks ties by every remaining column, which
    makes a following LIMIT give the same rows every time.
    """
    keys = [F.col(c).desc_nulls_first() for c in dates]
    return df.orderBy(*keys, *_tie_break(df, dates, total))


def by_name(df: DataFrame, *names: str) -> DataFrame:
    """Ascending with NULL last; ties by ``id``."""
    keys = [F.col(c).asc_nulls_last() for c in names]
    return df.orderBy(*keys, *_tie_break(df, names, False))


def newest_first_in_pieces(df: DataFrame, date: str, pieces: int, key: str = "id") -> DataFrame:
    """``newest_first(df, date)`` for a long list: partitions in order, each sorted on its own.

    A total order by ``orderBy`` runs the plan below it twice, the first time with all
    columns, to find where ranges begin. Here one pass over ``date`` and ``key`` counts the
    days; a row's piece then follows from its day's place among all rows and, within the day, from
    where its key lies between the day's first and last. So a day that holds most rows is spread
    too, evenly if its keys are. A list of more than ``MOST_DAYS`` days is ordered as before.
    """
    c, k = F.col(date), F.col(key)
    # The days are broadcast, so they are counted first; this reads one column.
    if df.select(c).distinct().count() > MOST_DAYS:
        return newest_first(df, date)
    days = df.groupBy(c.alias("__day")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(k).alias("__low"), F.max(k).alias("__high")
    )
    newer = Window.orderBy(F.col("__day").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
    total = df.agg(F.count(F.lit(1))).scalar()
    within = (k - F.col("__low")).cast("double") / (F.col("__high") - F.col("__low") + 1)
    # A missing key comes last within its day.
    place = F.col("__newer") + F.col("__n") * F.coalesce(within, F.lit(1.0))
    piece = F.least(F.floor(place * pieces / total).cast("int"), F.lit(pieces - 1))
    rows = df.join(F.broadcast(days), c.eqNullSafe(F.col("__day")))
    rows = rows.repartitionById(pieces, piece).select(*df.columns)
    return rows.sortWithinPartitions(c.desc_nulls_first(), k.asc_nulls_last())


def since_nth_newest(
    df: DataFrame, n: int, date: str, among: DataFrame | None = None
) -> DataFrame:
    """Rows of ``df`` that reach the ``n``-th newest ``date`` of ``among``.

    The date is found from that one column (a merged top-n, not a sort) and
    given to the scan of ``df``, which then skips older row groups or month
    directories. NULL counts as newest; with fewer than ``n`` dates all rows stay.
    """
    c = F.col(date)
    newest = (df if among is None else among).select(c).orderBy(c.desc_nulls_first()).limit(n)
    reached = newest.agg(F.min(c)).scalar()
    return df.filter(c.isNull() | (c >= reached))


def recent(df: DataFrame, n: int, *dates: str) -> DataFrame:
    """The ``n`` newest rows by ``dates``; ties are settled by all other columns.

    Only rows that reach the ``n``-th newest date are read in full.
    """
    return newest_first(since_nth_newest(df, n, dates[0]), *dates, total=True).limit(n)


def key_frame(like: DataFrame, ids: DataFrame | Sequence[int], key: str = "id") -> DataFrame:
    """Non-null keys as a one-column frame named ``key``, as often as they are listed.

    Semi and anti joins take it as it is: they do not mind repeats, and both sides
    then come straight from their exchange, so that Spark can split a hot key.
    """
    if not isinstance(ids, DataFrame):
        ids = like.sparkSession.createDataFrame([(int(i),) for i in ids], f"{key} long")
    return ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull())


def grouped(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """``df`` grouped by ``keys``, as the small side of a join on them.

    The keys are grouped inside a struct. The exchange of the aggregation is then not
    the one the join wants: the join gets its own, which Spark's skew handling asks
    for, and a hot key of the other side is split. It moves reduced rows only.
    """
    packed = df.groupBy(F.struct(*keys).alias("__key"))
    rows = packed.agg(*aggs) if aggs else df.select(F.struct(*keys).alias("__key")).distinct()
    rest = [c for c in rows.columns if c != "__key"]
    return rows.select(*[F.col("__key")[k].alias(k) for k in keys], *rest)


def by_ids(
    df: DataFrame, ids: DataFrame | Sequence[int], key: str = "id", joined: bool = False
) -> DataFrame:
    """Rows whose key is listed.

    A Python list is an IN predicate, which reaches the Parquet scan; a frame is a
    semi join, and so is a list with ``joined``, for lists too long for a predicate.
    """
    if not isinstance(ids, DataFrame) and not joined:
        return df.filter(F.col(key).isin([int(i) for i in ids]))
    return df.join(key_frame(df, ids, key), key, "left_semi").select(*df.columns)


def flag_ids(
    df: DataFrame,
    ids: DataFrame | Sequence[int],
    flag: str,
    key: str = "id",
    joined: bool = False,
) -> DataFrame:
    """``df`` with a boolean column ``flag``: is the row's key listed?

    ``joined`` joins a Python list instead of testing it in a predicate.
    """
    if not isinstance(ids, DataFrame) and not joined:
        listed = F.col(key).isin([int(i) for i in ids])
        return df.withColumn(flag, F.coalesce(listed, F.lit(False)))
    keys = grouped(key_frame(df, ids, key), [key]).withColumn(flag, F.lit(True))
    return in_order(df.join(keys, key, "left"), df.columns).withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def in_order(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Columns ``first`` in their order, then the rest; a join by name moves its keys."""
    return df.select(*first, *[c for c in df.columns if c not in set(first)])


def row_count(df: DataFrame) -> Column:
    """COUNT of rows; kept sums (``operators.sums``) say how many rows each stands for."""
    return F.sum("rows") if "rows" in df.columns else F.count(F.lit(1))


def search_any(df: DataFrame, text: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``text`` inside any one cell, ignoring case."""
    return df.filter(any_cell_contains(text, cols or df.columns))


def search_col(df: DataFrame, col: str, text: str) -> DataFrame:
    """Rows with ``text`` inside one column, ignoring case."""
    return df.filter(contains_text(col, text))


def stacked(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; a column a frame lacks is NULL there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: int, rows: int
) -> DataFrame:
    """Heavy keys with the pieces ``__a`` of their left and ``__b`` of their right rows.

    With ``l`` and ``r`` rows a key has ``l * r`` pairs. Pieces of about
    ``sqrt(pairs)`` rows on both sides repeat the fewest rows; where one side
    is smaller than that, it stays whole and the other is cut.
    """
    l, r = F.col("__l"), F.col("__r")
    side = pairs**0.5

    def pieces(own: Column, other: Column) -> Column:
        by_pairs = F.ceil(own * F.least(other, F.lit(side)) / pairs)
        return F.greatest(by_pairs, F.ceil(own / rows), F.lit(1)).cast("int")

    counts = grouped(
        stacked(
            left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")),
            right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")),
        ),
        keys,
        F.sum("__l").alias("__l"),
        F.sum("__r").alias("__r"),
    )
    heavy = counts.filter((l.cast("double") * r > pairs) | (l > rows) | (r > rows))
    return heavy.select(*keys, pieces(l, r).alias("__a"), pieces(r, l).alias("__b"))


def fan_out_left_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    pairs_per_piece: int = PAIRS_PER_PIECE,
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``keys``, many to many, hot keys split.

    Every pair of a key belongs to the result, so a key with a large share of
    both tables would otherwise be matched by one task. Keys are counted first
    (map-side combined). The left rows of a heavy key are dealt by hash into
    ``a`` pieces and its right rows into ``b``; each left piece is repeated for
    the ``b`` right pieces and the reverse, so each pair meets exactly once, in
    one of ``a * b`` groups. Other keys keep one piece and join as usual.

    The list of heavy keys is as long as it is. A short one is broadcast by Spark; a
    long one is joined, and that join is split by Spark where a key is hot. Which
    keys are split never changes the result.

    A repeated left row may find one of the right pieces empty. That copy is
    dropped: ``b > 1`` says the right side has the key, so the row has its
    matches in another piece. With ``b = 1`` an unmatched row is kept.
    """
    keys = list(keys)
    hot = _hot_keys(left, right, keys, pairs_per_piece, rows_per_piece)
    a, b, one = F.col("__a"), F.col("__b"), F.lit(1)

    def dealt(df: DataFrame, own: Column, other: Column, i: str, j: str) -> DataFrame:
        """Own piece by hash of the row; one copy for each piece opposite."""
        dealing = F.xxhash64(*[F.col(c) for c in df.columns if c not in keys])
        return (
            df.join(hot, keys, "left")
            .withColumn(i, F.pmod(dealing, F.coalesce(own, one)).cast("int"))
            .withColumn(j, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1)))
        )

    lefts = dealt(left, a, b, "__i", "__j").withColumn("__split", F.coalesce(b, one) > 1)
    rights = dealt(right, b, a, "__j", "__i").withColumn("__hit", F.lit(True))
    return (
        lefts.drop("__a", "__b")
        .join(rights.drop("__a", "__b"), [*keys, "__i", "__j"], "left")
        .filter(F.col("__hit").isNotNull() | ~F.col("__split"))
        .drop("__i", "__j", "__split", "__hit")
    )
