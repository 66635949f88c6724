"""Corrections to a table, as a batch: each function gives the new version.

Write a version to a new path (``sources.sinks.write_table``), or only the months
that are touched (``sources.versions``); the version being read is never
overwritten. Keys are few compared with the table, so the
table is not sorted or regrouped: a key list that is small enough is sent to
the table's rows, a long one is joined. Either side of every join here comes from an
exchange of its own (``common.grouped``, ``common.key_frame``), so that Spark splits a key
with a very large share of the rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import dates
from fleetbooks.functions.text import flipped, with_dated_note
from fleetbooks.operators.common import flag_ids, grouped, in_order, key_frame

Ids = DataFrame | Sequence[int]

SETTLED = "Settled"
MARKED_PAID = "Marked Paid"


def settle(
    sp: DataFrame,
    ids: Ids,
    payer: str,
    mode: str,
    as_of: dt.date | str,
    label: str = SETTLED,
    joined: bool = False,
) -> DataFrame:
    """Sets payer and mode of the listed spendings and notes it in the reason.

    Rows that were already paid are not left out; settling twice changes only
    the reason again. ``label=MARKED_PAID`` is the single-row form. ``joined`` joins a
    Python list instead of testing it in a predicate.
    """
    listed = F.col("__listed")
    note = with_dated_note("reason", label, dates.day(as_of))
    changed = {"spended_by": F.lit(payer), "mode": F.lit(mode), "reason": note}
    return flag_ids(sp, ids, "__listed", joined=joined).select(
        *[
            F.when(listed, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
            for c in sp.columns
        ]
    )


def toggle_marks(sp: DataFrame, ids: Ids) -> DataFrame:
    """Flips ``marked`` of the listed spendings; NULL counts as not marked.

    An id listed twice is flipped twice.
    """
    turns = grouped(key_frame(sp, ids), ["id"], F.count(F.lit(1)).alias("__turns"))
    once = flipped("marked")
    marked = (
        F.when(F.col("__turns").isNull(), F.col("marked"))
        .when(F.col("__turns") % 2 == 1, once)
        .otherwise(~once)
    )
    return in_order(sp.join(turns, "id", "left"), sp.columns).select(
        *[marked.alias(c) if c == "marked" else F.col(c) for c in sp.columns]
    )


def _present(keys: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """The keys that ``base`` has.

    The table is cut down to the wanted keys before they are made distinct; if
    these are few, its other keys are dropped at the scan.
    """
    return grouped(base.select(key).join(keys.select(key), key, "left_semi"), [key])


def require_existing(changes: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Changes whose record exists."""
    return changes.join(_present(changes, base, key), key, "left_semi").select(*changes.columns)


def unknown_keys(changes: DataFrame, base: DataFrame, key: str = "id") -> DataFrame:
    """Changes whose record does not exist."""
    return changes.join(_present(changes, base, key), key, "left_anti").select(*changes.columns)


def latest_per_key(changes: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """One change per key as (key, struct ``change``): the last by ``seq``.

    A map-side combined MAX over the whole row, so a key that is changed
    without end never gathers in one task. A MAX of rows with text is a sorted
    aggregation: the changes, not the table, are sorted before they move. Without
    ``seq``, or where it ties, the largest row counts, which is at least the same
    one every time.
    """
    values = [c for c in changes.columns if c not in (key, seq)]
    order = [seq] if seq is not None else []
    return grouped(changes, [key], F.max(F.struct(*order, *values)).alias("change"))


def apply_updates(
    base: DataFrame, changes: DataFrame, key: str = "id", seq: str | None = None
) -> DataFrame:
    """Replaces the fields of every row whose key has a change.

    ``changes`` holds the key and the columns to set, NULL included; columns
    it lacks stay as they are. Of several changes per key the last by ``seq``
    counts. Changes without a record do nothing here; ``unknown_keys`` reports
    them.
    """
    values = [c for c in changes.columns if c not in (key, seq)]
    last = latest_per_key(changes.filter(F.col(key).isNotNull()), key, seq)
    hit = F.col("change").isNotNull()
    return base.join(last, key, "left").select(
        *[
            F.when(hit, F.col("change")[c].cast(base.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c in values
            else F.col(c)
            for c in base.columns
        ]
    )


def delete_rows(base: DataFrame, ids: Ids, key: str = "id", joined: bool = False) -> DataFrame:
    """The table without the listed rows.

    Also the cascade to a child table, with ``key`` the child's foreign key: a
    NULL key refers to nothing and its row stays. ``joined`` joins a Python list
    instead of testing it in a predicate.
    """
    if not isinstance(ids, DataFrame) and not joined:
        listed = F.col(key).isin([int(i) for i in ids])
        return base.filter(~F.coalesce(listed, F.lit(False)))
    kept = base.join(key_frame(base, ids, key), key, "left_anti")
    return kept.select(*base.columns)


def detach_rows(children: DataFrame, ids: Ids, key: str, joined: bool = False) -> DataFrame:
    """Children of deleted rows keep their row and lose the reference.

    ``joined`` joins a Python list instead of testing it in a predicate.
    """
    flagged = flag_ids(children, ids, "__gone", key, joined)
    kept_key = F.when(~F.col("__gone"), F.col(key)).alias(key)
    return flagged.select(*[kept_key if c == key else F.col(c) for c in children.columns])
