"""Row predicates.

``is_paid``, ``is_unpaid`` and ``is_touched`` are three different tests. A
half-filled row (payer known, mode missing, or the reverse) is unpaid *and*
touched, so the three must never be folded into one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_paid(payer: str = "spended_by", mode: str = "mode") -> Column:
    """Both the payer and the payment mode are known."""
    return F.col(payer).isNotNull() & F.col(mode).isNotNull()


def is_unpaid(payer: str = "spended_by", mode: str = "mode") -> Column:
    """The payer or the payment mode is missing."""
    return F.col(payer).isNull() | F.col(mode).isNull()


def is_touched(payer: str = "spended_by", mode: str = "mode") -> Column:
    """The payer or the payment mode is known."""
    return F.col(payer).isNotNull() | F.col(mode).isNotNull()


def has_text(col: Column | str) -> Column:
    """Neither NULL nor the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (c != "")


def contains_text(col: Column | str, text: str) -> Column:
    """The column, shown as text, contains ``text``; case does not matter."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.coalesce(c.cast("string"), F.lit(""))).contains(F.lower(F.lit(text)))


def any_cell_contains(text: str, cols: Iterable[str]) -> Column:
    """One single cell of ``cols`` contains ``text``; a match never spans cells."""
    found = F.lit(False)
    for name in cols:
        found = found | contains_text(name, text)
    return found
