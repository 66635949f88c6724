"""Sums that are kept and brought up to date, instead of added up from nothing.

A table's sums have its own columns: the ones reports group and filter by, and the amount,
added up; ``rows`` says how many rows stand behind one. So a report of totals takes
the sums in the table's place and gives the same figures. Sums are mergeable: a change
takes away those of the touched rows as they were and adds those of the rows as they are now, and only
touched rows are read. Amounts are exact, so nothing drifts.

A last date cannot be taken away from a maximum. Company sales and receipts are
therefore summed by day, and their last date is the last day that has rows left.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.operators.common import stacked

# Wide enough for any total, and the same however often sums are merged.
_TOTAL = "decimal(28,2)"

# What reports of totals group, filter and join by, and the amount.
SUMMED: Mapping[str, tuple[tuple[str, ...], str]] = {
    "spendings": (("vehicle_id", "expense_month", "category", "spended_by", "mode"), "amount"),
    "payments": (("vehicle_id", "company_id"), "amount"),
    "employee_advances": (("employee_name",), "amount"),
    "hired_vehicle_transactions": (("hired_vehicle_id", "transaction_type", "month_year"), "amount"),
    "company_sales": (("company_name", "sale_date", "month_year"), "sale_amount"),
    "company_payments": (("company_name", "payment_date", "month_year"), "received_amount"),
}


def _merged(parts: DataFrame, table: str) -> DataFrame:
    keys, amount = SUMMED[table]
    return parts.groupBy(*keys).agg(F.sum(amount).cast(_TOTAL).alias(amount), F.sum("rows").alias("rows"))


def sums(rows: DataFrame, table: str) -> DataFrame:
    """The sums of a table, or of some of its rows: keys, amount and ``rows``."""
    keys, amount = SUMMED[table]
    return rows.groupBy(*keys).agg(F.sum(amount).cast(_TOTAL).alias(amount), F.count(F.lit(1)).alias("rows"))


def after_change(kept: DataFrame, before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """``kept`` once the rows ``before`` have become the rows ``after``.

    Both hold whole rows: the touched ones, or all of the touched months, as they were and as they
    are. New rows are only in ``after``, deleted ones only in ``before``. Groups that
    have no rows left are dropped, also where their amounts add up to nothing by chance others stay.
    """
    keys, amount = SUMMED[table]
    gone = sums(before, table).select(*keys, (-F.col(amount)).alias(amount), (-F.col("rows")).alias("rows"))
    return _merged(stacked(kept, gone, sums(after, table)), table).filter(F.col("rows") != 0)
