"""Hired vehicles: what each sold and what it was paid."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import dates, money
from fleetbooks.operators.common import by_ids, by_name, in_order, recent

Month = dt.date | str

# Fixed values of transaction_type; any other type counts in neither sum.
SALE = "sale"
PAYMENT = "payment"


def with_hired(t: DataFrame, hv: DataFrame) -> DataFrame:
    """Transactions with the hired vehicle's number and owner."""
    vehicles = hv.select(F.col("id").alias("hired_vehicle_id"), "vehicle_no", "owner_name")
    return in_order(t.join(vehicles, "hired_vehicle_id"), t.columns)


def recent_hired_txn(hv: DataFrame, t: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest transactions; ties are settled by all other columns."""
    return recent(with_hired(t, hv), n, "transaction_date", "created_at")


def hired_detail(t: DataFrame, vehicle_id: int, month: Month) -> DataFrame:
    """One vehicle's transactions of one month in the order they were made."""
    rows = t.filter(
        (F.col("hired_vehicle_id") == vehicle_id) & (F.col("month_year") == dates.day(month))
    )
    return by_name(rows, "transaction_date", "created_at")


def _total_of(kind: str) -> Column:
    return F.sum(F.when(F.col("transaction_type") == kind, F.col("amount")).otherwise(F.lit(0)))


def hired_summary(
    hv: DataFrame, t: DataFrame, month: Month | None = None, vehicle_id: int | None = None
) -> DataFrame:
    """Sales and payments per hired vehicle, all time or of one month.

    Every hired vehicle is kept, with zeros when it has no transactions: they
    are filtered and added up before the outer join, not after it.
    """
    if month is not None:
        t = t.filter(F.col("month_year") == dates.day(month))
    if vehicle_id is not None:
        t = t.filter(F.col("hired_vehicle_id") == vehicle_id)
        hv = hv.filter(F.col("id") == vehicle_id)
    totals = (
        t.filter(F.col("hired_vehicle_id").isNotNull())
        .groupBy(F.col("hired_vehicle_id").alias("id"))
        .agg(_total_of(SALE).alias("sales"), _total_of(PAYMENT).alias("payments"))
    )
    rows = hv.select("id", "vehicle_no", "owner_name").join(totals, "id", "left")
    return by_name(
        rows.select(
            "id",
            "vehicle_no",
            "owner_name",
            money.zero_if_null(F.col("sales")).alias("total_sales"),
            money.zero_if_null(F.col("payments")).alias("total_payments"),
        ),
        "vehicle_no",
    )


def hired_net_balance(hv: DataFrame, t: DataFrame, month: Month) -> DataFrame:
    """``hired_summary`` of a month without ids, with sales minus payments."""
    return hired_summary(hv, t, month).select(
        "vehicle_no",
        "owner_name",
        "total_sales",
        "total_payments",
        (F.col("total_sales") - F.col("total_payments")).alias("net_balance"),
    )


def lookup_hired_txn(t: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    return by_ids(t, keys).select(
        "id",
        "transaction_type",
        dates.day_label("transaction_date").alias("transaction_date"),
        dates.month_label("month_year").alias("month_year"),
        F.col("amount").cast("double").alias("amount"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("reference_no", F.lit("")).alias("reference_no"),
    )
