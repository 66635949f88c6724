"""Own vehicles: what they cost, what is paid, and the money received.

Reports that need a vehicle's number add up by ``vehicle_id`` first and join
afterwards, so the join sees one row per vehicle (and month) instead of every
spending. No join carries a broadcast hint: Spark broadcasts a vehicle list
that is small enough and shuffles one that is not.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import dates, money
from fleetbooks.functions.predicates import is_paid, is_touched, is_unpaid
from fleetbooks.operators.common import (
    by_ids,
    by_name,
    in_order,
    newest_first,
    recent,
    row_count,
    since_nth_newest,
    stacked,
)

Month = dt.date | str


def _vehicle_names(veh: DataFrame) -> DataFrame:
    return veh.select(F.col("id").alias("vehicle_id"), "vehicle_no")


def with_vehicle(sp: DataFrame, veh: DataFrame) -> DataFrame:
    """Spendings with ``vehicle_no``; rows without a known vehicle are left out."""
    return in_order(sp.join(_vehicle_names(veh), "vehicle_id"), sp.columns)


def _listed(df: DataFrame, ordered: bool) -> DataFrame:
    """A total order is a shuffle of all rows, and Spark runs the plan below it
    once more to find the ranges; ``ordered=False`` leaves it out."""
    return newest_first(df, "date") if ordered else df


# --- detail lists -----------------------------------------------------------


def paid_spendings(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    return _listed(with_vehicle(sp.filter(is_paid()), veh), ordered)


def unpaid_spendings(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    return _listed(with_vehicle(sp.filter(is_unpaid()), veh), ordered)


def touched_spendings(sp: DataFrame) -> DataFrame:
    """Rows the dashboard counts as debited: payer or mode known."""
    return sp.filter(is_touched())


def recent_paid(
    sp: DataFrame, veh: DataFrame, as_of: Month, days: int = 30, ordered: bool = True
) -> DataFrame:
    """Paid on or after ``as_of`` minus ``days``."""
    return paid_spendings(sp.filter(F.col("date") >= dates.days_before(as_of, days)), veh, ordered)


def settled_paid(
    sp: DataFrame, veh: DataFrame, as_of: Month, days: int = 30, ordered: bool = True
) -> DataFrame:
    """Paid before ``as_of`` minus ``days``."""
    return paid_spendings(sp.filter(F.col("date") < dates.days_before(as_of, days)), veh, ordered)


def month_detail(sp: DataFrame, veh: DataFrame, month: Month, ordered: bool = True) -> DataFrame:
    """One month's spendings by category and date."""
    rows = with_vehicle(sp.filter(F.col("expense_month") == dates.day(month)), veh)
    return by_name(rows, "category", "date") if ordered else rows


def vehicle_spendings(
    sp: DataFrame, vehicle_id: int, month: Month | None = None, ordered: bool = True
) -> DataFrame:
    """One vehicle's spendings, optionally of the month with that label."""
    rows = sp.filter(F.col("vehicle_id") == vehicle_id)
    if month is not None:
        rows = rows.filter(dates.in_month("expense_month", month))
    return newest_first(rows, "date") if ordered else rows


def payer_spendings(sp: DataFrame, payer: str) -> DataFrame:
    """Everything one payer spent; the mode is not looked at."""
    return sp.filter(F.col("spended_by") == payer)


def latest_spendings(sp: DataFrame, veh: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest spendings by month, then date."""
    cols = [
        "id",
        "vehicle_no",
        "date",
        "expense_month",
        "category",
        "reason",
        "amount",
        "spended_by",
        "mode",
    ]
    return recent(with_vehicle(sp, veh).select(cols), n, "expense_month", "date")


def payments_detail(
    pay: DataFrame, comp: DataFrame, veh: DataFrame, ordered: bool = True
) -> DataFrame:
    """Payments with company name and vehicle number where they have them."""
    companies = comp.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    rows = pay.join(companies, "company_id", "left").join(_vehicle_names(veh), "vehicle_id", "left")
    return _listed(in_order(rows, pay.columns), ordered)


def available_months(sp: DataFrame) -> DataFrame:
    """Months with spendings, newest first, as ``YYYY-MM``."""
    months = sp.select("expense_month").filter(F.col("expense_month").isNotNull()).distinct()
    return months.orderBy(F.col("expense_month").desc()).select(
        dates.month_label("expense_month").alias("month")
    )


def lookup_spendings(sp: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    """The edit form's record for each id: blanks for NULL text, dates as text."""
    return by_ids(sp, keys).select(
        "id",
        dates.day_label("date").alias("date"),
        F.coalesce(dates.month_label("expense_month"), F.lit("")).alias("expense_month"),
        "vehicle_id",
        "category",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.col("amount").cast("double").alias("amount"),
        F.coalesce("spended_by", F.lit("")).alias("spended_by"),
        F.coalesce("mode", F.lit("")).alias("mode"),
    )


# --- totals -----------------------------------------------------------------


def vehicle_totals(veh: DataFrame, sp: DataFrame) -> DataFrame:
    """Spent per vehicle, 0 for a vehicle without spendings."""
    spent = (
        sp.filter(F.col("vehicle_id").isNotNull())
        .groupBy(F.col("vehicle_id").alias("id"))
        .agg(F.sum("amount").alias("spent"))
    )
    return veh.select("id", "vehicle_no").join(spent, "id", "left").select(
        "id", "vehicle_no", money.zero_if_null(F.col("spent")).alias("total_spent")
    )


def dashboard_totals(veh: DataFrame, pay: DataFrame, sp: DataFrame, as_of: Month) -> DataFrame:
    """The dashboard's one row of numbers.

    The three tables are reduced together, each scanned once and combined
    map-side, so one tiny shuffle gives all six figures.
    """
    amount, month = F.col("amount"), F.col("expense_month")
    rows = stacked(
        veh.select(F.lit(1).cast("long").alias("vehicle")),
        pay.select(amount.alias("credit")),
        sp.select(
            F.when(is_touched(), amount).alias("debit"),
            F.when(month == dates.current_month(as_of), amount).alias("current"),
            F.when(month == dates.previous_month(as_of), amount).alias("previous"),
        ),
    )
    return rows.agg(
        F.count("vehicle").alias("vehicles"),
        money.total("credit").alias("credited"),
        money.total("debit").alias("debited"),
        (money.total("credit") - money.total("debit")).alias("balance"),
        money.total("current").alias("current_month"),
        money.total("previous").alias("prev_month"),
    )


def _sum_by_vehicle(sp: DataFrame, veh: DataFrame, total: str, *keys: str) -> DataFrame:
    """SUM per (``keys``, vehicle_no), joined after adding up by vehicle_id."""
    per_id = sp.groupBy(*keys, "vehicle_id").agg(F.sum("amount").alias("part"))
    return (
        per_id.join(_vehicle_names(veh), "vehicle_id")
        .groupBy(*keys, "vehicle_no")
        .agg(F.sum("part").alias(total))
    )


def month_by_vehicle(sp: DataFrame, veh: DataFrame, month: Month) -> DataFrame:
    """Spent per vehicle in one month, largest first."""
    rows = sp.filter(F.col("expense_month") == dates.day(month))
    return newest_first(_sum_by_vehicle(rows, veh, "monthly_total"), "monthly_total", total=True)


def month_vehicle_expenses(sp: DataFrame, veh: DataFrame, month: Month) -> DataFrame:
    """As ``month_by_vehicle``, with the month's label."""
    label = dates.month_label(dates.day(month)).alias("expense_month")
    return month_by_vehicle(sp, veh, month).select("vehicle_no", label, "monthly_total")


def monthly_trend(sp: DataFrame, as_of: Month, months: int = 6) -> DataFrame:
    """Spent per month since ``as_of`` minus ``months``.

    The cut is a date, not a month: seen from the 1st it reaches one month
    further back, and there is no upper end. Months are kept apart by date, so
    two rows may show one label.
    """
    rows = sp.filter(F.col("expense_month") >= dates.months_before(as_of, months))
    return (
        rows.groupBy("expense_month")
        .agg(F.sum("amount").alias("total_expense"))
        .orderBy(F.col("expense_month").desc_nulls_first())
        .select(dates.month_label("expense_month").alias("month"), "total_expense")
    )


def paid_unpaid_totals(sp: DataFrame) -> DataFrame:
    return sp.agg(
        money.total_when(is_paid()).alias("total_spent"),
        money.total_when(is_unpaid()).alias("total_unpaid"),
    )


def paid_monthly_totals(sp: DataFrame) -> DataFrame:
    """Paid amount per expense month, newest first; no month is a group too."""
    return (
        sp.filter(is_paid())
        .groupBy("expense_month")
        .agg(money.total("amount").alias("monthly_total"))
        .orderBy(F.col("expense_month").desc_nulls_first())
    )


def overall_monthly_expenses(sp: DataFrame) -> DataFrame:
    """``paid_monthly_totals`` for display: month label, amount as double."""
    return paid_monthly_totals(sp).select(
        dates.month_label("expense_month").alias("expense_month"),
        F.col("monthly_total").cast("double").alias("total_monthly_expense"),
    )


def total_credited(pay: DataFrame) -> DataFrame:
    return pay.agg(money.total("amount").alias("total_credited"))


def month_total(sp: DataFrame, month: Month) -> DataFrame:
    return sp.filter(F.col("expense_month") == dates.day(month)).agg(
        money.total("amount").alias("total")
    )


def monthly_expenses(sp: DataFrame, veh: DataFrame) -> DataFrame:
    """Paid amount per month and vehicle, newest month and largest amount first."""
    return (
        _sum_by_vehicle(sp.filter(is_paid()), veh, "total_expense", "expense_month")
        .orderBy(
            F.col("expense_month").desc_nulls_first(),
            F.col("total_expense").desc_nulls_first(),
            F.col("vehicle_no"),
        )
        .select(dates.month_label("expense_month").alias("month"), "vehicle_no", "total_expense")
    )


# What each form of the expense summary is grouped by.
BY_CATEGORY = "category"
BY_VEHICLE = "vehicle"
BY_MONTH = "month"


def expense_summary(
    sp: DataFrame, veh: DataFrame, by: str = BY_CATEGORY, n: int | None = None
) -> DataFrame:
    """All spendings per month: by vehicle and category, by vehicle, or overall.

    Grouped by date and shown by label. ``n`` keeps the first rows, with ties
    settled by every shown column. The first ``n`` rows lie in the ``n`` newest
    months, each of which has a row or more, so only those are added up.
    """
    if by not in (BY_CATEGORY, BY_VEHICLE, BY_MONTH):
        raise ValueError(f"unknown summary: {by}")
    if n is not None:
        seen = sp if by == BY_MONTH else sp.join(_vehicle_names(veh), "vehicle_id", "left_semi")
        months = seen.select("expense_month").distinct()
        sp = since_nth_newest(sp, n, "expense_month", among=months)
    month = dates.month_label("expense_month").alias("month")
    if by == BY_MONTH:
        rows = sp.groupBy("expense_month").agg(
            F.sum("amount").alias("total_expense"), row_count(sp).alias("transaction_count")
        )
        shown, amount = [month, "total_expense", "transaction_count"], "total_expense"
    elif by == BY_VEHICLE:
        per_id = sp.groupBy("expense_month", "vehicle_id").agg(F.sum("amount").alias("monthly_total"))
        rows = per_id.join(_vehicle_names(veh), "vehicle_id")
        shown, amount = [month, "vehicle_id", "vehicle_no", "monthly_total"], "monthly_total"
    else:
        per_id = sp.groupBy("expense_month", "vehicle_id", "category").agg(
            F.sum("amount").alias("total_amount"), row_count(sp).alias("transaction_count")
        )
        rows = per_id.join(_vehicle_names(veh), "vehicle_id")
        shown = [month, "vehicle_id", "vehicle_no", "category", "total_amount", "transaction_count"]
        amount = "total_amount"
    newest = newest_first(rows, "expense_month", amount, total=True)
    return (newest if n is None else newest.limit(n)).select(*shown)


# --- payers and settlement --------------------------------------------------


def incoming_totals(pay: DataFrame, sp: DataFrame) -> DataFrame:
    """Credit, paid debit and balance as the incoming page has them.

    Debit here is what is paid; the dashboard's also counts half-filled rows.
    """
    rows = stacked(
        pay.select(F.col("amount").alias("credit")),
        sp.filter(is_paid()).select(F.col("amount").alias("debit")),
    )
    credit, debit = money.total("credit"), money.total("debit")
    return rows.agg(
        credit.alias("credited"), debit.alias("debited"), (credit - debit).alias("balance")
    )


def payer_balance(pay: DataFrame, sp: DataFrame, payers: Sequence[str] | None = None) -> DataFrame:
    """Credit, paid debit and balance, and for each payer what is left of the
    whole credit after what that payer spent (the mode is not looked at).

    Spendings are read and reduced once, to a row per payer for what is paid and one
    for the rest; the totals and the payers' sums both start from these. The two
    overall figures are scalar subqueries, not joins. ``payers`` fixes the rows; by
    default every payer with spendings has one.
    """
    parts = (
        sp.filter(F.col("spended_by").isNotNull())
        .groupBy(F.col("spended_by").alias("payer"), is_paid().alias("paid"))
        .agg(F.sum("amount").alias("amount"))
    )
    per_payer = parts.groupBy("payer").agg(money.total("amount").alias("spent"))
    credited = pay.agg(money.total("amount")).scalar()
    debited = parts.agg(money.total_when(F.col("paid"))).scalar()
    rows = per_payer
    if payers is not None:
        listed = sp.sparkSession.createDataFrame([(p,) for p in payers], "payer string")
        rows = listed.join(per_payer, "payer", "left")
    spent = money.zero_if_null(F.col("spent"))
    return by_name(
        rows.select(
            "payer",
            credited.alias("credited"),
            debited.alias("debited"),
            (credited - debited).alias("balance"),
            spent.alias("spent"),
            (credited - spent).alias("payer_balance"),
        ),
        "payer",
    )


def settlement_preview(sp: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """How many rows a settlement of ``ids`` would touch, and their sum."""
    return by_ids(sp, ids).agg(
        F.count(F.lit(1)).alias("selected"), money.total("amount").alias("total")
    )


def ref_counts(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """For each row of ``dim`` how many rows of ``fact`` refer to it through ``key``."""
    counts = (
        fact.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return dim.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0).cast("long")).alias("ref_count")
    )
