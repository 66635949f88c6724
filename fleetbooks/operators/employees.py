"""Employees: advances against what they spent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import dates, money
from fleetbooks.functions.predicates import has_text
from fleetbooks.operators.common import by_ids, by_name, newest_first, stacked
from fleetbooks.operators.fleet import with_vehicle


def employee_names(adv: DataFrame, sp: DataFrame) -> DataFrame:
    """Every name with an advance or a spending; NULL and '' are no names."""
    names = adv.select("employee_name").union(sp.select(F.col("spended_by")))
    return by_name(names.filter(has_text("employee_name")).distinct(), "employee_name")


def employee_balance(adv: DataFrame, sp: DataFrame, all_names: bool = True) -> DataFrame:
    """Advances, expenses and what is left of the advances, per employee.

    Both tables are stacked and added up by name in one shuffle, with the
    amounts combined map-side; a join of two totals would shuffle each side.

    ``all_names=False`` gives the other definition of the balance: only names
    with advances, where an empty name counts as one.
    """
    advanced = adv.select("employee_name", F.col("amount").alias("advance"), F.lit(1).alias("seen"))
    spent = sp.select(F.col("spended_by").alias("employee_name"), F.col("amount").alias("expense"))
    if all_names:
        rows = stacked(advanced, spent).filter(has_text("employee_name"))
    else:
        rows = stacked(advanced, spent.filter(F.col("employee_name").isNotNull()))
    totals = rows.groupBy("employee_name").agg(
        money.total("advance").alias("total_advances"),
        money.total("expense").alias("total_expenses"),
        F.max("seen").alias("seen"),
    )
    if not all_names:
        totals = totals.filter(F.col("seen").isNotNull())
    return by_name(
        totals.select(
            "employee_name",
            "total_advances",
            "total_expenses",
            (F.col("total_advances") - F.col("total_expenses")).alias("balance"),
        ),
        "employee_name",
    )


def employee_summary(balances: DataFrame) -> DataFrame:
    """One row over the result of ``employee_balance``."""
    return balances.agg(
        F.count(F.lit(1)).alias("employees"),
        money.total("total_advances").alias("total_advances"),
        money.total("total_expenses").alias("total_expenses"),
        money.total("balance").alias("net_balance"),
    )


def employee_expense_detail(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    """Spendings with a payer, as the employee page lists them."""
    rows = with_vehicle(sp.filter(has_text("spended_by")), veh)
    if ordered:
        rows = newest_first(rows, "date")
    return rows.select(
        "date",
        F.col("spended_by").alias("employee_name"),
        "amount",
        "vehicle_no",
        "category",
        F.col("reason").alias("purpose"),
    )


def lookup_advances(adv: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    return by_ids(adv, keys).select(
        "id",
        "employee_name",
        dates.day_label("date").alias("date"),
        F.col("amount").cast("double").alias("amount"),
        F.coalesce("purpose", F.lit("")).alias("purpose"),
    )
