"""Lists as the pages show them: money with two decimals, labels, dashes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import labels
from fleetbooks.functions.money import money_text
from fleetbooks.operators import companies, employees, fleet, hired
from fleetbooks.operators.common import newest_first


def employee_balance_labelled(adv: DataFrame, sp: DataFrame, all_names: bool = True) -> DataFrame:
    return employees.employee_balance(adv, sp, all_names).select(
        "employee_name",
        money_text("total_advances").alias("total_advances"),
        money_text("total_expenses").alias("total_expenses"),
        money_text("balance").alias("balance"),
        labels.balance_label("balance").alias("status"),
    )


def spendings_labelled(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    """Spendings with what is shown for missing values and the paid label.

    An empty payer or mode is unpaid here, unlike in the paid totals.
    """
    rows = fleet.with_vehicle(sp, veh)
    if ordered:
        rows = newest_first(rows, "date")
    return rows.select(
        "date",
        "vehicle_no",
        "category",
        labels.shown("reason").alias("reason"),
        money_text("amount").alias("amount"),
        labels.shown("spended_by", labels.UNPAID).alias("paid_by"),
        labels.shown("mode").alias("payment_mode"),
        labels.paid_label().alias("status"),
        F.when(F.coalesce("marked", F.lit(False)), "Yes").otherwise("No").alias("marked"),
    )


def company_ledger_labelled(
    sales: DataFrame, pays: DataFrame, company: str, month: dt.date | str, ordered: bool = True
) -> DataFrame:
    rows = companies.company_ledger(sales, pays, company, month, with_mode=True, ordered=ordered)
    return rows.select(
        "date",
        F.upper("transaction_type").alias("type"),
        labels.shown("reference").alias("reference"),
        money_text("amount").alias("amount"),
        labels.shown(labels.mode_label("payment_mode")).alias("payment_mode"),
        labels.shown("description").alias("description"),
    )


def company_month_labelled(sales: DataFrame, pays: DataFrame, month: dt.date | str) -> DataFrame:
    return companies.company_month(sales, pays, month).select(
        "company_name",
        money_text("sales_amount").alias("sales"),
        money_text("received_amount").alias("received"),
        money_text("pending_amount").alias("pending"),
        labels.pending_class("pending_amount").alias("pending_class"),
    )


def recent_company_payments_labelled(pays: DataFrame, n: int = 20) -> DataFrame:
    return companies.recent_company_payments(pays, n).select(
        "payment_date",
        "company_name",
        money_text("received_amount").alias("received_amount"),
        labels.title_case("payment_mode").alias("payment_mode"),
        labels.shown("reference_number").alias("reference_number"),
    )


def hired_summary_labelled(hv: DataFrame, t: DataFrame) -> DataFrame:
    balance = F.col("total_sales") - F.col("total_payments")
    return hired.hired_summary(hv, t).select(
        "vehicle_no",
        labels.shown("owner_name").alias("owner_name"),
        money_text("total_sales").alias("total_sales"),
        money_text("total_payments").alias("total_payments"),
        money_text(balance).alias("balance"),
        labels.hired_balance_class(balance).alias("balance_class"),
    )


def recent_hired_txn_labelled(hv: DataFrame, t: DataFrame, n: int = 50) -> DataFrame:
    sale = F.col("transaction_type") == hired.SALE
    return hired.recent_hired_txn(hv, t, n).select(
        "transaction_date",
        "vehicle_no",
        labels.title_case("transaction_type").alias("type"),
        F.when(sale, "success").otherwise("danger").alias("type_class"),
        labels.shown("description").alias("description"),
        money_text("amount").alias("amount"),
        labels.shown("reference_no").alias("reference_no"),
    )


def company_summary_labelled(sales: DataFrame, pays: DataFrame) -> DataFrame:
    return companies.company_summary(sales, pays).select(
        "company_name",
        money_text("total_sales").alias("total_sales"),
        money_text("total_received").alias("total_received"),
        money_text("pending_amount").alias("pending_amount"),
        labels.pending_class("pending_amount").alias("pending_class"),
        labels.shown("last_sale_date").alias("last_sale"),
        labels.shown("last_payment_date").alias("last_payment"),
    )


def advances_labelled(adv: DataFrame, ordered: bool = True) -> DataFrame:
    return (newest_first(adv, "date") if ordered else adv).select(
        "date", "employee_name", money_text("amount").alias("amount"), labels.shown("purpose").alias("purpose")
    )
