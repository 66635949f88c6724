"""Companies: sales, payments received and what is still owed.

Sales and payments are facts of the same kind, so wherever a report sets one
against the other they are stacked and added up by company in one shuffle with
map-side sums. That gives what a full outer join of two totals would, with
both one-sided cases, and a company with a very large share of the rows costs
one partial sum per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions import dates, money
from fleetbooks.operators.common import (
    by_ids,
    by_name,
    fan_out_left_join,
    recent,
    stacked,
)

Month = dt.date | str


def company_names(sales: DataFrame, pays: DataFrame) -> DataFrame:
    """Every company with a sale or a payment."""
    names = sales.select("company_name").union(pays.select("company_name"))
    return by_name(names.distinct(), "company_name")


def recent_sales(sales: DataFrame, n: int = 20) -> DataFrame:
    return recent(sales, n, "sale_date")


def recent_company_payments(pays: DataFrame, n: int = 20) -> DataFrame:
    return recent(pays, n, "payment_date")


def _stacked(sales: DataFrame, pays: DataFrame) -> DataFrame:
    return stacked(
        sales.select("company_name", "sale_date", F.col("sale_amount").alias("sold")),
        pays.select("company_name", "payment_date", F.col("received_amount").alias("received")),
    )


def _of_month(df: DataFrame, month: Month, company: str | None = None) -> DataFrame:
    rows = df.filter(F.col("month_year") == dates.day(month))
    return rows if company is None else rows.filter(F.col("company_name") == company)


def company_summary(sales: DataFrame, pays: DataFrame) -> DataFrame:
    """All-time totals, pending amount and last dates per company."""
    totals = _stacked(sales, pays).groupBy("company_name").agg(
        money.total("sold").alias("total_sales"),
        money.total("received").alias("total_received"),
        F.max("sale_date").alias("last_sale"),
        F.max("payment_date").alias("last_payment"),
    )
    return by_name(
        totals.select(
            "company_name",
            "total_sales",
            "total_received",
            (F.col("total_sales") - F.col("total_received")).alias("pending_amount"),
            dates.day_label("last_sale").alias("last_sale_date"),
            dates.day_label("last_payment").alias("last_payment_date"),
        ),
        "company_name",
    )


def company_month(sales: DataFrame, pays: DataFrame, month: Month) -> DataFrame:
    """Sales, receipts and pending amount of one month; a company with neither
    has no row."""
    rows = _stacked(_of_month(sales, month), _of_month(pays, month))
    totals = rows.groupBy("company_name").agg(
        money.total("sold").alias("sales_amount"), money.total("received").alias("received_amount")
    )
    return by_name(
        totals.withColumn("pending_amount", F.col("sales_amount") - F.col("received_amount")),
        "company_name",
    )


def company_month_one(
    sales: DataFrame, pays: DataFrame, company: str, month: Month
) -> DataFrame:
    """One company's month: always exactly one row, zeros if there is nothing."""
    rows = _stacked(_of_month(sales, month, company), _of_month(pays, month, company))
    sold, received = money.total("sold"), money.total("received")
    return rows.agg(
        F.lit(company).alias("company_name"),
        sold.alias("sales_amount"),
        received.alias("received_amount"),
        (sold - received).alias("pending_amount"),
    )


def company_totals(sales: DataFrame, pays: DataFrame) -> DataFrame:
    """Overall totals and the number of companies, from one pass over each table."""
    per_company = _stacked(sales, pays).groupBy("company_name").agg(
        F.sum("sold").alias("sold"), F.sum("received").alias("received")
    )
    sold, received = money.total("sold"), money.total("received")
    return per_company.agg(
        sold.alias("total_sales"),
        received.alias("total_received"),
        (sold - received).alias("pending_amount"),
        F.count(F.lit(1)).alias("total_companies"),
    )


def company_month_totals(month_rows: DataFrame) -> DataFrame:
    """The overall row of the month report, over the rows of ``company_month``."""
    return month_rows.agg(
        money.total("sales_amount").alias("total_sales"),
        money.total("received_amount").alias("total_received"),
        money.total("pending_amount").alias("pending_amount"),
    )


def sales_with_payments(
    sales: DataFrame,
    pays: DataFrame,
    month: Month,
    ordered: bool = True,
) -> DataFrame:
    """Each sale of the month next to each payment of its company and month.

    Many to many, as the export defines it: rows multiply, and payments of a
    company without sales do not appear, so its amounts must not be added up.
    ``company_month`` has the right totals.
    """
    left = _of_month(sales, month).select(
        "id",
        "company_name",
        "month_year",
        "sale_date",
        "invoice_number",
        "sale_amount",
        "description",
    )
    right = _of_month(pays, month).select(
        F.col("id").alias("payment_id"),
        "company_name",
        "month_year",
        "payment_date",
        "received_amount",
        "payment_mode",
        "reference_number",
    )
    rows = fan_out_left_join(left, right, ["company_name", "month_year"])
    if ordered:
        rows = by_name(rows, "company_name", "sale_date", "id", "payment_id")
    return rows.select(
        "company_name",
        "sale_date",
        "invoice_number",
        "sale_amount",
        "description",
        "payment_date",
        "received_amount",
        "payment_mode",
        "reference_number",
    )


def company_ledger(
    sales: DataFrame,
    pays: DataFrame,
    company: str,
    month: Month,
    with_mode: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """One company's sales and payments of a month in one list by date.

    ``with_mode=True`` is the export's form: the type column is called
    ``transaction_type`` and the payment mode is added, NULL on sales.
    """
    kind = "transaction_type" if with_mode else "type"
    no_mode = F.lit(None).cast("string")

    def entry(what: str, date: str, reference: str, amount: str, mode):
        cols = [
            F.col("id"),
            F.lit(what).alias(kind),
            F.col(date).alias("date"),
            F.col(reference).alias("reference"),
            F.col(amount).alias("amount"),
            F.col("description"),
        ]
        return cols + [mode.alias("payment_mode")] if with_mode else cols

    sold = _of_month(sales, month, company).select(
        *entry("sale", "sale_date", "invoice_number", "sale_amount", no_mode)
    )
    received = _of_month(pays, month, company).select(
        *entry("payment", "payment_date", "reference_number", "received_amount", F.col("payment_mode"))
    )
    rows = sold.unionByName(received)
    # A day's entries without a reference are told apart by type and id.
    return (by_name(rows, "date", "reference", kind, "id") if ordered else rows).drop("id")


def lookup_sales(sales: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    return by_ids(sales, keys).select(
        "id",
        dates.day_label("sale_date").alias("sale_date"),
        "company_name",
        F.coalesce("invoice_number", F.lit("")).alias("invoice_number"),
        F.col("sale_amount").cast("double").alias("sale_amount"),
        dates.month_label("month_year").alias("month_year"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def lookup_company_payments(pays: DataFrame, keys: DataFrame | Sequence[int]) -> DataFrame:
    return by_ids(pays, keys).select(
        "id",
        dates.day_label("payment_date").alias("payment_date"),
        "company_name",
        F.col("received_amount").cast("double").alias("received_amount"),
        "payment_mode",
        F.coalesce("reference_number", F.lit("")).alias("reference_number"),
        dates.month_label("month_year").alias("month_year"),
        F.coalesce("description", F.lit("")).alias("description"),
    )
