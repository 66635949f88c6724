"""Bodies of the export files, in the column order of the file.

Feed them to ``sources.sinks.write_csv`` or ``write_json``. An entity argument
of None stands for all: the summary of everyone instead of one detail list.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetbooks.operators import companies, fleet, hired
from fleetbooks.operators.common import by_name, newest_first

Month = dt.date | str

_UNPAID_COLUMNS = ["date", "vehicle_no", "category", "reason", "amount"]
_PAID_COLUMNS = [*_UNPAID_COLUMNS, "spended_by", "mode"]


def export_paid_spendings(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    return fleet.paid_spendings(sp, veh, ordered).select(_PAID_COLUMNS)


def export_unpaid_spendings(sp: DataFrame, veh: DataFrame, ordered: bool = True) -> DataFrame:
    return fleet.unpaid_spendings(sp, veh, ordered).select(_UNPAID_COLUMNS)


def export_payments(pay: DataFrame, ordered: bool = True) -> DataFrame:
    rows = newest_first(pay, "date") if ordered else pay
    return rows.select("date", F.col("received_from").alias("company_name"), "amount", "reason")


def export_vehicles(veh: DataFrame) -> DataFrame:
    return by_name(veh, "vehicle_no").select(
        "vehicle_no", "owner_name", "contact_number", "created_at"
    )


def export_monthly_expenses(sp: DataFrame, veh: DataFrame) -> DataFrame:
    """All months; the page's choice of a month has no effect on this file."""
    return fleet.monthly_expenses(sp, veh)


def export_hired_detail(hv: DataFrame, t: DataFrame, vehicle_id: int, month: Month) -> DataFrame:
    rows = hired.with_hired(hired.hired_detail(t, vehicle_id, month), hv)
    return by_name(rows, "transaction_date", "created_at").select(
        "transaction_date",
        "transaction_type",
        "description",
        "reference_no",
        "amount",
        "vehicle_no",
        "owner_name",
    )


def export_hired(
    hv: DataFrame, t: DataFrame, month: Month, vehicle_id: int | None = None
) -> DataFrame:
    """Every hired vehicle's net balance of a month, or one vehicle's rows."""
    if vehicle_id is None:
        return hired.hired_net_balance(hv, t, month)
    return export_hired_detail(hv, t, vehicle_id, month)


def export_companies(
    sales: DataFrame,
    pays: DataFrame,
    month: Month,
    company: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Every sale next to its company's payments, or one company's ledger."""
    if company is None:
        return companies.sales_with_payments(sales, pays, month, ordered)
    return companies.company_ledger(sales, pays, company, month, with_mode=True, ordered=ordered)
