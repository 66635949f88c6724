"""Books that are changed month by month, and sums that are kept up to date: against the SQL of
the change and of the report, applied to the whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from checks import companies as company_checks
from checks import entries, fleet as fleet_checks
from checks.pairs import Pair
from checks.scratch import folder
from checks.views import AS_OF, Books, OddBooks
from fleetbooks.operators import changes, companies, fleet
from fleetbooks.operators.common import by_ids
from fleetbooks.operators.sums import after_change, sums
from fleetbooks.sources import versions

_KNOWN = {pair.key: pair for module in (fleet_checks, company_checks, entries) for pair in module.PAIRS}


def _settled(b: Books, rows: DataFrame) -> DataFrame:
    return changes.settle(rows, b.keys("spendings"), "E42", "UPI", AS_OF)


# --- versions ---------------------------------------------------------------


def _versions(b: Books, *tables: str) -> versions.Books:
    made = versions.Books(b.spark, folder(b.spark, "books"))
    made.publish({t: getattr(b, t)() for t in tables})
    return made


def _as_given(b: Books, made: versions.Books, table: str) -> DataFrame:
    return made.load(table).select(*getattr(b, table)().columns)


def _versioned_settle(b: Books) -> DataFrame:
    made = _versions(b, "spendings")
    made.change("spendings", b.keys("spendings"), lambda rows: _settled(b, rows))
    return _as_given(b, made, "spendings")


def _versioned_edit(b: Books) -> DataFrame:
    made, edits = _versions(b, "spendings"), entries.spending_edits(b)
    how = lambda rows: changes.apply_updates(rows, edits, seq="seq")
    made.change("spendings", edits.select("id"), how, arrivals=edits)
    return _as_given(b, made, "spendings")


def _versioned_toggle(b: Books) -> DataFrame:
    made = _versions(b, "spendings")
    made.change("spendings", b.keys("spendings"), lambda rows: changes.toggle_marks(rows, b.keys("spendings")))
    return _as_given(b, made, "spendings")


def _versioned_delete(table: str) -> Callable[[Books], DataFrame]:
    """Vehicles go, with their spendings; their payments lose the reference."""

    def build(b: Books) -> DataFrame:
        made = _versions(b, "vehicles", "spendings", "payments")
        children = [versions.Child("spendings", "vehicle_id"), versions.Child("payments", "vehicle_id", detach=True)]
        made.delete("vehicles", b.keys("vehicles"), children)
        return _as_given(b, made, table)

    return build


PAIRS = [
    Pair("versioned_settle", _versioned_settle, _KNOWN["settle_spendings"].sql),
    Pair("versioned_edit", _versioned_edit, _KNOWN["edit_spendings"].sql),
    Pair("versioned_toggle", _versioned_toggle, _KNOWN["toggle_marks"].sql),
    Pair("versioned_cascade", _versioned_delete("spendings"), _KNOWN["delete_cascade"].sql),
    Pair("versioned_set_null", _versioned_delete("payments"), _KNOWN["delete_set_null"].sql),
    Pair(
        "versioned_parents",
        _versioned_delete("vehicles"),
        "SELECT * FROM vehicles WHERE id NOT IN (SELECT id FROM vehicle_keys)",
    ),
]

# --- sums -------------------------------------------------------------------


def _after(report: str, table: str, changed: str) -> str:
    """A report's SQL over what the SQL ``changed`` gives, in place of ``table``."""
    own = re.sub(rf"\b{table}\b", "changed", report).strip()
    rest = f", {own[5:]}" if own.startswith("WITH ") else f" {own}"
    return f"WITH changed AS ({changed}){rest}"


def _kept_spendings(b: Books) -> DataFrame:
    """Sums of the spendings as they were, then settled by the touched rows alone."""
    sp = b.spendings()
    touched = by_ids(sp, b.keys("spendings"))
    return after_change(sums(sp, "spendings"), touched, _settled(b, touched), "spendings")


def _kept_without(b: Books) -> DataFrame:
    """Sums of the spendings, less those of the deleted vehicles."""
    sp = b.spendings()
    gone = by_ids(sp, b.keys("vehicles"), "vehicle_id")
    return after_change(sums(sp, "spendings"), gone, gone.limit(0), "spendings")


def _kept_sales(b: Books) -> DataFrame:
    sales = b.company_sales()
    gone = by_ids(sales, b.keys("company_sales"))
    return after_change(sums(sales, "company_sales"), gone, gone.limit(0), "company_sales")


# Money stays exact inside.
_SETTLED = _KNOWN["settle_spendings"].sql.replace("CAST(amount AS DOUBLE) AS amount", "amount")
_WITHOUT = "SELECT * FROM spendings WHERE vehicle_id IS NULL OR vehicle_id NOT IN (SELECT id FROM vehicle_keys)"
_UNSOLD = "SELECT * FROM company_sales WHERE id NOT IN (SELECT id FROM sale_keys)"

_REPORTS: dict[str, Callable[[Books, DataFrame], DataFrame]] = {
    "vehicle_totals": lambda b, kept: fleet.vehicle_totals(b.vehicles(), kept),
    "paid_unpaid_totals": lambda b, kept: fleet.paid_unpaid_totals(kept),
    "paid_monthly_totals": lambda b, kept: fleet.paid_monthly_totals(kept),
    "monthly_expenses": lambda b, kept: fleet.monthly_expenses(kept, b.vehicles()),
    "monthly_expense_summary": lambda b, kept: fleet.expense_summary(kept, b.vehicles()),
    "overall_monthly_totals": lambda b, kept: fleet.expense_summary(kept, b.vehicles(), fleet.BY_MONTH),
    "payer_balance": lambda b, kept: fleet.payer_balance(b.payments(), kept),
}


def _kept(key: str, report: str, kept: Callable[[Books], DataFrame], changed: str, odd: bool = False) -> Pair:
    build = _REPORTS[report]
    sql = _after(_KNOWN[report].sql, "spendings", changed)
    if not odd:
        return Pair(key, lambda b: build(b, kept(b)), sql)
    books = lambda b: OddBooks(b.spark, b.sf_dir)
    return Pair(key, lambda b: build(books(b), kept(books(b))), re.sub(r"\bspendings\b", "odd_spendings", sql))


PAIRS += [_kept(f"kept_{report}", report, _kept_spendings, _SETTLED) for report in _REPORTS]
PAIRS += [_kept(f"odd_kept_{report}", report, _kept_spendings, _SETTLED, odd=True) for report in _REPORTS]
PAIRS += [
    _kept("kept_totals_without_vehicles", "vehicle_totals", _kept_without, _WITHOUT),
    _kept("kept_months_without_vehicles", "overall_monthly_totals", _kept_without, _WITHOUT),
    _kept("odd_kept_months_without_vehicles", "overall_monthly_totals", _kept_without, _WITHOUT, odd=True),
    Pair(
        "kept_company_summary",
        lambda b: companies.company_summary(_kept_sales(b), sums(b.company_payments(), "company_payments")),
        _after(company_checks.SUMMARY, "company_sales", _UNSOLD),
    ),
]
