"""Queries on books with odd values (``views.OddBooks``): the same, on harder rows."""

from __future__ import annotations

import re

from checks import entries, fleet, people
from checks.pairs import Pair
from checks.views import Books, OddBooks
from fleetbooks.operators import changes, quality

_KNOWN = {pair.key: pair for module in (fleet, people, entries) for pair in module.PAIRS}


def _odd(key: str) -> Pair:
    """A query as it is registered, on the odd spendings."""
    known = _KNOWN[key]
    sql = re.sub(r"\bspendings\b", "odd_spendings", known.sql)
    return Pair(f"odd_{key}", lambda b: known.build(_books(b)), sql)


def _books(b: Books) -> OddBooks:
    return OddBooks(b.spark, b.sf_dir)


PAIRS = [
    _odd(key)
    for key in (
        "paid_spendings",
        "unpaid_spendings",
        "touched_spendings",
        "vehicle_spendings",
        "month_total",
        "monthly_trend",
        "paid_unpaid_totals",
        "paid_monthly_totals",
        "monthly_expenses",
        "monthly_expense_summary",
        "vehicle_totals",
        "dashboard_totals",
        "incoming_totals",
        "payer_balance",
        "employee_names",
        "employee_balance",
        "employee_balance_adv",
        "employee_expense_detail",
        "settle_spendings",
        "toggle_marks",
    )
]
PAIRS += [
    Pair(
        "odd_delete_cascade",
        lambda b: changes.delete_rows(_books(b).spendings(), b.keys("vehicles"), key="vehicle_id"),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM odd_spendings
           WHERE vehicle_id IS NULL OR vehicle_id NOT IN (SELECT id FROM vehicle_keys)""",
    ),
    Pair(
        "odd_delete_set_null",
        lambda b: changes.detach_rows(_books(b).spendings(), b.keys("vehicles"), key="vehicle_id"),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount,
                  CASE WHEN vehicle_id NOT IN (SELECT id FROM vehicle_keys) THEN vehicle_id END AS vehicle_id)
           FROM odd_spendings""",
    ),
    Pair(
        "odd_duplicate_report",
        lambda b: quality.duplicate_report(
            b.vehicles(), b.companies(), b.hired_vehicles(), b.company_sales(), _twice(b)
        ),
        """
        WITH twice AS (SELECT * FROM odd_spendings UNION ALL SELECT * FROM odd_spendings WHERE id % 17 = 0)
        SELECT 'spendings entry' AS "check",
               COALESCE(CAST(vehicle_id AS STRING), '') || ' | ' || CAST(date AS STRING) || ' | ' || category
                 || ' | ' || COALESCE(reason, '') || ' | ' || CAST(amount AS STRING) AS value,
               COUNT(*) AS rows
        FROM twice GROUP BY vehicle_id, date, category, reason, amount HAVING COUNT(*) > 1""",
    ),
]


def _twice(b: Books):
    """Some spendings entered twice: what the default columns of the report look for."""
    rows = _books(b).spendings()
    return rows.unionByName(rows.filter("id % 17 = 0"))
