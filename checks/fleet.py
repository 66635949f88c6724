"""Own vehicles: lists, totals, payers."""

from __future__ import annotations

from checks.pairs import Pair
from checks.views import AS_OF, M
from fleetbooks.operators import fleet
from fleetbooks.operators.common import by_ids, search_any
from fleetbooks.plans import exports, labelled
from fleetbooks.sources import sinks, tables

AS = f"DATE '{AS_OF}'"
MONTH = f"DATE '{M}'"
PAID = "s.spended_by IS NOT NULL AND s.mode IS NOT NULL"
UNPAID = "(s.spended_by IS NULL OR s.mode IS NULL)"
ROW = (
    "s.id, s.vehicle_id, s.date, s.expense_month, s.category, s.reason,"
    " CAST(s.amount AS DOUBLE) AS amount, s.spended_by, s.mode, s.marked"
)
JOINED = "spendings s JOIN vehicles v ON s.vehicle_id = v.id"
PAYMENT = (
    "p.id, p.company_id, p.vehicle_id, p.date, CAST(p.amount AS DOUBLE) AS amount,"
    " p.received_from, p.reason"
)
SUM = "CAST(COALESCE(SUM(s.amount), 0) AS DOUBLE)"


def _scan(key: str, table: str, columns: str, order: str) -> Pair:
    return Pair(
        key,
        lambda b: tables.listing(getattr(b, table)(), table),
        f"SELECT {columns} FROM {table} {order}",
    )


PAIRS = [
    # --- listings -----------------------------------------------------------
    _scan("scan_vehicles", "vehicles", "*", "ORDER BY vehicle_no"),
    _scan("scan_companies", "companies", "*", "ORDER BY name"),
    _scan("scan_hired_vehicles", "hired_vehicles", "*", "ORDER BY vehicle_no"),
    _scan("scan_spendings", "spendings", "* REPLACE (CAST(amount AS DOUBLE) AS amount)", "ORDER BY date DESC"),
    _scan("scan_payments", "payments", "* REPLACE (CAST(amount AS DOUBLE) AS amount)", "ORDER BY date DESC"),
    _scan(
        "scan_employee_advances",
        "employee_advances",
        "* REPLACE (CAST(amount AS DOUBLE) AS amount)",
        "ORDER BY date DESC",
    ),
    _scan(
        "scan_hired_vehicle_transactions",
        "hired_vehicle_transactions",
        "* REPLACE (CAST(amount AS DOUBLE) AS amount)",
        "ORDER BY transaction_date DESC",
    ),
    _scan(
        "scan_company_sales",
        "company_sales",
        "* REPLACE (CAST(sale_amount AS DOUBLE) AS sale_amount)",
        "ORDER BY sale_date DESC",
    ),
    _scan(
        "scan_company_payments",
        "company_payments",
        "* REPLACE (CAST(received_amount AS DOUBLE) AS received_amount)",
        "ORDER BY payment_date DESC",
    ),
    Pair(
        "vehicle_choices",
        lambda b: tables.choices(b.vehicles(), "id", "vehicle_no"),
        "SELECT id, vehicle_no FROM vehicles ORDER BY vehicle_no",
    ),
    Pair(
        "company_choices",
        lambda b: tables.choices(b.companies(), "id", "name"),
        "SELECT id, name FROM companies ORDER BY name",
    ),
    # --- detail lists -------------------------------------------------------
    Pair(
        "paid_spendings",
        lambda b: fleet.paid_spendings(b.spendings(), b.vehicles()),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED} WHERE {PAID} ORDER BY s.date DESC",
    ),
    Pair(
        "unpaid_spendings",
        lambda b: fleet.unpaid_spendings(b.spendings(), b.vehicles()),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED} WHERE {UNPAID} ORDER BY s.date DESC",
    ),
    Pair(
        "touched_spendings",
        lambda b: fleet.touched_spendings(b.spendings()),
        f"SELECT {ROW} FROM spendings s WHERE s.spended_by IS NOT NULL OR s.mode IS NOT NULL",
    ),
    Pair(
        "recent_paid",
        lambda b: fleet.recent_paid(b.spendings(), b.vehicles(), AS_OF),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED} WHERE {PAID}"
        f" AND s.date >= {AS} - INTERVAL 30 DAY ORDER BY s.date DESC",
    ),
    Pair(
        "settled_paid",
        lambda b: fleet.settled_paid(b.spendings(), b.vehicles(), AS_OF),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED} WHERE {PAID}"
        f" AND s.date < {AS} - INTERVAL 30 DAY ORDER BY s.date DESC",
    ),
    Pair(
        "month_detail",
        lambda b: fleet.month_detail(b.spendings(month=M), b.vehicles(), M),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED} WHERE s.expense_month = {MONTH}"
        " ORDER BY s.category, s.date",
    ),
    Pair(
        "vehicle_spendings",
        lambda b: fleet.vehicle_spendings(b.spendings(month=M), 7, M),
        f"SELECT {ROW} FROM spendings s WHERE s.vehicle_id = 7"
        f" AND strftime(s.expense_month, '%Y-%m') = '{M:%Y-%m}' ORDER BY s.date DESC",
    ),
    Pair(
        "vehicle_spendings_all_months",
        lambda b: fleet.vehicle_spendings(b.spendings(), 7),
        f"SELECT {ROW} FROM spendings s WHERE s.vehicle_id = 7 ORDER BY s.date DESC",
    ),
    Pair(
        "payer_spendings",
        lambda b: fleet.payer_spendings(b.spendings(), "E42"),
        f"SELECT {ROW} FROM spendings s WHERE s.spended_by = 'E42'",
    ),
    Pair(
        "spendings_by_ids",
        lambda b: by_ids(b.spendings(), b.keys("spendings")),
        f"SELECT {ROW} FROM spendings s WHERE s.id IN (SELECT id FROM spending_keys)",
    ),
    Pair(
        "lookup_spendings",
        lambda b: fleet.lookup_spendings(b.spendings(), b.keys("spendings")),
        """
        SELECT id, strftime(date, '%Y-%m-%d') AS date,
               COALESCE(strftime(expense_month, '%Y-%m'), '') AS expense_month, vehicle_id, category,
               COALESCE(reason, '') AS reason, CAST(amount AS DOUBLE) AS amount,
               COALESCE(spended_by, '') AS spended_by, COALESCE(mode, '') AS mode
        FROM spendings WHERE id IN (SELECT id FROM spending_keys)""",
    ),
    Pair(
        "search_payments",
        lambda b: search_any(
            fleet.paid_spendings(b.spendings(), b.vehicles(), ordered=False).select(
                "date", "vehicle_no", "category", "reason", "amount", "spended_by", "mode"
            ),
            "E10",
        ),
        f"""
        SELECT s.date, v.vehicle_no, s.category, s.reason, CAST(s.amount AS DOUBLE) AS amount, s.spended_by, s.mode
        FROM {JOINED} WHERE {PAID}
          AND (contains(lower(CAST(s.date AS STRING)), 'e10') OR contains(lower(v.vehicle_no), 'e10')
            OR contains(lower(s.category), 'e10') OR contains(lower(COALESCE(s.reason, '')), 'e10')
            OR contains(CAST(s.amount AS STRING), 'e10') OR contains(lower(s.spended_by), 'e10')
            OR contains(lower(s.mode), 'e10'))""",
    ),
    Pair(
        "available_months",
        lambda b: fleet.available_months(b.spendings()),
        """SELECT strftime(expense_month, '%Y-%m') AS month FROM
           (SELECT DISTINCT expense_month FROM spendings WHERE expense_month IS NOT NULL)
           ORDER BY expense_month DESC""",
    ),
    Pair(
        "spendings_with_vehicle",
        lambda b: fleet.with_vehicle(b.spendings(), b.vehicles()),
        f"SELECT {ROW}, v.vehicle_no FROM {JOINED}",
    ),
    Pair(
        "payments_detail",
        lambda b: fleet.payments_detail(b.payments(), b.companies(), b.vehicles()),
        f"""SELECT {PAYMENT}, c.name AS company_name, v.vehicle_no
            FROM payments p LEFT JOIN companies c ON p.company_id = c.id
            LEFT JOIN vehicles v ON p.vehicle_id = v.id ORDER BY p.date DESC""",
    ),
    Pair(
        "latest_spendings",
        lambda b: fleet.latest_spendings(b.spendings(), b.vehicles()),
        f"""SELECT s.id, v.vehicle_no, s.date, s.expense_month, s.category, s.reason,
                   CAST(s.amount AS DOUBLE) AS amount, s.spended_by, s.mode
            FROM {JOINED}
            ORDER BY s.expense_month DESC NULLS FIRST, s.date DESC NULLS FIRST, s.id, v.vehicle_no,
                     s.category, s.reason NULLS LAST, s.amount, s.spended_by NULLS LAST, s.mode NULLS LAST
            LIMIT 5""",
    ),
    # --- totals -------------------------------------------------------------
    Pair(
        "vehicle_totals",
        lambda b: fleet.vehicle_totals(b.vehicles(), b.spendings()),
        f"""SELECT v.id, v.vehicle_no, {SUM} AS total_spent
            FROM vehicles v LEFT JOIN spendings s ON v.id = s.vehicle_id GROUP BY v.id, v.vehicle_no""",
    ),
    Pair(
        "dashboard_totals",
        lambda b: fleet.dashboard_totals(b.vehicles(), b.payments(), b.spendings(), AS_OF),
        """
        WITH d AS (SELECT COALESCE(SUM(amount), 0) AS debited FROM spendings
                   WHERE spended_by IS NOT NULL OR mode IS NOT NULL),
             c AS (SELECT COALESCE(SUM(amount), 0) AS credited FROM payments),
             n AS (SELECT COUNT(*) AS vehicles FROM vehicles),
             m AS (SELECT COALESCE(SUM(amount), 0) AS t FROM spendings WHERE expense_month = DATE '2001-06-01'),
             p AS (SELECT COALESCE(SUM(amount), 0) AS t FROM spendings WHERE expense_month = DATE '2001-05-01')
        SELECT n.vehicles, CAST(c.credited AS DOUBLE) AS credited, CAST(d.debited AS DOUBLE) AS debited,
               CAST(c.credited - d.debited AS DOUBLE) AS balance,
               CAST(m.t AS DOUBLE) AS current_month, CAST(p.t AS DOUBLE) AS prev_month
        FROM n, c, d, m, p""",
    ),
    Pair(
        "month_by_vehicle",
        lambda b: fleet.month_by_vehicle(b.spendings(month=M), b.vehicles(), M),
        f"""SELECT v.vehicle_no, CAST(SUM(s.amount) AS DOUBLE) AS monthly_total FROM {JOINED}
            WHERE s.expense_month = {MONTH} GROUP BY v.vehicle_no ORDER BY monthly_total DESC""",
    ),
    Pair(
        "monthly_trend",
        lambda b: fleet.monthly_trend(b.spendings(), AS_OF),
        f"""SELECT strftime(s.expense_month, '%Y-%m') AS month, CAST(SUM(s.amount) AS DOUBLE) AS total_expense
            FROM spendings s WHERE s.expense_month >= {AS} - INTERVAL 6 MONTH
            GROUP BY s.expense_month ORDER BY s.expense_month DESC""",
    ),
    Pair(
        "paid_unpaid_totals",
        lambda b: fleet.paid_unpaid_totals(b.spendings()),
        f"""SELECT (SELECT {SUM} FROM spendings s WHERE {PAID}) AS total_spent,
                   (SELECT {SUM} FROM spendings s WHERE {UNPAID}) AS total_unpaid""",
    ),
    Pair(
        "paid_monthly_totals",
        lambda b: fleet.paid_monthly_totals(b.spendings()),
        f"""SELECT s.expense_month, {SUM} AS monthly_total FROM spendings s WHERE {PAID}
            GROUP BY s.expense_month ORDER BY s.expense_month DESC""",
    ),
    Pair(
        "overall_monthly_expenses",
        lambda b: fleet.overall_monthly_expenses(b.spendings()),
        f"""SELECT strftime(expense_month, '%Y-%m') AS expense_month, total_monthly_expense FROM
            (SELECT s.expense_month, CAST(SUM(s.amount) AS DOUBLE) AS total_monthly_expense
             FROM spendings s WHERE {PAID} GROUP BY s.expense_month) ORDER BY 1 DESC""",
    ),
    Pair(
        "total_credited",
        lambda b: fleet.total_credited(b.payments()),
        "SELECT CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS total_credited FROM payments",
    ),
    Pair(
        "month_total",
        lambda b: fleet.month_total(b.spendings(month=M), M),
        f"SELECT {SUM} AS total FROM spendings s WHERE s.expense_month = {MONTH}",
    ),
    Pair(
        "month_vehicle_expenses",
        lambda b: fleet.month_vehicle_expenses(b.spendings(month=M), b.vehicles(), M),
        f"""SELECT vehicle_no, strftime(expense_month, '%Y-%m') AS expense_month, monthly_total FROM
            (SELECT v.vehicle_no, s.expense_month, CAST(SUM(s.amount) AS DOUBLE) AS monthly_total
             FROM {JOINED} WHERE s.expense_month = {MONTH} GROUP BY v.vehicle_no, s.expense_month)
            ORDER BY monthly_total DESC""",
    ),
    Pair(
        "monthly_expenses",
        lambda b: fleet.monthly_expenses(b.spendings(), b.vehicles()),
        f"""SELECT strftime(s.expense_month, '%Y-%m') AS month, v.vehicle_no,
                   CAST(SUM(s.amount) AS DOUBLE) AS total_expense
            FROM {JOINED} WHERE {PAID} GROUP BY s.expense_month, v.vehicle_no
            ORDER BY s.expense_month DESC, total_expense DESC""",
    ),
]

_BY_CATEGORY = f"""
SELECT strftime(s.expense_month, '%Y-%m') AS month, s.vehicle_id, v.vehicle_no, s.category,
       CAST(SUM(s.amount) AS DOUBLE) AS total_amount, COUNT(*) AS transaction_count
FROM {JOINED} GROUP BY s.expense_month, s.vehicle_id, v.vehicle_no, s.category
ORDER BY s.expense_month DESC NULLS FIRST, SUM(s.amount) DESC"""
_BY_VEHICLE = f"""
SELECT strftime(s.expense_month, '%Y-%m') AS month, s.vehicle_id, v.vehicle_no,
       CAST(SUM(s.amount) AS DOUBLE) AS monthly_total
FROM {JOINED} GROUP BY s.expense_month, s.vehicle_id, v.vehicle_no
ORDER BY s.expense_month DESC NULLS FIRST, SUM(s.amount) DESC"""
_BY_MONTH = """
SELECT strftime(s.expense_month, '%Y-%m') AS month, CAST(SUM(s.amount) AS DOUBLE) AS total_expense,
       COUNT(*) AS transaction_count
FROM spendings s GROUP BY s.expense_month ORDER BY s.expense_month DESC NULLS FIRST"""


def _summary(key: str, by: str, sql: str, n: int | None = None) -> Pair:
    return Pair(key, lambda b: fleet.expense_summary(b.spendings(), b.vehicles(), by, n), sql)


PAIRS += [
    _summary("monthly_expense_summary", fleet.BY_CATEGORY, _BY_CATEGORY),
    _summary("vehicle_monthly_totals", fleet.BY_VEHICLE, _BY_VEHICLE),
    _summary("overall_monthly_totals", fleet.BY_MONTH, _BY_MONTH),
    _summary(
        "top_monthly_expense_summary",
        fleet.BY_CATEGORY,
        _BY_CATEGORY + ", s.vehicle_id, s.category, v.vehicle_no LIMIT 10",
        10,
    ),
    _summary(
        "top_vehicle_monthly_totals",
        fleet.BY_VEHICLE,
        _BY_VEHICLE + ", s.vehicle_id, v.vehicle_no LIMIT 10",
        10,
    ),
    _summary("top_overall_monthly_totals", fleet.BY_MONTH, _BY_MONTH + " LIMIT 12", 12),
    # --- payers and settlement ----------------------------------------------
    Pair(
        "incoming_totals",
        lambda b: fleet.incoming_totals(b.payments(), b.spendings()),
        f"""SELECT CAST(c AS DOUBLE) AS credited, CAST(d AS DOUBLE) AS debited, CAST(c - d AS DOUBLE) AS balance
            FROM (SELECT (SELECT COALESCE(SUM(amount), 0) FROM payments) AS c,
                         (SELECT COALESCE(SUM(s.amount), 0) FROM spendings s WHERE {PAID}) AS d)""",
    ),
    Pair(
        "payer_balance",
        lambda b: fleet.payer_balance(b.payments(), b.spendings()),
        f"""
        WITH c AS (SELECT COALESCE(SUM(amount), 0) AS credited FROM payments),
             d AS (SELECT COALESCE(SUM(s.amount), 0) AS debited FROM spendings s WHERE {PAID}),
             t AS (SELECT spended_by AS payer, SUM(amount) AS spent FROM spendings
                   WHERE spended_by IS NOT NULL GROUP BY spended_by)
        SELECT t.payer, CAST(c.credited AS DOUBLE) AS credited, CAST(d.debited AS DOUBLE) AS debited,
               CAST(c.credited - d.debited AS DOUBLE) AS balance, CAST(t.spent AS DOUBLE) AS spent,
               CAST(c.credited - t.spent AS DOUBLE) AS payer_balance
        FROM t, c, d""",
    ),
    Pair(
        "payer_balance_fixed_list",
        lambda b: fleet.payer_balance(b.payments(), b.spendings(), ["E42", "E7", "nobody"]),
        f"""
        WITH c AS (SELECT COALESCE(SUM(amount), 0) AS credited FROM payments),
             d AS (SELECT COALESCE(SUM(s.amount), 0) AS debited FROM spendings s WHERE {PAID}),
             l AS (SELECT unnest(['E42', 'E7', 'nobody']) AS payer),
             t AS (SELECT l.payer, COALESCE(SUM(s.amount), 0) AS spent
                   FROM l LEFT JOIN spendings s ON s.spended_by = l.payer GROUP BY l.payer)
        SELECT t.payer, CAST(c.credited AS DOUBLE) AS credited, CAST(d.debited AS DOUBLE) AS debited,
               CAST(c.credited - d.debited AS DOUBLE) AS balance, CAST(t.spent AS DOUBLE) AS spent,
               CAST(c.credited - t.spent AS DOUBLE) AS payer_balance
        FROM t, c, d""",
    ),
    Pair(
        "settlement_preview",
        lambda b: fleet.settlement_preview(b.spendings(), b.keys("spendings")),
        f"""SELECT COUNT(*) AS selected, {SUM} AS total FROM spendings s
            WHERE s.id IN (SELECT id FROM spending_keys)""",
    ),
    Pair(
        "vehicle_ref_counts",
        lambda b: fleet.ref_counts(b.vehicles(), b.spendings(), "vehicle_id"),
        """SELECT v.id, COUNT(s.vehicle_id) AS ref_count
           FROM vehicles v LEFT JOIN spendings s ON s.vehicle_id = v.id GROUP BY v.id""",
    ),
    # --- exports and labelled lists -----------------------------------------
    Pair(
        "export_paid_spendings",
        lambda b: exports.export_paid_spendings(b.spendings(), b.vehicles()),
        f"""SELECT s.date, v.vehicle_no, s.category, s.reason, CAST(s.amount AS DOUBLE) AS amount,
                   s.spended_by, s.mode FROM {JOINED} WHERE {PAID} ORDER BY s.date DESC""",
    ),
    Pair(
        "export_unpaid_spendings",
        lambda b: exports.export_unpaid_spendings(b.spendings(), b.vehicles()),
        f"""SELECT s.date, v.vehicle_no, s.category, s.reason, CAST(s.amount AS DOUBLE) AS amount
            FROM {JOINED} WHERE {UNPAID} ORDER BY s.date DESC""",
    ),
    Pair(
        "export_payments",
        lambda b: exports.export_payments(b.payments()),
        """SELECT date, received_from AS company_name, CAST(amount AS DOUBLE) AS amount, reason
           FROM payments ORDER BY date DESC""",
    ),
    Pair(
        "export_vehicles",
        lambda b: exports.export_vehicles(b.vehicles()),
        "SELECT vehicle_no, owner_name, contact_number, created_at FROM vehicles ORDER BY vehicle_no",
    ),
    Pair(
        "export_monthly_expenses",
        lambda b: exports.export_monthly_expenses(b.spendings(), b.vehicles()),
        f"""SELECT strftime(s.expense_month, '%Y-%m') AS month, v.vehicle_no,
                   CAST(SUM(s.amount) AS DOUBLE) AS total_expense
            FROM {JOINED} WHERE {PAID} GROUP BY s.expense_month, v.vehicle_no""",
    ),
    Pair(
        "export_csv",
        lambda b: sinks.csv_ready(exports.export_unpaid_spendings(b.spendings(), b.vehicles())),
        f"""SELECT CAST(s.date AS STRING) AS date, v.vehicle_no, s.category,
                   COALESCE(s.reason, '') AS reason, CAST(s.amount AS STRING) AS amount
            FROM {JOINED} WHERE {UNPAID}""",
    ),
    Pair(
        "export_json",
        lambda b: sinks.json_ready(fleet.vehicle_spendings(b.spendings(), 7)),
        """SELECT id, vehicle_id, strftime(date, '%Y-%m-%d') AS date,
                  strftime(expense_month, '%Y-%m-%d') AS expense_month, category, reason,
                  CAST(amount AS DOUBLE) AS amount, spended_by, mode, marked
           FROM spendings WHERE vehicle_id = 7""",
    ),
    Pair(
        "spendings_labelled",
        lambda b: labelled.spendings_labelled(b.spendings(), b.vehicles()),
        f"""SELECT s.date, v.vehicle_no, s.category, COALESCE(NULLIF(s.reason, ''), '-') AS reason,
                   printf('%.2f', CAST(s.amount AS DOUBLE)) AS amount,
                   COALESCE(NULLIF(s.spended_by, ''), 'Unpaid') AS paid_by,
                   COALESCE(NULLIF(s.mode, ''), '-') AS payment_mode,
                   CASE WHEN COALESCE(s.spended_by, '') <> '' AND COALESCE(s.mode, '') <> ''
                        THEN 'Paid' ELSE 'Unpaid' END AS status,
                   CASE WHEN s.marked THEN 'Yes' ELSE 'No' END AS marked
            FROM {JOINED}""",
    ),
]
