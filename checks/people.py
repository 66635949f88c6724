"""Employees and hired vehicles."""

from __future__ import annotations

from checks.pairs import Pair
from checks.views import HM
from fleetbooks.functions.predicates import has_text
from fleetbooks.operators import employees, hired
from fleetbooks.plans import exports, labelled

MONTH = f"DATE '{HM}'"
TXN = (
    "t.id, t.hired_vehicle_id, t.transaction_type, t.transaction_date, t.month_year,"
    " CAST(t.amount AS DOUBLE) AS amount, t.description, t.reference_no, t.created_at"
)

# Advances and expenses are added up by name, each on its own; the totals meet by name.
_TOTALS = """
WITH given AS (SELECT employee_name AS name, SUM(amount) AS total FROM employee_advances GROUP BY ALL),
     spent AS (SELECT spended_by AS name, SUM(amount) AS total FROM spendings GROUP BY ALL),
     books AS (
       SELECT COALESCE(given.name, spent.name) AS employee_name, given.name IS NOT NULL AS advanced,
              COALESCE(given.total, 0) AS total_advances, COALESCE(spent.total, 0) AS total_expenses
       FROM given FULL JOIN spent USING (name))
SELECT employee_name, total_advances, total_expenses, total_advances - total_expenses AS balance FROM books"""
# Everyone whose name has text; or everyone with an advance.
BALANCE = f"{_TOTALS} WHERE length(employee_name) > 0"
BALANCE_OF_ADVANCED = f"{_TOTALS} WHERE advanced"
AS_DOUBLE = (
    "employee_name, CAST(total_advances AS DOUBLE) AS total_advances,"
    " CAST(total_expenses AS DOUBLE) AS total_expenses, CAST(balance AS DOUBLE) AS balance"
)


def _hired(result: str, month: str = "") -> str:
    """``result`` of ``books``: every hired vehicle with what it sold and what was paid for it.

    Transactions are added up by vehicle and kind on their own, the kinds become columns, and
    these go next to the list of vehicles; one without has 0."""
    return f"""
    WITH kinds AS (SELECT hired_vehicle_id AS id, transaction_type AS kind, SUM(amount) AS total
                   FROM hired_vehicle_transactions {month} GROUP BY ALL),
         wide AS (PIVOT kinds ON kind IN ('sale', 'payment') USING FIRST(total) GROUP BY id),
         books AS (SELECT id, vehicle_no, owner_name, COALESCE(sale, 0) AS sold, COALESCE(payment, 0) AS paid
                   FROM hired_vehicles LEFT JOIN wide USING (id))
    SELECT {result}"""


_OF_MONTH = f"WHERE month_year = {MONTH}"
_SUMMED = "CAST(sold AS DOUBLE) AS total_sales, CAST(paid AS DOUBLE) AS total_payments"
_SUMMARY = f"id, vehicle_no, owner_name, {_SUMMED} FROM books"
NET = _hired(f"vehicle_no, owner_name, {_SUMMED}, CAST(sold - paid AS DOUBLE) AS net_balance FROM books", _OF_MONTH)

PAIRS = [
    Pair(
        "named_employees",
        lambda b: b.spendings().filter(has_text("spended_by")).select("id", "date", "spended_by", "amount"),
        """SELECT id, date, spended_by, CAST(amount AS DOUBLE) AS amount FROM spendings
           WHERE spended_by IS NOT NULL AND spended_by <> ''""",
    ),
    Pair(
        "employee_names",
        lambda b: employees.employee_names(b.employee_advances(), b.spendings()),
        """SELECT DISTINCT employee_name FROM employee_advances WHERE employee_name IS NOT NULL AND employee_name <> ''
           UNION SELECT DISTINCT spended_by FROM spendings WHERE spended_by IS NOT NULL AND spended_by <> ''""",
    ),
    Pair(
        "employee_balance",
        lambda b: employees.employee_balance(b.employee_advances(), b.spendings()),
        f"SELECT {AS_DOUBLE} FROM ({BALANCE})",
    ),
    Pair(
        "employee_balance_adv",
        lambda b: employees.employee_balance(b.employee_advances(), b.spendings(), all_names=False),
        f"SELECT {AS_DOUBLE} FROM ({BALANCE_OF_ADVANCED})",
    ),
    Pair(
        "employee_summary",
        lambda b: employees.employee_summary(
            employees.employee_balance(b.employee_advances(), b.spendings())
        ),
        f"""SELECT COUNT(*) AS employees, CAST(SUM(total_advances) AS DOUBLE) AS total_advances,
                   CAST(SUM(total_expenses) AS DOUBLE) AS total_expenses, CAST(SUM(balance) AS DOUBLE) AS net_balance
            FROM ({BALANCE})""",
    ),
    Pair(
        "employee_summary_adv",
        lambda b: employees.employee_summary(
            employees.employee_balance(b.employee_advances(), b.spendings(), all_names=False)
        ),
        f"""SELECT COUNT(*) AS employees, CAST(SUM(total_advances) AS DOUBLE) AS total_advances,
                   CAST(SUM(total_expenses) AS DOUBLE) AS total_expenses, CAST(SUM(balance) AS DOUBLE) AS net_balance
            FROM ({BALANCE_OF_ADVANCED})""",
    ),
    Pair(
        "employee_balance_labelled",
        lambda b: labelled.employee_balance_labelled(b.employee_advances(), b.spendings()),
        f"""SELECT employee_name, printf('%.2f', CAST(total_advances AS DOUBLE)) AS total_advances,
                   printf('%.2f', CAST(total_expenses AS DOUBLE)) AS total_expenses,
                   printf('%.2f', CAST(balance AS DOUBLE)) AS balance,
                   CASE WHEN balance > 0 THEN 'Employee owes company'
                        WHEN balance < 0 THEN 'Company owes employee' ELSE 'Settled' END AS status
            FROM ({BALANCE})""",
    ),
    Pair(
        "employee_expense_detail",
        lambda b: employees.employee_expense_detail(b.spendings(), b.vehicles()),
        """SELECT s.date, s.spended_by AS employee_name, CAST(s.amount AS DOUBLE) AS amount, v.vehicle_no,
                  s.category, s.reason AS purpose
           FROM spendings s JOIN vehicles v ON s.vehicle_id = v.id
           WHERE s.spended_by IS NOT NULL AND s.spended_by <> '' ORDER BY s.date DESC""",
    ),
    Pair(
        "lookup_advances",
        lambda b: employees.lookup_advances(b.employee_advances(), b.keys("employee_advances")),
        """SELECT id, employee_name, strftime(date, '%Y-%m-%d') AS date, CAST(amount AS DOUBLE) AS amount,
                  COALESCE(purpose, '') AS purpose
           FROM employee_advances WHERE id IN (SELECT id FROM advance_keys)""",
    ),
    # --- hired vehicles -----------------------------------------------------
    Pair(
        "hired_txn_with_vehicle",
        lambda b: hired.with_hired(b.hired_vehicle_transactions(), b.hired_vehicles()),
        f"""SELECT {TXN}, hv.vehicle_no, hv.owner_name
            FROM hired_vehicle_transactions t JOIN hired_vehicles hv ON t.hired_vehicle_id = hv.id""",
    ),
    Pair(
        "recent_hired_txn",
        lambda b: hired.recent_hired_txn(b.hired_vehicles(), b.hired_vehicle_transactions()),
        f"""SELECT {TXN}, hv.vehicle_no, hv.owner_name
            FROM hired_vehicle_transactions t JOIN hired_vehicles hv ON t.hired_vehicle_id = hv.id
            ORDER BY t.transaction_date DESC NULLS FIRST, t.created_at DESC NULLS FIRST, t.id LIMIT 50""",
    ),
    Pair(
        "hired_month_detail",
        lambda b: hired.hired_detail(b.hired_vehicle_transactions(month=HM), 7, HM),
        f"""SELECT {TXN} FROM hired_vehicle_transactions t
            WHERE t.hired_vehicle_id = 7 AND t.month_year = {MONTH} ORDER BY t.transaction_date, t.created_at""",
    ),
    Pair(
        "hired_summary",
        lambda b: hired.hired_summary(b.hired_vehicles(), b.hired_vehicle_transactions()),
        _hired(_SUMMARY),
    ),
    Pair(
        "hired_month_summary",
        lambda b: hired.hired_summary(b.hired_vehicles(), b.hired_vehicle_transactions(month=HM), HM),
        _hired(_SUMMARY, _OF_MONTH),
    ),
    Pair(
        "hired_month_one",
        lambda b: hired.hired_summary(b.hired_vehicles(), b.hired_vehicle_transactions(month=HM), HM, 7),
        _hired(f"{_SUMMARY} WHERE id = 7", _OF_MONTH),
    ),
    Pair(
        "hired_net_balance",
        lambda b: hired.hired_net_balance(b.hired_vehicles(), b.hired_vehicle_transactions(month=HM), HM),
        NET,
    ),
    Pair(
        "export_hired_all",
        lambda b: exports.export_hired(b.hired_vehicles(), b.hired_vehicle_transactions(month=HM), HM),
        NET,
    ),
    Pair(
        "export_hired_detail",
        lambda b: exports.export_hired(b.hired_vehicles(), b.hired_vehicle_transactions(month=HM), HM, 7),
        f"""SELECT t.transaction_date, t.transaction_type, t.description, t.reference_no,
                   CAST(t.amount AS DOUBLE) AS amount, hv.vehicle_no, hv.owner_name
            FROM hired_vehicle_transactions t JOIN hired_vehicles hv ON t.hired_vehicle_id = hv.id
            WHERE t.hired_vehicle_id = 7 AND t.month_year = {MONTH} ORDER BY t.transaction_date, t.created_at""",
    ),
    Pair(
        "hired_summary_labelled",
        lambda b: labelled.hired_summary_labelled(b.hired_vehicles(), b.hired_vehicle_transactions()),
        _hired(
            """vehicle_no, COALESCE(NULLIF(owner_name, ''), '-') AS owner_name,
               printf('%.2f', CAST(sold AS DOUBLE)) AS total_sales, printf('%.2f', CAST(paid AS DOUBLE)) AS total_payments,
               printf('%.2f', CAST(sold - paid AS DOUBLE)) AS balance,
               CASE WHEN sold > paid THEN 'success' ELSE 'danger' END AS balance_class FROM books"""
        ),
    ),
    Pair(
        "lookup_hired_txn",
        lambda b: hired.lookup_hired_txn(
            b.hired_vehicle_transactions(), b.keys("hired_vehicle_transactions")
        ),
        """SELECT id, transaction_type, strftime(transaction_date, '%Y-%m-%d') AS transaction_date,
                  strftime(month_year, '%Y-%m') AS month_year, CAST(amount AS DOUBLE) AS amount,
                  COALESCE(description, '') AS description, COALESCE(reference_no, '') AS reference_no
           FROM hired_vehicle_transactions WHERE id IN (SELECT id FROM hired_txn_keys)""",
    ),
    Pair(
        "advances_labelled",
        lambda b: labelled.advances_labelled(b.employee_advances()),
        """SELECT date, employee_name, printf('%.2f', CAST(amount AS DOUBLE)) AS amount,
                  COALESCE(NULLIF(purpose, ''), '-') AS purpose FROM employee_advances""",
    ),
    Pair(
        "recent_hired_txn_labelled",
        lambda b: labelled.recent_hired_txn_labelled(b.hired_vehicles(), b.hired_vehicle_transactions()),
        """SELECT t.transaction_date, hv.vehicle_no,
                  concat(upper(substr(t.transaction_type, 1, 1)), lower(substr(t.transaction_type, 2))) AS type,
                  CASE WHEN t.transaction_type = 'sale' THEN 'success' ELSE 'danger' END AS type_class,
                  COALESCE(NULLIF(t.description, ''), '-') AS description,
                  printf('%.2f', CAST(t.amount AS DOUBLE)) AS amount,
                  COALESCE(NULLIF(t.reference_no, ''), '-') AS reference_no
           FROM hired_vehicle_transactions t JOIN hired_vehicles hv ON t.hired_vehicle_id = hv.id
           ORDER BY t.transaction_date DESC NULLS FIRST, t.created_at DESC NULLS FIRST, t.id LIMIT 50""",
    ),
]
