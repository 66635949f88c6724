"""Raw entries, corrections, deletions and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.pairs import Pair
from checks.views import AS_OF, Books
from fleetbooks.operators import changes, ingest, quality


def _day(c: str) -> str:
    return f"try_cast(NULLIF({c}, '') AS DATE)"


def _month(c: str) -> str:
    return f"try_cast({c} || '-01' AS DATE)"


def _money(c: str) -> str:
    return f"try_cast({c} AS DECIMAL(12,2))"


def _missing(c: str, name: str) -> str:
    return f"WHEN {c} IS NULL OR {c} = '' THEN 'missing {name}'"


def _bad(c: str, parsed: str, name: str) -> str:
    return f"WHEN {c} <> '' AND {parsed} IS NULL THEN 'bad {name}'"


def _ingest(key: str, raw: str, check, row: str, rules: list[str]) -> list[Pair]:
    """The accepted and the rejected part of one ingest, as two queries."""
    reason = "CASE " + " ".join(rules) + " END"
    checked = f"SELECT *, {reason} AS reject_reason FROM {raw}"
    return [
        Pair(
            key,
            lambda b: check(b).accepted,
            f"SELECT {row} FROM ({checked}) WHERE reject_reason IS NULL",
        ),
        Pair(
            f"{key}_rejected",
            lambda b: check(b).rejected,
            f"SELECT * FROM ({checked}) WHERE reject_reason IS NOT NULL",
        ),
    ]


PAIRS: list[Pair] = []

PAIRS += _ingest(
    "ingest_spendings",
    "raw_spendings",
    lambda b: ingest.ingest_spendings(b.raw_spendings()),
    f"""CAST(id AS BIGINT) AS id, CAST(vehicle_id AS BIGINT) AS vehicle_id, {_day('date')} AS date,
        {_month('expense_month')} AS expense_month, trim(category) AS category,
        trim(COALESCE(reason, '')) AS reason, CAST({_money('amount')} AS DOUBLE) AS amount,
        NULLIF(trim(spended_by), '') AS spended_by, NULLIF(trim(mode), '') AS mode, FALSE AS marked""",
    [
        _missing("vehicle_id", "vehicle_id"),
        _missing("date", "date"),
        _missing("expense_month", "expense_month"),
        _missing("trim(category)", "category"),
        _missing("amount", "amount"),
        _bad("vehicle_id", "try_cast(vehicle_id AS BIGINT)", "vehicle_id"),
        _bad("date", _day("date"), "date"),
        _bad("expense_month", _month("expense_month"), "expense_month"),
        _bad("amount", _money("amount"), "amount"),
        f"WHEN {_money('amount')} <= 0 THEN 'amount not above zero'",
        "WHEN trim(category) = 'others' AND trim(COALESCE(reason, '')) = '' THEN 'missing reason'",
    ],
)
PAIRS += _ingest(
    "ingest_payments",
    "raw_payments",
    lambda b: ingest.ingest_payments(b.raw_payments()),
    f"""CAST(id AS BIGINT) AS id, {_day('date')} AS date, CAST({_money('amount')} AS DOUBLE) AS amount,
        NULLIF(trim(received_from), '') AS received_from, NULLIF(trim(reason), '') AS reason,
        CAST(company_id AS BIGINT) AS company_id, CAST(vehicle_id AS BIGINT) AS vehicle_id""",
    [
        _missing("date", "date"),
        _missing("amount", "amount"),
        _bad("date", _day("date"), "date"),
        _bad("amount", _money("amount"), "amount"),
    ],
)
PAIRS += _ingest(
    "ingest_advances",
    "raw_advances",
    lambda b: ingest.ingest_advances(b.raw_advances()),
    f"""CAST(id AS BIGINT) AS id, employee_name, {_day('date')} AS date,
        CAST({_money('amount')} AS DOUBLE) AS amount, COALESCE(purpose, '') AS purpose""",
    [
        _missing("employee_name", "employee_name"),
        _missing("date", "date"),
        _missing("amount", "amount"),
        _bad("date", _day("date"), "date"),
        _bad("amount", _money("amount"), "amount"),
    ],
)
PAIRS += _ingest(
    "ingest_hired_txn",
    "raw_hired_txn",
    # created_at is set by the table, it is no field of the form
    lambda b: ingest.ingest_hired_txn(b.raw_hired_txn().drop("created_at")),
    f"""CAST(id AS BIGINT) AS id, CAST(hired_vehicle_id AS BIGINT) AS hired_vehicle_id, transaction_type,
        {_day('transaction_date')} AS transaction_date, {_month('month_year')} AS month_year,
        CAST({_money('amount')} AS DOUBLE) AS amount, trim(COALESCE(description, '')) AS description,
        trim(COALESCE(reference_no, '')) AS reference_no""",
    [
        _missing("hired_vehicle_id", "hired_vehicle_id"),
        _missing("transaction_type", "transaction_type"),
        _missing("transaction_date", "transaction_date"),
        _missing("month_year", "month_year"),
        _missing("amount", "amount"),
        _bad("transaction_date", _day("transaction_date"), "transaction_date"),
        _bad("month_year", _month("month_year"), "month_year"),
        _bad("amount", _money("amount"), "amount"),
    ],
)
PAIRS += _ingest(
    "ingest_company_sales",
    "raw_company_sales",
    lambda b: ingest.ingest_company_sales(b.raw_company_sales()),
    f"""CAST(id AS BIGINT) AS id, {_day('sale_date')} AS sale_date, trim(company_name) AS company_name,
        trim(COALESCE(invoice_number, '')) AS invoice_number, CAST({_money('sale_amount')} AS DOUBLE) AS sale_amount,
        trim(COALESCE(description, '')) AS description, {_month('month_year')} AS month_year""",
    [
        _missing("sale_date", "sale_date"),
        _missing("trim(company_name)", "company_name"),
        _missing("sale_amount", "sale_amount"),
        _missing("month_year", "month_year"),
        _bad("sale_date", _day("sale_date"), "sale_date"),
        _bad("sale_amount", _money("sale_amount"), "sale_amount"),
    ],
)
_RECEIVER = "trim(CASE WHEN trim(company_name) = '_new' THEN new_company_name ELSE company_name END)"
PAIRS += _ingest(
    "ingest_company_payments",
    "raw_company_payments",
    lambda b: ingest.ingest_company_payments(b.raw_company_payments()),
    f"""CAST(id AS BIGINT) AS id, {_day('payment_date')} AS payment_date, {_RECEIVER} AS company_name,
        CAST({_money('received_amount')} AS DOUBLE) AS received_amount, payment_mode,
        trim(COALESCE(reference_number, '')) AS reference_number,
        trim(COALESCE(description, '')) AS description, {_month('month_year')} AS month_year""",
    [
        _missing("payment_date", "payment_date"),
        _missing(_RECEIVER, "company_name"),
        _missing("received_amount", "received_amount"),
        _missing("payment_mode", "payment_mode"),
        _missing("month_year", "month_year"),
        _bad("payment_date", _day("payment_date"), "payment_date"),
        _bad("received_amount", _money("received_amount"), "received_amount"),
    ],
)


def _names(key: str, check, column: str, base: str, blanks: str) -> list[Pair]:
    """Names that must be new: against the table, then within the batch by id."""
    checked = f"""
    SELECT r.id, r.name, trim(r.name) AS clean,
           CASE WHEN trim(r.name) = '' THEN 'missing {column}'
                WHEN trim(r.name) IN (SELECT {column} FROM {base}) THEN '{column} already exists'
                WHEN r.id > MIN(r.id) OVER (PARTITION BY trim(r.name)) THEN '{column} repeated in the batch'
           END AS reject_reason
    FROM raw_names r"""
    return [
        Pair(
            key,
            lambda b: check(b).accepted,
            f"SELECT id, clean AS {column}{blanks} FROM ({checked}) WHERE reject_reason IS NULL",
        ),
        Pair(
            f"{key}_rejected",
            lambda b: check(b).rejected,
            f"SELECT id, name AS {column}, reject_reason FROM ({checked}) WHERE reject_reason IS NOT NULL",
        ),
    ]


_NO_OWNER = ", '' AS owner_name, '' AS contact_number"
PAIRS += _names(
    "ingest_vehicles",
    lambda b: ingest.ingest_vehicles(b.raw_names("vehicle_no"), b.vehicles()),
    "vehicle_no",
    "vehicles",
    _NO_OWNER,
)
PAIRS += _names(
    "ingest_hired_vehicles",
    lambda b: ingest.ingest_vehicles(b.raw_names("vehicle_no"), b.hired_vehicles()),
    "vehicle_no",
    "hired_vehicles",
    _NO_OWNER,
)
PAIRS += _names(
    "ingest_companies",
    lambda b: ingest.ingest_companies(b.raw_names("name"), b.companies()),
    "name",
    "companies",
    "",
)

PAIRS += [
    Pair(
        "new_vehicles",
        lambda b: ingest.reject_existing(b.raw_names("vehicle_no"), b.vehicles(), "vehicle_no", "id"),
        """SELECT MIN(id) AS id, name AS vehicle_no FROM raw_names
           WHERE name NOT IN (SELECT vehicle_no FROM vehicles) GROUP BY name""",
    ),
    Pair(
        "shape_spending_forms",
        lambda b: ingest.shape_spending_forms(b.spending_forms()),
        """SELECT id, category,
                  CASE category WHEN 'diesel' THEN concat('Diesel - ', CASE WHEN paid THEN 'Paid' ELSE 'Unpaid' END)
                                WHEN 'salary' THEN 'Driver Salary' ELSE reason END AS reason,
                  CAST(amount AS STRING) AS amount,
                  CASE WHEN category = 'diesel' AND NOT paid THEN '' ELSE spended_by END AS spended_by,
                  CASE WHEN category = 'diesel' AND NOT paid THEN '' ELSE mode END AS mode
           FROM (SELECT *, spended_by IS NOT NULL AND mode IS NOT NULL AS paid FROM spendings)""",
    ),
]

# --- corrections ------------------------------------------------------------


def _settle(key: str, label: str) -> Pair:
    return Pair(
        key,
        lambda b: changes.settle(b.spendings(), b.keys("spendings"), "E42", "UPI", AS_OF, label),
        f"""
        SELECT id, vehicle_id, date, expense_month, category,
               CASE WHEN hit THEN COALESCE(reason, '') || ' - {label} on {AS_OF}' ELSE reason END AS reason,
               CAST(amount AS DOUBLE) AS amount, CASE WHEN hit THEN 'E42' ELSE spended_by END AS spended_by,
               CASE WHEN hit THEN 'UPI' ELSE mode END AS mode, marked
        FROM (SELECT *, id IN (SELECT id FROM spending_keys) AS hit FROM spendings)""",
    )


def _edits(keys: str, fields: str) -> str:
    """The edits as the Spark side makes them; the last usable one per id counts."""
    return f"""
    SELECT * FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC) AS rank FROM (
        SELECT id, seq, {fields}
        FROM (SELECT id, unnest([1, 2]) AS seq FROM {keys})
      ) WHERE amount IS NOT NULL
    ) WHERE rank = 1"""


# Every eleventh edit has an amount that cannot be used and is not applied.
def _amount():
    some = (F.col("id") % 1000 + F.col("seq")).cast("string")
    return F.when((F.col("id") + F.col("seq")) % 11 == 0, "abc").otherwise(F.concat(some, F.lit(".50")))


_AMOUNT_SQL = (
    "CASE WHEN (id + seq) % 11 <> 0 THEN CAST((id % 1000 + seq) || '.50' AS DECIMAL(12,2)) END AS amount"
)


def spending_edits(b: Books):
    fields = {
        "vehicle_id": F.lit("3"),
        "date": F.lit("2000-1-2"),
        "expense_month": F.lit("2000-1"),
        "category": F.lit("others"),
        "reason": F.lit(" edited "),
        "amount": _amount(),
        "spended_by": F.when(F.col("id") % 2 == 0, "").otherwise("E9"),
        "mode": F.lit("UPI"),
    }
    return ingest.spending_edits(b.edits("spendings", fields)).accepted


def _edit(key: str, base, edit, table: str, keys: str, amount: str, fields: str, values: dict[str, str]) -> Pair:
    """``values``: column -> expression over the edit ``e``; other columns stay."""
    stay = "* REPLACE (" + ", ".join(
        f"CASE WHEN e.id IS NOT NULL THEN {v} ELSE t.{c} END AS {c}" for c, v in values.items()
    ) + ")"
    sql = f"""
    WITH e AS ({_edits(keys, fields)}),
         n AS (SELECT t.{stay} FROM {table} t LEFT JOIN e ON t.id = e.id)
    SELECT * REPLACE (CAST({amount} AS DOUBLE) AS {amount}) FROM n"""
    return Pair(key, lambda b: changes.apply_updates(base(b), edit(b), seq="seq"), sql)


def _text_edit(table: str, parse, fields):
    return lambda b: parse(b.edits(table, fields())).accepted


PAIRS += [
    _settle("settle_spendings", changes.SETTLED),
    _settle("mark_paid", changes.MARKED_PAID),
    _edit(
        "edit_spendings",
        lambda b: b.spendings(),
        spending_edits,
        "spendings",
        "spending_keys",
        "amount",
        _AMOUNT_SQL,
        {
            "vehicle_id": "3",
            "date": "DATE '2000-01-02'",
            "expense_month": "DATE '2000-01-01'",
            "category": "'others'",
            "reason": "' edited '",
            "amount": "e.amount",
            "spended_by": "CASE WHEN t.id % 2 <> 0 THEN 'E9' END",
            "mode": "CASE WHEN t.id % 2 <> 0 THEN 'UPI' END",
        },
    ),
    _edit(
        "edit_advances",
        lambda b: b.employee_advances(),
        _text_edit(
            "employee_advances",
            ingest.advance_edits,
            lambda: {
                "employee_name": F.lit("E1"),
                "date": F.lit("2024-02-03"),
                "amount": _amount(),
                "purpose": F.when(F.col("id") % 2 == 0, "edited"),
            },
        ),
        "employee_advances",
        "advance_keys",
        "amount",
        _AMOUNT_SQL,
        {
            "employee_name": "'E1'",
            "date": "DATE '2024-02-03'",
            "amount": "e.amount",
            "purpose": "CASE WHEN t.id % 2 = 0 THEN 'edited' END",
        },
    ),
    _edit(
        "edit_hired_txn",
        lambda b: b.hired_vehicle_transactions(),
        _text_edit(
            "hired_vehicle_transactions",
            ingest.ingest_hired_txn,
            lambda: {
                "transaction_type": F.lit("sale"),
                "transaction_date": F.lit("2024-02-03"),
                "month_year": F.lit("2024-02"),
                "amount": _amount(),
                "description": F.lit(" edited "),
                "reference_no": F.lit(""),
            },
        ),
        "hired_vehicle_transactions",
        "hired_txn_keys",
        "amount",
        _AMOUNT_SQL,
        {
            "transaction_type": "'sale'",
            "transaction_date": "DATE '2024-02-03'",
            "month_year": "DATE '2024-02-01'",
            "amount": "e.amount",
            "description": "'edited'",
            "reference_no": "''",
        },
    ),
    _edit(
        "edit_company_sales",
        lambda b: b.company_sales(),
        _text_edit(
            "company_sales",
            ingest.ingest_company_sales,
            lambda: {
                "sale_date": F.lit("2000-01-02"),
                "company_name": F.lit(" Someone "),
                "invoice_number": F.concat(F.lit("N"), F.col("id").cast("string")),
                "sale_amount": _amount(),
                "description": F.lit("edited"),
                "month_year": F.lit("2000-01"),
            },
        ),
        "company_sales",
        "sale_keys",
        "sale_amount",
        _AMOUNT_SQL,
        {
            "sale_date": "DATE '2000-01-02'",
            "company_name": "'Someone'",
            "invoice_number": "'N' || t.id",
            "sale_amount": "e.amount",
            "description": "'edited'",
            "month_year": "DATE '2000-01-01'",
        },
    ),
    _edit(
        "edit_company_payments",
        lambda b: b.company_payments(),
        _text_edit(
            "company_payments",
            ingest.company_payment_edits,
            lambda: {
                "payment_date": F.lit("2000-01-02"),
                "company_name": F.when(F.col("id") % 2 == 0, " _new ").otherwise(" Someone "),
                "received_amount": _amount(),
                "payment_mode": F.lit("upi"),
                "reference_number": F.lit(" R "),
                "description": F.lit("edited"),
                "month_year": F.lit("2000-01"),
            },
        ),
        "company_payments",
        "company_payment_keys",
        "received_amount",
        _AMOUNT_SQL,
        {
            "payment_date": "DATE '2000-01-02'",
            "company_name": "CASE WHEN t.id % 2 = 0 THEN '_new' ELSE 'Someone' END",
            "received_amount": "e.amount",
            "payment_mode": "'upi'",
            "reference_number": "'R'",
            "description": "'edited'",
            "month_year": "DATE '2000-01-01'",
        },
    ),
    Pair(
        "toggle_marks",
        lambda b: changes.toggle_marks(b.spendings(), b.keys("spendings")),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount,
                  CASE WHEN id IN (SELECT id FROM spending_keys) THEN NOT COALESCE(marked, FALSE) ELSE marked END AS marked)
           FROM spendings""",
    ),
    Pair(
        "existing_ids",
        lambda b: changes.require_existing(b.keys("spendings"), b.spendings()),
        "SELECT id FROM spending_keys WHERE id IN (SELECT id FROM spendings)",
    ),
    Pair(
        "unknown_ids",
        lambda b: changes.unknown_keys(b.keys("spendings"), b.spendings()),
        "SELECT id FROM spending_keys WHERE id NOT IN (SELECT id FROM spendings)",
    ),
]


def _delete(key: str, table: str, keys: str, amount: str) -> Pair:
    def build(b: Books):
        base = getattr(b, table)()
        return changes.delete_rows(base, b.keys(table))

    return Pair(
        key,
        build,
        f"""SELECT * REPLACE (CAST({amount} AS DOUBLE) AS {amount}) FROM {table}
            WHERE id NOT IN (SELECT id FROM {keys})""",
    )


PAIRS += [
    _delete("delete_rows", "spendings", "spending_keys", "amount"),
    _delete("delete_payments", "payments", "payment_keys", "amount"),
    _delete("delete_advances", "employee_advances", "advance_keys", "amount"),
    _delete("delete_hired_txn", "hired_vehicle_transactions", "hired_txn_keys", "amount"),
    _delete("delete_company_sales", "company_sales", "sale_keys", "sale_amount"),
    _delete("delete_company_payments", "company_payments", "company_payment_keys", "received_amount"),
    Pair(
        "delete_cascade",
        lambda b: changes.delete_rows(b.spendings(), b.keys("vehicles"), key="vehicle_id"),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM spendings
           WHERE vehicle_id NOT IN (SELECT id FROM vehicle_keys)""",
    ),
    Pair(
        "delete_set_null",
        lambda b: changes.detach_rows(b.payments(), b.keys("vehicles"), key="vehicle_id"),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount,
                  CASE WHEN vehicle_id NOT IN (SELECT id FROM vehicle_keys) THEN vehicle_id END AS vehicle_id)
           FROM payments""",
    ),
]

# --- constraint checks ------------------------------------------------------

PAIRS += [
    Pair(
        "duplicate_report",
        lambda b: quality.duplicate_report(
            b.vehicles(),
            b.companies(),
            b.hired_vehicles(),
            b.company_sales(),
            b.spendings(),
            same_entry=("vehicle_id", "date", "category"),
        ),
        """
        SELECT * FROM (
          SELECT 'vehicles.vehicle_no' AS "check", vehicle_no AS value, COUNT(*) AS rows FROM vehicles GROUP BY vehicle_no
          UNION ALL SELECT 'companies.name', name, COUNT(*) FROM companies GROUP BY name
          UNION ALL SELECT 'hired_vehicles.vehicle_no', vehicle_no, COUNT(*) FROM hired_vehicles GROUP BY vehicle_no
          UNION ALL SELECT 'company_sales.invoice_number', invoice_number, COUNT(*) FROM company_sales GROUP BY invoice_number
          UNION ALL SELECT 'spendings entry',
                           CAST(vehicle_id AS STRING) || ' | ' || CAST(date AS STRING) || ' | ' || category, COUNT(*)
                    FROM spendings GROUP BY vehicle_id, date, category
        ) WHERE rows > 1""",
    ),
    Pair(
        "duplicate_spending_ids",
        lambda b: quality.duplicates(b.spendings(), ["id"]),
        "SELECT id, COUNT(*) AS rows FROM spendings GROUP BY id HAVING COUNT(*) > 1",
    ),
    Pair(
        "duplicate_vehicle_days",
        lambda b: quality.duplicates(b.spendings(), ["vehicle_id", "date"]),
        "SELECT vehicle_id, date, COUNT(*) AS rows FROM spendings GROUP BY vehicle_id, date HAVING COUNT(*) > 1",
    ),
    Pair(
        "deletable_vehicles",
        lambda b: quality.unreferenced(
            b.hired_vehicles(), b.hired_vehicle_transactions(), "hired_vehicle_id"
        ),
        "SELECT * FROM hired_vehicles WHERE id NOT IN (SELECT hired_vehicle_id FROM hired_vehicle_transactions)",
    ),
    Pair(
        "orphan_report",
        lambda b: quality.orphans(
            b.spendings(), changes.delete_rows(b.vehicles(), b.keys("vehicles")), "vehicle_id"
        ),
        """SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM spendings
           WHERE vehicle_id IS NOT NULL AND vehicle_id NOT IN
                 (SELECT id FROM vehicles WHERE id NOT IN (SELECT id FROM vehicle_keys))""",
    ),
    Pair(
        "safe_vehicle_delete",
        lambda b: quality.safe_delete(
            b.hired_vehicles(), b.hired_vehicle_transactions(), b.keys("hired_vehicles"), "hired_vehicle_id"
        ),
        """SELECT * FROM hired_vehicles
           WHERE id NOT IN (SELECT id FROM hired_vehicle_keys)
              OR id IN (SELECT hired_vehicle_id FROM hired_vehicle_transactions)""",
    ),
]
