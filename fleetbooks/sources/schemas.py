"""Schemas of the books, as Spark types.

Where two definitions of a table disagree the wider one is used, and columns
known to only one of them are kept and nullable.
"""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(12, 2)


def _table(ddl: str) -> T.StructType:
    """``name type`` pairs; a ``!`` after the type marks a required column."""
    kinds = {
        "long": T.LongType(),
        "text": T.StringType(),
        "date": T.DateType(),
        "money": _MONEY,
        "flag": T.BooleanType(),
        "time": T.TimestampNTZType(),
    }
    fields = []
    for item in ddl.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


SCHEMAS: dict[str, T.StructType] = {
    "vehicles": _table(
        "id long!, vehicle_no text!, owner_name text, contact_number text, created_at time"
    ),
    "companies": _table("id long!, name text!, created_at time"),
    "spendings": _table(
        "id long!, vehicle_id long, date date!, expense_month date, category text!, reason text,"
        " amount money!, spended_by text, mode text, marked flag, created_at time"
    ),
    "payments": _table(
        "id long!, date date!, amount money!, received_from text, reason text, company_id long,"
        " vehicle_id long, created_at time"
    ),
    "employee_advances": _table(
        "id long!, employee_name text!, date date!, amount money!, purpose text, created_at time"
    ),
    "hired_vehicles": _table(
        "id long!, vehicle_no text!, owner_name text, contact_number text, created_at time"
    ),
    "hired_vehicle_transactions": _table(
        "id long!, hired_vehicle_id long, transaction_type text!, transaction_date date!,"
        " month_year date!, amount money!, description text, reference_no text, created_at time"
    ),
    "company_sales": _table(
        "id long!, sale_date date!, company_name text!, invoice_number text, sale_amount money!,"
        " description text, month_year date!, created_at time"
    ),
    "company_payments": _table(
        "id long!, payment_date date!, company_name text!, received_amount money!,"
        " payment_mode text!, reference_number text, description text, month_year date!,"
        " created_at time"
    ),
}

# The month column each large table is laid out by on disk.
MONTH_COLUMN: dict[str, str] = {
    "spendings": "expense_month",
    "hired_vehicle_transactions": "month_year",
    "company_sales": "month_year",
    "company_payments": "month_year",
}

# Columns that rows are looked up by one at a time; the ids of other tables first of all
# find the months of a deleted row's children.
KEYS: dict[str, tuple[str, ...]] = {
    "vehicles": ("id",),
    "companies": ("id",),
    "spendings": ("id", "vehicle_id"),
    "payments": ("id", "vehicle_id", "company_id"),
    "employee_advances": ("id",),
    "hired_vehicles": ("id",),
    "hired_vehicle_transactions": ("id", "hired_vehicle_id"),
    "company_sales": ("id",),
    "company_payments": ("id",),
}

# How a full listing of each table is ordered: column, newest first or by name.
LISTING_ORDER: dict[str, tuple[str, bool]] = {
    "vehicles": ("vehicle_no", False),
    "companies": ("name", False),
    "spendings": ("date", True),
    "payments": ("date", True),
    "employee_advances": ("date", True),
    "hired_vehicles": ("vehicle_no", False),
    "hired_vehicle_transactions": ("transaction_date", True),
    "company_sales": ("sale_date", True),
    "company_payments": ("payment_date", True),
}
