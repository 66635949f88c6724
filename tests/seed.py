"""A small set of books with hand-worked results, and a builder for edge cases.

The numbers are fixed values: their totals are known by hand. ``P`` and ``Q``
stand for the two payers.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from fleetbooks.sources.schemas import SCHEMAS

P, Q = "P", "Q"


def day(text: str | None) -> dt.date | None:
    return None if text is None else dt.date.fromisoformat(text)


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows of a table; columns left out are NULL, dates and money may be text."""
    schema = SCHEMAS[name]

    def value(field, row):
        v = row.get(field.name)
        kind = field.dataType.typeName()
        if v is None:
            return None
        if kind == "date" and isinstance(v, str):
            return day(v)
        return Decimal(str(v)) if kind == "decimal" else v

    return spark.createDataFrame([tuple(value(f, r) for f in schema.fields) for r in rows], schema)


VEHICLES = [(1, "3393"), (2, "407"), (3, "202"), (4, "505")]

SPENDINGS = [
    (1, 1, "2024-01-15", "2024-01-01", "diesel", "Diesel - Paid", "5000.00", P, "UPI"),
    (2, 1, "2024-01-20", "2024-01-01", "salary", "Driver Salary", "8000.00", Q, "Cash"),
    (3, 2, "2024-01-10", "2024-01-01", "diesel", "Diesel - Paid", "4500.00", P, "UPI"),
    (4, 2, "2024-01-25", "2024-01-01", "others", "Maintenance", "2000.00", Q, "Cash"),
    (5, 3, "2024-01-05", "2024-01-01", "diesel", "Diesel - Unpaid", "4800.00", None, None),
    (6, 1, "2024-02-12", "2024-02-01", "diesel", "Diesel - Paid", "5200.00", P, "UPI"),
    (7, 1, "2024-02-18", "2024-02-01", "salary", "Driver Salary", "8000.00", Q, "Cash"),
    (8, 2, "2024-02-08", "2024-02-01", "diesel", "Diesel - Paid", "4600.00", P, "UPI"),
    (9, 3, "2024-02-22", "2024-02-01", "others", "Repair", "3500.00", Q, "Cash"),
]

PAYMENTS = [
    (1, 1, 1, "2024-01-10", "15000.00"),
    (2, 2, 2, "2024-01-15", "12000.00"),
    (3, 3, 3, "2024-01-20", "10000.00"),
    (4, 1, 1, "2024-02-12", "16000.00"),
    (5, 2, 2, "2024-02-18", "13000.00"),
]

ADVANCES = [
    (1, "Rajesh Kumar", "2024-01-05", "5000.00", "Advance for family emergency"),
    (2, "Suresh Patel", "2024-01-10", "3000.00", "Medical advance"),
    (3, "Rajesh Kumar", "2024-02-08", "4000.00", "Festival advance"),
]

COMPANIES = ["ABC Transport", "XYZ Logistics", "Quick Delivery", "Fast Cargo"]


class Seed:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        named = lambda cols, rows: [dict(zip(cols.split(), r)) for r in rows]
        self.vehicles = table(spark, "vehicles", named("id vehicle_no", VEHICLES))
        self.companies = table(
            spark, "companies", [{"id": i, "name": n} for i, n in enumerate(COMPANIES, 1)]
        )
        self.spendings = table(
            spark,
            "spendings",
            named("id vehicle_id date expense_month category reason amount spended_by mode", SPENDINGS),
        )
        self.payments = table(spark, "payments", named("id company_id vehicle_id date amount", PAYMENTS))
        self.advances = table(
            spark, "employee_advances", named("id employee_name date amount purpose", ADVANCES)
        )


def spending(id: int = 1, **changes) -> dict:
    """One paid spending of vehicle 1, with changes."""
    row = {
        "id": id,
        "vehicle_id": 1,
        "date": "2024-01-15",
        "expense_month": "2024-01-01",
        "category": "diesel",
        "amount": "10.00",
        "spended_by": P,
        "mode": "UPI",
    }
    return {**row, **changes}


def rows(df: DataFrame, *cols: str) -> list[tuple]:
    """Rows as tuples in order, money as float."""
    tidy = lambda v: float(v) if isinstance(v, Decimal) else v
    return [tuple(tidy(v) for v in r) for r in (df.select(*cols) if cols else df).collect()]
