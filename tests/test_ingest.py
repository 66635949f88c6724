import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetbooks.operators import ingest
from tests.seed import Seed, rows

GOOD = {
    "id": "1",
    "vehicle_id": "3",
    "date": "2024-3-5",
    "expense_month": "2024-3",
    "category": " others ",
    "reason": " tyres ",
    "amount": "12.345",
    "spended_by": " ",
    "mode": "UPI",
}


def raw(spark, *entries):
    cols = list(GOOD)
    schema = ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame([tuple({**GOOD, **e}[c] for c in cols) for e in entries], schema)


def test_good_spending_is_trimmed_and_parsed(spark):
    (row,) = ingest.ingest_spendings(raw(spark, {})).accepted.collect()
    assert row.asDict() == {
        "id": 1,
        "vehicle_id": 3,
        "date": dt.date(2024, 3, 5),
        "expense_month": dt.date(2024, 3, 1),
        "category": "others",
        "reason": "tyres",
        "amount": Decimal("12.35"),
        "spended_by": None,
        "mode": "UPI",
        "marked": False,
    }


BAD = [
    ({"vehicle_id": ""}, "missing vehicle_id"),
    ({"vehicle_id": "x"}, "bad vehicle_id"),
    ({"date": None}, "missing date"),
    ({"date": "2024-02-30"}, "bad date"),
    ({"date": "2024-1-5\n"}, "bad date"),
    ({"date": " 2024-1-5"}, "bad date"),
    ({"date": "2024-001-05"}, "bad date"),
    ({"date": "0000-01-05"}, "bad date"),
    ({"date": "05/01/2024"}, "bad date"),
    ({"expense_month": "2024-13"}, "bad expense_month"),
    ({"expense_month": "2024-01-01"}, "bad expense_month"),
    ({"category": " \t"}, "missing category"),
    ({"amount": ""}, "missing amount"),
    ({"amount": "abc"}, "bad amount"),
    ({"amount": "99999999999"}, "bad amount"),
    ({"amount": "0"}, "amount not above zero"),
    ({"amount": "-1"}, "amount not above zero"),
    ({"reason": "  "}, "missing reason"),
    ({"reason": None}, "missing reason"),
    # what is missing is named before what cannot be read
    ({"date": "x", "amount": ""}, "missing amount"),
]


def test_rejected_spendings_keep_their_text_and_a_reason(spark):
    entries = [{**e, "id": str(i)} for i, (e, _) in enumerate(BAD)]
    checked = ingest.ingest_spendings(raw(spark, *entries))
    assert checked.accepted.count() == 0
    got = checked.rejected.collect()
    assert [r.reject_reason for r in sorted(got, key=lambda r: int(r.id))] == [why for _, why in BAD]
    assert {r.category for r in got} == {" others ", " \t"}


def test_form_rules_can_be_left_out(spark):
    entries = raw(spark, {"amount": "-1"}, {"reason": None})
    assert ingest.ingest_spendings(entries, form_rules=False).accepted.count() == 2


def test_reason_is_blank_not_null_and_payer_and_mode_are_nulled_apart(spark):
    entries = raw(spark, {"category": "diesel", "reason": None, "spended_by": "P", "mode": " "})
    got = rows(ingest.ingest_spendings(entries).accepted, "reason", "spended_by", "mode")
    assert got == [("", "P", None)]


def test_edit_nulls_payer_and_mode_together_and_trims_nothing(spark):
    entries = raw(
        spark,
        {"spended_by": "P", "mode": ""},
        {"spended_by": None, "mode": "UPI"},
        {"spended_by": " ", "mode": "UPI"},
    )
    got = rows(ingest.spending_edits(entries).accepted, "category", "reason", "spended_by", "mode")
    assert got == [
        (" others ", " tyres ", None, None),
        (" others ", " tyres ", None, None),
        (" others ", " tyres ", " ", "UPI"),
    ]


def test_white_space_of_any_kind_is_trimmed(spark):
    padded = "  \t dies el \n　"
    got = rows(ingest.ingest_spendings(raw(spark, {"category": padded})).accepted, "category")
    assert got == [(padded.strip(),)]


def test_a_missing_column_is_a_missing_field(spark):
    entries = raw(spark, {}).drop("amount", "spended_by")
    assert rows(ingest.ingest_spendings(entries).rejected, "reject_reason") == [("missing amount",)]


def test_payments_of_either_form(spark):
    entries = spark.createDataFrame(
        [
            ("2024-01-02", "5", " A ", "", None, None),
            ("2024-01-02", "-5", None, None, "3", ""),
            ("2024-01-02", "5", None, None, "x", None),
            ("2024-01-02", None, None, None, None, None),
        ],
        "date string, amount string, received_from string, reason string, company_id string, vehicle_id string",
    )
    checked = ingest.ingest_payments(entries)
    assert rows(checked.accepted) == [
        (dt.date(2024, 1, 2), 5.0, "A", None, None, None),
        (dt.date(2024, 1, 2), -5.0, None, None, 3, None),
    ]
    assert rows(checked.rejected, "reject_reason") == [("bad company_id",), ("missing amount",)]


def test_advances_are_not_trimmed(spark):
    entries = spark.createDataFrame(
        [(" ", "2024-01-02", "5", None), ("", "2024-01-02", "5", "x")],
        "employee_name string, date string, amount string, purpose string",
    )
    checked = ingest.ingest_advances(entries)
    assert rows(checked.accepted, "employee_name", "purpose") == [(" ", "")]
    assert rows(checked.rejected, "reject_reason") == [("missing employee_name",)]


def test_new_company_name_replaces_the_placeholder(spark):
    entries = spark.createDataFrame(
        [("_new", " Fresh "), (" Old ", "ignored"), (" _new", " ")],
        "company_name string, new_company_name string",
    ).selectExpr(
        "*", "'2024-01-02' payment_date", "'5' received_amount", "'upi' payment_mode", "'2024-01' month_year"
    )
    checked = ingest.ingest_company_payments(entries)
    assert rows(checked.accepted, "company_name") == [("Fresh",), ("Old",)]
    assert rows(checked.rejected, "reject_reason") == [("missing company_name",)]


def test_sales_and_hired_transactions(spark):
    sales = spark.createDataFrame(
        [("2024-01-02", " A ", "5", "2024-01")],
        "sale_date string, company_name string, sale_amount string, month_year string",
    )
    (row,) = ingest.ingest_company_sales(sales).accepted.collect()
    assert (row.company_name, row.invoice_number, row.month_year) == ("A", "", dt.date(2024, 1, 1))
    txn = spark.createDataFrame(
        [("1", "sale", "2024-01-02", "2024-01", "5"), (None, "sale", "2024-01-02", "2024-01", "5")],
        "hired_vehicle_id string, transaction_type string, transaction_date string, month_year string, amount string",
    )
    assert ingest.ingest_hired_txn(txn).accepted.count() == 1
    # an edit does not name the vehicle
    edit = ingest.ingest_hired_txn(txn.drop("hired_vehicle_id")).accepted
    assert "hired_vehicle_id" not in edit.columns and edit.count() == 2


def test_new_vehicles_against_table_and_batch(spark):
    seed = Seed(spark)
    entries = spark.createDataFrame(
        [(1, " 3393 "), (2, "new"), (3, " new"), (4, " "), (5, None), (6, "other")],
        "id long, vehicle_no string",
    )
    checked = ingest.ingest_vehicles(entries, seed.vehicles)
    assert sorted(rows(checked.accepted, "id", "vehicle_no", "owner_name")) == [(2, "new", ""), (6, "other", "")]
    assert sorted(rows(checked.rejected, "id", "reject_reason")) == [
        (1, "vehicle_no already exists"),
        (3, "vehicle_no repeated in the batch"),
        (4, "missing vehicle_no"),
        (5, "missing vehicle_no"),
    ]


def test_reject_existing_keeps_the_first_of_each_name(spark):
    seed = Seed(spark)
    entries = spark.createDataFrame(
        [(3, "x", "late"), (1, "x", "first"), (2, "407", "known")],
        "id long, vehicle_no string, note string",
    )
    got = ingest.reject_existing(entries, seed.vehicles, "vehicle_no", "id")
    assert got.columns == entries.columns and rows(got) == [(1, "x", "first")]


@pytest.mark.parametrize(
    "category, status, expected",
    [
        ("diesel", "Paid", ("Diesel - Paid", "1", "P1", "M1")),
        ("diesel", "Unpaid", ("Diesel - Unpaid", "2", "", "")),
        ("salary", "Unpaid", ("Driver Salary", "3", "P3", "M3")),
        ("others", "Unpaid", ("given", "4", "P4", "M4")),
        ("rent", "Paid", (None, None, None, None)),
    ],
)
def test_form_fields_by_category(spark, category, status, expected):
    form = spark.range(1).select(
        F.lit(category).alias("category"),
        F.lit(status).alias("diesel_payment_status"),
        F.lit("given").alias("reason"),
        F.lit("2").alias("unpaid_diesel_amount"),
        *[
            F.lit(f"{v}{n}" if v else n).alias(f"{c}_{part}")
            for c, n in (("diesel", "1"), ("salary", "3"), ("others", "4"))
            for part, v in (("amount", ""), ("spended_by", "P"), ("mode", "M"))
        ],
    )
    got = rows(ingest.shape_spending_forms(form), "reason", "amount", "spended_by", "mode")
    assert got == [expected]


def test_row_rules_run_on_a_stream(spark, tmp_path):
    """The rules need no state, so a folder of raw entries can be read as a stream."""
    source = str(tmp_path / "raw")
    raw(spark, {}, {"amount": "abc"}).write.json(source)
    schema = ", ".join(f"{c} string" for c in GOOD)
    stream = spark.readStream.schema(schema).json(source)
    query = (
        ingest.ingest_spendings(stream)
        .rejected.writeStream.format("memory")
        .queryName("rejected_entries")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert rows(spark.table("rejected_entries"), "reject_reason") == [("bad amount",)]
