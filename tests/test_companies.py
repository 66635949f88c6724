import datetime as dt
from collections import Counter

import pytest

from fleetbooks.operators import companies
from fleetbooks.operators.common import _hot_keys, fan_out_left_join, search_col
from fleetbooks.plans import exports, labelled
from tests.seed import rows, table

JAN, FEB = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


def sale(id, name, amount, month="2024-01-01", date="2024-01-05"):
    return {
        "id": id,
        "company_name": name,
        "sale_amount": amount,
        "month_year": month,
        "sale_date": date,
        "invoice_number": f"I{id}",
    }


def pay(id, name, amount, month="2024-01-01", date="2024-01-07", mode="bank_transfer"):
    return {
        "id": id,
        "company_name": name,
        "received_amount": amount,
        "month_year": month,
        "payment_date": date,
        "payment_mode": mode,
        "reference_number": f"R{id}",
    }


@pytest.fixture(scope="module")
def books(spark):
    sales = table(
        spark,
        "company_sales",
        [
            sale(1, "Both", "100"),
            sale(2, "Both", "50", date="2024-01-02"),
            sale(3, "Sold", "10"),
            sale(4, "Late", "5", month="2024-02-01"),
        ],
    )
    pays = table(
        spark,
        "company_payments",
        [
            pay(1, "Both", "30"),
            pay(2, "Both", "20", date="2024-01-03"),
            pay(3, "Both", "10", mode="cash"),
            pay(4, "Paid", "8"),
            pay(5, "Sold", "3", month="2024-02-01"),
        ],
    )
    return sales, pays


def test_month_has_all_three_cases_and_no_idle_company(books):
    assert rows(companies.company_month(*books, JAN)) == [
        ("Both", 150.0, 60.0, 90.0),
        ("Paid", 0.0, 8.0, -8.0),
        ("Sold", 10.0, 0.0, 10.0),
    ]


def test_one_company_always_has_a_row(books):
    assert rows(companies.company_month_one(*books, "Both", JAN)) == [("Both", 150.0, 60.0, 90.0)]
    assert rows(companies.company_month_one(*books, "Nobody", JAN)) == [("Nobody", 0.0, 0.0, 0.0)]


def test_summary_and_totals(books):
    assert rows(companies.company_summary(*books)) == [
        ("Both", 150.0, 60.0, 90.0, "2024-01-05", "2024-01-07"),
        ("Late", 5.0, 0.0, 5.0, "2024-01-05", None),
        ("Paid", 0.0, 8.0, -8.0, None, "2024-01-07"),
        ("Sold", 10.0, 3.0, 7.0, "2024-01-05", "2024-01-07"),
    ]
    assert rows(companies.company_totals(*books)) == [(165.0, 71.0, 94.0, 4)]
    assert rows(companies.company_month_totals(companies.company_month(*books, JAN))) == [
        (160.0, 68.0, 92.0)
    ]
    assert rows(companies.company_names(*books)) == [("Both",), ("Late",), ("Paid",), ("Sold",)]
    assert rows(search_col(companies.company_summary(*books), "company_name", "OL"), "company_name") == [
        ("Sold",)
    ]


def test_months_add_up_to_the_summary(books):
    months = [companies.company_month(*books, m) for m in (JAN, FEB)]
    by_company = Counter()
    for m in months:
        for name, _, _, pending in rows(m):
            by_company[name] += pending
    summary = rows(companies.company_summary(*books), "company_name", "pending_amount")
    assert by_company == Counter(dict(summary))


def test_export_multiplies_rows_and_drops_payments_without_sales(books):
    got = rows(companies.sales_with_payments(*books, JAN))
    assert Counter(r[0] for r in got) == {"Both": 6, "Sold": 1}
    assert got[-1] == ("Sold", dt.date(2024, 1, 5), "I3", 10.0, None, None, None, None, None)
    assert rows(exports.export_companies(*books, JAN)) == got


@pytest.mark.parametrize(
    "pairs, rows_each", [(1, 1000), (1000, 1), (4, 2), (9, 1000), (9, 3), (10**7, 10**6)]
)
def test_hot_keys_give_the_plain_join(spark, pairs, rows_each):
    """Split keys, repeated copies, keys on one side only and NULL keys."""
    left = [("hot", i) for i in range(11)] + [("copies", 1)] * 7 + [("alone", i) for i in range(5)]
    left += [(None, 1), (None, 2), ("cold", 1)]
    right = [("hot", i) for i in range(9)] + [("copies", 1)] * 6 + [("other", i) for i in range(9)]
    right += [(None, 1), ("cold", 5)]
    a = spark.createDataFrame(left, "k string, x int")
    b = spark.createDataFrame(right, "k string, y int")
    got = Counter(tuple(r) for r in fan_out_left_join(a, b, ["k"], pairs, rows_each).collect())
    want = Counter(tuple(r) for r in a.join(b, "k", "left").collect())
    assert got == want


def test_pieces_follow_the_pairs(spark):
    def pieces(l, r, pairs=100, rows_each=1000):
        a = spark.range(l).selectExpr("'k' AS k", "id AS x")
        b = spark.range(r).selectExpr("'k' AS k", "id AS y")
        return [tuple(x)[1:] for x in _hot_keys(a, b, ["k"], pairs, rows_each).collect()]

    assert pieces(10, 10) == []
    assert pieces(50, 30) == [(5, 3)]
    # the small side stays whole
    assert pieces(500, 2) == [(10, 1)]
    assert pieces(2, 500) == [(1, 10)]
    # many rows without a partner are cut by number alone
    assert pieces(5000, 0) == [(5, 1)]
    assert pieces(0, 5000) == [(1, 5)]


def test_hot_key_is_spread_over_tasks(spark):
    a = spark.range(400).selectExpr("'hot' AS k", "id AS x")
    b = spark.range(300).selectExpr("'hot' AS k", "id AS y")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = fan_out_left_join(a, b, ["k"], pairs_per_piece=2500)
        sizes = [n for n in joined.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 400 * 300
    assert len(sizes) > 4 and max(sizes) < 400 * 300 / 3


def test_ledger(books):
    got = rows(companies.company_ledger(*books, "Both", JAN), "type", "reference", "amount")
    assert got == [
        ("sale", "I2", 50.0),
        ("payment", "R2", 20.0),
        ("sale", "I1", 100.0),
        ("payment", "R1", 30.0),
        ("payment", "R3", 10.0),
    ]
    with_mode = companies.company_ledger(*books, "Both", JAN, with_mode=True)
    assert with_mode.columns == [
        "transaction_type",
        "date",
        "reference",
        "amount",
        "description",
        "payment_mode",
    ]
    assert {r[0] for r in rows(with_mode.filter("payment_mode IS NULL"))} == {"sale"}
    assert rows(exports.export_companies(*books, JAN, "Both")) == rows(with_mode)
    shown = rows(labelled.company_ledger_labelled(*books, "Both", JAN), "type", "payment_mode", "amount")
    assert shown[:2] == [("SALE", "-", "50.00"), ("PAYMENT", "BANK TRANSFER", "20.00")]


def test_ledger_adds_up_to_the_month(books):
    ledger = companies.company_ledger(*books, "Both", JAN)
    by_type = dict(rows(ledger.groupBy("type").agg({"amount": "sum"})))
    (one,) = rows(companies.company_month_one(*books, "Both", JAN))
    assert (by_type["sale"], by_type["payment"]) == one[1:3]


def test_recent_lists_and_labels(books):
    sales, pays = books
    assert rows(companies.recent_sales(sales, 2), "id") == [(1,), (3,)]
    assert rows(companies.recent_company_payments(pays, 1), "id") == [(1,)]
    assert rows(labelled.recent_company_payments_labelled(pays, 1), "payment_mode") == [("Bank_transfer",)]
    month = rows(labelled.company_month_labelled(*books, JAN), "company_name", "pending", "pending_class")
    assert month == [("Both", "90.00", "warning"), ("Paid", "-8.00", "success"), ("Sold", "10.00", "warning")]


def test_lookups(books):
    sales, pays = books
    assert rows(companies.lookup_sales(sales, [3])) == [(3, "2024-01-05", "Sold", "I3", 10.0, "2024-01", "")]
    assert rows(companies.lookup_company_payments(pays, [3])) == [
        (3, "2024-01-07", "Both", 10.0, "cash", "R3", "2024-01", "")
    ]
