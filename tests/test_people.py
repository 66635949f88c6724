import datetime as dt

import pytest

from fleetbooks.operators import employees, hired
from fleetbooks.plans import exports, labelled
from tests.seed import P, Q, Seed, rows, spending, table

JAN = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def seed(spark):
    return Seed(spark)


def test_employee_balance_of_all_names(seed):
    got = rows(employees.employee_balance(seed.advances, seed.spendings), "employee_name", "balance")
    assert got == [(P, -19300.0), (Q, -21500.0), ("Rajesh Kumar", 9000.0), ("Suresh Patel", 3000.0)]


def test_employee_balance_of_names_with_advances(seed):
    got = rows(employees.employee_balance(seed.advances, seed.spendings, all_names=False))
    assert got == [("Rajesh Kumar", 9000.0, 0.0, 9000.0), ("Suresh Patel", 3000.0, 0.0, 3000.0)]


def test_empty_and_null_names(spark):
    adv = table(
        spark,
        "employee_advances",
        [
            {"id": 1, "employee_name": "", "date": "2024-01-01", "amount": "7"},
            {"id": 2, "employee_name": P, "date": "2024-01-01", "amount": "9"},
        ],
    )
    sp = table(spark, "spendings", [spending(1, spended_by=""), spending(2, spended_by=None), spending(3)])
    assert rows(employees.employee_names(adv, sp)) == [(P,)]
    assert rows(employees.employee_balance(adv, sp)) == [(P, 9.0, 10.0, -1.0)]
    assert rows(employees.employee_balance(adv, sp, all_names=False)) == [
        ("", 7.0, 10.0, -3.0),
        (P, 9.0, 10.0, -1.0),
    ]


def test_both_definitions_agree_on_names_with_advances(seed):
    everyone = set(rows(employees.employee_balance(seed.advances, seed.spendings)))
    advanced = set(rows(employees.employee_balance(seed.advances, seed.spendings, all_names=False)))
    names = {r[0] for r in rows(seed.advances, "employee_name")}
    assert advanced == {r for r in everyone if r[0] in names}


def test_employee_summary_and_labels(spark, seed):
    balances = employees.employee_balance(seed.advances, seed.spendings)
    assert rows(employees.employee_summary(balances)) == [(4, 12000.0, 40800.0, -28800.0)]
    status = dict(
        rows(labelled.employee_balance_labelled(seed.advances, seed.spendings), "employee_name", "status")
    )
    assert status[P] == "Company owes employee" and status["Suresh Patel"] == "Employee owes company"
    adv = table(
        spark, "employee_advances", [{"id": 1, "employee_name": P, "date": "2024-01-01", "amount": "10"}]
    )
    even = labelled.employee_balance_labelled(adv, table(spark, "spendings", [spending(1)]))
    assert rows(even) == [(P, "10.00", "10.00", "0.00", "Settled")]


def test_employee_expense_detail(seed):
    got = rows(employees.employee_expense_detail(seed.spendings, seed.vehicles))
    assert len(got) == 8
    assert got[0] == (dt.date(2024, 2, 22), Q, 3500.0, "202", "others", "Repair")


# --- hired vehicles ---------------------------------------------------------


def txn(id, vehicle, kind, amount, month="2024-01-01", date="2024-01-10", minute=0):
    return {
        "id": id,
        "hired_vehicle_id": vehicle,
        "transaction_type": kind,
        "transaction_date": date,
        "month_year": month,
        "amount": amount,
        "created_at": dt.datetime(2024, 1, 10, 8, minute),
    }


@pytest.fixture(scope="module")
def books(spark):
    hv = table(
        spark,
        "hired_vehicles",
        [
            {"id": 1, "vehicle_no": "B", "owner_name": "Ann"},
            {"id": 2, "vehicle_no": "A"},
            {"id": 3, "vehicle_no": "C"},
        ],
    )
    t = table(
        spark,
        "hired_vehicle_transactions",
        [
            txn(1, 1, "sale", "100", minute=2),
            txn(2, 1, "payment", "30", minute=1),
            txn(3, 1, "gift", "500"),
            txn(4, 1, "sale", "7", month="2024-02-01"),
            txn(5, 2, "payment", "5", month="2024-02-01"),
            txn(6, None, "sale", "1000"),
        ],
    )
    return hv, t


def test_hired_vehicles_without_rows_in_the_month_stay(books):
    hv, t = books
    assert rows(hired.hired_summary(hv, t, JAN)) == [
        (2, "A", None, 0.0, 0.0),
        (1, "B", "Ann", 100.0, 30.0),
        (3, "C", None, 0.0, 0.0),
    ]
    assert rows(hired.hired_summary(hv, t)) == [
        (2, "A", None, 0.0, 5.0),
        (1, "B", "Ann", 107.0, 30.0),
        (3, "C", None, 0.0, 0.0),
    ]
    assert rows(hired.hired_summary(hv, t, JAN, 2)) == [(2, "A", None, 0.0, 0.0)]
    assert rows(hired.hired_summary(hv, t, JAN, 99)) == []


def test_hired_net_balance_and_labels(books):
    hv, t = books
    assert rows(hired.hired_net_balance(hv, t, JAN))[1] == ("B", "Ann", 100.0, 30.0, 70.0)
    assert rows(exports.export_hired(hv, t, JAN)) == rows(hired.hired_net_balance(hv, t, JAN))
    got = rows(labelled.hired_summary_labelled(hv, t), "vehicle_no", "owner_name", "balance", "balance_class")
    assert got == [
        ("A", "-", "-5.00", "danger"),
        ("B", "Ann", "77.00", "success"),
        ("C", "-", "0.00", "danger"),
    ]


def test_hired_detail_in_order_of_entry(books):
    hv, t = books
    assert rows(hired.hired_detail(t, 1, JAN), "id") == [(3,), (2,), (1,)]
    detail = rows(exports.export_hired(hv, t, JAN, 1))
    assert [r[1] for r in detail] == ["gift", "payment", "sale"] and detail[0][-2:] == ("B", "Ann")


def test_recent_hired(books):
    hv, t = books
    assert rows(hired.recent_hired_txn(hv, t, 2), "id", "vehicle_no") == [(1, "B"), (2, "B")]
    assert hired.with_hired(t, hv).count() == 5


def test_lookups(books, seed):
    _, t = books
    assert rows(hired.lookup_hired_txn(t, [4])) == [(4, "sale", "2024-01-10", "2024-02", 7.0, "", "")]
    assert rows(employees.lookup_advances(seed.advances, [2])) == [
        (2, "Suresh Patel", "2024-01-10", 3000.0, "Medical advance")
    ]
