import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetbooks.operators import fleet
from fleetbooks.operators.common import by_ids, recent, search_any
from fleetbooks.plans import labelled
from tests.seed import P, Q, Seed, rows, spending, table

JAN, FEB = dt.date(2024, 1, 1), dt.date(2024, 2, 1)


@pytest.fixture(scope="module")
def seed(spark):
    return Seed(spark)


def test_hand_worked_totals(seed):
    sp, veh, pay = seed.spendings, seed.vehicles, seed.payments
    assert rows(fleet.paid_unpaid_totals(sp)) == [(40800.0, 4800.0)]
    assert rows(fleet.total_credited(pay)) == [(66000.0,)]
    assert rows(fleet.month_total(sp, JAN)) == [(24300.0,)]
    assert rows(fleet.month_total(sp, dt.date(2030, 1, 1))) == [(0.0,)]
    totals = dict(rows(fleet.vehicle_totals(veh, sp), "vehicle_no", "total_spent"))
    assert totals == {"3393": 26200.0, "407": 11100.0, "202": 8300.0, "505": 0.0}
    assert rows(fleet.paid_monthly_totals(sp)) == [(FEB, 21300.0), (JAN, 19500.0)]
    assert rows(fleet.overall_monthly_expenses(sp))[0] == ("2024-02", 21300.0)


def test_payer_balance(seed):
    got = rows(fleet.payer_balance(seed.payments, seed.spendings, [P, Q, "nobody"]))
    assert got == [
        (P, 66000.0, 40800.0, 25200.0, 19300.0, 46700.0),
        (Q, 66000.0, 40800.0, 25200.0, 21500.0, 44500.0),
        ("nobody", 66000.0, 40800.0, 25200.0, 0.0, 66000.0),
    ]
    assert rows(fleet.payer_balance(seed.payments, seed.spendings)) == got[:2]


def test_payer_total_ignores_mode(spark, seed):
    sp = table(spark, "spendings", [spending(1), spending(2, mode=None, amount="5")])
    (got,) = rows(fleet.payer_balance(seed.payments, sp), "debited", "spent")
    assert got == (10.0, 15.0)


def test_dashboard(seed):
    got = rows(
        fleet.dashboard_totals(seed.vehicles, seed.payments, seed.spendings, dt.date(2024, 2, 20))
    )
    assert got == [(4, 66000.0, 40800.0, 25200.0, 21300.0, 24300.0)]


def test_dashboard_over_nothing(spark, seed):
    empty = lambda name: table(spark, name, [])
    got = fleet.dashboard_totals(empty("vehicles"), empty("payments"), empty("spendings"), JAN)
    assert rows(got) == [(0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_half_filled_row_is_unpaid_and_debited(spark, seed):
    sp = table(spark, "spendings", [spending(1, mode=None), spending(2, spended_by=None)])
    assert rows(fleet.paid_unpaid_totals(sp)) == [(0.0, 20.0)]
    assert fleet.unpaid_spendings(sp, seed.vehicles).count() == 2
    assert fleet.touched_spendings(sp).count() == 2
    debited = fleet.dashboard_totals(seed.vehicles, seed.payments, sp, JAN)
    assert rows(debited, "debited") == [(20.0,)]
    assert rows(fleet.incoming_totals(seed.payments, sp)) == [(66000.0, 0.0, 66000.0)]


def test_empty_payer_is_paid_in_totals_but_not_on_the_page(spark, seed):
    sp = table(spark, "spendings", [spending(1, spended_by="")])
    assert rows(fleet.paid_unpaid_totals(sp)) == [(10.0, 0.0)]
    assert rows(labelled.spendings_labelled(sp, seed.vehicles), "paid_by", "status") == [
        ("Unpaid", "Unpaid")
    ]


def test_thirty_days_edge_belongs_to_recent(spark, seed):
    as_of = dt.date(2024, 3, 1)
    sp = table(
        spark,
        "spendings",
        [spending(1, date="2024-01-31"), spending(2, date="2024-01-30"), spending(3, mode=None)],
    )
    assert rows(fleet.recent_paid(sp, seed.vehicles, as_of), "id") == [(1,)]
    assert rows(fleet.settled_paid(sp, seed.vehicles, as_of), "id") == [(2,)]


def test_month_filters_differ_off_day_one(spark, seed):
    sp = table(
        spark,
        "spendings",
        [spending(1), spending(2, expense_month="2024-01-20"), spending(3, expense_month="2024-02-01")],
    )
    assert rows(fleet.month_detail(sp, seed.vehicles, JAN), "id") == [(1,)]
    assert sorted(rows(fleet.vehicle_spendings(sp, 1, JAN), "id")) == [(1,), (2,)]
    trend = rows(fleet.monthly_trend(sp, dt.date(2024, 3, 1)), "month")
    assert trend == [("2024-02",), ("2024-01",), ("2024-01",)]


def test_null_month_is_its_own_group_and_comes_first(spark):
    sp = table(spark, "spendings", [spending(1), spending(2, expense_month=None)])
    assert rows(fleet.paid_monthly_totals(sp)) == [(None, 10.0), (JAN, 10.0)]
    assert rows(fleet.available_months(sp)) == [("2024-01",)]


def test_trend_cut_is_a_date_not_a_month(spark):
    months = [f"2024-{m:02d}-01" for m in range(1, 10)]
    sp = table(spark, "spendings", [spending(i, expense_month=m) for i, m in enumerate(months)])
    first = rows(fleet.monthly_trend(sp, dt.date(2024, 8, 1)), "month")
    later = rows(fleet.monthly_trend(sp, dt.date(2024, 8, 2)), "month")
    assert [m for (m,) in first] == [f"2024-{m:02d}" for m in range(9, 1, -1)]
    assert [m for (m,) in later] == [f"2024-{m:02d}" for m in range(9, 2, -1)]
    # the end of a longer month is clamped: 31 August minus six months is 29 February
    clamped = rows(fleet.monthly_trend(sp, dt.date(2024, 8, 31)), "month")
    assert clamped[-1] == ("2024-03",)


def test_unknown_vehicle_is_left_out_of_joined_lists_only(spark, seed):
    sp = table(spark, "spendings", [spending(1), spending(2, vehicle_id=None), spending(3, vehicle_id=99)])
    assert rows(fleet.with_vehicle(sp, seed.vehicles), "id", "vehicle_no") == [(1, "3393")]
    assert rows(fleet.paid_unpaid_totals(sp)) == [(30.0, 0.0)]
    assert rows(fleet.month_by_vehicle(sp, seed.vehicles, JAN)) == [("3393", 10.0)]
    assert sum(t for _, t in rows(fleet.vehicle_totals(seed.vehicles, sp), "id", "total_spent")) == 10.0


def test_same_number_on_two_vehicles_is_one_group(spark):
    veh = table(spark, "vehicles", [{"id": 1, "vehicle_no": "X"}, {"id": 2, "vehicle_no": "X"}])
    sp = table(spark, "spendings", [spending(1), spending(2, vehicle_id=2)])
    assert rows(fleet.month_by_vehicle(sp, veh, JAN)) == [("X", 20.0)]


def test_month_reports(seed):
    sp, veh = seed.spendings, seed.vehicles
    assert rows(fleet.month_by_vehicle(sp, veh, FEB)) == [
        ("3393", 13200.0),
        ("407", 4600.0),
        ("202", 3500.0),
    ]
    assert rows(fleet.month_vehicle_expenses(sp, veh, FEB))[0] == ("3393", "2024-02", 13200.0)
    assert rows(fleet.monthly_expenses(sp, veh)) == [
        ("2024-02", "3393", 13200.0),
        ("2024-02", "407", 4600.0),
        ("2024-02", "202", 3500.0),
        ("2024-01", "3393", 13000.0),
        ("2024-01", "407", 6500.0),
    ]


def test_expense_summaries(seed):
    sp, veh = seed.spendings, seed.vehicles
    assert rows(fleet.expense_summary(sp, veh, fleet.BY_MONTH)) == [
        ("2024-02", 21300.0, 4),
        ("2024-01", 24300.0, 5),
    ]
    assert rows(fleet.expense_summary(sp, veh, fleet.BY_VEHICLE, n=1)) == [
        ("2024-02", 1, "3393", 13200.0)
    ]
    by_category = fleet.expense_summary(sp, veh, fleet.BY_CATEGORY)
    assert rows(by_category)[0] == ("2024-02", 1, "3393", "salary", 8000.0, 1)
    with pytest.raises(ValueError):
        fleet.expense_summary(sp, veh, "weekly")


@pytest.mark.parametrize("by", [fleet.BY_MONTH, fleet.BY_VEHICLE, fleet.BY_CATEGORY])
def test_first_rows_of_a_summary(spark, seed, by):
    """Months without a known vehicle have no row and must not use up the n."""
    months = [None, "2024-05-01", "2024-04-01", "2024-04-01", "2024-03-01", "2024-02-01"]
    sp = table(
        spark,
        "spendings",
        [spending(i, expense_month=m, vehicle_id=99 if i in (1, 2) else 1) for i, m in enumerate(months)],
    )
    everything = rows(fleet.expense_summary(sp, seed.vehicles, by))
    for n in (1, 2, 3, 9):
        assert rows(fleet.expense_summary(sp, seed.vehicles, by, n)) == everything[:n]


def test_lists_are_newest_first(seed):
    dates = [d for (d,) in rows(fleet.paid_spendings(seed.spendings, seed.vehicles), "date")]
    assert dates == sorted(dates, reverse=True)
    assert rows(fleet.latest_spendings(seed.spendings, seed.vehicles), "id") == [(9,), (7,), (6,), (8,), (4,)]


def test_payments_detail_keeps_payments_without_partners(spark, seed):
    extra = table(spark, "payments", [{"id": 9, "date": "2025-01-01", "amount": "1"}])
    got = rows(
        fleet.payments_detail(seed.payments.union(extra), seed.companies, seed.vehicles),
        "id",
        "company_name",
        "vehicle_no",
    )
    assert got[0] == (9, None, None)
    assert (3, "Quick Delivery", "202") in got and len(got) == 6


def test_settlement_preview_and_ids(seed):
    sp = seed.spendings
    assert rows(fleet.settlement_preview(sp, [5, 9, 1000])) == [(2, 8300.0)]
    assert rows(fleet.settlement_preview(sp, [])) == [(0, 0.0)]
    keys = sp.sparkSession.createDataFrame([(5,), (9,), (9,), (None,)], "id long")
    assert rows(fleet.settlement_preview(sp, keys)) == [(2, 8300.0)]
    many = list(range(5000))
    assert by_ids(sp, many).count() == 9 and by_ids(sp, many, joined=True).count() == 9


def test_lookup_shows_blanks(spark):
    sp = table(spark, "spendings", [spending(1, spended_by=None, mode=None, expense_month=None)])
    assert rows(fleet.lookup_spendings(sp, [1])) == [
        (1, "2024-01-15", "", 1, "diesel", "", 10.0, "", "")
    ]


def test_search_never_spans_cells(spark, seed):
    sp = seed.spendings.select("category", "reason", "amount", "date")
    assert search_any(sp, "REPAIR").count() == 1
    assert search_any(sp, "2024-02-1").count() == 2
    assert search_any(sp, "othersRepair").count() == 0
    assert search_any(sp, "").count() == 9


def test_ref_counts(seed):
    got = dict(rows(fleet.ref_counts(seed.vehicles, seed.spendings, "vehicle_id")))
    assert got == {1: 4, 2: 3, 3: 2, 4: 0}


def test_recent_is_settled_by_all_columns(spark):
    sp = table(spark, "spendings", [spending(i, amount=str(i)) for i in range(20)])
    first = rows(recent(sp.repartition(7), 5, "date"), "id")
    again = rows(recent(sp.repartition(3).orderBy(F.rand(1)), 5, "date"), "id")
    assert first == again == [(i,) for i in range(5)]


def test_recent_with_null_dates_and_short_tables(spark):
    months = [None, "2024-01-01", None, "2024-03-01", "2024-02-01", "2024-02-01"]
    sp = table(spark, "spendings", [spending(i, expense_month=m) for i, m in enumerate(months)])
    take = lambda n: [i for (i,) in rows(recent(sp, n, "expense_month", "date"), "id")]
    assert [take(n) for n in (1, 2, 3, 4, 6, 99)] == [
        [0],
        [0, 2],
        [0, 2, 3],
        [0, 2, 3, 4],
        [0, 2, 3, 4, 5, 1],
        [0, 2, 3, 4, 5, 1],
    ]
    assert rows(recent(sp.filter("id > 99"), 5, "date")) == []


def test_paid_and_unpaid_split_the_table(seed):
    sp, veh = seed.spendings, seed.vehicles
    paid, unpaid = rows(fleet.paid_unpaid_totals(sp))[0]
    assert paid + unpaid == sum(t for (t,) in rows(sp, "amount"))
    as_of = dt.date(2024, 3, 1)
    parts = fleet.recent_paid(sp, veh, as_of).count() + fleet.settled_paid(sp, veh, as_of).count()
    assert parts == fleet.paid_spendings(sp, veh).count()
