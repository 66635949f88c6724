from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.views import Books, OddBooks
from fleetbooks.operators import changes, companies, fleet, hired
from fleetbooks.operators.sums import SUMMED, after_change, sums
from fleetbooks.sources import versions
from tests.seed import Q, Seed, rows, spending, table

SF = "/root/testdata/sf0.001"


def test_sums_have_the_tables_own_columns(spark):
    b = Books(spark, SF)
    for name, (keys, amount) in SUMMED.items():
        df = getattr(b, name)()
        kept = sums(df, name)
        assert kept.columns == [*keys, amount, "rows"] and kept.agg(F.sum("rows")).first()[0] == df.count()


def test_a_change_and_its_undoing_leave_the_sums_as_they_were(spark):
    seed = Seed(spark)
    sp = seed.spendings
    kept = sums(sp, "spendings")
    before = sp.filter("id IN (1, 5)")
    settled = changes.settle(before, [1, 5], Q, "Cash", "2024-03-01")
    changed = after_change(kept, before, settled, "spendings")
    assert rows(fleet.paid_unpaid_totals(changed)) == [(45600.0, 0.0)]
    # The group of the one unpaid spending has no rows left.
    assert changed.filter("spended_by IS NULL").count() == 0
    back = after_change(changed, settled, before, "spendings")
    assert sorted(map(str, back.collect())) == sorted(map(str, kept.collect())) and back.dtypes == kept.dtypes


def test_rows_count_not_amounts(spark):
    """A group whose amounts add up to nothing still has its rows; one without rows is gone."""
    sp = table(spark, "spendings", [spending(1, amount="5.00"), spending(2, amount="-5.00"), spending(3, vehicle_id=2)])
    kept = after_change(sums(sp, "spendings"), sp.filter("id = 3"), sp.limit(0), "spendings")
    assert rows(kept, "vehicle_id", "amount", "rows") == [(1, 0.0, 2)]
    got = rows(fleet.expense_summary(kept, table(spark, "vehicles", [{"id": 1, "vehicle_no": "V"}])))
    assert got == [("2024-01", 1, "V", "diesel", 0.0, 2)]


def test_amounts_beyond_twelve_digits_stay_exact(spark):
    sp = table(spark, "spendings", [spending(k, amount="9999999999.99") for k in range(40)])
    kept = sums(sp, "spendings")
    for _ in range(3):
        kept = after_change(kept, sp.limit(0), sp, "spendings")
    assert kept.first()["amount"] == Decimal("9999999999.99") * 160 and kept.first()["rows"] == 160


def test_a_last_date_goes_back(spark):
    sales = [{"id": k, "sale_date": d, "company_name": "A", "sale_amount": "1.00", "month_year": "2024-01-01"} for k, d in enumerate(["2024-01-05", "2024-01-09"])]
    sales = table(spark, "company_sales", sales)
    pays = sums(table(spark, "company_payments", []), "company_payments")
    kept = sums(sales, "company_sales")
    assert rows(companies.company_summary(kept, pays), "last_sale_date") == [("2024-01-09",)]
    less = after_change(kept, sales.filter("id = 1"), sales.limit(0), "company_sales")
    assert rows(companies.company_summary(less, pays), "total_sales", "last_sale_date") == [(1.0, "2024-01-05")]


@pytest.mark.parametrize("kind", [Books, OddBooks])
def test_reports_from_sums_equal_reports_from_tables(spark, kind):
    b = kind(spark, SF)
    sp, veh, pay = b.spendings(), b.vehicles(), b.payments()
    kept = sums(sp, "spendings")
    for report in (
        lambda x: fleet.vehicle_totals(veh, x),
        lambda x: fleet.monthly_trend(x, "1998-06-15"),
        lambda x: fleet.dashboard_totals(veh, sums(pay, "payments") if x is kept else pay, x, "1998-06-15"),
        lambda x: fleet.month_by_vehicle(x, veh, "1998-03-01"),
        lambda x: fleet.expense_summary(x, veh, n=10),
        lambda x: fleet.expense_summary(x, veh, fleet.BY_MONTH, 5),
        lambda x: fleet.incoming_totals(pay, x),
    ):
        assert sorted(map(str, rows(report(kept)))) == sorted(map(str, rows(report(sp))))
    txn = b.hired_vehicle_transactions()
    got, want = (rows(hired.hired_summary(b.hired_vehicles(), x)) for x in (sums(txn, "hired_vehicle_transactions"), txn))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_sums_follow_a_version(spark, tmp_path):
    """What a correction by month has read and written is all that the sums need."""
    b = Books(spark, SF)
    made = versions.Books(spark, str(tmp_path / "books"))
    made.publish({"spendings": b.spendings()})
    kept = sums(made.load("spendings"), "spendings")
    seen = []

    def how(sp):
        seen.append(sp)
        return changes.settle(sp, b.keys("spendings"), "E42", "UPI", "2001-06-15")

    made.change("spendings", b.keys("spendings"), how)
    now = made.load("spendings")
    months = [r[0] for r in seen[0].select("expense_month").distinct().collect()]
    kept = after_change(kept, seen[0], now.filter(F.col("expense_month").isin(months)), "spendings")
    want = sums(now, "spendings")
    assert sorted(map(str, kept.collect())) == sorted(map(str, want.collect()))
