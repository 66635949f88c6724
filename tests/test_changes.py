import datetime as dt

import pytest

from fleetbooks.operators import changes, fleet, quality
from tests.seed import P, Q, Seed, rows, spending, table

DAY = dt.date(2024, 3, 1)


@pytest.fixture(scope="module")
def seed(spark):
    return Seed(spark)


def keys(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize("as_frame", [False, True])
def test_settle(spark, seed, as_frame):
    ids = keys(spark, 5, 1, 5, None, 77) if as_frame else [5, 1, 77]
    new = changes.settle(seed.spendings, ids, Q, "Cash", DAY)
    assert new.columns == seed.spendings.columns and new.count() == 9
    got = {r[0]: r[1:] for r in rows(new, "id", "reason", "spended_by", "mode")}
    assert got[5] == ("Diesel - Unpaid - Settled on 2024-03-01", Q, "Cash")
    # a row that was paid already is not left out
    assert got[1] == ("Diesel - Paid - Settled on 2024-03-01", Q, "Cash")
    assert got[2] == ("Driver Salary", Q, "Cash") and got[3][1] == P


def test_null_reason_counts_as_empty_and_label_is_chosen(spark):
    sp = table(spark, "spendings", [spending(1, mode=None)])
    new = changes.settle(sp, [1], P, "UPI", DAY, changes.MARKED_PAID)
    assert rows(new, "reason", "mode") == [(" - Marked Paid on 2024-03-01", "UPI")]


def test_settling_twice_changes_only_the_reason(seed):
    once = changes.settle(seed.spendings, [5], P, "UPI", DAY)
    twice = changes.settle(once, [5], P, "UPI", DAY)
    rest = [c for c in once.columns if c != "reason"]
    assert rows(once, *rest) == rows(twice, *rest)
    assert rows(twice.filter("id = 5"), "reason")[0][0].count("Settled on") == 2
    assert rows(fleet.paid_unpaid_totals(once)) == [(45600.0, 0.0)]


def test_toggle(spark):
    sp = table(
        spark,
        "spendings",
        [spending(1, marked=True), spending(2, marked=False), spending(3), spending(4), spending(5)],
    )
    new = changes.toggle_marks(sp, keys(spark, 1, 2, 3, 4, 4, 99))
    assert new.columns == sp.columns
    assert sorted(rows(new, "id", "marked")) == [(1, False), (2, True), (3, True), (4, False), (5, None)]
    assert rows(changes.unknown_keys(keys(spark, 1, 99), sp)) == [(99,)]
    assert rows(changes.require_existing(keys(spark, 1, 99), sp)) == [(1,)]


def test_updates_replace_given_columns_by_the_last_change(spark, seed):
    edits = spark.createDataFrame(
        [(1, 2, "salary", "P"), (1, 1, "others", "Q"), (5, 1, "others", None), (99, 1, "others", "Q")],
        "id long, seq long, category string, spended_by string",
    )
    new = changes.apply_updates(seed.spendings, edits, seq="seq")
    assert new.schema.names == seed.spendings.schema.names and new.count() == 9
    got = {r[0]: r[1:] for r in rows(new, "id", "category", "spended_by", "reason")}
    assert got[1] == ("salary", "P", "Diesel - Paid")
    assert got[5] == ("others", None, "Diesel - Unpaid")
    assert got[2] == ("salary", Q, "Driver Salary")
    assert rows(changes.unknown_keys(edits, seed.spendings), "id") == [(99,)]


def test_repeated_changes_never_multiply_rows(spark, seed):
    edits = spark.createDataFrame([(1, "a"), (1, "b")], "id long, category string")
    new = changes.apply_updates(seed.spendings, edits)
    assert new.count() == 9
    assert rows(new.filter("id = 1"), "category") == [("b",)]


def test_change_of_a_value_to_null(spark, seed):
    edits = spark.createDataFrame([(1, None)], "id long, spended_by string")
    new = changes.apply_updates(seed.spendings, edits)
    assert rows(new.filter("id = 1"), "spended_by") == [(None,)]


@pytest.mark.parametrize("as_frame", [False, True])
def test_delete(spark, seed, as_frame):
    ids = keys(spark, 1, 1, 99, None) if as_frame else [1, 99]
    left = changes.delete_rows(seed.spendings, ids)
    assert left.count() == 8 and left.columns == seed.spendings.columns


@pytest.mark.parametrize("as_frame", [False, True])
def test_children_of_deleted_rows(spark, as_frame):
    sp = table(spark, "spendings", [spending(1), spending(2, vehicle_id=2), spending(3, vehicle_id=None)])
    ids = keys(spark, 1, None) if as_frame else [1]
    assert sorted(rows(changes.delete_rows(sp, ids, "vehicle_id"), "id")) == [(2,), (3,)]
    detached = changes.detach_rows(sp, ids, "vehicle_id")
    assert detached.columns == sp.columns
    assert sorted(rows(detached, "id", "vehicle_id"), key=str) == [(1, None), (2, 2), (3, None)]


def test_duplicates(spark, seed):
    veh = table(spark, "vehicles", [{"id": 1, "vehicle_no": "X"}, {"id": 2, "vehicle_no": "X"}])
    assert rows(quality.duplicates(veh, ["vehicle_no"])) == [("X", 2)]
    sales = table(spark, "company_sales", [])
    hired = table(spark, "hired_vehicles", [])
    twice = seed.spendings.union(seed.spendings.filter("id = 9"))
    got = rows(quality.duplicate_report(veh, seed.companies, hired, sales, twice))
    assert sorted(got) == [
        ("spendings entry", "3 | 2024-02-22 | others | Repair | 3500.00", 2),
        ("vehicles.vehicle_no", "X", 2),
    ]


def test_references(spark, seed):
    sp, veh = seed.spendings, seed.vehicles
    assert rows(quality.unreferenced(veh, sp, "vehicle_id"), "id") == [(4,)]
    some = veh.filter("id <> 3")
    assert sorted(rows(quality.orphans(sp, some, "vehicle_id"), "id")) == [(5,), (9,)]
    no_vehicle = table(spark, "spendings", [spending(1, vehicle_id=None)])
    assert quality.orphans(no_vehicle, veh, "vehicle_id").count() == 0
    assert quality.unreferenced(veh, no_vehicle, "vehicle_id").count() == 4
    left = quality.safe_delete(veh, sp, keys(spark, 3, 4, 99), "vehicle_id")
    assert sorted(rows(left, "id")) == [(1,), (2,), (3,)]
