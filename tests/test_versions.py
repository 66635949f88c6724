import re
from urllib.parse import unquote

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.views import Books as Given
from fleetbooks.operators import changes, companies, ingest
from fleetbooks.sources import versions
from fleetbooks.sources.versions import Books, Child
from tests.seed import P, Q, Seed, rows, spending, table

SF = "/root/testdata/sf0.001"
DAY = "2024-03-01"


@pytest.fixture
def books(spark, tmp_path):
    """The seed as version 1, with a spending that has no month."""
    seed = Seed(spark)
    odd = table(spark, "spendings", [spending(10, expense_month=None), spending(11, expense_month="2024-03-01", vehicle_id=4)])
    made = Books(spark, str(tmp_path / "books"))
    sales = table(spark, "company_sales", [{"id": 1, "sale_date": "2024-01-02", "company_name": "A", "sale_amount": "1.00", "month_year": "2024-01-01"}])
    tables = {"spendings": seed.spendings.unionByName(odd), "payments": seed.payments, "vehicles": seed.vehicles, "company_sales": sales}
    assert made.publish(tables) == 1
    return made


def files(df) -> dict[str, set[str]]:
    """Month -> its files."""
    found = {}
    for path in df.inputFiles():
        month = re.search(r"(?:expense_month|month_year)=([^/]+)", unquote(path))
        found.setdefault(month and month.group(1), set()).add(path)
    return found


def test_a_version_reads_as_it_was_published(books, spark):
    assert Books(spark, books.root).version() == 1
    sp = books.load("spendings")
    assert sorted(rows(sp, "id")) == [(i,) for i in range(1, 12)]
    assert rows(sp.filter("expense_month IS NULL"), "id") == [(10,)]
    assert rows(books.load("employee_advances"), "id") == []
    assert set(files(sp)) == {"2024-01-01", "2024-02-01", "2024-03-01", "__HIVE_DEFAULT_PARTITION__"}
    with pytest.raises(ValueError):
        books.load("spendings", 7)


def test_no_version_yet(spark, tmp_path):
    none = Books(spark, str(tmp_path / "none"))
    assert none.version() == 0 and none.load("spendings").count() == 0
    assert none.change("spendings", [1], lambda sp: changes.toggle_marks(sp, [1])) == 0


@pytest.mark.parametrize("as_frame", [False, True])
def test_a_correction_writes_the_months_it_touches(books, spark, as_frame):
    ids = spark.createDataFrame([(6,), (8,), (6,), (99,), (None,)], "id long") if as_frame else [6, 8, 99]
    before = books.load("spendings")
    want = sorted(map(str, changes.settle(before, ids, Q, "Cash", DAY).collect()))
    assert books.change("spendings", ids, lambda sp: changes.settle(sp, ids, Q, "Cash", DAY)) == 2
    old, new = files(before), files(books.load("spendings"))
    assert {m for m in new if new[m] != old[m]} == {"2024-02-01"} and not new["2024-02-01"] & old["2024-02-01"]
    assert sorted(map(str, books.load("spendings").collect())) == want
    # The version before is still there, and other tables are the same files.
    assert files(books.load("spendings", 1)) == old
    assert files(books.load("payments", 1)) == files(books.load("payments", 2))


def test_the_month_that_is_none_is_a_month(books):
    old = files(books.load("spendings"))
    books.change("spendings", [10], lambda sp: changes.toggle_marks(sp, [10]))
    new = files(books.load("spendings"))
    assert {m for m in new if new[m] != old[m]} == {"__HIVE_DEFAULT_PARTITION__"}
    assert rows(books.load("spendings").filter("id = 10"), "marked", "expense_month") == [(True, None)]


def test_nothing_touched_is_no_new_version(books):
    assert books.change("spendings", [99], lambda sp: changes.toggle_marks(sp, [99])) == 1
    assert books.delete("vehicles", [99], [Child("spendings", "vehicle_id")]) == 1
    assert books.version() == 1


def test_only_touched_months_are_read_for_the_change(books):
    seen = []

    def how(sp):
        seen.append(files(sp))
        return changes.toggle_marks(sp, [11])

    books.change("spendings", [11], how)
    assert [set(x) for x in seen] == [{"2024-03-01"}]


def test_an_edit_moves_a_row_to_another_month(books, spark):
    raw = spark.createDataFrame(
        [("1", "1", "2024-01-15", "2024-06", "others", "5", "x", "UPI"), ("77", "1", "2024-01-15", "2024-09", "others", "5", "x", "UPI")],
        "id string, vehicle_id string, date string, expense_month string, category string, amount string, spended_by string, mode string",
    )
    edits = ingest.spending_edits(raw).accepted
    old = files(books.load("spendings"))
    how = lambda sp: changes.apply_updates(sp, edits)
    with pytest.raises(ValueError, match="2024, 6, 1"):
        books.change("spendings", edits.select("id"), how)
    assert books.version() == 1
    books.change("spendings", edits.select("id"), how, arrivals=edits)
    new = files(books.load("spendings"))
    assert {m for m in new if new[m] != old.get(m)} == {"2024-01-01", "2024-06-01"}
    assert rows(books.load("spendings").filter("id = 1"), "category", "amount") == [("others", 5.0)]
    assert books.load("spendings").count() == 11


def test_a_month_without_rows_goes(books):
    books.change("spendings", [11], lambda sp: changes.delete_rows(sp, [11]))
    assert "2024-03-01" not in files(books.load("spendings"))
    assert sorted(rows(books.load("spendings"), "id")) == [(i,) for i in range(1, 11)]


@pytest.mark.parametrize("as_frame", [False, True])
def test_parent_and_children_change_in_one_version(books, spark, as_frame):
    ids = spark.createDataFrame([(4,), (3,), (99,)], "id long") if as_frame else [3, 4, 99]
    old = files(books.load("spendings"))
    made = books.delete("vehicles", ids, [Child("spendings", "vehicle_id"), Child("payments", "vehicle_id", detach=True)])
    assert made == books.version() == 2
    assert sorted(rows(books.load("vehicles"), "id")) == [(1,), (2,)]
    assert sorted(rows(books.load("spendings"), "id")) == [(i,) for i in (1, 2, 3, 4, 6, 7, 8, 10)]
    assert sorted(rows(books.load("payments"), "id", "vehicle_id"), key=str) == [(1, 1), (2, 2), (3, None), (4, 1), (5, 2)]
    new = files(books.load("spendings"))
    # Vehicles 3 and 4 are in all months but the one that is none.
    assert new["__HIVE_DEFAULT_PARTITION__"] == old["__HIVE_DEFAULT_PARTITION__"]
    assert files(books.load("company_sales", 1)) == files(books.load("company_sales", 2))


def test_a_table_that_refers_twice(books):
    how = [Child("payments", "company_id"), Child("payments", "vehicle_id", detach=True)]
    books.delete("vehicles", [2], how)
    # Company 2's payments are vehicle 2's as well: gone, not only detached.
    assert sorted(rows(books.load("payments"), "id", "vehicle_id")) == [(1, 1), (3, 3), (4, 1)]


def test_two_writers_from_one_version(books, spark, monkeypatch):
    other = Books(spark, books.root)
    monkeypatch.setattr(other, "version", lambda: 1)
    books.change("spendings", [1], lambda sp: changes.toggle_marks(sp, [1]))
    with pytest.raises(AnalysisException):
        other.change("spendings", [6], lambda sp: changes.toggle_marks(sp, [6]))
    assert books.version() == 2 and rows(books.load("spendings").filter("id = 6"), "marked") == [(None,)]


def test_a_failed_change_publishes_nothing(books):
    bad = lambda sp: sp.withColumn("reason", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        books.change("spendings", [1], bad)
    assert books.version() == 1 and books.load("spendings").count() == 11


def test_keys_are_found_without_reading_the_other_columns(books):
    plans = []
    real = versions.stacked

    def stacked(*frames):
        found = real(*frames)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    versions.stacked = stacked
    try:
        books.delete("vehicles", [3], [Child("spendings", "vehicle_id"), Child("payments", "vehicle_id")])
    finally:
        versions.stacked = real
    # One job over three tables; of each the key alone.
    assert len(plans) == 1
    assert sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plans[0])) == ["id:bigint", "vehicle_id:bigint", "vehicle_id:bigint"]


def test_lookups_by_id_skip_row_groups(spark, tmp_path):
    """Ids lie in no order within a month; the filters on them leave few row groups to read."""
    sp = spark.range(0, 60000, 1, 4).selectExpr(
        "(id * 7919) % 60000 AS id", "id % 50 AS vehicle_id", "DATE '2024-01-05' AS date", "DATE '2024-01-01' AS expense_month",
        "'diesel' AS category", "repeat(md5(string(id)), 4) AS reason", "CAST(1 AS DECIMAL(12,2)) AS amount",
        "'P' AS spended_by", "'UPI' AS mode", "true AS marked", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at",
    )
    small = {"parquet.block.size": "200000", "parquet.block.size.row.check.min": "1"}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in small.items():
        conf.set(k, v)
    try:
        made = Books(spark, str(tmp_path / "books"))
        made.publish({"spendings": sp})
    finally:
        for k in small:
            conf.unset(k)
    ids = [59999, 17, 31234]
    found = made.load("spendings").filter(F.col("id").isin(ids))
    assert sorted(rows(found, "id")) == sorted((i,) for i in ids)
    assert _scanned(found) < 60000 / 4
    missing = made.load("spendings").filter(F.col("id").isin([60001, -4]))
    assert missing.count() == 0
    everything = made.load("spendings").filter(F.col("reason") != "")
    assert _scanned(everything) == 60000


def _scanned(df) -> int:
    """Rows that the scan handed on: those of the row groups it opened."""
    df = df.select("id", "reason")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "Scan parquet" in node.nodeName():
            scans.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sum(scans)


def test_queries_over_the_given_tables_agree(spark, tmp_path):
    b = Given(spark, SF)
    made = Books(spark, str(tmp_path / "books"))
    sp = b.spendings()
    made.publish({"spendings": sp})
    ids = b.keys("spendings")
    made.change("spendings", ids, lambda x: changes.settle(x, ids, P, "UPI", DAY))
    want = sorted(map(str, changes.settle(sp, ids, P, "UPI", DAY).collect()))
    assert sorted(map(str, made.load("spendings").select(*sp.columns).collect())) == want


def test_newest_rows_are_found_from_the_footers(spark, tmp_path):
    b = Given(spark, SF)
    made = Books(spark, str(tmp_path / "books"))
    odd = table(spark, "company_payments", [
        {"id": 9_000_001, "payment_date": "2030-01-01", "company_name": "A", "received_amount": "1.00", "payment_mode": "upi", "month_year": "1992-01-01"},
    ])
    pays = b.company_payments().unionByName(odd, allowMissingColumns=True)
    made.publish({"company_payments": pays, "spendings": b.spendings()})
    plans = []
    for n in (1, 20, 300, 10_000):
        near = made.newest("company_payments", n, "payment_date")
        want = rows(companies.recent_company_payments(made.load("company_payments"), n))
        assert rows(companies.recent_company_payments(near, n)) == want
        plans.append((near.count(), made.load("company_payments").count()))
    assert plans[0][0] < plans[0][1] / 2 and plans[-1][0] == plans[-1][1]
    # One extent for each month, and the settings are as before.
    extents = made.extents("spendings", "date")
    assert len(extents) == made.load("spendings").select("expense_month").distinct().count()
    assert sum(n for _, _, n in extents) == made.load("spendings").count()
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_extents_read_no_column(spark, tmp_path):
    made = Books(spark, str(tmp_path / "books"))
    made.publish({"spendings": Given(spark, SF).spendings()})
    for key, value in versions._FOOTERS.items():
        spark.conf.set(key, value)
    try:
        text = made._extents("spendings", "date", None)._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in versions._FOOTERS:
            spark.conf.unset(key)
    assert re.search(r"PushedAggregation: \[MIN\(date\), MAX\(date\), COUNT\(\*\)\]", text)


def test_a_table_without_rows_has_no_extent(spark, tmp_path):
    made = Books(spark, str(tmp_path / "books"))
    made.publish({"spendings": table(spark, "spendings", [])})
    assert made.extents("spendings", "date") == [] and made.newest("spendings", 5, "date").collect() == []
