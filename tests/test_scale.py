"""What the physical plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from checks.registry import PAIRS
from checks.views import M, Books
from fleetbooks.operators import changes, companies, fleet, ingest, quality
from fleetbooks.operators.common import _hot_keys, by_ids, fan_out_left_join, flag_ids
from fleetbooks.sources import sinks, tables
from tests.seed import rows

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", text))


@pytest.mark.parametrize("key", list(PAIRS))
def test_no_python_no_cross_join_no_window(spark, key):
    text = plan(PAIRS[key].run(spark, SF))
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoopJoin", "Window", "Collect"):
        assert node not in text.replace("CollectLimit", ""), (key, node)


def test_dashboard_scans_each_table_once_and_moves_one_row_per_task(spark):
    text = plan(PAIRS["dashboard_totals"].run(spark, SF))
    assert len(re.findall("FileScan", text)) == 3 and exchanges(text) == 1


@pytest.mark.parametrize("key", ["company_summary", "company_month", "employee_balance"])
def test_two_tables_meet_in_one_shuffle(spark, key):
    df = PAIRS[key].run(spark, SF)
    text = plan(df)
    # the second exchange is the final ORDER BY
    assert exchanges(text) == 2 and "SortMergeJoin" not in text.split("Union")[0]


@pytest.mark.parametrize("key", ["recent_hired_txn", "recent_sales", "latest_spendings", "top_monthly_expense_summary"])
def test_top_n_is_not_a_full_sort(spark, key):
    text = plan(PAIRS[key].run(spark, SF))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_only_the_newest_month_is_read_in_full(spark, tmp_path):
    root = str(tmp_path / "books")
    b = Books(spark, SF)
    sinks.write_table(b.spendings(), root, "spendings")
    sp = tables.load(spark, root, "spendings")
    df = fleet.latest_spendings(sp, b.vehicles())
    assert [r[0] for r in rows(df)] == [r[0] for r in rows(fleet.latest_spendings(b.spendings(), b.vehicles()))]
    final = plan(df).split("Initial Plan")[0]
    assert re.search(r"PartitionFilters: \[[^\]]*expense_month[^\]]*>= Subquery", final)


def test_the_nth_newest_date_reaches_the_scan(spark, tmp_path):
    root = str(tmp_path / "books")
    sinks.write_table(Books(spark, SF).company_payments(), root, "company_payments")
    text = plan(companies.recent_company_payments(tables.load(spark, root, "company_payments")))
    assert "GreaterThanOrEqual(payment_date,ScalarSubquery" in text


def test_sorted_lists_cost_nothing_under_an_aggregate(spark):
    b = Books(spark, SF)
    text = plan(fleet.paid_spendings(b.spendings(), b.vehicles()).groupBy("category").count())
    assert "rangepartitioning" not in text


@pytest.mark.parametrize("key", ["month_by_vehicle", "month_total", "company_month", "company_export_all", "hired_month_summary"])
def test_the_month_reaches_the_scan(spark, key):
    text = plan(PAIRS[key].run(spark, SF))
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|LessThan)\((l_shipdate|o_orderdate|ts)", text)


def test_look_back_reaches_the_scan(spark):
    text = plan(PAIRS["recent_paid"].run(spark, SF))
    assert "GreaterThanOrEqual(l_shipdate,2001-05-16" in text


def test_only_needed_columns_are_read(spark):
    text = plan(PAIRS["monthly_trend"].run(spark, SF))
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_month_directories_are_pruned(spark, tmp_path):
    root = str(tmp_path / "books")
    b = Books(spark, SF)
    sinks.write_table(b.spendings(), root, "spendings")
    sp = tables.load(spark, root, "spendings")
    for df in (fleet.month_total(sp, M), fleet.vehicle_spendings(sp, 7, M), fleet.monthly_trend(sp, "2001-06-15")):
        found = re.search(r"PartitionFilters: \[([^\]]*)\]", plan(df))
        assert "expense_month" in found.group(1)
    assert rows(fleet.month_total(sp, M)) == rows(fleet.month_total(b.spendings(), M))


def test_without_broadcast_the_fact_is_added_up_before_it_is_joined(spark):
    """Large vehicle lists: the join sees partial sums, not spendings."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = Books(spark, SF)
        text = plan(fleet.vehicle_totals(b.vehicles(), b.spendings()))
        # one exchange of partial sums, reused by the join, and one of vehicles
        assert "SortMergeJoin" in text and exchanges(text) == 2
        got = rows(fleet.vehicle_totals(b.vehicles(), b.spendings()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == sorted(rows(fleet.vehicle_totals(b.vehicles(), b.spendings())))


@pytest.mark.parametrize(
    "key", ["paid_spendings", "settle_spendings", "edit_spendings", "delete_rows", "company_export_all", "orphan_report"]
)
def test_results_do_not_depend_on_broadcasts(spark, key):
    want = sorted(map(str, PAIRS[key].run(spark, SF).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(str, PAIRS[key].run(spark, SF).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == want


SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def skewed(spark):
    """No broadcasts, and skew handling that begins at small sizes."""
    before = {k: spark.conf.get(k, None) for k in SKEWED}
    for k, v in SKEWED.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """From files: 60,000 rows, a third of them on key 7, and keys that repeat."""
    root = str(tmp_path_factory.mktemp("hot"))
    hot_id = "IF(id % 3 = 0, 7L, id % 1000)"
    spark.range(0, 60000, 1, 8).selectExpr(
        f"{hot_id} AS id", f"{hot_id} AS vehicle_id", "false AS marked", "id AS seq", "'P' AS spended_by",
        "'UPI' AS mode", "repeat(md5(string(id)), 2) AS reason", f"concat('V', {hot_id}) AS vehicle_no",
    ).write.parquet(f"{root}/rows")
    spark.range(0, 3000, 1, 4).selectExpr("id % 1000 AS id", "concat('V', id % 1000) AS vehicle_no").write.parquet(f"{root}/keys")
    return spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/keys")


def _names(raw, base):
    return ingest.ingest_vehicles(raw.withColumn("id", F.col("seq")), base, seq="id")


SPLIT = {
    "with_vehicle": lambda r, k: fleet.with_vehicle(r.drop("vehicle_no"), k.distinct()),
    "by_ids": lambda r, k: by_ids(r, k.filter("id < 8").select("id")),
    "settle": lambda r, k: changes.settle(r, k.select("id"), "Q", "Cash", M),
    "toggle_marks": lambda r, k: changes.toggle_marks(r, k.select("id")),
    "apply_updates": lambda r, k: changes.apply_updates(r, k.selectExpr("id", "vehicle_no AS reason")),
    "delete_rows": lambda r, k: changes.delete_rows(r, k.filter("id > 7").select("id")),
    "delete_cascade": lambda r, k: changes.delete_rows(r, k.filter("id > 7").select("id"), key="vehicle_id"),
    "detach_rows": lambda r, k: changes.detach_rows(r, k.filter("id > 7").select("id"), "vehicle_id"),
    "require_existing": lambda r, k: changes.require_existing(r, k),
    "unknown_keys": lambda r, k: changes.unknown_keys(r, k.filter("id > 7")),
    "reject_existing": lambda r, k: ingest.reject_existing(r, k.filter("id > 7"), "vehicle_no", "seq"),
    "ingest_vehicles": lambda r, k: _names(r, k.filter("id > 7")).accepted,
    "ingest_vehicles_rejected": lambda r, k: _names(r, k.filter("id > 7")).rejected,
    "orphans": lambda r, k: quality.orphans(r, k.filter("id > 7"), "vehicle_id"),
}


@pytest.mark.parametrize("key", list(SPLIT))
def test_a_hot_key_is_split_by_the_skew_join(spark, hot, skewed, key):
    """Both sides too large to broadcast, keys from a file and with repeats."""
    df = SPLIT[key](*hot)
    got = sorted(map(str, df.collect()))
    assert "SortMergeJoin(skew=true)" in plan(df)
    for k in SKEWED:
        spark.conf.unset(k)
    assert got == sorted(map(str, SPLIT[key](*hot).collect()))


def test_blank_names_take_no_part_in_joins(spark, skewed, tmp_path):
    raw = spark.range(0, 30000, 1, 4).selectExpr("id", "IF(id % 3 = 0, ' ', concat('N', id % 500)) AS vehicle_no")
    raw.write.parquet(str(tmp_path / "raw"))
    base = spark.range(100).selectExpr("id", "concat('N', id) AS vehicle_no")
    checked = _names(spark.read.parquet(str(tmp_path / "raw")).withColumn("seq", F.col("id")), base)
    assert checked.accepted.count() == 400
    reasons = {r[0]: r[1] for r in checked.rejected.groupBy("reject_reason").count().collect()}
    assert reasons == {
        "missing vehicle_no": 10000,
        "vehicle_no already exists": 4000,
        "vehicle_no repeated in the batch": 15600,
    }


def test_every_heavy_key_is_split(spark):
    """More heavy keys than would fit any fixed list of them."""
    keys = 12000
    left = spark.range(0, 3 * keys, 1, 4).selectExpr(f"id % {keys} AS k", "id AS x")
    right = spark.range(0, 2 * keys, 1, 4).selectExpr(f"id % {keys} AS k", "id AS y")
    pieces = _hot_keys(left, right, ["k"], 4, 1000)
    assert pieces.filter("__a * __b > 1").count() == keys
    got = fan_out_left_join(left, right, ["k"], 4, 1000)
    assert got.count() == 6 * keys and got.select("x", "y").distinct().count() == 6 * keys


def _largest_share(df) -> float:
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    return max(sizes) / sum(sizes)


def test_sorted_lists_spread_one_sale_and_one_day(spark, skewed):
    """Many payments of one sale, many receipts of one day without a reference."""
    b = Books(spark, SF)
    sale = b.company_sales().limit(1).selectExpr("* EXCEPT (company_name, month_year)", "'A' AS company_name", f"DATE '{M}' AS month_year")
    many = spark.range(0, 40000, 1, 4).selectExpr(
        "id", f"DATE '{M}' AS payment_date", "'A' AS company_name", "CAST(1 AS DECIMAL(12,2)) AS received_amount",
        "'cash' AS payment_mode", "CAST(NULL AS STRING) AS reference_number", "'' AS description", f"DATE '{M}' AS month_year",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (companies.sales_with_payments(sale, many, M), companies.company_ledger(sale, many, "A", M)):
            assert df.count() >= 40000 and _largest_share(df) < 0.2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_lists_are_ordered_without_a_range_exchange(spark, tmp_path):
    """A third of the rows on one day, a row without date, one without id."""
    hot = spark.range(0, 20000, 1, 4).selectExpr("id * 3 AS id", f"DATE '{M}' AS date", "'a' AS category")
    rest = spark.range(0, 40000, 1, 4).selectExpr("id * 3 + 1 AS id", "date_add(DATE '1997-01-01', CAST(id % 900 AS INT)) AS date", "'b'")
    odd = spark.createDataFrame([(5, None, "c"), (None, None, "c")], "id long, date date, category string")
    hot.union(rest).union(odd).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    found = tables.listing(df, "spendings", pieces=12)
    assert "rangepartitioning" not in plan(found) and "shufflepartitionidpassthrough" in plan(found)
    assert rows(found) == rows(tables.listing(df, "spendings"))
    # Twelve pieces of about one size, although one day has a third of the rows.
    sizes = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 60002 / 12
    assert rows(tables.listing(df.limit(0), "spendings", pieces=3)) == []


def test_a_list_of_very_many_days_is_ordered_as_before(spark, monkeypatch):
    from fleetbooks.operators import common

    monkeypatch.setattr(common, "MOST_DAYS", 10)
    sp = Books(spark, SF).spendings()
    found = tables.listing(sp, "spendings", pieces=4)
    assert "rangepartitioning" in plan(found) and found.count() == sp.count()


@pytest.mark.parametrize("key", ["payer_balance", "payer_balance_fixed_list"])
def test_payer_balance_reads_spendings_once(spark, key):
    df = PAIRS[key].run(spark, SF)
    df.collect()
    # What both parts need of the spendings is shuffled by one of them.
    assert re.search(r"ReusedExchange \[spended_by#\d+, _groupingexpression", plan(df))


def test_ingest_parses_each_field_once(spark):
    text = plan(PAIRS["ingest_spendings"].run(spark, SF))
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert filters and not any("try_cast" in line or "cast(" in line.lower() for line in filters)


def test_a_list_may_be_a_predicate_or_a_join(spark):
    sp = Books(spark, SF).spendings()
    ids = [r[0] for r in sp.select("id").distinct().limit(50).collect()]
    for run in (
        lambda joined: by_ids(sp, ids, joined=joined),
        lambda joined: flag_ids(sp, ids, "f", joined=joined),
        lambda joined: changes.delete_rows(sp, ids, joined=joined),
        lambda joined: changes.settle(sp, ids, "Q", "Cash", M, joined=joined),
        lambda joined: changes.detach_rows(sp, ids, "vehicle_id", joined=joined),
    ):
        listed, joined = run(False), run(True)
        assert "Join" not in plan(listed) and "Join" in plan(joined)
        assert sorted(map(str, listed.collect())) == sorted(map(str, joined.collect()))


def test_entries_of_names_are_read_twice(spark):
    for key in ("ingest_vehicles", "ingest_vehicles_rejected"):
        b = Books(spark, SF)
        checked = ingest.ingest_vehicles(b.raw_names("vehicle_no"), b.vehicles())
        text = plan(checked.accepted if key == "ingest_vehicles" else checked.rejected)
        # Raw names come from three scans, the vehicles from one.
        assert len(re.findall("FileScan", text)) <= 2 * 3 + 1, key


def test_blank_names_are_spread_over_the_join(spark, skewed, tmp_path):
    raw = spark.range(0, 60000, 1, 4).selectExpr("id", "IF(id % 3 > 0, ' ', concat('N', id)) AS vehicle_no", "repeat('x', 50) AS owner_name")
    raw.write.parquet(str(tmp_path / "raw"))
    base = spark.range(100).selectExpr("id", "concat('N', id) AS vehicle_no")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        checked = _names(spark.read.parquet(str(tmp_path / "raw")).withColumn("seq", F.col("id")), base)
        assert _largest_share(checked.entries) < 0.2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_duplicates_are_counted_by_hash_first(spark, monkeypatch):
    sp = Books(spark, SF).spendings()
    wide = list(quality.SAME_ENTRY)
    some = sp.unionByName(sp.filter("id % 17 = 0"))
    want = sorted(map(str, some.groupBy(*wide).agg(F.count("*").alias("rows")).filter("rows > 1").collect()))
    got = quality.duplicates(some, wide)
    assert want and sorted(map(str, got.collect())) == want
    assert "__hash" in plan(got) and "__hash" not in plan(quality.duplicates(some, ["id"]))
    # Values that share a hash are told apart by the second pass.
    for hashed in (lambda cols: F.lit(1).cast("long"), lambda cols: F.pmod(F.xxhash64(*cols), F.lit(3))):
        monkeypatch.setattr(quality, "_hash", hashed)
        assert sorted(map(str, quality.duplicates(some, wide).collect())) == want
    # NULL in one column or in the other.
    odd = spark.createDataFrame([("a", None, 1), (None, "a", 1), ("a", None, 1)], "x string, y string, z int")
    monkeypatch.undo()
    assert rows(quality.duplicates(odd, ["x", "y", "z"])) == [("a", None, 1, 2)]


def test_library_never_reads_the_clock_or_collects():
    import pathlib

    source = [p.read_text() for p in pathlib.Path("fleetbooks").rglob("*.py") if "llm" not in p.parts and p.name != "versions.py"]
    # The list of months that a version is made of is the one thing the driver gets.
    parts = pathlib.Path("fleetbooks/sources/versions.py").read_text()
    assert parts.count(".collect(") == 4 and parts.count("distinct().collect(") == 2
    source = "\n".join([*source, parts.replace(".collect(", "")])
    for word in (".collect(", "toPandas", "current_date", "datetime.now", "localCheckpoint", ".rdd", "udf("):
        assert word not in source, word
