"""The given tables seen as the books, once for Spark and once for the SQL check.

Parameters of the registered queries are fixed: ``AS_OF`` stands for "now",
``M`` is the report month and ``HM`` the report month of hired vehicles.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbooks.functions.dates import in_month

AS_OF = dt.date(2001, 6, 15)
M = dt.date(1998, 3, 1)
HM = dt.date(2024, 1, 1)
MONEY = "decimal(12,2)"


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _month_of(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "MM")


# Which rows of a table the registered changes and lookups by id are about.
SELECTED: dict[str, str] = {
    "spendings": f"(spended_by IS NULL OR mode IS NULL) AND expense_month = DATE '{M}'",
    "payments": "vehicle_id IS NULL",
    "employee_advances": "amount >= 25",
    "hired_vehicle_transactions": "transaction_type NOT IN ('sale', 'payment')",
    "company_sales": "description = '5-LOW'",
    "company_payments": "payment_mode = 'cash'",
    "vehicles": "vehicle_no LIKE '%3%'",
    "hired_vehicles": "owner_name = 'BUILDING'",
}


class Books:
    """The domain tables over one directory of given tables.

    Here every month column is the first day of the row's own date, so a query
    about one month may ask for the table with ``month=``: the same rows pass,
    and the range on the date reaches the Parquet scan, which a test on the
    truncated date cannot. Tables written by ``write_table`` need no such help:
    they are laid out by month.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def given(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    @staticmethod
    def _within(df: DataFrame, date: str, month: dt.date | None) -> DataFrame:
        return df if month is None else df.filter(in_month(date, month))

    def vehicles(self) -> DataFrame:
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        day = F.date_add(F.lit(dt.date(2000, 1, 1)), (key % 9000).cast("int"))
        return self.given("supplier").select(
            key.alias("id"),
            F.col("s_name").alias("vehicle_no"),
            F.when(key % 4 == 1, "").when(key % 4 > 1, F.concat(F.lit("Owner "), _text(nation))).alias("owner_name"),
            F.when(nation % 5 > 0, F.concat(F.lit("98-"), _text(nation * 1000 + key))).alias("contact_number"),
            F.when(nation != 3, day.cast("timestamp_ntz")).alias("created_at"),
        )

    def companies(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
        )

    def spendings(self, month: dt.date | None = None) -> DataFrame:
        flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
        rows = self.given("lineitem").select(
            F.col("l_orderkey").alias("id"),
            F.col("l_suppkey").alias("vehicle_id"),
            F.col("l_shipdate").cast("date").alias("date"),
            _month_of("l_shipdate").alias("expense_month"),
            F.when(flag == "A", "diesel").when(flag == "N", "salary").otherwise("others").alias("category"),
            F.when(line != 1, F.concat(F.lit("line "), _text(line))).alias("reason"),
            F.col("l_extendedprice").cast(MONEY).alias("amount"),
            F.when(flag != "R", F.concat(F.lit("E"), _text(F.col("l_partkey") % 200 + 5))).alias("spended_by"),
            F.when((status == "O") & (flag != "A"), F.lit(None))
            .when(line % 3 == 0, "Cash")
            .when(line % 3 == 1, "UPI")
            .otherwise("Automatic")
            .alias("mode"),
            (line % 2 == 0).alias("marked"),
        )
        return self._within(rows, "date", month)

    def payments(self) -> DataFrame:
        return self.given("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("company_id"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 10).alias("vehicle_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_totalprice").cast(MONEY).alias("amount"),
            F.concat(F.lit("C"), _text("o_custkey")).alias("received_from"),
            F.col("o_orderpriority").alias("reason"),
        )

    def employee_advances(self) -> DataFrame:
        return self.given("events").filter(F.col("event_type") == "signup").select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("E"), _text("user_id")).alias("employee_name"),
            F.col("ts").cast("date").alias("date"),
            F.col("value").cast(MONEY).alias("amount"),
            F.col("props").alias("purpose"),
        )

    def hired_vehicles(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("vehicle_no"),
            F.col("c_mktsegment").alias("owner_name"),
        )

    def hired_vehicle_transactions(self, month: dt.date | None = None) -> DataFrame:
        kind = F.col("event_type")
        rows = self.given("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("hired_vehicle_id"),
            F.when(kind == "purchase", "sale").when(kind == "click", "payment").otherwise(kind).alias("transaction_type"),
            F.col("ts").cast("date").alias("transaction_date"),
            _month_of("ts").alias("month_year"),
            F.col("value").cast(MONEY).alias("amount"),
            F.col("props").alias("description"),
            F.concat(F.lit("REF"), _text("event_id")).alias("reference_no"),
            F.col("ts").alias("created_at"),
        )
        return self._within(rows, "transaction_date", month)

    def company_sales(self, month: dt.date | None = None) -> DataFrame:
        orders = self._within(
            self.given("orders").withColumn("sale_date", F.col("o_orderdate").cast("date")),
            "sale_date",
            month,
        )
        customers = self.given("customer").select("c_custkey", "c_name")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"),
            "sale_date",
            F.col("c_name").alias("company_name"),
            F.concat(F.lit("INV"), _text("o_orderkey")).alias("invoice_number"),
            F.col("o_totalprice").cast(MONEY).alias("sale_amount"),
            F.col("o_orderpriority").alias("description"),
            _month_of("o_orderdate").alias("month_year"),
        )

    def company_payments(self, month: dt.date | None = None) -> DataFrame:
        lines = self._within(
            self.given("lineitem").withColumn("payment_date", F.col("l_shipdate").cast("date")),
            "payment_date",
            month,
        )
        buyers = (
            self.given("orders")
            .select("o_orderkey", "o_custkey")
            .join(
                self.given("customer").select("c_custkey", "c_name"),
                F.col("o_custkey") == F.col("c_custkey"),
            )
        )
        flag = F.col("l_returnflag")
        return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_orderkey").alias("id"),
            "payment_date",
            F.col("c_name").alias("company_name"),
            F.col("l_extendedprice").cast(MONEY).alias("received_amount"),
            F.when(flag == "A", "cash").when(flag == "N", "bank_transfer").otherwise("cheque").alias("payment_mode"),
            F.concat(F.lit("PAY"), _text("l_orderkey")).alias("reference_number"),
            F.col("l_linestatus").alias("description"),
            _month_of("l_shipdate").alias("month_year"),
        )

    # --- inputs of the change operators, made from the books ----------------

    def keys(self, table: str) -> DataFrame:
        """The ids a change is about (see ``SELECTED``), and one that does not exist."""
        rows = getattr(self, table)()
        if table == "spendings":
            rows = self.spendings(month=M)
        picked = rows.filter(F.expr(SELECTED[table])).select("id").distinct()
        return picked.union(self.spark.range(1).select(-1 - F.col("id")))

    @staticmethod
    def _raw(df: DataFrame, date: str, amount: str, month: str | None, payer: str | None, blank: str) -> DataFrame:
        """All columns as text, with some entries broken."""
        every = lambda n: F.col("id") % n == 0
        made = {
            date: F.when(every(17), "").otherwise(_text(date)),
            amount: F.when(every(19), "abc").when(every(23), "-1").otherwise(_text(amount)),
        }
        if month is not None:
            made[month] = F.date_format(month, "yyyy-MM")
        if payer is not None:
            made[payer] = F.when(every(29), blank).otherwise(F.col(payer))
        return df.select(*[made.get(c, _text(c)).alias(c) for c in df.columns])

    def raw_spendings(self) -> DataFrame:
        return self._raw(self.spendings(), "date", "amount", "expense_month", "spended_by", " ")

    def raw_payments(self) -> DataFrame:
        return self._raw(self.payments(), "date", "amount", None, "received_from", " ")

    def raw_advances(self) -> DataFrame:
        return self._raw(self.employee_advances(), "date", "amount", None, "employee_name", "")

    def raw_hired_txn(self) -> DataFrame:
        return self._raw(
            self.hired_vehicle_transactions(), "transaction_date", "amount", "month_year", "description", " "
        )

    def raw_company_sales(self) -> DataFrame:
        rows = self._raw(self.company_sales(), "sale_date", "sale_amount", "month_year", "description", " ")
        return rows.withColumn("company_name", F.concat(F.lit(" "), "company_name", F.lit(" ")))

    def raw_company_payments(self) -> DataFrame:
        rows = self._raw(
            self.company_payments(), "payment_date", "received_amount", "month_year", "description", " "
        )
        new = F.col("id").cast("long") % 13 == 0
        return rows.withColumn(
            "new_company_name", F.when(new, F.concat(F.lit(" New "), "company_name"))
        ).withColumn("company_name", F.when(new, "_new").otherwise(F.col("company_name")))

    def spending_forms(self) -> DataFrame:
        """The entry page's fields, one group per category."""
        sp, amount = self.spendings(), _text("amount")
        paid = F.col("spended_by").isNotNull() & F.col("mode").isNotNull()
        cat = F.col("category")
        return sp.select(
            "id",
            "category",
            "reason",
            F.when(paid, "Paid").otherwise("Unpaid").alias("diesel_payment_status"),
            *[
                F.when((cat == c) & (F.lit(c != "diesel") | paid), amount).otherwise("").alias(f"{c}_amount")
                for c in ("diesel", "salary", "others")
            ],
            F.when((cat == "diesel") & ~paid, amount).otherwise("").alias("unpaid_diesel_amount"),
            *[F.col("spended_by").alias(f"{c}_spended_by") for c in ("diesel", "salary", "others")],
            *[F.col("mode").alias(f"{c}_mode") for c in ("diesel", "salary", "others")],
        )

    def raw_names(self, column: str) -> DataFrame:
        """Names to enter: known ones, new ones, and the new ones again with
        blanks around them or nothing else."""
        sup, cust = self.given("supplier"), self.given("customer")
        again = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
        return (
            sup.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias(column))
            .union(cust.select(F.col("c_custkey") + 1000000000000, "c_name"))
            .union(cust.select(F.col("c_custkey") + 2000000000000, again))
        )

    def edits(self, table: str, fields: dict[str, Column]) -> DataFrame:
        """Two edits per listed id, one after the other, some of them unusable."""
        seqs = self.keys(table).select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
        return seqs.select("id", F.col("seq").cast("long"), *[c.alias(n) for n, c in fields.items()])


class OddBooks(Books):
    """The same books with the odd values that the given tables lack: spendings without
    vehicle, month or mark, with an empty payer, and with months that are no first day."""

    def spendings(self, month: dt.date | None = None) -> DataFrame:
        every = lambda n: F.col("id") % n == 0
        return super().spendings(month).withColumns(
            {
                "vehicle_id": F.when(~every(7), F.col("vehicle_id")),
                "expense_month": F.when(every(11), None).when(every(13), F.col("date")).otherwise(F.col("expense_month")),
                "spended_by": F.when(every(5) & F.col("spended_by").isNull(), "").otherwise(F.col("spended_by")),
                "marked": F.when(~every(3), F.col("marked")),
            }
        )

    def keys(self, table: str) -> DataFrame:
        return Books(self.spark, self.sf_dir).keys(table)


# The same tables for the SQL check.
VIEWS: dict[str, str] = {
    "vehicles": """
SELECT s_suppkey AS id, s_name AS vehicle_no,
       CASE WHEN s_suppkey % 4 = 1 THEN '' WHEN s_suppkey % 4 > 1 THEN 'Owner ' || s_nationkey END AS owner_name,
       CASE WHEN s_nationkey % 5 > 0 THEN '98-' || (s_nationkey * 1000 + s_suppkey) END AS contact_number,
       CASE WHEN s_nationkey <> 3
            THEN CAST(DATE '2000-01-01' + CAST(s_suppkey % 9000 AS INTEGER) AS TIMESTAMP) END AS created_at
FROM supplier""",
    "companies": "SELECT c_custkey AS id, c_name AS name FROM customer",
    "spendings": """
SELECT l_orderkey AS id, l_suppkey AS vehicle_id,
       CAST(l_shipdate AS DATE) AS date,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS expense_month,
       CASE l_returnflag WHEN 'A' THEN 'diesel' WHEN 'N' THEN 'salary' ELSE 'others' END AS category,
       CASE WHEN l_linenumber = 1 THEN CAST(NULL AS STRING) ELSE concat('line ', CAST(l_linenumber AS STRING)) END AS reason,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
       CASE WHEN l_returnflag = 'R' THEN CAST(NULL AS STRING)
            ELSE concat('E', CAST(l_partkey % 200 + 5 AS STRING)) END AS spended_by,
       CASE WHEN l_linestatus = 'O' AND l_returnflag <> 'A' THEN CAST(NULL AS STRING)
            WHEN l_linenumber % 3 = 0 THEN 'Cash' WHEN l_linenumber % 3 = 1 THEN 'UPI'
            ELSE 'Automatic' END AS mode,
       (l_linenumber % 2 = 0) AS marked
FROM lineitem""",
    "odd_spendings": """
SELECT * REPLACE (
    CASE WHEN id % 7 <> 0 THEN vehicle_id END AS vehicle_id,
    CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN date ELSE expense_month END AS expense_month,
    CASE WHEN id % 5 = 0 AND spended_by IS NULL THEN '' ELSE spended_by END AS spended_by,
    CASE WHEN id % 3 <> 0 THEN marked END AS marked)
FROM spendings""",
    "payments": """
SELECT o_orderkey AS id, o_custkey AS company_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey % 10 END AS vehicle_id,
       CAST(o_orderdate AS DATE) AS date, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
       concat('C', CAST(o_custkey AS STRING)) AS received_from, o_orderpriority AS reason
FROM orders""",
    "employee_advances": """
SELECT event_id AS id, concat('E', CAST(user_id AS STRING)) AS employee_name,
       CAST(ts AS DATE) AS date, CAST(value AS DECIMAL(12,2)) AS amount, props AS purpose
FROM events WHERE event_type = 'signup'""",
    "hired_vehicles": "SELECT c_custkey AS id, c_name AS vehicle_no, c_mktsegment AS owner_name FROM customer",
    "hired_vehicle_transactions": """
SELECT event_id AS id, user_id AS hired_vehicle_id,
       CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'click' THEN 'payment' ELSE event_type END AS transaction_type,
       CAST(ts AS DATE) AS transaction_date, CAST(date_trunc('month', ts) AS DATE) AS month_year,
       CAST(value AS DECIMAL(12,2)) AS amount, props AS description,
       concat('REF', CAST(event_id AS STRING)) AS reference_no, ts AS created_at
FROM events""",
    "company_sales": """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS sale_date, c_name AS company_name,
       concat('INV', CAST(o_orderkey AS STRING)) AS invoice_number,
       CAST(o_totalprice AS DECIMAL(12,2)) AS sale_amount, o_orderpriority AS description,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_year
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "company_payments": """
SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS payment_date, c_name AS company_name,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS received_amount,
       CASE l_returnflag WHEN 'A' THEN 'cash' WHEN 'N' THEN 'bank_transfer' ELSE 'cheque' END AS payment_mode,
       concat('PAY', CAST(l_orderkey AS STRING)) AS reference_number,
       l_linestatus AS description, CAST(date_trunc('month', l_shipdate) AS DATE) AS month_year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    **{
        name: f"SELECT DISTINCT id FROM {table} WHERE {SELECTED[table]} UNION ALL SELECT -1"
        for name, table in {
            "spending_keys": "spendings",
            "payment_keys": "payments",
            "advance_keys": "employee_advances",
            "hired_txn_keys": "hired_vehicle_transactions",
            "sale_keys": "company_sales",
            "company_payment_keys": "company_payments",
            "vehicle_keys": "vehicles",
            "hired_vehicle_keys": "hired_vehicles",
        }.items()
    },
    "raw_spendings": """
SELECT CAST(id AS STRING) AS id, CAST(vehicle_id AS STRING) AS vehicle_id,
       CASE WHEN id % 17 = 0 THEN '' ELSE CAST(date AS STRING) END AS date,
       strftime(expense_month, '%Y-%m') AS expense_month, category, reason,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(amount AS STRING) END AS amount,
       CASE WHEN id % 29 = 0 THEN ' ' ELSE spended_by END AS spended_by, mode, CAST(marked AS STRING) AS marked
FROM spendings""",
    "raw_payments": """
SELECT CAST(id AS STRING) AS id, CAST(company_id AS STRING) AS company_id, CAST(vehicle_id AS STRING) AS vehicle_id,
       CASE WHEN id % 17 = 0 THEN '' ELSE CAST(date AS STRING) END AS date,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(amount AS STRING) END AS amount,
       CASE WHEN id % 29 = 0 THEN ' ' ELSE received_from END AS received_from, reason
FROM payments""",
    "raw_advances": """
SELECT CAST(id AS STRING) AS id, CASE WHEN id % 29 = 0 THEN '' ELSE employee_name END AS employee_name,
       CASE WHEN id % 17 = 0 THEN '' ELSE CAST(date AS STRING) END AS date,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(amount AS STRING) END AS amount, purpose
FROM employee_advances""",
    "raw_hired_txn": """
SELECT CAST(id AS STRING) AS id, CAST(hired_vehicle_id AS STRING) AS hired_vehicle_id, transaction_type,
       CASE WHEN id % 17 = 0 THEN '' ELSE CAST(transaction_date AS STRING) END AS transaction_date,
       strftime(month_year, '%Y-%m') AS month_year,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(amount AS STRING) END AS amount,
       CASE WHEN id % 29 = 0 THEN ' ' ELSE description END AS description, reference_no
FROM hired_vehicle_transactions""",
    "raw_company_sales": """
SELECT CAST(id AS STRING) AS id, CASE WHEN id % 17 = 0 THEN '' ELSE CAST(sale_date AS STRING) END AS sale_date,
       concat(' ', company_name, ' ') AS company_name, invoice_number,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(sale_amount AS STRING) END AS sale_amount,
       CASE WHEN id % 29 = 0 THEN ' ' ELSE description END AS description,
       strftime(month_year, '%Y-%m') AS month_year
FROM company_sales""",
    "raw_company_payments": """
SELECT CAST(id AS STRING) AS id, CASE WHEN id % 17 = 0 THEN '' ELSE CAST(payment_date AS STRING) END AS payment_date,
       CASE WHEN id % 13 = 0 THEN '_new' ELSE company_name END AS company_name,
       CASE WHEN id % 13 = 0 THEN concat(' New ', company_name) END AS new_company_name,
       CASE WHEN id % 19 = 0 THEN 'abc' WHEN id % 23 = 0 THEN '-1' ELSE CAST(received_amount AS STRING) END AS received_amount,
       payment_mode, reference_number,
       CASE WHEN id % 29 = 0 THEN ' ' ELSE description END AS description,
       strftime(month_year, '%Y-%m') AS month_year
FROM company_payments""",
    "raw_names": """
SELECT s_suppkey AS id, s_name AS name FROM supplier
UNION ALL SELECT c_custkey + 1000000000000, c_name FROM customer
UNION ALL SELECT c_custkey + 2000000000000, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE concat(' ', c_name, ' ') END FROM customer""",
}


def with_views(sql: str) -> str:
    """The statement with the views it uses, and those they use, put before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        words = set(re.findall(r"\w+", re.sub(r"'[^']*'", "", text)))
        for name, body in VIEWS.items():
            if name in words and name not in needed:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    own = sql.strip()
    if own.startswith("WITH "):
        return f"WITH {ctes},\n{own[5:]}"
    return f"WITH {ctes}\n{own}"
