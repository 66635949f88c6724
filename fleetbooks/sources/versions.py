"""Versions of the books that share the months they have in common.

    <root>/data/<table>/write=<name>/<month column>=<month>/...    rows; never changed
    <root>/versions/version=<n>/...                                what version n is made of

A version is a short table: for each month of each table the write that holds it. A
correction reads and writes the months it touches, and publishes a version that takes
these from its own write and all others from where they were. Versions already read
stay as they are, a job that fails publishes nothing, and of two writers that start
from one version the second gets an error instead of undoing the first. A table
without a month column is one part, written as a whole.

The driver holds the list of months, never rows. Months of rows with a key are found by one job over
the key and month columns alone.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetbooks.operators.changes import Ids, delete_rows, detach_rows
from fleetbooks.operators.common import by_ids, stacked
from fleetbooks.sources.schemas import MONTH_COLUMN, SCHEMAS
from fleetbooks.sources.sinks import write_rows

# Settings under which Spark answers MIN, MAX and COUNT from the footers of Parquet files.
_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}

_PARTS = "table string, month date, write string"
# Fixed value: the directory of rows without a month.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"

Month = dt.date | None
Part = tuple[str, Month]


@dataclass(frozen=True)
class Child:
    """A table that refers to a deleted row: its rows go, or lose the reference."""

    table: str
    key: str
    detach: bool = False


class Books:
    """All tables under ``root``, version by version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- reading --------------------------------------------------------------

    def _listed(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_PARTS}, version int").parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def version(self) -> int:
        """The newest version; 0 if there is none yet."""
        listed = self._listed()
        return 0 if listed is None else listed.agg(F.max("version").alias("n")).first()["n"] or 0

    def parts(self, version: int | None = None) -> dict[Part, str]:
        """Which write holds each month of each table; the newest version by default."""
        version = self.version() if version is None else version
        listed = self._listed()
        if not version or listed is None:
            return {}
        rows = listed.filter(F.col("version") == version).collect()
        if not rows:
            raise ValueError(f"no version {version} in {self.root}")
        return {(r["table"], r["month"]): r["write"] for r in rows}

    def load(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, pruned by month like any table laid out by month."""
        return self._load(table, self.parts(version))

    def _load(self, table: str, parts: Mapping[Part, str]) -> DataFrame:
        return self._files(table, parts).select(*SCHEMAS[table].names)

    def _files(self, table: str, parts: Mapping[Part, str]) -> DataFrame:
        """The rows of some parts, with the name of their ``write``."""
        column, base = MONTH_COLUMN.get(table), f"{self.root}/data/{table}"
        paths = []
        for (name, month), write in sorted(parts.items(), key=str):
            if name == table:
                at = "" if column is None else f"/{column}={_NO_MONTH if month is None else month.isoformat()}"
                paths.append(f"{base}/write={write}{at}")
        schema = SCHEMAS[table]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("write", F.lit(""))
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _extents(self, table: str, date: str, version: int | None) -> DataFrame:
        # By all directories, or the footers would not do.
        rows = self._files(table, self.parts(version)).groupBy("write", MONTH_COLUMN[table])
        return rows.agg(F.min(date).alias("oldest"), F.max(date).alias("newest"), F.count(F.lit(1)).alias("n"))

    def extents(self, table: str, date: str, version: int | None = None) -> list[tuple[dt.date | None, dt.date | None, int]]:
        """Oldest and newest ``date`` and the number of rows of each month of a table.

        All three stand in the footers of the files: Spark's newer Parquet reader takes them
        from there and reads no column.
        """
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in _FOOTERS}
        for key, value in _FOOTERS.items():
            conf.set(key, value)
        try:
            found = self._extents(table, date, version).collect()
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)
        return [(r["oldest"], r["newest"], r["n"]) for r in found]

    def newest(self, table: str, n: int, date: str, version: int | None = None) -> DataFrame:
        """Rows that can be among the ``n`` newest by ``date``, and some more; reports of the newest take them.

        The months that go furthest, as many as hold ``n`` rows, have none older than
        some date, so no row older than that is wanted. Parquet's filters on
        the date skip the rest. NULL counts as newest.
        """
        held, floor = 0, None
        # A month without any date has only rows that are newest.
        for oldest, latest, rows in sorted(self.extents(table, date, version), key=lambda x: x[1] or dt.date.max, reverse=True):
            if held >= n:
                break
            held += rows
            floor = min(x for x in (floor, oldest, dt.date.max) if x is not None)
        found = self.load(table, version)
        c = F.col(date)
        return found if held < n or floor == dt.date.max else found.filter(c.isNull() | (c >= F.lit(floor)))

    # --- writing --------------------------------------------------------------

    def _written(self, table: str, rows: DataFrame) -> dict[Part, str]:
        """``rows`` as a write of their own, and the months that it has."""
        # A letter first, so that no name is taken for a number.
        write = f"w{uuid.uuid4().hex}"
        base = f"{self.root}/data/{table}"
        write_rows(rows, f"{base}/write={write}", table)
        column = MONTH_COLUMN.get(table)
        if column is None:
            return {(table, None): write}
        found = self.spark.read.schema(rows.schema).option("basePath", base).parquet(f"{base}/write={write}")
        # Reads no column: the month is a directory, the number of rows stands in the footers.
        return {(table, r[column]): write for r in found.select(column).distinct().collect()}

    def _publish(self, version: int, parts: Mapping[Part, str]) -> int:
        rows = [(table, month, write) for (table, month), write in parts.items()]
        made = self.spark.createDataFrame(rows, _PARTS).coalesce(1)
        made.write.mode("errorifexists").parquet(f"{self.root}/versions/version={version + 1}")
        return version + 1

    def publish(self, tables: Mapping[str, DataFrame]) -> int:
        """A new version in which ``tables`` are replaced as a whole."""
        version = self.version()
        parts = {p: w for p, w in self.parts(version).items() if p[0] not in tables}
        for table, rows in tables.items():
            parts |= self._written(table, rows)
        return self._publish(version, parts)

    def _touched(self, parts: Mapping[Part, str], refs: Sequence[Child], ids: Ids, arrivals: DataFrame | None = None) -> set[Part]:
        """The parts that have a row whose key is listed, found by one job over all of ``refs``.

        It reads the key of every row, less where Parquet's own filters rule a row group
        out; months are directories. The months of ``arrivals`` count as well, for the first table.
        """
        found = []
        for ref in refs:
            rows = self._load(ref.table, parts)
            hits = by_ids(rows, ids, ref.key)
            found.append(hits.select(F.lit(ref.table).alias("table"), _month(ref.table)))
        if arrivals is not None:
            found.append(arrivals.select(F.lit(refs[0].table).alias("table"), _month(refs[0].table)))
        return {(r["table"], r["month"]) for r in stacked(*found).distinct().collect()}

    def _changed(self, version: int, changes: Mapping[str, Callable[[DataFrame], DataFrame]], touched: set[Part]) -> int:
        """The version in which each table's touched months are what its change makes of them."""
        parts = self.parts(version)
        if not touched:
            return version
        kept = {p: w for p, w in parts.items() if p not in touched}
        for table, change in changes.items():
            months = {month for name, month in touched if name == table}
            if not months:
                continue
            held = {p: w for p, w in parts.items() if p[0] == table and p[1] in months}
            made = self._written(table, change(self._load(table, held)))
            if not made.keys() <= touched:
                raise ValueError(f"{table}: the change moved rows to months that were not read: {made.keys() - touched}")
            kept |= made
        return self._publish(version, kept)

    def change(
        self,
        table: str,
        ids: Ids,
        how: Callable[[DataFrame], DataFrame],
        key: str = "id",
        arrivals: DataFrame | None = None,
    ) -> int:
        """A new version with ``how`` applied to the months that have a row with a listed key.

        ``how`` is any correction of ``operators.changes``, bound to its keys: it must
        leave rows with other keys as they are, as only some of them are shown to it.
        If it can give a row another month, ``arrivals`` holds rows with these months, for
        instance the edits themselves; a month that only an edit of no row names is
        written as it is. Returns the number of the version, the old one's if
        nothing is touched.
        """
        version = self.version()
        touched = self._touched(self.parts(version), [Child(table, key)], ids, arrivals)
        return self._changed(version, {table: how}, touched)

    def delete(self, table: str, ids: Ids, children: Sequence[Child] = (), key: str = "id") -> int:
        """A new version without the listed rows, and with their children deleted or detached.

        One pass over the keys of all tables finds the months; parent and children
        change in one version or not at all. A child may refer by several columns, one entry each.
        """
        version = self.version()
        refs = [Child(table, key), *children]
        touched = self._touched(self.parts(version), refs, ids)
        changes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        for ref in refs:
            changes[ref.table] = _then(changes.get(ref.table), ref, ids)
        return self._changed(version, changes, touched)


def _month(table: str) -> Column:
    column = MONTH_COLUMN.get(table)
    return (F.lit(None).cast("date") if column is None else F.col(column)).alias("month")


def _then(before: Callable[[DataFrame], DataFrame] | None, child: Child, ids: Ids) -> Callable[[DataFrame], DataFrame]:
    def change(rows: DataFrame) -> DataFrame:
        rows = rows if before is None else before(rows)
        step = detach_rows if child.detach else delete_rows
        return step(rows, ids, child.key)

    return change
