"""Checks that a database would enforce as constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbooks.operators.common import grouped, stacked


def duplicates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values of ``cols`` that occur more than once, with their number of rows.

    NULL is a value here; filter it out first where it may repeat. Wide values are counted
    by a hash of eight bytes first, and only rows whose hash comes again are grouped
    by the values themselves, which tells values that share a hash apart. So the
    shuffle has the hashes of all rows and the text of suspects.
    """
    kinds = [df.schema[c].dataType for c in cols]
    if len(cols) > 2 or any(isinstance(k, (T.StringType, T.BinaryType)) for k in kinds):
        keyed = df.select(*cols, _hash(cols).alias("__hash"))
        again = grouped(keyed, ["__hash"], F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
        df = keyed.join(again.select("__hash"), "__hash", "left_semi")
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def _hash(cols: Sequence[str]) -> Column:
    return F.xxhash64(*cols)


SAME_ENTRY = ("vehicle_id", "date", "category", "reason", "amount")


def duplicate_report(
    veh: DataFrame,
    comp: DataFrame,
    hv: DataFrame,
    sales: DataFrame,
    sp: DataFrame,
    same_entry: Sequence[str] = SAME_ENTRY,
) -> DataFrame:
    """Everything that should be unique and is not, as (check, value, rows).

    A spending counts as entered twice when all columns of ``same_entry`` agree.
    """

    def found(check: str, df: DataFrame, *cols: Column) -> DataFrame:
        names = [f"k{i}" for i in range(len(cols))]
        keyed = df.select(*[c.alias(n) for c, n in zip(cols, names)])
        shown = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
        value = F.concat_ws(" | ", *shown).alias("value")
        return duplicates(keyed, names).select(F.lit(check).alias("check"), value, "rows")

    invoices = sales.filter(F.col("invoice_number").isNotNull())
    entry = [F.col(c) for c in same_entry]
    return stacked(
        found("vehicles.vehicle_no", veh, F.col("vehicle_no")),
        found("companies.name", comp, F.col("name")),
        found("hired_vehicles.vehicle_no", hv, F.col("vehicle_no")),
        found("company_sales.invoice_number", invoices, F.col("invoice_number")),
        found("spendings entry", sp, *entry),
    )


def unreferenced(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    """Rows of ``dim`` that no row of ``fact`` refers to through ``key``.

    The fact's keys are made distinct map-side before they are moved, so a key
    with a very large share of the rows arrives as one row per task.
    """
    used = fact.select(F.col(key).alias("id")).filter(F.col("id").isNotNull()).distinct()
    return dim.join(used, "id", "left_anti").select(*dim.columns)


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of ``fact`` whose ``key`` is set and has no row in ``dim``."""
    parents = dim.select(F.col("id").alias(key))
    rows = fact.filter(F.col(key).isNotNull())
    return rows.join(parents, key, "left_anti").select(*fact.columns)


def safe_delete(dim: DataFrame, fact: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``dim`` without the listed rows, except those still referred to."""
    free = unreferenced(dim.select("id"), fact, key)
    going = ids.select(F.col(ids.columns[0]).alias("id")).join(free, "id", "left_semi")
    return dim.join(going.distinct(), "id", "left_anti").select(*dim.columns)
