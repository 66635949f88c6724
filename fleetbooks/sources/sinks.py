"""Writers. Every one is distributed: a directory of part files, never one file
made by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbooks.functions.dates import DAY_LABEL
from fleetbooks.sources.schemas import KEYS, LISTING_ORDER, MONTH_COLUMN

_TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def csv_ready(df: DataFrame) -> DataFrame:
    """Every column as the text its CSV cell holds; NULL is an empty cell."""

    def cell(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, _TIME_TEXT)
        return F.coalesce(c.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header plus rows in column order.

    NULL and '' are both written as nothing, quotes inside a cell are doubled
    and blanks around a value are kept.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("timestampFormat", _TIME_TEXT)
        .option("timestampNTZFormat", _TIME_TEXT)
        .csv(path)
    )


def json_ready(df: DataFrame) -> DataFrame:
    """Dates and times as ``YYYY-MM-DD``, money as double; NULL stays NULL."""

    def value(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, DAY_LABEL)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        return c.alias(f.name)

    return df.select(*[value(f) for f in df.schema.fields])


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, with every field named even where it is NULL."""
    json_ready(df).write.mode(mode).option("ignoreNullFields", False).json(path)


# Bloom filters of the key, one for each row group: months do not cluster ids, so without
# them a lookup by id opens every row group. Parquet keeps the smallest of some
# sizes that fits the keys it has seen.
BLOOM_BYTES = 4 << 20


def write_rows(df: DataFrame, target: str, table: str) -> None:
    """A table's rows as Parquet in the directory ``target``, which must not exist.

    Large tables are laid out by month; the rebalance hint lets Spark split a month
    that holds far more rows than the others over several tasks and merge small ones.
    Rows lie by date within a file, so date ranges skip row groups.
    """
    month = MONTH_COLUMN.get(table)
    if month is not None:
        df = df.hint("rebalance", month).sortWithinPartitions(month, LISTING_ORDER[table][0])
    out = df.write.mode("errorifexists")
    for key in (c for c in KEYS[table] if c in df.columns):
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
        out = out.option(f"parquet.bloom.filter.adaptive.enabled#{key}", "true")
    out = out.option("parquet.bloom.filter.max.bytes", str(BLOOM_BYTES))
    (out if month is None else out.partitionBy(month)).parquet(target)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """A new version of a table under a new path.

    Refuses an existing path, so a version that is being read is never
    overwritten. ``sources.versions`` writes only the months that a correction touches.
    """
    write_rows(df, f"{path.rstrip('/')}/{table}", table)
