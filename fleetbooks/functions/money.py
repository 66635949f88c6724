"""Exact money: decimals inside, double only where a report leaves Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(12,2)"


def zero_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast(MONEY))


def total(col: Column | str) -> Column:
    """SUM that is 0, not NULL, over no rows."""
    return zero_if_null(F.sum(col))


def total_when(condition: Column, col: Column | str = "amount") -> Column:
    """Sum over the rows that meet ``condition``, without a second scan."""
    c = F.col(col) if isinstance(col, str) else col
    return total(F.when(condition, c))


def parse_amount(col: Column) -> Column:
    """Text as exact money, rounded half up to two places; NULL if unusable."""
    return col.try_cast(MONEY)


def money_text(col: Column | str) -> Column:
    """Two fixed decimals, as ``%.2f`` prints them, but from the exact value."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("decimal(38,2)").cast("string")


def money_as_double(df: DataFrame) -> DataFrame:
    """Every decimal column as double; the last step before a report is shown."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
