"""Months, look-back dates and date parsing.

A month is a DATE on its first day. "Now" is always an explicit ``as_of``
argument, so a report gives the same rows whenever and wherever it runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_LABEL = "yyyy-MM"
DAY_LABEL = "yyyy-MM-dd"


def as_date(value: dt.date | dt.datetime | str) -> dt.date:
    """A parameter as a date: a date, ``YYYY-MM-DD`` or ``YYYY-MM`` (day 1)."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    parts = [int(p) for p in value.split("-")]
    if len(parts) == 2:
        parts.append(1)
    return dt.date(*parts)


def report_month(month: dt.date | str | None, as_of: dt.date | str) -> dt.date:
    """The month asked for, or the month of ``as_of`` when none was."""
    return as_date(as_of if month is None else month).replace(day=1)


def day(value: dt.date | str) -> Column:
    return F.lit(as_date(value))


def current_month(as_of: dt.date | str) -> Column:
    return F.trunc(day(as_of), "MM").cast("date")


def previous_month(as_of: dt.date | str) -> Column:
    return F.add_months(current_month(as_of), -1)


def days_before(as_of: dt.date | str, days: int) -> Column:
    return F.date_sub(day(as_of), days)


def months_before(as_of: dt.date | str, months: int) -> Column:
    """``as_of`` minus whole months; the day is clamped to the month's end."""
    return F.add_months(day(as_of), -months)


def month_label(col: Column | str) -> Column:
    return F.date_format(col, MONTH_LABEL)


def day_label(col: Column | str) -> Column:
    return F.date_format(col, DAY_LABEL)


def in_month(col: Column | str, month: dt.date | str) -> Column:
    """The date carries the month label of ``month``.

    The same rows as comparing ``YYYY-MM`` texts, written as a range so that
    partition pruning and Parquet statistics apply. Differs from equality only
    for months that are not pinned to day 1.
    """
    c = F.col(col) if isinstance(col, str) else col
    first = as_date(month).replace(day=1)
    following = (first + dt.timedelta(days=31)).replace(day=1)
    return (c >= F.lit(first)) & (c < F.lit(following))


# Four-digit year from 1 on, one- or two-digit month and day, nothing around them.
_DAY_FORM = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z"
_MONTH_FORM = r"^(?!0000)\d{4}-\d{1,2}\z"


def parse_day(col: Column) -> Column:
    """Strict ``YYYY-MM-DD`` (one-digit month and day allowed); else NULL.

    A cast is several times faster than a parse by pattern; the form test keeps
    it from taking more than the pattern would.
    """
    return F.when(col.rlike(_DAY_FORM), col.try_cast("date"))


def parse_month(col: Column) -> Column:
    """Strict ``YYYY-MM`` (one-digit month allowed) as day 1; else NULL."""
    return F.when(col.rlike(_MONTH_FORM), F.concat(col, F.lit("-1")).try_cast("date"))
