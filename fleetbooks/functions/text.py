"""Text clean-up as the entry forms do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes, ASCII ones first.
ASCII_WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
WHITESPACE = ASCII_WHITESPACE + (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Fixed values of the entry forms.
CATEGORY_DIESEL = "diesel"
CATEGORY_SALARY = "salary"
CATEGORY_OTHERS = "others"
SALARY_REASON = "Driver Salary"
DIESEL_REASON_PREFIX = "Diesel - "
NEW_NAME = "_new"


def trimmed(col: Column | str) -> Column:
    """Without white space of any kind at either end.

    Text of ASCII characters only, where bytes and characters agree in number,
    needs the short list alone, which is several times cheaper.
    """
    c = F.col(col) if isinstance(col, str) else col
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.btrim(c, F.lit(ASCII_WHITESPACE))).otherwise(
        F.btrim(c, F.lit(WHITESPACE))
    )


def blank_to_null(col: Column | str) -> Column:
    """Trimmed text; nothing left becomes NULL."""
    return F.nullif(trimmed(col), F.lit(""))


def null_to_blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(""))


def new_or_listed(name: Column | str, new_name: Column | str) -> Column:
    """The listed name, or the typed one when the placeholder was chosen."""
    listed = trimmed(name)
    return F.when(listed == NEW_NAME, trimmed(new_name)).otherwise(listed)


def reason_for(category: Column, status: Column, reason: Column) -> Column:
    """The reason the spending form fills in for each category."""
    return (
        F.when(category == CATEGORY_DIESEL, F.concat(F.lit(DIESEL_REASON_PREFIX), status))
        .when(category == CATEGORY_SALARY, F.lit(SALARY_REASON))
        .when(category == CATEGORY_OTHERS, reason)
    )


def with_dated_note(reason: Column | str, label: str, on: Column) -> Column:
    """``reason`` followed by `` - <label> on <date>``; NULL counts as empty."""
    return F.concat(
        null_to_blank(reason), F.lit(f" - {label} on "), F.date_format(on, "yyyy-MM-dd")
    )


def flipped(marked: Column | str) -> Column:
    """Boolean NOT where NULL counts as false."""
    c = F.col(marked) if isinstance(marked, str) else marked
    return ~F.coalesce(c, F.lit(False))
