"""What the pages show next to the numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetbooks.functions.predicates import has_text

# Fixed values shown on the pages.
DASH = "-"
PAID = "Paid"
UNPAID = "Unpaid"
EMPLOYEE_OWES = "Employee owes company"
COMPANY_OWES = "Company owes employee"
SETTLED = "Settled"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def shown(col: Column | str, missing: str = DASH) -> Column:
    """The text, or ``missing`` where it is NULL or empty."""
    return F.coalesce(F.nullif(_col(col).cast("string"), F.lit("")), F.lit(missing))


def paid_label(payer: str = "spended_by", mode: str = "mode") -> Column:
    """Unlike ``is_paid``, an empty string counts as unpaid here."""
    return F.when(has_text(payer) & has_text(mode), PAID).otherwise(UNPAID)


def balance_label(balance: Column | str) -> Column:
    b = _col(balance)
    return F.when(b > 0, EMPLOYEE_OWES).when(b < 0, COMPANY_OWES).otherwise(SETTLED)


def pending_class(pending: Column | str) -> Column:
    """Money still to come is a warning."""
    return F.when(_col(pending) > 0, "warning").otherwise("success")


def hired_balance_class(balance: Column | str) -> Column:
    """A hired vehicle in credit is fine; zero or less is not."""
    return F.when(_col(balance) > 0, "success").otherwise("danger")


def title_case(col: Column | str) -> Column:
    """First letter of each word upper, the rest lower.

    Words start after white space, a hyphen or an opening bracket;
    ``initcap`` knows white space only.
    """
    words = F.split(_col(col), r"(?<=[-\s({\[<])")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))
    return F.array_join(F.transform(words, capital), "")


def mode_label(col: Column | str) -> Column:
    """Upper case with the first underscore shown as a space."""
    return F.upper(F.regexp_replace(_col(col), r"^([^_]*)_", "$1 "))
