"""Raw entries to table rows, with rejected entries kept aside.

A raw frame holds text columns named as the entry form names its fields; a
missing field is NULL; ``id`` and ``seq`` (the order of entry) are carried along
where the frame has them. Each ``ingest_*`` gives a ``Checked`` with two frames:
``accepted`` has the table's columns and types, ``rejected`` the raw columns
and ``reject_reason``, the first rule that failed. Rules look at one row only,
so these functions also run on a streaming frame; the two that compare entries
with each other (``ingest_vehicles``, ``ingest_companies``) need a batch.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetbooks.functions.dates import parse_day, parse_month
from fleetbooks.functions.money import parse_amount
from fleetbooks.functions.text import (
    CATEGORY_DIESEL,
    CATEGORY_OTHERS,
    CATEGORY_SALARY,
    blank_to_null,
    new_or_listed,
    null_to_blank,
    reason_for,
    trimmed,
)
from fleetbooks.operators.common import grouped, stacked

# How many pieces entries with a blank name are spread over.
BLANK_PIECES = 1000

# A condition and what is said about an entry that meets it.
Reason = tuple[Column, str]


@dataclass(frozen=True)
class Checked:
    """Entries, the row each becomes, and what keeps one out.

    ``fails`` decides; ``reasons`` only name the first failure, in the order
    the form checks them, and are worked out for rejected entries alone. A
    field that cannot be read parses to NULL, as a missing one does, so one
    NULL test per field decides and the filter stays small enough for the JVM
    to compile.
    """

    entries: DataFrame
    raw_columns: Sequence[str]
    row: Mapping[str, Column]
    fails: Sequence[Column]
    reasons: Sequence[Reason]

    @property
    def _fails(self) -> Column:
        return functools.reduce(operator.or_, self.fails)

    @property
    def accepted(self) -> DataFrame:
        """Fields are parsed once: the verdict is worked out next to them, and goes
        through a generator of one row, below which Spark does not push the filter
        (it would parse every field a second time there)."""
        rows = self.entries.select(
            *[c.alias(name) for name, c in self.row.items()], self._fails.alias("__fails")
        )
        told = rows.select(*self.row, F.explode(F.array("__fails")).alias("__out"))
        return told.filter(~F.col("__out")).select(*self.row)

    @property
    def rejected(self) -> DataFrame:
        first, *others = self.reasons
        reason = functools.reduce(lambda r, rule: r.when(*rule), others, F.when(*first))
        return self.entries.filter(self._fails).select(
            *self.raw_columns, reason.alias("reject_reason")
        )


def _field(raw: DataFrame, name: str) -> Column:
    """A field of the form as text; NULL where the frame lacks it."""
    return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")


def _empty(c: Column) -> Column:
    return null_to_blank(c) == ""


def _carried(raw: DataFrame) -> dict[str, Column]:
    """Ids come with the data; they are not made here."""
    return {c: F.col(c).try_cast("long") for c in ("id", "seq") if c in raw.columns}


def _check(
    raw: DataFrame,
    row: Mapping[str, Column],
    required: Mapping[str, Column],
    optional: Mapping[str, Column] | None = None,
    fails: Mapping[str, Column] | None = None,
    reasons: Sequence[Reason] = (),
) -> Checked:
    """``required`` and ``optional`` are texts of fields; one that ``row`` holds
    in another form must be readable. ``fails`` replaces a field's own test or,
    under a new name, adds one; ``reasons`` come after those for missing and
    bad fields."""
    optional = optional or {}
    parsed = [name for name, c in required.items() if row[name] is not c]
    tests = {name: row[name].isNull() if name in parsed else _empty(c) for name, c in required.items()}
    tests |= {name: c.isNotNull() & row[name].isNull() for name, c in optional.items()}
    tests |= fails or {}
    said = [(_empty(c), f"missing {name}") for name, c in required.items()]
    said += [(row[name].isNull(), f"bad {name}") for name in parsed]
    said += [(c.isNotNull() & row[name].isNull(), f"bad {name}") for name, c in optional.items()]
    return Checked(raw, raw.columns, {**_carried(raw), **row}, list(tests.values()), [*said, *reasons])


# --- spendings --------------------------------------------------------------


def shape_spending_forms(form: DataFrame) -> DataFrame:
    """The spending form's per-category fields as one amount, payer, mode and reason.

    Diesel that is not paid has its own amount field and neither payer nor
    mode. The reason follows from the category, except for others.
    """
    f = lambda name: _field(form, name)
    category = f("category")
    diesel, salary, others = (
        category == c for c in (CATEGORY_DIESEL, CATEGORY_SALARY, CATEGORY_OTHERS)
    )
    paid = f("diesel_payment_status") == "Paid"

    def picked(part: str, unpaid: Column) -> Column:
        return (
            F.when(diesel & paid, f(f"diesel_{part}"))
            .when(diesel, unpaid)
            .when(salary, f(f"salary_{part}"))
            .when(others, f(f"others_{part}"))
        )

    shaped = {
        "reason": reason_for(category, f("diesel_payment_status"), f("reason")),
        "amount": picked("amount", f("unpaid_diesel_amount")),
        "spended_by": picked("spended_by", F.lit("")),
        "mode": picked("mode", F.lit("")),
    }
    kept = ("id", "seq", "vehicle_id", "date", "expense_month", "category")
    kept = [c for c in kept if c in form.columns]
    return form.select(*kept, *[c.alias(name) for name, c in shaped.items()])


def _spending_fields(raw: DataFrame) -> dict[str, Column]:
    return {
        name: _field(raw, name)
        for name in ("vehicle_id", "date", "expense_month", "category", "amount")
    }


def ingest_spendings(raw: DataFrame, form_rules: bool = True) -> Checked:
    """New spendings.

    An empty payer and an empty mode become NULL each on its own, so a row may
    be half paid. ``form_rules`` adds what the entry page insists on: an amount
    above zero and a reason for category others.
    """
    text = _spending_fields(raw)
    text["category"] = trimmed(text["category"])
    row = {
        "vehicle_id": text["vehicle_id"].try_cast("long"),
        "date": parse_day(text["date"]),
        "expense_month": parse_month(text["expense_month"]),
        "category": text["category"],
        "reason": trimmed(null_to_blank(_field(raw, "reason"))),
        "amount": parse_amount(text["amount"]),
        "spended_by": blank_to_null(_field(raw, "spended_by")),
        "mode": blank_to_null(_field(raw, "mode")),
        "marked": F.lit(False),
    }
    if not form_rules:
        return _check(raw, row, text)
    no_reason = (row["category"] == CATEGORY_OTHERS) & (row["reason"] == "")
    not_above_zero = ~F.coalesce(row["amount"] > 0, F.lit(False))
    return _check(
        raw,
        row,
        text,
        fails={"amount": not_above_zero, "reason": no_reason},
        reasons=[(not_above_zero, "amount not above zero"), (no_reason, "missing reason")],
    )


def spending_edits(raw: DataFrame) -> Checked:
    """Edits of spendings, one full record per row.

    Nothing is trimmed, and if the payer *or* the mode is empty both become
    NULL: an edited row is never half paid.
    """
    text = _spending_fields(raw)
    payer, mode = _field(raw, "spended_by"), _field(raw, "mode")
    both = (null_to_blank(payer) != "") & (null_to_blank(mode) != "")
    row = {
        "vehicle_id": text["vehicle_id"].try_cast("long"),
        "date": parse_day(text["date"]),
        "expense_month": parse_month(text["expense_month"]),
        "category": text["category"],
        "reason": null_to_blank(_field(raw, "reason")),
        "amount": parse_amount(text["amount"]),
        "spended_by": F.when(both, payer),
        "mode": F.when(both, mode),
    }
    return _check(raw, row, text)


# --- payments and advances --------------------------------------------------


def ingest_payments(raw: DataFrame) -> Checked:
    """New payments, of either form: from a name, or from a company's id."""
    text = {name: _field(raw, name) for name in ("date", "amount")}
    ids = {name: blank_to_null(_field(raw, name)) for name in ("company_id", "vehicle_id")}
    row = {
        "date": parse_day(text["date"]),
        "amount": parse_amount(text["amount"]),
        "received_from": blank_to_null(_field(raw, "received_from")),
        "reason": blank_to_null(_field(raw, "reason")),
        "company_id": ids["company_id"].try_cast("long"),
        "vehicle_id": ids["vehicle_id"].try_cast("long"),
    }
    return _check(raw, row, text, optional=ids)


def _advances(raw: DataFrame, purpose: Column) -> Checked:
    text = {name: _field(raw, name) for name in ("employee_name", "date", "amount")}
    row = {
        "employee_name": text["employee_name"],
        "date": parse_day(text["date"]),
        "amount": parse_amount(text["amount"]),
        "purpose": purpose,
    }
    return _check(raw, row, text)


def ingest_advances(raw: DataFrame) -> Checked:
    """New advances: nothing is trimmed, an absent purpose is blank."""
    return _advances(raw, null_to_blank(_field(raw, "purpose")))


def advance_edits(raw: DataFrame) -> Checked:
    """Edits of advances: nothing is trimmed, an absent purpose is NULL."""
    return _advances(raw, _field(raw, "purpose"))


# --- hired vehicles and companies -------------------------------------------


def ingest_hired_txn(raw: DataFrame) -> Checked:
    """New transactions of hired vehicles, and edits of them when the raw frame
    has no ``hired_vehicle_id`` (an edit leaves the vehicle alone)."""
    names = ["transaction_type", "transaction_date", "month_year", "amount"]
    if "hired_vehicle_id" in raw.columns:
        names.insert(0, "hired_vehicle_id")
    text = {name: _field(raw, name) for name in names}
    row: dict[str, Column] = {}
    if "hired_vehicle_id" in text:
        row["hired_vehicle_id"] = text["hired_vehicle_id"].try_cast("long")
    row |= {
        "transaction_type": text["transaction_type"],
        "transaction_date": parse_day(text["transaction_date"]),
        "month_year": parse_month(text["month_year"]),
        "amount": parse_amount(text["amount"]),
        "description": trimmed(null_to_blank(_field(raw, "description"))),
        "reference_no": trimmed(null_to_blank(_field(raw, "reference_no"))),
    }
    return _check(raw, row, text)


def ingest_company_sales(raw: DataFrame) -> Checked:
    """New sales, and edits of sales."""
    text = {name: _field(raw, name) for name in ("sale_date", "company_name", "sale_amount", "month_year")}
    text["company_name"] = trimmed(text["company_name"])
    row = {
        "sale_date": parse_day(text["sale_date"]),
        "company_name": text["company_name"],
        "invoice_number": trimmed(null_to_blank(_field(raw, "invoice_number"))),
        "sale_amount": parse_amount(text["sale_amount"]),
        "description": trimmed(null_to_blank(_field(raw, "description"))),
        "month_year": parse_month(text["month_year"]),
    }
    return _check(raw, row, text)


def ingest_company_payments(raw: DataFrame) -> Checked:
    """New receipts; a placeholder name takes the typed one."""
    return _receipts(raw, new_or_listed(_field(raw, "company_name"), _field(raw, "new_company_name")))


def company_payment_edits(raw: DataFrame) -> Checked:
    """Edits of receipts; the name is trimmed and knows no placeholder."""
    return _receipts(raw, trimmed(_field(raw, "company_name")))


def _receipts(raw: DataFrame, company: Column) -> Checked:
    text = {
        name: _field(raw, name)
        for name in ("payment_date", "company_name", "received_amount", "payment_mode", "month_year")
    }
    text["company_name"] = company
    row = {
        "payment_date": parse_day(text["payment_date"]),
        "company_name": text["company_name"],
        "received_amount": parse_amount(text["received_amount"]),
        "payment_mode": text["payment_mode"],
        "reference_number": trimmed(null_to_blank(_field(raw, "reference_number"))),
        "description": trimmed(null_to_blank(_field(raw, "description"))),
        "month_year": parse_month(text["month_year"]),
    }
    return _check(raw, row, text)


# --- names that must be new -------------------------------------------------


def reject_existing(new: DataFrame, base: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``base``; of several, the first by ``seq``.

    The first row is picked with a map-side combined MIN over the whole row, so
    a key that is repeated without end never gathers in one task; as a MIN of rows
    with text it sorts the new rows first.
    """
    fresh = new.join(base.select(key), key, "left_anti")
    rest = [c for c in new.columns if c not in (key, seq)]
    first = grouped(fresh, [key], F.min(F.struct(seq, *rest)).alias("first"))
    return first.select(key, "first.*").select(*new.columns)


def _new_names(
    raw: DataFrame, base: DataFrame, key: str, seq: str, name: Column, row: Mapping[str, Column]
) -> Checked:
    """Entries whose name is neither empty, nor known, nor entered before in the batch.

    There may be very many blank names. They match nothing, but stay in the one join, so
    that the entries are read twice and no more: each has a number next to its empty name,
    which spreads them. A known name has 0 there.
    """
    entries = raw.withColumn("__name", name)
    blank = _empty(F.col("__name"))
    spread = F.when(blank, 1 + F.pmod(F.xxhash64(seq), F.lit(BLANK_PIECES))).otherwise(0)
    entries = entries.withColumn("__key", F.struct(F.when(~blank, F.col("__name")).alias("name"), spread.alias("piece")))
    # One look-up for both questions, so that the join's rows are not needed by name again.
    names = grouped(
        stacked(
            entries.filter(~blank).select("__name", F.col(seq).alias("__seq")),
            base.select(F.col(key).alias("__name"), F.lit(True).alias("__known")),
        ),
        ["__name"],
        F.min("__seq").alias("__first"),
        F.max("__known").alias("__known"),
    )
    whole = F.struct(F.col("__name").alias("name"), F.lit(0).cast("long").alias("piece"))
    joined = entries.join(names.select(whole.alias("__key"), "__first", "__known"), "__key", "left")
    reasons = [
        (_empty(F.col("__name")), f"missing {key}"),
        (F.col("__known").isNotNull(), f"{key} already exists"),
        (F.col(seq) > F.col("__first"), f"{key} repeated in the batch"),
    ]
    fails = [F.coalesce(c, F.lit(False)) for c, _ in reasons]
    return Checked(joined, raw.columns, {**_carried(raw), **row}, fails, reasons)


def ingest_vehicles(raw: DataFrame, veh: DataFrame, seq: str = "id") -> Checked:
    """New vehicles, own or hired. ``seq`` orders the entries and is unique."""
    name = trimmed(_field(raw, "vehicle_no"))
    row = {
        "vehicle_no": name,
        "owner_name": trimmed(null_to_blank(_field(raw, "owner_name"))),
        "contact_number": trimmed(null_to_blank(_field(raw, "contact_number"))),
    }
    return _new_names(raw, veh, "vehicle_no", seq, name, row)


def ingest_companies(raw: DataFrame, comp: DataFrame, seq: str = "id") -> Checked:
    """New companies by name. ``seq`` orders the entries and is unique."""
    name = trimmed(_field(raw, "name"))
    return _new_names(raw, comp, "name", seq, name, {"name": name})
