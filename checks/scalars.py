"""The column functions, each over every row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.pairs import Pair
from checks.views import AS_OF, M
from fleetbooks.functions import dates, labels, money, predicates, text

AS = f"DATE '{AS_OF}'"


def _dates(b):
    day, month = F.col("date").cast("string"), F.date_format("expense_month", "yyyy-M")
    return b.spendings().select(
        "id",
        "date",
        dates.month_label("expense_month").alias("month"),
        dates.day_label("date").alias("day"),
        (F.col("date") >= dates.days_before(AS_OF, 30)).alias("within_30_days"),
        (F.col("expense_month") >= dates.months_before(AS_OF, 6)).alias("within_6_months"),
        (F.col("expense_month") == dates.current_month(AS_OF)).alias("is_current_month"),
        (F.col("expense_month") == dates.previous_month(AS_OF)).alias("is_previous_month"),
        dates.in_month("date", M).alias("in_report_month"),
        dates.parse_day(day).alias("parsed_day"),
        dates.parse_month(month).alias("parsed_month"),
        dates.parse_day(month).alias("not_a_day"),
    )


def _money(b):
    amount = F.col("amount")
    over = amount - F.lit(50000).cast("decimal(12,2)")
    return b.spendings().select(
        "id",
        "amount",
        money.zero_if_null(F.when(F.col("mode") == "Cash", amount)).alias("cash"),
        F.when(F.col("category") == "diesel", amount).otherwise(0).alias("diesel"),
        money.parse_amount(amount.cast("string")).alias("parsed"),
        money.parse_amount(F.concat(F.lit("x"), amount.cast("string"))).alias("not_money"),
        over.alias("over"),
        money.money_text(over).alias("over_text"),
        labels.balance_label(over).alias("balance_label"),
        labels.pending_class(over).alias("pending_class"),
        labels.hired_balance_class(over).alias("hired_class"),
    )


def _text(b):
    reason = F.concat(F.lit("  "), F.coalesce("reason", F.lit("")), F.lit(" "))
    return b.spendings().select(
        "id",
        "reason",
        text.trimmed(reason).alias("trimmed"),
        text.blank_to_null(reason).alias("blank_to_null"),
        text.null_to_blank("reason").alias("null_to_blank"),
        text.with_dated_note("reason", "Settled", dates.day(AS_OF)).alias("noted"),
        text.flipped(F.when(F.col("mode").isNotNull(), F.col("marked"))).alias("flipped"),
        text.reason_for(F.col("category"), F.lit("Paid"), F.col("reason")).alias("form_reason"),
        text.new_or_listed(F.when(F.col("mode") == "Cash", "_new").otherwise("listed"), F.lit(" typed ")).alias("name"),
        labels.shown("reason").alias("shown"),
        labels.shown("spended_by", labels.UNPAID).alias("payer_shown"),
        labels.paid_label().alias("paid_label"),
        labels.title_case("category").alias("title"),
        labels.mode_label(F.concat(F.col("category"), F.lit("_by_"), F.col("mode"))).alias("mode_label"),
        predicates.contains_text("reason", "LINE 3").alias("mentions_line_3"),
    )


PAIRS = [
    Pair(
        "scalar_dates",
        _dates,
        f"""
        SELECT id, date, strftime(expense_month, '%Y-%m') AS month, strftime(date, '%Y-%m-%d') AS day,
               date >= {AS} - INTERVAL 30 DAY AS within_30_days,
               expense_month >= {AS} - INTERVAL 6 MONTH AS within_6_months,
               expense_month = DATE '2001-06-01' AS is_current_month,
               expense_month = DATE '2001-05-01' AS is_previous_month,
               strftime(date, '%Y-%m') = '{M:%Y-%m}' AS in_report_month,
               date AS parsed_day, expense_month AS parsed_month, CAST(NULL AS DATE) AS not_a_day
        FROM spendings""",
    ),
    Pair(
        "scalar_money",
        _money,
        """
        SELECT id, CAST(amount AS DOUBLE) AS amount,
               CAST(CASE WHEN mode = 'Cash' THEN amount ELSE 0 END AS DOUBLE) AS cash,
               CAST(CASE WHEN category = 'diesel' THEN amount ELSE 0 END AS DOUBLE) AS diesel,
               CAST(amount AS DOUBLE) AS parsed, CAST(NULL AS DOUBLE) AS not_money,
               CAST(amount - 50000 AS DOUBLE) AS over, printf('%.2f', CAST(amount - 50000 AS DOUBLE)) AS over_text,
               CASE WHEN amount > 50000 THEN 'Employee owes company'
                    WHEN amount < 50000 THEN 'Company owes employee' ELSE 'Settled' END AS balance_label,
               CASE WHEN amount > 50000 THEN 'warning' ELSE 'success' END AS pending_class,
               CASE WHEN amount > 50000 THEN 'success' ELSE 'danger' END AS hired_class
        FROM spendings""",
    ),
    Pair(
        "scalar_text",
        _text,
        rf"""
        SELECT id, reason, COALESCE(reason, '') AS trimmed, reason AS blank_to_null,
               COALESCE(reason, '') AS null_to_blank, COALESCE(reason, '') || ' - Settled on {AS_OF}' AS noted,
               NOT COALESCE(CASE WHEN mode IS NOT NULL THEN marked END, FALSE) AS flipped,
               CASE category WHEN 'diesel' THEN 'Diesel - Paid' WHEN 'salary' THEN 'Driver Salary' ELSE reason END AS form_reason,
               CASE WHEN mode = 'Cash' THEN 'typed' ELSE 'listed' END AS name,
               COALESCE(reason, '-') AS shown, COALESCE(spended_by, 'Unpaid') AS payer_shown,
               CASE WHEN spended_by IS NOT NULL AND mode IS NOT NULL THEN 'Paid' ELSE 'Unpaid' END AS paid_label,
               concat(upper(substr(category, 1, 1)), substr(category, 2)) AS title,
               CASE WHEN mode IS NOT NULL
                    THEN upper(regexp_replace(category || '_by_' || mode, '^([^_]*)_', '\1 ')) END AS mode_label,
               COALESCE(contains(lower(reason), 'line 3'), FALSE) AS mentions_line_3
        FROM spendings""",
    ),
]
