"""Companies: sales, receipts, ledgers."""

from __future__ import annotations

from checks.pairs import Pair
from checks.views import M
from fleetbooks.operators import companies
from fleetbooks.operators.common import search_col
from fleetbooks.plans import exports, labelled

COMPANY = "Customer#000000259"
MONTH = f"DATE '{M}'"
SALE = (
    "id, sale_date, company_name, invoice_number, CAST(sale_amount AS DOUBLE) AS sale_amount,"
    " description, month_year"
)
RECEIPT = (
    "id, payment_date, company_name, CAST(received_amount AS DOUBLE) AS received_amount, payment_mode,"
    " reference_number, description, month_year"
)

SUMMARY = """
SELECT n.company_name, CAST(COALESCE(s.total, 0) AS DOUBLE) AS total_sales,
       CAST(COALESCE(p.total, 0) AS DOUBLE) AS total_received,
       CAST(COALESCE(s.total, 0) - COALESCE(p.total, 0) AS DOUBLE) AS pending_amount,
       strftime(s.last, '%Y-%m-%d') AS last_sale_date, strftime(p.last, '%Y-%m-%d') AS last_payment_date
FROM (SELECT DISTINCT company_name FROM company_sales
      UNION SELECT DISTINCT company_name FROM company_payments) n
LEFT JOIN (SELECT company_name, SUM(sale_amount) AS total, MAX(sale_date) AS last
           FROM company_sales GROUP BY company_name) s ON n.company_name = s.company_name
LEFT JOIN (SELECT company_name, SUM(received_amount) AS total, MAX(payment_date) AS last
           FROM company_payments GROUP BY company_name) p ON n.company_name = p.company_name"""

BY_MONTH = f"""
SELECT COALESCE(s.company_name, p.company_name) AS company_name, COALESCE(s.total, 0) AS sales,
       COALESCE(p.total, 0) AS received
FROM (SELECT company_name, SUM(sale_amount) AS total FROM company_sales
      WHERE month_year = {MONTH} GROUP BY company_name) s
FULL OUTER JOIN (SELECT company_name, SUM(received_amount) AS total FROM company_payments
      WHERE month_year = {MONTH} GROUP BY company_name) p ON s.company_name = p.company_name"""

# Pairs of the month that match, and the sales that no payment of the month matches.
ALL_PAIRS = f"""
WITH sold AS (SELECT * FROM company_sales WHERE month_year = {MONTH}),
     paid AS (SELECT * FROM company_payments WHERE month_year = {MONTH}),
     matched AS (
       SELECT company_name, sale_date, invoice_number, sale_amount, sold.description, payment_date,
              received_amount, payment_mode, reference_number
       FROM sold JOIN paid USING (company_name)),
     unmatched AS (
       SELECT company_name, sale_date, invoice_number, sale_amount, description, NULL, NULL, NULL, NULL
       FROM sold WHERE company_name NOT IN (SELECT company_name FROM paid))
SELECT * REPLACE (CAST(sale_amount AS DOUBLE) AS sale_amount, CAST(received_amount AS DOUBLE) AS received_amount)
FROM (SELECT * FROM matched UNION ALL SELECT * FROM unmatched)"""

LEDGER = f"""
SELECT 'sale' AS transaction_type, sale_date AS date, invoice_number AS reference,
       CAST(sale_amount AS DOUBLE) AS amount, description, CAST(NULL AS STRING) AS payment_mode
FROM company_sales WHERE company_name = '{COMPANY}' AND month_year = {MONTH}
UNION ALL
SELECT 'payment', payment_date, reference_number, CAST(received_amount AS DOUBLE), description, payment_mode
FROM company_payments WHERE company_name = '{COMPANY}' AND month_year = {MONTH}"""

PAIRS = [
    Pair(
        "company_names",
        lambda b: companies.company_names(b.company_sales(), b.company_payments()),
        """SELECT DISTINCT company_name FROM company_sales UNION SELECT DISTINCT company_name
           FROM company_payments ORDER BY company_name""",
    ),
    Pair(
        "search_company",
        lambda b: search_col(
            companies.company_summary(b.company_sales(), b.company_payments()), "company_name", "R#00000012"
        ),
        f"SELECT * FROM ({SUMMARY}) WHERE contains(lower(company_name), 'r#00000012')",
    ),
    Pair(
        "recent_sales",
        lambda b: companies.recent_sales(b.company_sales()),
        f"""SELECT {SALE} FROM company_sales c
            ORDER BY c.sale_date DESC NULLS FIRST, id, company_name, invoice_number, c.sale_amount LIMIT 20""",
    ),
    Pair(
        "recent_company_payments",
        lambda b: companies.recent_company_payments(b.company_payments()),
        f"""SELECT {RECEIPT} FROM company_payments c
            ORDER BY c.payment_date DESC NULLS FIRST, id, company_name, c.received_amount, payment_mode,
                     reference_number, description LIMIT 20""",
    ),
    Pair(
        "recent_company_payments_labelled",
        lambda b: labelled.recent_company_payments_labelled(b.company_payments()),
        """SELECT payment_date, company_name, printf('%.2f', CAST(c.received_amount AS DOUBLE)) AS received_amount,
                  concat(upper(substr(payment_mode, 1, 1)), lower(substr(payment_mode, 2))) AS payment_mode,
                  COALESCE(NULLIF(reference_number, ''), '-') AS reference_number
           FROM (SELECT * FROM company_payments
                 ORDER BY payment_date DESC NULLS FIRST, id, company_name, received_amount, payment_mode,
                          reference_number, description LIMIT 20) c""",
    ),
    Pair(
        "company_summary",
        lambda b: companies.company_summary(b.company_sales(), b.company_payments()),
        SUMMARY,
    ),
    Pair(
        "company_summary_labelled",
        lambda b: labelled.company_summary_labelled(b.company_sales(), b.company_payments()),
        f"""SELECT company_name, printf('%.2f', total_sales) AS total_sales,
                   printf('%.2f', total_received) AS total_received, printf('%.2f', pending_amount) AS pending_amount,
                   CASE WHEN pending_amount > 0 THEN 'warning' ELSE 'success' END AS pending_class,
                   COALESCE(last_sale_date, '-') AS last_sale, COALESCE(last_payment_date, '-') AS last_payment
            FROM ({SUMMARY})""",
    ),
    Pair(
        "company_month",
        lambda b: companies.company_month(b.company_sales(month=M), b.company_payments(month=M), M),
        f"""SELECT company_name, CAST(sales AS DOUBLE) AS sales_amount, CAST(received AS DOUBLE) AS received_amount,
                   CAST(sales - received AS DOUBLE) AS pending_amount FROM ({BY_MONTH})""",
    ),
    Pair(
        "company_month_one",
        lambda b: companies.company_month_one(
            b.company_sales(month=M), b.company_payments(month=M), COMPANY, M
        ),
        f"""SELECT '{COMPANY}' AS company_name, CAST(s AS DOUBLE) AS sales_amount,
                   CAST(p AS DOUBLE) AS received_amount, CAST(s - p AS DOUBLE) AS pending_amount
            FROM (SELECT (SELECT COALESCE(SUM(sale_amount), 0) FROM company_sales
                          WHERE company_name = '{COMPANY}' AND month_year = {MONTH}) AS s,
                         (SELECT COALESCE(SUM(received_amount), 0) FROM company_payments
                          WHERE company_name = '{COMPANY}' AND month_year = {MONTH}) AS p)""",
    ),
    Pair(
        "company_totals",
        lambda b: companies.company_totals(b.company_sales(), b.company_payments()),
        """SELECT CAST(s AS DOUBLE) AS total_sales, CAST(p AS DOUBLE) AS total_received,
                  CAST(s - p AS DOUBLE) AS pending_amount, n AS total_companies
           FROM (SELECT (SELECT COALESCE(SUM(sale_amount), 0) FROM company_sales) AS s,
                        (SELECT COALESCE(SUM(received_amount), 0) FROM company_payments) AS p,
                        (SELECT COUNT(*) FROM (SELECT company_name FROM company_sales
                                               UNION SELECT company_name FROM company_payments)) AS n)""",
    ),
    Pair(
        "company_month_totals",
        lambda b: companies.company_month_totals(
            companies.company_month(b.company_sales(month=M), b.company_payments(month=M), M)
        ),
        f"""SELECT CAST(SUM(sales) AS DOUBLE) AS total_sales, CAST(SUM(received) AS DOUBLE) AS total_received,
                   CAST(SUM(sales - received) AS DOUBLE) AS pending_amount FROM ({BY_MONTH})""",
    ),
    Pair(
        "company_month_labelled",
        lambda b: labelled.company_month_labelled(b.company_sales(month=M), b.company_payments(month=M), M),
        f"""SELECT company_name, printf('%.2f', CAST(sales AS DOUBLE)) AS sales,
                   printf('%.2f', CAST(received AS DOUBLE)) AS received,
                   printf('%.2f', CAST(sales - received AS DOUBLE)) AS pending,
                   CASE WHEN sales - received > 0 THEN 'warning' ELSE 'success' END AS pending_class
            FROM ({BY_MONTH})""",
    ),
    Pair(
        "company_export_all",
        lambda b: companies.sales_with_payments(b.company_sales(month=M), b.company_payments(month=M), M),
        ALL_PAIRS,
    ),
    Pair(
        "export_company_all",
        lambda b: exports.export_companies(b.company_sales(month=M), b.company_payments(month=M), M),
        ALL_PAIRS,
    ),
    Pair(
        "company_ledger",
        lambda b: companies.company_ledger(
            b.company_sales(month=M), b.company_payments(month=M), COMPANY, M
        ),
        f"SELECT transaction_type AS type, date, reference, amount, description FROM ({LEDGER}) ORDER BY date",
    ),
    Pair(
        "company_ledger_export",
        lambda b: companies.company_ledger(
            b.company_sales(month=M), b.company_payments(month=M), COMPANY, M, with_mode=True
        ),
        f"SELECT * FROM ({LEDGER}) ORDER BY date",
    ),
    Pair(
        "export_company_detail",
        lambda b: exports.export_companies(
            b.company_sales(month=M), b.company_payments(month=M), M, COMPANY
        ),
        f"SELECT * FROM ({LEDGER}) ORDER BY date",
    ),
    Pair(
        "company_ledger_labelled",
        lambda b: labelled.company_ledger_labelled(
            b.company_sales(month=M), b.company_payments(month=M), COMPANY, M
        ),
        rf"""SELECT date, upper(transaction_type) AS type, COALESCE(NULLIF(reference, ''), '-') AS reference,
                    printf('%.2f', amount) AS amount,
                    COALESCE(upper(regexp_replace(payment_mode, '^([^_]*)_', '\1 ')), '-') AS payment_mode,
                    COALESCE(NULLIF(description, ''), '-') AS description
             FROM ({LEDGER})""",
    ),
    Pair(
        "lookup_sales",
        lambda b: companies.lookup_sales(b.company_sales(), b.keys("company_sales")),
        """SELECT id, strftime(sale_date, '%Y-%m-%d') AS sale_date, company_name,
                  COALESCE(invoice_number, '') AS invoice_number, CAST(sale_amount AS DOUBLE) AS sale_amount,
                  strftime(month_year, '%Y-%m') AS month_year, COALESCE(description, '') AS description
           FROM company_sales WHERE id IN (SELECT id FROM sale_keys)""",
    ),
    Pair(
        "lookup_company_payments",
        lambda b: companies.lookup_company_payments(b.company_payments(), b.keys("company_payments")),
        """SELECT id, strftime(payment_date, '%Y-%m-%d') AS payment_date, company_name,
                  CAST(received_amount AS DOUBLE) AS received_amount, payment_mode,
                  COALESCE(reference_number, '') AS reference_number,
                  strftime(month_year, '%Y-%m') AS month_year, COALESCE(description, '') AS description
           FROM company_payments WHERE id IN (SELECT id FROM company_payment_keys)""",
    ),
]
