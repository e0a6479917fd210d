"""Scope, period and choice-list checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import scope
from tallyspark.operators.filters import Period, date_context, in_month, options, period_column, rule_period
from tallyspark.suite.base import OFFICIAL_SQL, RECEIPTS_SQL, money, query, rounded

_SCOPE = ("order_id", "amount", "receipt_type", "pay_method")


@query(
    "F03_excluded_orders",
    f"WITH {OFFICIAL_SQL} SELECT order_id FROM poisoned",
)
def excluded_orders(t):
    return scope.excluded_orders([t.receipts(*_SCOPE)])


@query(
    "F04_official_rows",
    f"""WITH {OFFICIAL_SQL}
SELECT is_tour, unified_date::VARCHAR AS day, count(*) AS receipts, round(sum(amount), 2) AS amount FROM official GROUP BY 1, 2""",
)
def official_rows(t):
    rows = t.official("order_id", "amount", "unified_date")
    out = rows.groupBy("is_tour", F.date_format("unified_date", "yyyy-MM-dd").alias("day"))
    return out.agg(F.count(F.lit(1)).alias("receipts"), F.round(F.sum("amount"), 2).alias("amount"))


@query(
    "F05_scope_by_parameters",
    f"""WITH {RECEIPTS_SQL}, bad AS (SELECT DISTINCT order_id FROM receipts WHERE receipt_type IN ('掛賬核銷', 'AO') OR pay_method IN ('P'))
SELECT count(*) AS receipts, count(DISTINCT order_id) AS orders, round(sum(amount), 2) AS amount
FROM receipts WHERE order_id NOT IN (SELECT order_id FROM bad)""",
)
def scope_by_parameters(t):
    tour, others = t.split(*_SCOPE)
    a, b = scope.official_scope(tour, others, ("掛賬核銷", "AO"), ("P",))
    return a.unionByName(b).agg(
        F.count(F.lit(1)).alias("receipts"), F.countDistinct("order_id").alias("orders"), F.round(F.sum("amount"), 2).alias("amount")
    )


_AUDIT_SQL = f"""WITH {OFFICIAL_SQL}, raw AS (SELECT count(*) AS n, sum(amount) AS a FROM receipts), kept AS (SELECT count(*) AS n, sum(amount) AS a FROM official)
SELECT '不含掛賬核銷與TT退款轉團款' AS scope_label, (SELECT count(*) FROM poisoned) AS excluded_order_count, raw.n AS raw_rows, kept.n AS analysis_rows,
 raw.n - kept.n AS excluded_rows, round(raw.a, 2) AS raw_amount, round(kept.a, 2) AS analysis_amount, round(raw.a - kept.a, 2) AS excluded_amount FROM raw, kept"""


@query("A19_scope_audit", _AUDIT_SQL)
def scope_audit(t):
    return rounded(scope.scope_audit(t.receipts(*_SCOPE)), 2)


@query("C03_official_scope_frames", _AUDIT_SQL)
def official_frames(t):
    """The audit recomputed from the two official frames, not from the one-pass audit."""
    tour, others = t.split(*_SCOPE)
    a, b = scope.official_scope(tour, others)
    both, kept = tour.unionByName(others), a.unionByName(b)
    sums = lambda df, p: df.agg(F.count(F.lit(1)).alias(p + "_rows"), F.sum("amount").alias(p + "_amount"))
    from tallyspark.functions.keys import attach_one_row

    row = attach_one_row(sums(both, "raw"), sums(kept, "analysis"))
    row = attach_one_row(row, scope.excluded_orders([tour, others]).agg(F.count(F.lit(1)).alias("excluded_order_count")))
    return row.select(
        F.lit(scope.SCOPE_LABEL).alias("scope_label"),
        "excluded_order_count",
        "raw_rows",
        "analysis_rows",
        (F.col("raw_rows") - F.col("analysis_rows")).alias("excluded_rows"),
        money("raw_amount"),
        money("analysis_amount"),
        F.round(F.col("raw_amount") - F.col("analysis_amount"), 2).alias("excluded_amount"),
    )


@query(
    "A18_data_freshness",
    f"""WITH {OFFICIAL_SQL} SELECT min(unified_date)::VARCHAR AS min_date, max(unified_date)::VARCHAR AS max_date,
 (SELECT count(*) FROM receipts) AS raw_rows, count(*) AS analysis_rows, (SELECT count(*) FROM receipts) - count(*) AS excluded_rows,
 '不含掛賬核銷與TT退款轉團款' AS scope FROM official""",
)
def data_freshness(t):
    rows = t.receipts(*_SCOPE, "unified_date")
    return scope.freshness(scope.official_rows(rows), scope.scope_audit(rows))


@query(
    "F02_upload_row_filter",
    f"""WITH {RECEIPTS_SQL}, stored AS (SELECT DISTINCT receipt_no FROM receipts WHERE unified_date < DATE '1998-01-01'),
incoming AS (SELECT * FROM receipts WHERE unified_date >= DATE '1998-01-01')
SELECT receipt_type, count(*) AS receipts, round(sum(amount), 2) AS amount FROM incoming
WHERE NOT (receipt_type = '掛賬核銷' OR pay_method = 'TT 退款轉團款') OR receipt_no IN (SELECT receipt_no FROM stored) GROUP BY 1""",
)
def upload_row_filter(t):
    rows = t.receipts("receipt_no", "unified_date", "amount", "receipt_type", "pay_method")
    from tallyspark.sources.store import receipt_numbers

    stored = receipt_numbers(rows.where(F.col("unified_date") < "1998-01-01"))
    kept = scope.filter_upload(rows.where(F.col("unified_date") >= "1998-01-01"), stored)
    return kept.groupBy("receipt_type").agg(F.count(F.lit(1)).alias("receipts"), F.round(F.sum("amount"), 2).alias("amount"))


@query(
    "F06_period_filter",
    f"""WITH {RECEIPTS_SQL} SELECT unified_date::VARCHAR AS day, count(*) AS receipts, round(sum(amount), 2) AS amount FROM receipts
WHERE year(unified_date) IN (1996, 1997) AND strftime(unified_date, '%Y-%m') IN ('1996-11', '1996-12', '1997-01')
  AND unified_date BETWEEN DATE '1996-11-10' AND DATE '1997-01-20' GROUP BY 1""",
)
def period_filter(t):
    period = Period(years=(1996, 1997), months=("1996-11", "1996-12", "1997-01"), date_range=("1996-11-10", "1997-01-20"))
    rows = period.apply(t.receipts("unified_date", "amount"), "unified_date")
    return rows.groupBy(F.date_format("unified_date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("receipts"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query(
    "F07_period_filter_month_forms",
    f"""WITH {RECEIPTS_SQL} SELECT strftime(unified_date, '%Y-%m') AS month, count(*) AS receipts, round(sum(amount), 2) AS amount FROM receipts
WHERE strftime(unified_date, '%Y-%m') IN ('1996-11') OR strftime(unified_date, '%m') IN ('03', '07') GROUP BY 1""",
)
def period_filter_month_forms(t):
    rows = Period(months=("1996-11", "3", "07")).apply(t.receipts("unified_date", "amount"), "unified_date")
    return rows.groupBy(F.date_format("unified_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("receipts"), F.round(F.sum("amount"), 2).alias("amount")
    )


@query(
    "F08_rule_period",
    f"""WITH {RECEIPTS_SQL} SELECT count(*) FILTER (strftime(receipt_time, '%Y-%m') = '1997-05') AS in_month,
 count(*) FILTER (strftime(receipt_time, '%Y') = '1998') AS in_year, count(*) AS all_rows, 'receipt_time' AS date_column FROM receipts""",
)
def rule_periods(t):
    rows = t.receipts("receipt_time").withColumn("unified_date", F.lit("n/a"))  # no parseable value: skipped
    column = period_column(rows)
    return rows.agg(
        F.count(F.when(rule_period(rows, column, month="1997-05"), 1)).alias("in_month"),
        F.count(F.when(rule_period(rows, column, year="1998"), 1)).alias("in_year"),
        F.count(F.when(rule_period(rows, column), 1)).alias("all_rows"),
        F.lit(column).alias("date_column"),
    )


@query(
    "F09_month_filter",
    f"""WITH {RECEIPTS_SQL} SELECT order_id, receipt_no, amount FROM receipts WHERE strftime(unified_date, '%Y-%m') = '1997-05'""",
)
def month_filter(t):
    return in_month(t.receipts("order_id", "receipt_no", "amount", "unified_date"), "1997-05").drop("unified_date")


@query(
    "F10_excluded_row_predicate",
    f"""WITH {RECEIPTS_SQL} SELECT receipt_type, pay_method, (receipt_type = '掛賬核銷' OR pay_method = 'TT 退款轉團款') AS is_excluded, count(*) AS receipts
FROM receipts GROUP BY 1, 2, 3""",
)
def excluded_predicate(t):
    rows = t.receipts("receipt_type", "pay_method")
    return rows.groupBy("receipt_type", "pay_method", scope.is_excluded_receipt(rows).alias("is_excluded")).agg(
        F.count(F.lit(1)).alias("receipts")
    )


@query(
    "F13_exclude_listed_orders",
    f"""WITH {RECEIPTS_SQL}, listed AS (SELECT DISTINCT lpad(CAST(k % 30 AS VARCHAR), 2, '0') || CAST(k % 7 AS VARCHAR) || '-' || CAST(k AS VARCHAR) AS order_id
 FROM (SELECT o_custkey * 11 AS k FROM orders))
SELECT 'kept' AS part, count(*) AS n, round(sum(amount), 2) AS amount FROM receipts WHERE order_id NOT IN (SELECT order_id FROM listed)
UNION ALL SELECT 'excluded', count(*), round(sum(amount), 2) FROM receipts WHERE order_id IN (SELECT order_id FROM listed)
UNION ALL SELECT 'matched', count(*), NULL FROM listed WHERE order_id IN (SELECT order_id FROM receipts)
UNION ALL SELECT 'unmatched', count(*), NULL FROM listed WHERE order_id NOT IN (SELECT order_id FROM receipts)""",
)
def exclude_listed(t):
    from tallyspark.suite.base import order_code

    listed = t.orders.select(order_code(F.col("o_custkey") * 11).alias("order_id")).distinct()
    parts = scope.exclude_listed(t.receipts("order_id", "amount"), listed)
    size = lambda df, name: df.agg(
        F.lit(name).alias("part"),
        F.count(F.lit(1)).alias("n"),
        (F.round(F.sum("amount"), 2) if "amount" in df.columns else F.lit(None).cast("double")).alias("amount"),
    )
    out = size(parts["kept"], "kept")
    for name in ("excluded", "matched", "unmatched"):
        out = out.unionByName(size(parts[name], name))
    return out


@query(
    "F20_choice_lists",
    f"""WITH {RECEIPTS_SQL} SELECT 'branch' AS field, branch AS value FROM receipts GROUP BY 2
UNION ALL SELECT 'salesperson', salesperson FROM receipts GROUP BY 2 UNION ALL SELECT 'pay_method', pay_method FROM receipts GROUP BY 2""",
)
def choice_lists(t):
    rows = t.receipts("branch", "salesperson", "pay_method")
    out = None
    for field in ("branch", "salesperson", "pay_method"):
        part = options(rows, field).select(F.lit(field).alias("field"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "F20_date_context",
    f"""WITH {RECEIPTS_SQL} SELECT count(*) FILTER (is_tour) AS tour_rows, count(*) FILTER (NOT is_tour) AS others_rows,
 min(unified_date)::VARCHAR AS min_date, max(unified_date)::VARCHAR AS max_date,
 (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT strftime(unified_date, '%Y') AS y FROM receipts)) AS years,
 (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT strftime(unified_date, '%Y-%m') AS m FROM receipts)) AS months FROM receipts""",
)
def date_bounds(t):
    return date_context(t.receipts("unified_date", "is_tour"))
