"""Store, diff, gate, quality and exclusion checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.keys import attach_one_row
from tallyspark.operators import diff, exclusions, gates, quality, scope
from tallyspark.plans import preflight
from tallyspark.session import written
from tallyspark.sources import store
from tallyspark.suite.base import DESK, RECEIPTS_SQL, query, rounded, texted
from tallyspark.suite.cleaning import KIND_SQL, _SHIFT_SQL, shifted_sheet
from tallyspark.suite.mart import FACTS_SQL, _BOTH, _TOTAL, _facts

# live = everything shipped before 1999 or of an even order; upload = all of 1998 and later, with a price change
_LIVE = "unified_date < DATE '1999-01-01' OR order_key % 2 = 0"
_UPLOAD_SQL = f"""{RECEIPTS_SQL}, live AS (SELECT * FROM receipts WHERE {_LIVE}), incoming AS (SELECT * REPLACE (CASE WHEN order_key % 5 = 0 THEN amount + 100 ELSE amount END AS amount) FROM receipts WHERE unified_date >= DATE '1998-01-01'),
merged AS (SELECT * FROM live WHERE order_id NOT IN (SELECT order_id FROM incoming) UNION ALL SELECT * FROM incoming)"""
_ROLES = ("order_id", "order_key", "receipt_no", "receipt_time", "unified_date", "amount", "receipt_type", "pay_method", "branch", "sub_branch", "salesperson")


def _day(text):
    return F.lit(text).cast("date")


def _upload(t, *roles):
    rows = t.receipts(*(roles or _ROLES))
    live = rows.where((F.col("unified_date") < _day("1999-01-01")) | (F.col("order_key") % 2 == 0))
    incoming = rows.where(F.col("unified_date") >= _day("1998-01-01"))
    return live, incoming.withColumn("amount", F.when(F.col("order_key") % 5 == 0, F.col("amount") + 100).otherwise(F.col("amount")))


_STORE = ("order_id", "order_key", "receipt_no", "receipt_time", "unified_date", "amount")


@query("S07_upsert", f"WITH {_UPLOAD_SQL} SELECT order_id, count(*) AS rows, round(sum(amount), 2) AS amount FROM merged GROUP BY 1")
def s07(t):
    live, incoming = _upload(t, *_STORE)
    out = store.upsert(live, incoming)
    return rounded(out.groupBy("order_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")), 2)


@query("S07_upsert_twice_is_once", f"WITH {_UPLOAD_SQL} SELECT count(*) AS rows, round(sum(amount), 2) AS amount FROM merged")
def s07_idempotent(t):
    live, incoming = _upload(t, *_STORE)
    out = store.upsert(store.upsert(live, incoming), incoming)
    return rounded(out.agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")), 2)


@query(
    "S07_upsert_pair",
    f"""WITH {_UPLOAD_SQL}, moved AS (SELECT *, order_key % 3 = 0 AS to_tour FROM incoming), ids AS (SELECT DISTINCT order_id FROM incoming)
SELECT 'tour_data' AS table_name, (SELECT count(*) FROM live WHERE order_key % 2 = 0 AND order_id NOT IN (FROM ids)) + (SELECT count(*) FROM moved WHERE to_tour) AS rows
UNION ALL SELECT 'others_data', (SELECT count(*) FROM live WHERE order_key % 2 = 1 AND order_id NOT IN (FROM ids)) + (SELECT count(*) FROM moved WHERE NOT to_tour)""",
)
def s07_pair(t):
    live, incoming = _upload(t, *_STORE)
    key = F.col("order_key")
    merged = store.upsert_pair(
        {"tour_data": live.where(key % 2 == 0), "others_data": live.where(key % 2 == 1)}, {"tour_data": incoming.where(key % 3 == 0), "others_data": incoming.where(key % 3 != 0)}
    )
    a, b = (merged[n].agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("rows")) for n in store.DETAIL_TABLES)
    return a.unionByName(b)


@query("S06_append_merges_columns", f"WITH {_UPLOAD_SQL} SELECT count(*) AS rows, (SELECT count(*) FROM incoming) AS with_new_column FROM (FROM live UNION ALL FROM incoming)")
def s06(t):
    live, incoming = _upload(t, *_STORE)
    both = store.append_compatible(live, incoming.withColumn("batch", F.lit("b1")))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count("batch").alias("with_new_column"))


@query("S08_delete_keys", f"WITH {_UPLOAD_SQL} SELECT count(*) AS rows, round(sum(amount), 2) AS amount FROM live WHERE order_id NOT IN (SELECT order_id FROM incoming)")
def s08(t):
    live, incoming = _upload(t, *_STORE)
    return rounded(store.delete_keys(live, store.key_set(incoming)).agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount")), 2)


@query("S09_overlapping_keys", f"WITH {_UPLOAD_SQL} SELECT count(DISTINCT order_id) AS overlap_order_ids, count(*) AS deleted_rows FROM live WHERE order_id IN (SELECT order_id FROM incoming)")
def s09(t):
    live, incoming = _upload(t, *_STORE)
    return store.overlap_stats(live, store.key_set(incoming))


@query("S10_table_stats", f"WITH {_UPLOAD_SQL} SELECT count(*) AS rows, max(receipt_time)::DATE::VARCHAR AS max_date, round(sum(amount), 2) AS amount FROM live")
def s10(t):
    row = store.table_stats(_upload(t, *_STORE)[0])
    return rounded(row.withColumn("max_date", F.date_format("max_date", "yyyy-MM-dd")), 2)


@query("S11_receipt_numbers", f"WITH {_UPLOAD_SQL} SELECT DISTINCT receipt_no FROM live")
def s11(t):
    return store.receipt_numbers(_upload(t, *_STORE)[0])


@query(
    "C31_upsert_summary",
    f"""WITH {_UPLOAD_SQL}, good AS (SELECT * FROM incoming WHERE order_key % 7 <> 0) SELECT 'receipts' AS table_name, (SELECT count(*) FROM live) AS before_rows, (SELECT count(*) FROM live WHERE order_id NOT IN (SELECT order_id FROM good)) + (SELECT count(*) FROM good) AS after_rows,
 (SELECT max(unified_date)::VARCHAR FROM live) AS before_max_date, (SELECT max(unified_date)::VARCHAR FROM (SELECT unified_date FROM live WHERE order_id NOT IN (SELECT order_id FROM good) UNION ALL SELECT unified_date FROM good)) AS after_max_date,
 (SELECT count(*) FROM incoming) AS input_rows, (SELECT count(*) FROM incoming) - (SELECT count(*) FROM good) AS filtered_rows, (SELECT count(*) FROM good) AS write_rows,
 (SELECT count(DISTINCT order_id) FROM live WHERE order_id IN (SELECT order_id FROM good)) AS overlap_order_ids, (SELECT count(*) FROM live WHERE order_id IN (SELECT order_id FROM good)) AS deleted_rows, (SELECT count(*) FROM good) AS inserted_rows""",
)
def c31(t):
    live, incoming = _upload(t, *_STORE)
    row = store.upsert_summary(live, incoming, incoming.where(F.col("order_key") % 7 != 0), "receipts")
    return row.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("before_max_date", "after_max_date")})


# --- diffs ---------------------------------------------------------------------------------------------------


@query(
    "U07_snapshot_diff",
    f"""WITH {_UPLOAD_SQL}, l AS (SELECT order_id, list_sort(list(receipt_no || '|' || printf('%.2f', amount))) AS c, count(*) AS n FROM live GROUP BY 1), r AS (SELECT order_id, list_sort(list(receipt_no || '|' || printf('%.2f', amount))) AS c, count(*) AS n FROM merged GROUP BY 1)
SELECT order_id, CASE WHEN l.n IS NULL THEN 'added' WHEN r.n IS NULL THEN 'removed' WHEN l.c <> r.c THEN 'changed' ELSE 'unchanged' END AS change_type, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows FROM l FULL JOIN r USING (order_id)""",
)
def u07(t):
    live, incoming = _upload(t, *_STORE)
    text = [F.col("order_id"), F.col("receipt_no"), F.format_string("%.2f", "amount").alias("amount")]
    return diff.snapshot_diff(live.select(*text), store.upsert(live, incoming).select(*text), ["order_id"])


_DRIFT = ("order_id", "order_key", "receipt_no", "unified_date", "amount", "receipt_type", "pay_method", "branch", "sub_branch", "salesperson")
_BAD = "receipt_type = '掛賬核銷' OR pay_method = 'TT 退款轉團款'"
_ORDERS_SQL = f"""{_UPLOAD_SQL}, sides AS (SELECT *, true AS is_live FROM live UNION ALL SELECT *, false FROM merged),
o AS (SELECT order_id, coalesce(sum(amount) FILTER (is_live), 0.0) AS ls, coalesce(sum(amount) FILTER (NOT is_live), 0.0) AS cs, count(*) FILTER (is_live) AS live_rows, count(*) FILTER (NOT is_live) AS candidate_rows,
 coalesce(bool_or({_BAD}) FILTER (is_live), false) AS live_excluded, coalesce(bool_or({_BAD}) FILTER (NOT is_live), false) AS candidate_excluded FROM sides GROUP BY 1),
d AS (SELECT *, CASE WHEN live_excluded THEN 0.0 ELSE ls END AS lc, CASE WHEN candidate_excluded THEN 0.0 ELSE cs END AS cc FROM o), m AS (SELECT *, round(cc - lc, 2) AS delta FROM d WHERE abs(round(cc - lc, 2)) >= 1 OR live_excluded <> candidate_excluded)"""


def _drift_sides(t):
    live, incoming = _upload(t, *_DRIFT)
    return live.drop("order_key"), store.upsert(live, incoming).drop("order_key")


@query(
    "J19_order_drift",
    f"""WITH {_ORDERS_SQL} SELECT order_id, round(lc, 2) AS live_contribution, round(cc, 2) AS candidate_contribution, delta AS delta_amount, live_rows, candidate_rows, live_excluded, candidate_excluded,
 CASE WHEN candidate_excluded AND NOT live_excluded THEN '新增排除明細，觸發整個來源單據號被正式口徑排除' WHEN live_excluded AND NOT candidate_excluded THEN '排除明細被移除，來源單據號回補' WHEN live_rows <> candidate_rows THEN '來源單據號筆數變動' ELSE '來源單據號明細變動' END AS reason FROM m""",
)
def j19(t):
    live, candidate = _drift_sides(t)
    out = diff.order_diffs(diff.drift_frame(live), diff.drift_frame(candidate), 100.0)
    return rounded(out.drop("trigger_receipt_no", "explains_delta"), 2)


@query(
    "J18_receipt_drift",
    f"""WITH {_ORDERS_SQL}, k AS (SELECT 'receipt::' || receipt_no AS row_key, coalesce(sum(amount) FILTER (is_live), 0.0) AS la, coalesce(sum(amount) FILTER (NOT is_live), 0.0) AS ca, count(*) FILTER (is_live) AS live_rows, count(*) FILTER (NOT is_live) AS candidate_rows
 FROM sides WHERE order_id IN (SELECT order_id FROM m) GROUP BY 1) SELECT row_key, round(la, 2) AS live_amount, round(ca, 2) AS candidate_amount, round(ca - la, 2) AS amount_delta, live_rows, candidate_rows,
 CASE WHEN candidate_rows = 0 THEN 'left_only' WHEN live_rows = 0 THEN 'right_only' ELSE 'both' END AS row_state FROM k WHERE live_rows = 0 OR candidate_rows = 0 OR abs(round(ca - la, 2)) >= 1""",
)
def j18(t):
    live, candidate = (diff.drift_frame(f) for f in _drift_sides(t))
    out = diff.receipt_diffs(live, candidate, diff.order_diffs(live, candidate, 100.0))
    return rounded(out.select("row_key", "live_amount", "candidate_amount", "amount_delta", "live_rows", "candidate_rows", "row_state"), 2)


_TOLD = ", ".join(f"coalesce({c}, '')" for c in ("order_id", "order_id", "receipt_type", "pay_method", "branch", "sub_branch", "salesperson"))


@query(
    "J18_receipt_pairs",
    f"""WITH {_ORDERS_SQL}, k AS (SELECT 'receipt::' || order_id AS row_key, round(amount, 2) AS amount, md5(concat_ws('|', {_TOLD}, strftime(unified_date, '%Y-%m-%d'), printf('%.2f', amount))) AS print, is_live FROM sides WHERE order_id IN (SELECT order_id FROM m)),
n AS (SELECT row_key, print, amount, sum(CASE WHEN is_live THEN 1 ELSE -1 END) AS n FROM k GROUP BY 1, 2, 3 HAVING n <> 0), e AS (SELECT row_key, print, amount, n > 0 AS is_live, unnest(range(abs(n)::BIGINT)) AS copy FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY row_key, is_live ORDER BY print, copy) AS ordinal FROM e), a AS (SELECT * FROM r WHERE is_live), b AS (SELECT * FROM r WHERE NOT is_live)
SELECT row_key, ordinal, coalesce(a.amount, 0.0) AS live_amount, coalesce(b.amount, 0.0) AS candidate_amount, round(coalesce(b.amount, 0.0) - coalesce(a.amount, 0.0), 2) AS amount_delta, CASE WHEN b.print IS NULL THEN 'left_only' WHEN a.print IS NULL THEN 'right_only' ELSE 'both' END AS row_state FROM a FULL JOIN b USING (row_key, ordinal)""",
)
def j18_pairs(t):
    """Every receipt bears the number of its order, so that keys repeat."""
    live, candidate = (diff.drift_frame(f) for f in _drift_sides(t))
    orders = diff.order_diffs(live, candidate, 100.0)
    shared = [f.withColumn("receipt_no", F.col("order_id")) for f in (live, candidate)]
    out = diff.receipt_pairs(*shared, orders)
    return rounded(out.select("row_key", "ordinal", "live_amount", "candidate_amount", "amount_delta", "row_state"), 2)


@query("J20_candidate_rows", f"WITH {_ORDERS_SQL} SELECT count(*) FILTER (is_live) AS live_rows, count(*) FILTER (NOT is_live) AS candidate_rows FROM sides WHERE order_id IN (SELECT order_id FROM m)")
def j20(t):
    live, candidate = (diff.drift_frame(f) for f in _drift_sides(t))
    wanted = diff.order_diffs(live, candidate, 100.0).select("order_id")
    a = live.join(wanted, "order_id", "left_semi").agg(F.count(F.lit(1)).alias("live_rows"))
    return attach_one_row(a, candidate.join(wanted, "order_id", "left_semi").agg(F.count(F.lit(1)).alias("candidate_rows")))


@query(
    "K04_driver_rows",
    f"""WITH {RECEIPTS_SQL} SELECT order_id, bool_or({_BAD}) AS is_excluded, round(coalesce(max(amount) FILTER ({_BAD}), max(amount)), 2) AS amount FROM receipts GROUP BY 1""",
)
def k04(t):
    rows = diff.drift_frame(t.receipts(*[r for r in _DRIFT if r != "order_key"]))
    best = diff.driver_row(rows)
    return rounded(best.select("order_id", scope.is_excluded_receipt(best).alias("is_excluded"), "amount"), 2)


@query("K05_largest_order_drift", f"WITH {_ORDERS_SQL} SELECT order_id, delta AS delta_amount, abs(delta - 100) < 1 AS explains_delta FROM m ORDER BY explains_delta DESC, abs(delta) DESC, order_id")
def k05(t):
    live, candidate = (diff.drift_frame(f) for f in _drift_sides(t))
    return diff.largest_order_diffs(diff.order_diffs(live, candidate, 100.0)).select("order_id", "delta_amount", "explains_delta")


@query(
    "C14_drift_diagnosis",
    f"""WITH {_ORDERS_SQL}, top AS (SELECT * FROM m), r AS (SELECT t.order_id, t.delta, s.amount, s.receipt_no, ({_BAD}) AS bad, s.is_live, bool_or(NOT s.is_live) OVER (PARTITION BY t.order_id) AS has_new FROM top t JOIN sides s USING (order_id))
SELECT order_id, delta AS delta_amount, round(coalesce(max(amount) FILTER (bad), max(amount)), 2) AS amount FROM r WHERE NOT has_new OR NOT is_live GROUP BY 1, 2""",
)
def c14(t):
    live, candidate = _drift_sides(t)
    found = diff.drift_diagnosis(live, candidate, {"status": "drift", "delta_amount": 100.0})
    return rounded(found["top_drivers"].select("order_id", "delta_amount", "amount"), 2)


# --- gates ---------------------------------------------------------------------------------------------------

_MONTHLY_SQL = f"""{FACTS_SQL}, {_BOTH}, monthly AS (SELECT strftime(day, '%Y-%m') AS month, sum(CASE WHEN channel = 'branch' THEN {_TOTAL} ELSE 0 END) AS b, sum(CASE WHEN channel = 'specialist' THEN {_TOTAL} ELSE 0 END) AS s FROM facts GROUP BY 1),
registry AS (SELECT month, round(b + s, 2) + CASE WHEN month LIKE '1997%' THEN 500 ELSE 0 END AS expected, CASE WHEN month < '1998' THEN 'blocking' ELSE 'monitoring' END AS mode, month = '1996-05' AS legacy FROM monthly WHERE month >= '1996')"""


def _registry(monthly):
    bump = F.when(F.col("month").startswith("1997"), F.lit(500.0)).otherwise(F.lit(0.0))
    return monthly.where(F.col("month") >= "1996").select(
        "month", (F.round("combined_revenue", 2) + bump).alias("expected_total"), F.when(F.col("month") < "1998", F.lit("blocking")).otherwise(F.lit("monitoring")).alias("mode"),
        (F.col("month") == "1996-05").alias("legacy_core"), F.lit(1.0).alias("tolerance"), F.lit(scope.SCOPE_LABEL).alias("scope"), F.lit("v1").alias("version"),
    )


def _evaluation(t):
    from tallyspark.operators.dashboards import monthly_trend

    monthly = monthly_trend(_facts(t))
    return gates.evaluate_baselines(gates.check_baselines(_registry(monthly)), monthly)


@query(
    "J27_baselines_against_actuals",
    f"""WITH {_MONTHLY_SQL} SELECT 'monthlyRevenue:' || month AS check_key, month, mode, legacy AS legacy_core, round(expected, 2) AS expected_total, round(b + s, 2) AS actual_total, round(b, 2) AS branch_revenue, round(s, 2) AS specialist_revenue,
 round(b + s - expected, 2) AS delta_amount, CASE WHEN abs(b + s - expected) < 1 THEN 'matched' ELSE 'drift' END AS status FROM registry JOIN monthly USING (month)""",
)
def j27(t):
    return rounded(_evaluation(t), 2)


@query(
    "C12_baseline_evaluation",
    f"""WITH {_MONTHLY_SQL}, e AS (SELECT mode, abs(b + s - expected) < 1 AS ok FROM registry JOIN monthly USING (month)) SELECT count(*) FILTER (ok) AS matched_count, count(*) AS total_checks, bool_and(ok) AS all_matched,
 CASE WHEN bool_and(ok) FILTER (mode = 'blocking') THEN 'matched' ELSE 'drift' END AS blocking_status, bool_and(mode = 'blocking') AS all_blocking FROM e""",
)
def c12(t):
    return gates.evaluation_summary(_evaluation(t))


def _gate(t, wrong=0.0):
    from tallyspark.operators.dashboards import revenue_totals
    from tallyspark.operators.filters import Period

    totals = revenue_totals(_facts(t), Period(months=("1996-05",)))
    rows = t.receipts("order_id", "amount", "receipt_type", "pay_method", "unified_date")
    fresh = scope.freshness(scope.official_rows(rows), scope.scope_audit(rows))
    # the expectation is the sum itself plus ``wrong``; the freshness marks are stale on purpose
    expected = attach_one_row(totals, totals.select(F.lit(wrong).alias("w")))
    baseline = gates.CoreBaseline("1996-05", 0.0, "1990-01-01", 1, 1)
    shifted = expected.withColumn("combined_revenue", F.col("w"))
    return gates.stability_checks(shifted, fresh, baseline)


@query(
    "C11_stability_checks",
    """SELECT * FROM (VALUES ('core', 'combined_revenue', 'matched'), ('core', 'revenue_scope', 'matched'), ('freshness', 'max_date', 'updated'), ('freshness', 'analysis_rows', 'updated'), ('freshness', 'excluded_rows', 'updated')) AS v(check_group, check_key, status) WHERE (SELECT count(*) FROM lineitem) > 0""",
)
def c11(t):
    return _gate(t).select("check_group", "check_key", "status")


@query(
    "C32_governed_gate",
    f"""WITH {_MONTHLY_SQL}, e AS (SELECT abs(b + s - expected) < 1 AS ok FROM registry JOIN monthly USING (month) WHERE mode = 'blocking' AND NOT legacy) SELECT CASE WHEN bool_and(ok) THEN 'matched' ELSE 'drift' END AS status, 2 + count(*) AS total_checks,
 2 + count(*) FILTER (ok) AS matched_checks, count(*) FILTER (NOT ok) AS drift_check_count, 'updated' AS freshness_status, 3 AS freshness_update_count FROM e""",
)
def c32(t):
    return gates.gate_summary(gates.governed_checks(_gate(t), _evaluation(t)))


@query(
    "C13_promotion_readiness",
    f"""WITH {_MONTHLY_SQL}, e AS (SELECT mode, abs(b + s - expected) < 1 AS ok FROM registry JOIN monthly USING (month)) SELECT 'drift' AS status, 0 AS stable_cycles, false AS promotion_ready, CAST(NULL AS BIGINT) AS eligible_record_id, count(*) FILTER (ok) AS matched_count, count(*) AS total_checks,
 CASE WHEN bool_and(ok) FILTER (mode = 'blocking') THEN 'matched' ELSE 'drift' END AS blocking_status FROM e""",
)
def c13(t):
    history = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.lit("accepted")).otherwise(F.lit("rejected")).alias("upload_status"), F.lit("not_required").alias("rollback_status"),
        F.lit("v1").alias("registry_version"), F.lit(True).alias("all_matched"),
    )
    return gates.baseline_governance(gates.evaluation_summary(_evaluation(t)), history, 1, "v1")


@query(
    "S28_latest_history",
    """SELECT o_orderkey AS id, 'matched' AS status, o_orderstatus AS core_status FROM orders ORDER BY o_orderkey DESC LIMIT 20""",
)
def s28(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("core_status"), F.lit('{"status": "matched", "checks": 3}').alias("gate_json"))
    return store.latest_history(rows, 20, {"gate_json": "status string"}).select("id", F.col("gate.status").alias("status"), "core_status")


# --- quality -------------------------------------------------------------------------------------------------

_QUALITY = ("order_id", "receipt_time", "amount", "branch", "salesperson", "trans_time", "source_tag", "receipt_type", "pay_method", "part_key")


def _quality_rows(t):
    rows = t.receipts(*_QUALITY)
    k = F.col("part_key")
    # a few zero and negative amounts, blank branches and missing times
    return rows.withColumns(
        {
            "amount": F.when(k % 97 == 0, F.lit(0.0)).when(k % 89 == 0, -F.col("amount")).otherwise(F.col("amount")),
            "branch": F.when(k % 83 == 0, F.lit(" ")).otherwise(F.col("branch")),
            "receipt_time": F.when(k % 79 != 0, F.col("receipt_time")),
        }
    ).drop("part_key")


_Q = f"""{RECEIPTS_SQL}, q AS (SELECT order_id, CASE WHEN part_key % 79 <> 0 THEN receipt_time END AS receipt_time, CASE WHEN part_key % 97 = 0 THEN 0.0 WHEN part_key % 89 = 0 THEN -amount ELSE amount END AS amount,
 CASE WHEN part_key % 83 = 0 THEN ' ' ELSE branch END AS branch, salesperson, trans_time, source_tag, receipt_type, pay_method FROM receipts),
dates AS (SELECT count(*) AS total, count(*) FILTER (receipt_time IS NULL) AS invalid, count(DISTINCT receipt_time::DATE) AS days, date_diff('day', min(receipt_time::DATE), max(receipt_time::DATE)) + 1 AS span FROM q),
date_score AS (SELECT round(100 - invalid / total * 80 - (span - days) / span * 20, 2) AS s FROM dates),
fields AS (SELECT count(*) AS total, unnest(['order_id', 'receipt_time', 'amount', 'branch', 'salesperson', 'trans_time', 'source_tag']) AS field, unnest([count(*), count(receipt_time), count(*), count(*) FILTER (trim(branch) <> ''), count(*), count(trans_time), count(*)]) AS complete_rows FROM q),
field_score AS (SELECT round(avg(complete_rows / total * 100), 2) AS s FROM fields),
keys AS (SELECT order_id, count(*) AS n FROM q GROUP BY 1), ent AS (SELECT (SELECT sum(n) FROM keys WHERE n > 1) AS dup, count(*) AS total, count(*) FILTER (source_tag = '未匹配') AS un, coalesce(sum(amount) FILTER (source_tag = '未匹配'), 0.0) AS ua, sum(amount) AS a FROM q),
ent_score AS (SELECT round(100 - un / total * 60 - dup / total * 40, 2) AS s FROM ent),
poison AS (SELECT DISTINCT order_id FROM q WHERE receipt_type = '掛賬核銷' OR pay_method = 'TT 退款轉團款'), sc AS (SELECT sum(amount) AS raw, coalesce(sum(amount) FILTER (order_id IN (SELECT order_id FROM poison)), 0.0) AS ex FROM q),
sc_score AS (SELECT round(100 - least(ex / raw / 0.25, 1.0) * 20, 2) AS s FROM sc),
ranked AS (SELECT abs(amount) AS v, row_number() OVER (ORDER BY abs(amount) DESC) AS rn, count(*) OVER () AS n FROM q), am AS (SELECT count(*) AS total, count(*) FILTER (amount = 0) AS z, count(*) FILTER (amount < 0) AS neg, sum(amount) AS a FROM q),
top AS (SELECT sum(v) FILTER (rn <= greatest(1, floor(n * 0.05))) AS t5, sum(v) AS whole, max(greatest(1, floor(n * 0.05))) AS k FROM ranked),
am_score AS (SELECT round(100 - (z + neg) / total * 40 - greatest(0, t5 / whole - 0.6) / 0.4 * 10, 2) AS s, round(100 - (z + neg) / total * 40, 2) AS s2 FROM am, top)"""


def _audit(t):
    return scope.scope_audit(_quality_rows(t))


def _dimension_sql(amount: str) -> str:
    return f"""SELECT 'Date Coverage' AS dimension, s AS score FROM date_score UNION ALL SELECT 'Field Completeness', s FROM field_score UNION ALL SELECT 'Entity Resolution', s FROM ent_score UNION ALL SELECT 'Official Scope Health', s FROM sc_score UNION ALL SELECT 'Amount Health', {amount} FROM am_score"""


@query("C07_quality_scorecard", f"WITH {_Q}, d AS ({_dimension_sql('s')}) SELECT dimension, score, CASE WHEN score >= 90 THEN '優秀' WHEN score >= 75 THEN '可接受' WHEN score >= 60 THEN '需關注' ELSE '需處理' END AS health FROM d")
def c07(t):
    return quality.scorecard(_quality_rows(t), _audit(t))["dimensions"].drop("metric")


@query("C08_quality_service", f"WITH {_Q}, d AS ({_dimension_sql('s2')}), o AS (SELECT round(avg(score), 2) AS v FROM d) SELECT v AS overall_score, CASE WHEN v >= 90 THEN '優秀' WHEN v >= 75 THEN '可接受' WHEN v >= 60 THEN '需關注' ELSE '需處理' END AS overall_health FROM o")
def c08(t):
    return quality.scorecard(_quality_rows(t), _audit(t), concentration=False)["overall"]


@query(
    "A38_quality_parts",
    f"""WITH {_Q} SELECT invalid AS invalid_rows, span - days AS missing_days, dup::BIGINT AS duplicate_rows, un AS unmatched_rows, round(ua, 2) AS unmatched_amount, z AS zero_rows, neg AS negative_rows, k::BIGINT AS top5_rows, round(t5, 2) AS top5_amount FROM dates, ent, am, top""",
)
def a38(t):
    rows = _quality_rows(t)
    row = quality.date_coverage(rows).select("invalid_rows", "missing_days")
    row = attach_one_row(row, quality.entity_health(rows).select("duplicate_rows", "unmatched_rows", "unmatched_amount"))
    row = attach_one_row(row, quality.amount_health(rows).select("zero_rows", "negative_rows", "top5_rows", "top5_amount"))
    return rounded(row, 2)


@query("K09_top_five_percent", f"WITH {_Q} SELECT k::BIGINT AS top_rows, round(t5, 2) AS top_sum, round(whole, 2) AS all_sum, total AS all_rows FROM top, am")
def k09(t):
    from tallyspark.functions.quantile import top_share_sum

    rows = _quality_rows(t).select(F.abs("amount").alias("v"))
    return rounded(top_share_sum(rows, "v", 0.05, lambda n: F.greatest(F.lit(1), F.floor(n * 0.05))), 2)


@query("A38_field_completeness", f"WITH {_Q} SELECT field, 'evaluated' AS status, complete_rows, total AS total_rows, round(complete_rows / total, 6) AS complete_rate FROM fields")
def field_completeness(t):
    return rounded(quality.field_completeness(_quality_rows(t)), 6)


@query("U04_missing_days", f"WITH {RECEIPTS_SQL}, s AS (SELECT branch, salesperson, unnest(generate_series(min(unified_date), max(unified_date), INTERVAL 1 DAY))::DATE AS d FROM receipts GROUP BY 1, 2) SELECT branch, salesperson, d::VARCHAR AS day FROM s ANTI JOIN receipts r ON r.branch = s.branch AND r.salesperson = s.salesperson AND r.unified_date = s.d")
def u04(t):
    """Days without a receipt, of every seller of every branch."""
    who = ["branch", "salesperson"]
    days = t.receipts(*who, "unified_date").distinct()
    span = days.groupBy(*who).agg(F.min("unified_date").alias("a"), F.max("unified_date").alias("b")).select(*who, F.explode(F.sequence("a", "b")).alias("unified_date"))
    return texted(span.join(days, [*who, "unified_date"], "left_anti").withColumnRenamed("unified_date", "day"))


# --- exclusions ----------------------------------------------------------------------------------------------

# rules: one per excluded receipt; every tenth of them names a wrong order, every eleventh a wrong kind
_RULES_SQL = f"""{_SHIFT_SQL}, typed AS (SELECT *, {KIND_SQL} AS kind, CASE WHEN moved THEN base_amount ELSE seen_amount END AS observed FROM sheet),
per AS (SELECT receipt_no, min(order_id) AS order_id, max(kind) AS kind, CAST(split_part(receipt_no, '-', 1) AS BIGINT) AS k FROM typed WHERE kind <> '' GROUP BY receipt_no),
rules AS (SELECT k AS id, receipt_no, CASE WHEN k % 10 = 0 THEN 'X' ELSE order_id END AS ro, CASE WHEN k % 11 = 0 THEN 'receipt_type:X' ELSE kind END AS rk FROM per),
v AS (SELECT t.*, r.id, CASE WHEN r.ro <> t.order_id THEN 'source_order_mismatch' WHEN r.rk <> t.kind THEN 'exclusion_kind_mismatch' ELSE 'match' END AS verdict FROM typed t JOIN rules r USING (receipt_no))"""


def _rules(t):
    rows = exclusions.with_identity(shifted_sheet(t)).where(F.col("_kind") != "")
    per = rows.groupBy(F.col("_receipt").alias("receipt_no")).agg(F.min("_order").alias("o"), F.max("_kind").alias("kk"))
    k = F.split("receipt_no", "-")[0].cast("long")
    per = per.withColumn("id", k)
    return per.select(
        "id", "receipt_no", F.when(F.col("id") % 10 == 0, F.lit("X")).otherwise(F.col("o")).alias("source_order_no"),
        F.when(F.col("id") % 11 == 0, F.lit("receipt_type:X")).otherwise(F.col("kk")).alias("exclusion_kind"), F.lit("active").alias("status"),
    )


@query("J17_rule_matches", f"WITH {_RULES_SQL} SELECT receipt_no, order_id AS source_order_no, kind AS exclusion_kind, round(observed, 2) AS observed_amount FROM v WHERE verdict = 'match'")
def j17(t):
    found = exclusions.match_rules(shifted_sheet(t), _rules(t))
    return rounded(found["matches"].drop("row_hash", "registry_id"), 2)


@query("J17_rule_collisions", f"WITH {_RULES_SQL}, total AS (SELECT count(*) AS n FROM sheet) SELECT verdict AS reason, count(*) AS n FROM v WHERE verdict <> 'match' GROUP BY 1 UNION ALL SELECT 'kept', (SELECT n FROM total) - (SELECT count(*) FROM v WHERE verdict = 'match')")
def j17_collisions(t):
    found = exclusions.match_rules(shifted_sheet(t), _rules(t))
    kept = found["kept"].agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"))
    return found["collisions"].groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(kept)


# registry facts: one rule per excluded receipt, three events each, every seventh rule revoked
_REG_SQL = f"""{RECEIPTS_SQL}, ids AS (SELECT receipt_no, min(order_id) AS order_id, min(order_key) AS k FROM receipts WHERE receipt_type = '掛賬核銷' GROUP BY receipt_no)"""


def _registry_facts(t):
    rows = t.receipts("receipt_no", "order_id", "order_key", "receipt_type").where(F.col("receipt_type") == "掛賬核銷")
    ids = rows.groupBy("receipt_no").agg(F.min("order_id").alias("source_order_no"), F.min("order_key").alias("k"))
    ids = ids.withColumn("exclusion_kind", F.lit("receipt_type:掛賬核銷"))
    rules = ids.withColumn("id", exclusions.rule_id())
    kinds = F.explode(F.array(F.lit("activated"), F.lit("auto_applied"), F.lit("auto_applied"), F.when(F.col("k") % 7 == 0, F.lit("revoked"))))
    events = rules.select(F.col("id").alias("registry_id"), "k", kinds.alias("event_type")).where(F.col("event_type").isNotNull())
    return rules, events


@query("A42_registry_counts", f"WITH {_REG_SQL} SELECT count(*) FILTER (k % 7 <> 0) AS active, count(*) FILTER (k % 7 = 0) AS revoked FROM ids")
def a42(t):
    rules, events = _registry_facts(t)
    return exclusions.status_counts(exclusions.rule_states(rules, events))


@query("C36_exclusion_read_model", f"WITH {_REG_SQL} SELECT receipt_no, order_id AS source_order_no, 'revoked' AS status, 4 AS event_count FROM ids WHERE k % 7 = 0")
def c36(t):
    rules, events = _registry_facts(t)
    return exclusions.read_model(rules, events)["revoked"].select("receipt_no", "source_order_no", "status", "event_count")


@query("C18_registry_revision", f"WITH {_REG_SQL} SELECT count(*) FILTER (k % 7 <> 0) AS active_rules, true AS stable, true AS moves FROM ids")
def c18(t):
    rules, events = _registry_facts(t)
    one = exclusions.registry_revision(exclusions.rule_states(rules, events))
    again = exclusions.registry_revision(exclusions.rule_states(rules.repartition(5), events.repartition(3)))
    fewer = exclusions.registry_revision(exclusions.rule_states(rules.where(F.col("k") % 5 != 0), events))
    return one.select("active_rules", (F.col("revision") == again.select("revision").scalar()).alias("stable"), (F.col("revision") != fewer.select("revision").scalar()).alias("moves"))


@query(
    "C17_activation",
    f"""WITH {_REG_SQL} SELECT 'rules' AS part, count(*) FILTER (k % 2 = 1) AS n FROM ids UNION ALL SELECT 'already_active', count(*) FILTER (k % 2 = 0 AND k % 7 <> 0) FROM ids UNION ALL SELECT 'rejected_revoked', count(*) FILTER (k % 2 = 0 AND k % 7 = 0) FROM ids
UNION ALL SELECT 'events_again', 0""",
)
def c17(t):
    rules, events = _registry_facts(t)
    known = rules.where(F.col("k") % 2 == 0)
    states = exclusions.rule_states(known, events)
    evidence = {"target_table": "others_data", "raw_payload": "{}", "raw_row_hash": "a", "prepared_payload": "{}", "prepared_row_hash": "b"}
    candidates = rules.drop("id").withColumns({k: F.lit(v) for k, v in evidence.items()}).withColumns({"observed_amount": F.lit(1.0), "candidate_id": exclusions.candidate_id()})
    out = exclusions.activation(candidates, known, states, "op1", "me", "fp")
    again = exclusions.new_events(out["events"], out["events"])
    sizes = None
    for name, frame in (("rules", out["rules"]), ("already_active", out["already_active"]), ("rejected_revoked", out["rejected_revoked"]), ("events_again", again)):
        row = frame.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        sizes = row if sizes is None else sizes.unionByName(row)
    return sizes


@query("J30_first_evidence", f"WITH {_REG_SQL} SELECT receipt_no, 'first' AS operation_id FROM ids")
def j30(t):
    rules, _ = _registry_facts(t)
    rules = rules.withColumn("evidence_hash", F.sha2("receipt_no", 256))
    attempts = F.explode(F.array(F.struct(F.lit(2).alias("seq"), F.lit("second").alias("operation_id")), F.struct(F.lit(1).alias("seq"), F.lit("first").alias("operation_id"))))
    rows = rules.select(F.col("id").alias("registry_id"), "receipt_no", attempts.alias("q")).select("registry_id", "receipt_no", "q.*")
    return exclusions.first_evidence(rows, rules).select("receipt_no", "operation_id")


@query(
    "J31_proposal_evidence",
    f"""WITH {RECEIPTS_SQL}, ex AS (SELECT *, CASE WHEN receipt_type = '掛賬核銷' THEN 'receipt_type:掛賬核銷' WHEN pay_method = 'TT 退款轉團款' THEN 'payment_method:TT 退款轉團款' ELSE '' END AS kind FROM receipts), drv AS (SELECT DISTINCT order_id FROM ex WHERE kind <> '')
SELECT receipt_no, order_id AS source_order_no, kind AS exclusion_kind, count(*) = 1 AS is_unambiguous FROM ex WHERE kind <> '' AND order_id IN (SELECT order_id FROM drv) GROUP BY 1, 2, 3""",
)
def j31(t):
    rows = t.receipts("receipt_no", "order_id", "order_key", "amount", "receipt_type", "pay_method", "branch", "is_tour")
    drivers = rows.where(scope.is_excluded_receipt(rows)).withColumn("delta_amount", F.col("amount"))
    found = exclusions.proposal(drivers, rows.drop("is_tour"), rows)
    return found.select("receipt_no", "source_order_no", "exclusion_kind", "is_unambiguous")


@query("C16_exclusion_proposal", f"WITH {RECEIPTS_SQL}, ex AS (SELECT receipt_no, order_id, count(*) AS n FROM receipts WHERE receipt_type = '掛賬核銷' GROUP BY 1, 2) SELECT count(*) FILTER (n = 1) AS candidates, true AS stands, true AS has_print FROM ex")
def c16(t):
    rows = t.receipts("receipt_no", "order_id", "order_key", "amount", "receipt_type", "branch", "is_tour")
    drivers = rows.where(F.col("receipt_type") == "掛賬核銷").withColumn("delta_amount", F.col("amount"))
    found = exclusions.proposal(drivers, rows.drop("is_tour"), rows).where("is_unambiguous")
    out = exclusions.proposal_fingerprint(found, {"checkKey": "combined_revenue", "batch": "b1"})
    return out.select("candidates", "stands", (F.length("fingerprint") == 64).alias("has_print"))


_DRY_ROLES = ("order_id", "order_key", "receipt_no", "receipt_time", "unified_date", "amount", "receipt_type", "pay_method", "branch", "sub_branch", "salesperson", "is_tour")


def _expected(months):
    """Registry rows that expect the months as they are."""
    return months.select(
        "month", F.round("combined_revenue", 2).alias("expected_total"), F.lit("blocking").alias("mode"), F.lit(False).alias("legacy_core"),
        F.lit(1.0).alias("tolerance"), F.lit(scope.SCOPE_LABEL).alias("scope"), F.lit("v1").alias("version"),
    )


def _months_sql(rows):
    return f"SELECT strftime(unified_date, '%Y-%m') AS month, sum(amount) AS v FROM {rows} WHERE order_id NOT IN (SELECT order_id FROM {rows} WHERE {_BAD}) GROUP BY 1"


@query(
    "C15_upload_preflight",
    f"""WITH {_ORDERS_SQL}, l AS ({_months_sql("live")}), c AS ({_months_sql("merged")}), e AS (SELECT abs(coalesce(c.v, 0) - round(l.v, 2)) >= 1 AS off FROM l LEFT JOIN c USING (month)),
p AS (SELECT receipt_no, order_id, count(*) AS n FROM merged WHERE ({_BAD}) AND order_id IN (SELECT order_id FROM m) GROUP BY receipt_no, order_id, receipt_type = '掛賬核銷')
SELECT CASE WHEN (SELECT count(*) FILTER (off) FROM e) = 0 THEN 'ready' WHEN (SELECT bool_and(n = 1) FROM p) THEN 'proposal' ELSE 'blocked' END AS status, (SELECT count(*) FILTER (off) FROM e) AS drifting_months,
 (SELECT count(*) FROM m) AS drifting_orders, (SELECT count(*) FROM p) AS candidates, (SELECT count(*) FROM merged) AS rows""",
)
def c15(t):
    live, incoming = _upload(t, *_DRY_ROLES)
    # read by the registry, the upsert and the diagnosis
    live, incoming = written(live.drop("order_key")), written(incoming.drop("order_key"))
    found = preflight.upload_preflight(live, incoming, _expected(preflight.monthly_revenue(live, DESK)), DESK, {"batch": "b1"})
    row = attach_one_row(found["verdict"], found["candidate"].agg(F.count(F.lit(1)).alias("rows")))
    return row.select("status", "drifting_months", "drifting_orders", "candidates", "rows")


# every fifth quarantined receipt goes back; of those, every tenth as an ordinary one, which moves its month
_BACK_SQL = f"""{_REG_SQL}, chosen AS (SELECT receipt_no, k FROM ids WHERE k % 5 = 0), kept AS (SELECT order_id, receipt_no, unified_date, amount, receipt_type, pay_method FROM receipts WHERE receipt_no NOT IN (SELECT receipt_no FROM chosen)),
back AS (SELECT order_id, receipt_no, unified_date, amount, CASE WHEN k % 10 = 0 THEN 'XX' ELSE receipt_type END AS receipt_type, pay_method FROM receipts JOIN chosen USING (receipt_no)),
cand AS (SELECT * FROM kept WHERE order_id NOT IN (SELECT order_id FROM back) UNION ALL SELECT * FROM back)"""


@query(
    "C35_revocation_preview",
    f"""WITH {_BACK_SQL}, l AS ({_months_sql("kept")}), c AS ({_months_sql("cand")}), e AS (SELECT abs(coalesce(c.v, 0) - round(l.v, 2)) >= 1 AS off FROM l LEFT JOIN c USING (month))
SELECT (SELECT count(*) FROM cand) AS rows, count(*) FILTER (off) AS drifting_months, CASE WHEN count(*) FILTER (off) = 0 THEN 'ready' ELSE 'blocked' END AS status FROM e""",
)
def c35(t):
    """Quarantined receipts go back through the upsert, and the gate runs on the result."""
    rules, _ = _registry_facts(t)
    chosen = rules.where(F.col("k") % 5 == 0).select("receipt_no", "k")
    names = ("order_id", "receipt_no", "unified_date", "amount", "receipt_type", "pay_method", "branch")
    rows = t.receipts(*names)
    kept = written(rows.join(chosen, "receipt_no", "left_anti").select(*names))
    put = rows.join(chosen, "receipt_no").withColumn("receipt_type", F.when(F.col("k") % 10 == 0, F.lit("XX")).otherwise(F.col("receipt_type")))
    evidence = put.select(F.to_json(F.struct(*names)).alias("prepared_payload"), F.lit("others_data").alias("target_table"))
    schema = "order_id string, receipt_no string, unified_date date, amount double, receipt_type string, pay_method string, branch string"
    found = preflight.revocation_preflight(kept, evidence, schema, _expected(preflight.monthly_revenue(kept, DESK)), DESK)
    return found["verdict"].select("rows", "drifting_months", "status")

