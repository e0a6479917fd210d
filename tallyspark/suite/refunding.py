"""Refund and driver checks: returned lines are refund rows, some of them blemished."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import drivers, refunds
from tallyspark.session import cut_lineage
from tallyspark.suite.base import DESK, OFFICIAL_SQL, TIES, query, rounded, texted

_STATES: dict = {}
FILE_ORDER = ["part_key", "supplier_key", "line_no"]
_REFUND_ROLES = ("order_id", "order_key", "receipt_no", "line_no", "part_key", "supplier_key", "amount", "returnflag", "linestatus", "unified_date")

REFUND_SQL = f"""{OFFICIAL_SQL}, refunds AS (SELECT 'RF' || receipt_no AS refund_no, CASE WHEN part_key % 109 = 0 THEN '' WHEN line_no % 2 = 0 THEN order_id || '.0' ELSE order_id END AS order_id,
 CASE WHEN part_key % 101 = 0 THEN 'bad' WHEN part_key % 103 = 0 THEN '-5' WHEN order_key % 4 = 0 THEN CAST(round(CAST(amount AS DECIMAL(18,2)) * 3, 2) AS VARCHAR) ELSE CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) END AS refund_amount,
 CASE WHEN part_key % 107 = 0 THEN '' WHEN line_no % 2 = 1 THEN '已退款' WHEN part_key % 7 = 0 THEN '處理中' ELSE '待退款' END AS refund_status, unified_date::VARCHAR AS refund_date, 'HKD' AS currency, part_key, supplier_key, line_no, order_key
 FROM receipts WHERE returnflag = 'R'),
flagged AS (SELECT *, regexp_replace(order_id, '\\.0$', '') AS oid, TRY_CAST(refund_amount AS DOUBLE) AS amt FROM refunds), valid AS (SELECT * FROM flagged WHERE oid <> '' AND refund_status <> '' AND amt >= 0)"""


def refund_rows(t):
    rows = t.receipts(*_REFUND_ROLES).where(F.col("returnflag") == "R")
    p, amount = F.col("part_key"), F.col("amount").cast("decimal(18,2)")
    text = F.when(p % 101 == 0, F.lit("bad")).when(p % 103 == 0, F.lit("-5")).when(F.col("order_key") % 4 == 0, (amount * 3).cast("decimal(20,2)").cast("string")).otherwise(amount.cast("string"))
    return rows.select(
        F.concat(F.lit("RF"), "receipt_no").alias("refund_no"),
        F.when(p % 109 == 0, F.lit("")).when(F.col("line_no") % 2 == 0, F.concat("order_id", F.lit(".0"))).otherwise(F.col("order_id")).alias("order_id"),
        text.alias("refund_amount"),
        F.when(p % 107 == 0, F.lit("")).when(F.col("line_no") % 2 == 1, F.lit("已退款")).when(p % 7 == 0, F.lit("處理中")).otherwise(F.lit("待退款")).alias("refund_status"),
        F.date_format("unified_date", "yyyy-MM-dd").alias("refund_date"),
        F.lit("HKD").alias("currency"),
        "part_key",
        "supplier_key",
        "line_no",
        "order_key",
    )


@query(
    "F12_refund_file_metrics",
    f"""WITH {REFUND_SQL} SELECT count(*) AS rows, count(*) FILTER (oid <> '' AND refund_status <> '' AND amt >= 0) AS valid_rows, count(*) FILTER (oid = '') AS empty_source_rows, count(*) FILTER (oid <> '' AND refund_status = '') AS empty_status_rows,
 count(*) FILTER (amt IS NULL) AS invalid_amount_rows, count(*) FILTER (amt < 0) AS negative_amount_rows, count(*) FILTER (amt = 0) AS zero_amount_rows, (SELECT round(sum(amt), 2) FROM valid) AS refund_total, (SELECT count(DISTINCT oid) FROM valid) AS source_orders,
 (SELECT count(*) FROM valid) - (SELECT count(*) FROM (SELECT DISTINCT oid, amt, refund_status FROM valid)) AS duplicate_rows, 'ready' AS status FROM flagged""",
)
def f12(t):
    return rounded(refunds.refund_file_metrics(refund_rows(t).select("order_id", "refund_amount", "refund_status")), 2)


@query("S13_valid_refund_sheet", f"WITH {REFUND_SQL} SELECT refund_no, oid AS order_id, round(amt, 2) AS refund_amount, refund_status FROM valid")
def s13(t):
    return rounded(refunds.valid_refunds(refund_rows(t)).select("refund_no", "order_id", "refund_amount", "refund_status"), 2)


@query("A44_refund_statuses", f"WITH {REFUND_SQL} SELECT oid AS order_id, string_agg(DISTINCT refund_status, '、' ORDER BY refund_status) AS refund_status FROM valid GROUP BY 1")
def a44(t):
    raw = t.receipts("order_id", "amount", "branch", "salesperson", "is_tour", *[c for c in TIES if c != "amount"])
    index = refunds.match_index(raw, raw, list(TIES))
    return refunds.refund_exceptions(refund_rows(t).select("order_id", "refund_amount", "refund_status"), index, raw).select("order_id", "refund_status")


_INDEX_SQL = f"""{REFUND_SQL}, idx AS (SELECT order_id, sum(amount) AS raw_amount, arg_min(branch, ((NOT is_tour)::INT, receipt_time, receipt_no, part_key, supplier_key, amount)) AS raw_branch, CASE WHEN bool_and(is_tour) THEN '旅行團' WHEN bool_or(is_tour) THEN '其他業務、旅行團' ELSE '其他業務' END AS raw_tables FROM receipts GROUP BY 1),
fidx AS (SELECT order_id, sum(amount) AS formal_amount FROM official GROUP BY 1)"""
_INDEX_ROLES = ("order_id", "amount", "branch", "salesperson", "is_tour", "receipt_time", "receipt_no", "part_key", "supplier_key", "receipt_type", "pay_method")


def _index(t):
    raw, formal = t.receipts(*_INDEX_ROLES), t.official(*_INDEX_ROLES)
    return raw, formal, refunds.match_index(raw, formal, list(TIES))


@query("J14_match_index", f"WITH {_INDEX_SQL} SELECT order_id, round(raw_amount, 2) AS raw_amount, raw_branch, raw_tables, formal_amount IS NOT NULL AS formal_present, round(coalesce(formal_amount, 0.0), 2) AS formal_amount FROM idx LEFT JOIN fidx USING (order_id)")
def j14(t):
    _, _, index = _index(t)
    return rounded(index.select("order_id", "raw_amount", "raw_branch", "raw_tables", "formal_present", "formal_amount"), 2)


_EXC_SQL = f"""{_INDEX_SQL}, per AS (SELECT oid AS order_id, sum(amt) AS refund, string_agg(DISTINCT refund_status, '、' ORDER BY refund_status) AS st FROM valid GROUP BY 1),
dup AS (SELECT oid AS order_id, sum(c) AS copies FROM (SELECT oid, amt, refund_status, count(*) AS c FROM valid GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
x AS (SELECT p.*, i.raw_amount, f.formal_amount, coalesce(copies, 0) AS copies, CASE WHEN i.raw_amount > 0 THEN greatest(round(refund - i.raw_amount, 4), 0.0) ELSE 0.0 END AS excess, i.raw_amount IS NOT NULL AS rp, f.formal_amount IS NOT NULL AS fp FROM per p LEFT JOIN idx i USING (order_id) LEFT JOIN fidx f USING (order_id) LEFT JOIN dup USING (order_id))"""


@query(
    "J15_refund_exceptions",
    f"""WITH {_EXC_SQL} SELECT order_id, st AS refund_status, round(refund, 2) AS refund_amount, CASE WHEN fp THEN '正式口徑匹配' WHEN rp THEN '被收入規則排除' ELSE 'SQLite 找不到' END AS match_state,
 CASE WHEN refund <= 0 THEN 'INVALID_REFUND_AMOUNT' WHEN excess > 0 THEN 'OVER_REFUND' WHEN copies > 0 THEN 'DUPLICATE_REFUND_ROW' WHEN fp THEN 'FORMAL_MATCHED' WHEN rp THEN 'REVENUE_SCOPE_EXCLUDED' ELSE 'SQLITE_SOURCE_NOT_FOUND' END AS reason_code,
 round(CASE WHEN fp THEN least(refund, formal_amount) ELSE 0.0 END, 2) AS deducted_amount, round(excess, 2) AS excess_amount FROM x""",
)
def j15(t):
    _, formal, index = _index(t)
    out = refunds.refund_exceptions(refund_rows(t).select("order_id", "refund_amount", "refund_status"), index, formal)
    # cents: float noise around zero is not an excess
    return rounded(out.select("order_id", "refund_status", "refund_amount", "match_state", "reason_code", "deducted_amount", "excess_amount"), 2)


_ALLOC_SQL = f"""{REFUND_SQL}, tot AS (SELECT oid AS order_id, sum(amt) AS refund FROM valid GROUP BY 1), ftot AS (SELECT order_id, sum(amount) AS orig FROM official GROUP BY 1),
alloc AS (SELECT o.*, CASE WHEN t.refund IS NOT NULL THEN o.amount / f.orig * least(t.refund, f.orig) END AS deducted FROM official o JOIN ftot f USING (order_id) LEFT JOIN tot t USING (order_id))"""


@query("J16_refund_allocation", f"WITH {_ALLOC_SQL} SELECT order_id, receipt_no, round(amount, 2) AS amount_before, round(deducted, 4) AS refund_deducted, round(greatest(amount - deducted, 0.0), 4) AS amount FROM alloc WHERE deducted > 0")
def j16(t):
    formal = t.official("order_id", "receipt_no", "amount")
    out = refunds.apply_refunds(formal, refunds.valid_refunds(refund_rows(t)))["detail"]
    return rounded(rounded(out.select("order_id", "receipt_no", "amount_before", "refund_deducted", "amount"), 4), 2, "amount_before")


@query("W09_share_of_order", f"WITH {_ALLOC_SQL} SELECT order_id, round(sum(deducted), 2) AS deducted, round(max(least(refund, (SELECT orig FROM ftot f WHERE f.order_id = alloc_.order_id))), 2) AS applied FROM (SELECT a.*, t.refund FROM alloc a JOIN tot t USING (order_id)) alloc_ GROUP BY 1")
def w09(t):
    formal = t.official("order_id", "receipt_no", "amount")
    out = refunds.apply_refunds(formal, refunds.valid_refunds(refund_rows(t)))
    sums = out["detail"].groupBy("order_id").agg(F.sum("refund_deducted").alias("deducted"))
    orders = out["orders"].where("is_matched").select("order_id", F.col("applied_amount").alias("applied"))
    return rounded(sums.join(orders, "order_id"), 2)


def _metric_sql(label: str, where: str) -> str:
    return f"""SELECT '{label}' AS refund_dimension, count(*) AS source_orders, count(f.orig) AS matched_orders, count(*) - count(f.orig) AS unmatched_orders, round(sum(refund), 2) AS refund_total, round(sum(CASE WHEN f.orig IS NOT NULL THEN least(refund, f.orig) ELSE 0 END), 2) AS applied_amount,
 round(sum(CASE WHEN f.orig IS NOT NULL THEN greatest(refund - f.orig, 0) ELSE 0 END), 2) AS excess_amount FROM (SELECT oid AS order_id, sum(amt) AS refund FROM valid WHERE {where} GROUP BY 1) t LEFT JOIN ftot f USING (order_id)"""


@query("A39_refund_metrics", f"WITH {_ALLOC_SQL} {_metric_sql('總退款', 'true')} UNION ALL {_metric_sql('已退款', chr(114) + 'efund_status = ' + repr('已退款'))}")
def a39(t):
    formal, rows = t.official("order_id", "amount"), refunds.valid_refunds(refund_rows(t))
    out = None
    for label, status in refunds.DIMENSIONS:
        row = refunds.refund_metrics(refunds.reconcile(formal, rows, status)).withColumn("refund_dimension", F.lit(label))
        out = row if out is None else out.unionByName(row)
    return rounded(out, 2)


@query("C19_refund_adjustment", f"WITH {_ALLOC_SQL} SELECT is_tour, count(*) AS receipts, round(sum(amount), 2) AS before, round(sum(greatest(amount - coalesce(deducted, 0), 0.0)), 2) AS after FROM alloc GROUP BY 1")
def c19(t):
    formal = t.official("order_id", "amount", "is_tour")
    out = refunds.apply_refunds(formal, refunds.valid_refunds(refund_rows(t)), parity=True)["receipts"]
    return rounded(out.groupBy("is_tour").agg(F.count(F.lit(1)).alias("receipts"), F.sum("amount_before").alias("before"), F.sum("amount").alias("after")), 2)


@query(
    "C20_refund_preflight",
    f"""WITH {_EXC_SQL} SELECT '總退款' AS refund_dimension, count(*) AS source_orders, count(*) FILTER (fp) AS matched_formal_orders, count(*) FILTER (rp AND NOT fp) AS matched_excluded_orders, count(*) FILTER (NOT rp) AS unmatched_orders, round(count(*) FILTER (fp) / count(*), 4) AS formal_match_rate,
 round(sum(refund), 2) AS refund_total, round(sum(CASE WHEN fp THEN least(refund, formal_amount) ELSE 0 END), 2) AS applied_amount FROM x""",
)
def c20(t):
    raw, formal, _ = _index(t)
    report = refunds.refund_preflight(raw, formal, refund_rows(t), list(TIES))
    out = report["dimensions"].where(F.col("refund_dimension") == "總退款")
    names = ["refund_dimension", "source_orders", "matched_formal_orders", "matched_excluded_orders", "unmatched_orders", "formal_match_rate", "refund_total", "applied_amount"]
    return rounded(rounded(out.select(*names), 4), 2, "refund_total", "applied_amount")


# --- ledger --------------------------------------------------------------------------------------------------

# observations keep the order text as filed; the current state holds earlier refunds, some since changed
_OBS_SQL = f"""{REFUND_SQL}, obs AS (SELECT refund_no, order_id AS source_receipt_no, refund_status, CAST(round(TRY_CAST(refund_amount AS DECIMAL(38,10)), 2) * 100 AS BIGINT) AS minor, refund_date, order_key, part_key, supplier_key, line_no,
 CASE WHEN order_id = '' THEN 'EMPTY_SOURCE_RECEIPT_NO' WHEN refund_status = '' THEN 'EMPTY_REFUND_STATUS' WHEN TRY_CAST(refund_amount AS DECIMAL(38,10)) IS NULL OR TRY_CAST(refund_amount AS DECIMAL(38,10)) < 0 THEN 'INVALID_REFUND_AMOUNT' END AS code FROM refunds),
good AS (SELECT *, row_number() OVER (PARTITION BY refund_no ORDER BY part_key, supplier_key, line_no) AS rn FROM obs WHERE code IS NULL),
cur AS (SELECT refund_no, CASE WHEN order_key % 7 = 0 THEN 'moved' ELSE source_receipt_no END AS source_receipt_no, CASE WHEN order_key % 5 = 0 THEN '待退款' ELSE refund_status END AS refund_status, minor, refund_date FROM good WHERE rn = 1 AND refund_date < '1999'),
chg AS (SELECT g.*, CASE WHEN rn > 1 THEN 'DUPLICATE_REFUND_ORDER_NO' WHEN c.refund_no IS NULL THEN 'NEW' WHEN c.source_receipt_no <> g.source_receipt_no OR c.minor <> g.minor THEN 'REFUND_IDENTITY_CONFLICT' WHEN c.refund_status <> g.refund_status THEN 'STATUS_CHANGED' ELSE 'UNCHANGED' END AS change FROM good g LEFT JOIN cur c USING (refund_no))"""


def _ledger_rows(t):
    file = refund_rows(t)
    rows, refused = refunds.observations(file.drop("order_key"), FILE_ORDER)
    firsts = rows.groupBy("refund_no").agg(F.min(F.struct(*FILE_ORDER, *refunds.STATE_COLUMNS[1:])).alias("f")).select("refund_no", "f.*")
    key = F.split(F.substring("refund_no", 3, 99), "-")[0].cast("long")
    current = firsts.where(F.col("refund_date") < "1999").select(
        "refund_no", F.when(key % 7 == 0, F.lit("moved")).otherwise(F.col("source_receipt_no")).alias("source_receipt_no"), "refund_amount_minor",
        F.when(key % 5 == 0, F.lit("待退款")).otherwise(F.col("refund_status")).alias("refund_status"), "currency_code", "refund_date",
    )
    return rows, refused, current


@query("C37_refund_observations", f"WITH {_OBS_SQL} SELECT coalesce(code, 'ok') AS blocking_code, count(*) AS rows, coalesce(sum(minor) FILTER (code IS NULL), 0)::BIGINT AS minor FROM obs GROUP BY 1")
def c37(t):
    rows, refused, _ = _ledger_rows(t)
    a = rows.agg(F.lit("ok").alias("blocking_code"), F.count(F.lit(1)).alias("rows"), F.sum("refund_amount_minor").alias("minor"))
    return a.unionByName(refused.groupBy("blocking_code").agg(F.count(F.lit(1)).alias("rows"), F.lit(0).cast("long").alias("minor")))


@query("J25_refund_changes", f"WITH {_OBS_SQL} SELECT refund_no, part_key, supplier_key, line_no, change FROM chg")
def j25(t):
    rows, _, current = _ledger_rows(t)
    return refunds.classify_changes(rows, current, FILE_ORDER).select("refund_no", *FILE_ORDER, "change")


@query(
    "C21_refund_preview",
    f"""WITH {_OBS_SQL} SELECT count(*) FILTER (change = 'NEW') AS "NEW", count(*) FILTER (change = 'UNCHANGED') AS "UNCHANGED", count(*) FILTER (change = 'STATUS_CHANGED') AS "STATUS_CHANGED", count(*) FILTER (change IN ('REFUND_IDENTITY_CONFLICT', 'DUPLICATE_REFUND_ORDER_NO')) AS "REFUND_IDENTITY_CONFLICT",
 'blocked' AS status, (SELECT CAST(round(sum(amount) * 100) AS BIGINT) FROM official) AS formal_revenue_minor FROM chg""",
)
def c21(t):
    from tallyspark.functions.keys import attach_one_row

    _, _, current = _ledger_rows(t)
    found = refunds.preview(refund_rows(t).drop("order_key"), current, t.official("order_id", "amount"), FILE_ORDER)
    return attach_one_row(found["counts"], found["verdict"].select("status", "formal_revenue_minor"))


_STATE_SQL = f"""{_OBS_SQL}, state AS (SELECT refund_no, source_receipt_no, minor, refund_status, refund_date FROM cur WHERE refund_no NOT IN (SELECT refund_no FROM chg WHERE change IN ('NEW', 'STATUS_CHANGED')) UNION ALL SELECT refund_no, source_receipt_no, minor, refund_status, refund_date FROM chg WHERE change IN ('NEW', 'STATUS_CHANGED')),
sref AS (SELECT regexp_replace(source_receipt_no, '\\.0$', '') AS order_id, minor, refund_status FROM state), so AS (SELECT upper(order_id) AS order_id, sum(minor) AS m FROM sref GROUP BY 1), sp AS (SELECT upper(order_id) AS order_id, sum(minor) AS m FROM sref WHERE refund_status = '已退款' GROUP BY 1),
fo AS (SELECT order_id, CAST(round(sum(amount) * 100) AS BIGINT) AS orig FROM official GROUP BY 1)"""


def _state(t):
    """The state a confirmed file leaves; a ledger stores it before anything is computed from it."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STATES:
        rows, _, current = _ledger_rows(t)
        _STATES[key] = cut_lineage(refunds.proposed_state(refunds.classify_changes(rows, current, FILE_ORDER), current))
    return _STATES[key]


@query(
    "C22_ledger_reconciliation",
    f"""WITH {_STATE_SQL}, a AS (SELECT 'TOTAL_REFUND' AS refund_dimension, * FROM so LEFT JOIN fo USING (order_id) UNION ALL SELECT 'REFUNDED', * FROM sp LEFT JOIN fo USING (order_id))
SELECT refund_dimension, order_id, CASE WHEN orig IS NULL THEN 'SQLITE_SOURCE_NOT_FOUND' ELSE 'FORMAL_MATCHED' END AS match_status, m::BIGINT AS refund_total_minor, coalesce(orig, 0) AS original_amount_minor, least(m, coalesce(orig, 0))::BIGINT AS applied_amount_minor, (m - least(m, coalesce(orig, 0)))::BIGINT AS excess_minor FROM a""",
)
def c22(t):
    ledger = refunds.ledger_rows(_state(t), t.official("order_id", "amount", "receipt_no"), "v1", ["order_id", "receipt_no"])
    return ledger["reconciliation"].drop("version_id")


@query(
    "C22_ledger_conservation",
    f"""WITH {_STATE_SQL} SELECT sum(least(m, coalesce(orig, 0)))::BIGINT AS deducted_minor, sum(least(m, coalesce(orig, 0)))::BIGINT AS applied_minor, true AS is_conserved FROM sp LEFT JOIN fo USING (order_id)""",
)
def c22_conservation(t):
    ledger = refunds.ledger_rows(_state(t), t.official("order_id", "amount", "receipt_no"), "v1", ["order_id", "receipt_no"])
    return refunds.conservation(ledger["adjustments"], ledger["metrics"])


@query(
    "C22_settled_orders",
    f"WITH {OFFICIAL_SQL}, o AS (SELECT order_id, CAST(round(sum(amount) * 100) AS BIGINT) AS cents, count(*) FILTER (amount > 0) AS receipts FROM official GROUP BY 1) SELECT order_id, least(cents // 3 + 1, cents) AS deducted_minor, receipts FROM o",
)
def c22_settled(t):
    """A refund of a third of every order, a cent up, which rounds in nearly every receipt."""
    receipts = t.official("order_id", "amount", "receipt_no")
    cents = F.round(F.sum("amount") * 100).cast("long")
    file = receipts.groupBy("order_id").agg(((F.floor(cents / 3) + 1) / 100).alias("refund_amount")).withColumn("refund_status", F.lit(refunds.PAID))
    rows = refunds.adjustment_rows(receipts, file, refunds.PAID, ["order_id", "receipt_no"])
    return rows.groupBy("order_id").agg(F.sum("deducted_minor").alias("deducted_minor"), F.count(F.lit(1)).alias("receipts"))


@query("J25_wide_identity", f"WITH {_OBS_SQL} SELECT refund_no, 'UNCHANGED' AS change FROM cur")
def j25_wide(t):
    """The stored refunds filed again in full-width characters."""
    _, _, current = _ledger_rows(t)
    wide = [F.translate(c, "0123456789-", "０１２３４５６７８９－").alias(c) for c in ("refund_no", "source_receipt_no")]
    file = current.select(
        *wide, F.col("refund_status"), (F.col("refund_amount_minor") / 100).cast("decimal(18,2)").cast("string").alias("refund_amount"), F.col("refund_no").alias("pos")
    ).withColumnRenamed("source_receipt_no", "order_id")
    rows, _ = refunds.observations(file, ["pos"])
    return refunds.classify_changes(rows, current, ["pos"]).select("refund_no", "change")


@query(
    "A40_ledger_metrics",
    f"""WITH {_STATE_SQL}, a AS (SELECT 'TOTAL_REFUND' AS d, m, orig FROM so LEFT JOIN fo USING (order_id) UNION ALL SELECT 'REFUNDED', m, orig FROM sp LEFT JOIN fo USING (order_id)), s AS (SELECT d, sum(m) AS r, sum(least(m, coalesce(orig, 0))) AS ap, count(*) AS n, count(orig) AS k FROM a GROUP BY 1)
SELECT d AS refund_dimension, 'REFUND_DETAIL' AS metric_name, r::BIGINT AS amount_minor, n AS order_count FROM s UNION ALL SELECT d, 'APPLIED_REFUND', ap::BIGINT, k FROM s UNION ALL SELECT d, 'ORIGINAL_TRANSACTION_QUANTITY', 0, 0 FROM s""",
)
def a40(t):
    return refunds.ledger_rows(_state(t), t.official("order_id", "amount", "receipt_no"), "v1", ["order_id", "receipt_no"])["metrics"].drop("version_id")


_PRINT_SQL = """SELECT '{"currencyCode":"HKD","refundAmountMinor":' || minor || ',"refundDate":' || coalesce('"' || refund_date || '"', 'null') || ',"refundOrderNo":"' || refund_no || '","refundStatus":"' || refund_status || '","sourceReceiptNo":"' || source_receipt_no || '"}' AS j FROM state"""
_PRINT_SUMS = ", ".join(f"coalesce(sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS UBIGINT)), 0)::VARCHAR" for i in range(4))


@query("C38_state_print", f"WITH {_STATE_SQL}, j AS ({_PRINT_SQL}), h AS (SELECT sha256(j) AS h FROM j) SELECT count(*) AS refunds, sha256(concat_ws('|', count(*)::VARCHAR, {_PRINT_SUMS})) AS state_print FROM h")
def c38(t):
    return refunds.state_fingerprint(_state(t))


@query("C38_edited_state_print", f"WITH {_STATE_SQL}, j AS ({_PRINT_SQL.replace('|| minor ||', '|| (minor + 1) ||')}), h AS (SELECT sha256(j) AS h FROM j) SELECT count(*) AS refunds, sha256(concat_ws('|', count(*)::VARCHAR, {_PRINT_SUMS})) AS state_print FROM h")
def c38_edited(t):
    """The print of the same state with every amount a cent up, its rows dealt out anew."""
    return refunds.state_fingerprint(_state(t).withColumn("refund_amount_minor", F.col("refund_amount_minor") + 1).repartition("refund_no"))


@query("C39_active_read_model", f"WITH {_STATE_SQL}, a AS (SELECT '總退款' AS refund_dimension, m, orig FROM so LEFT JOIN fo USING (order_id) UNION ALL SELECT '已退款', m, orig FROM sp LEFT JOIN fo USING (order_id)) SELECT refund_dimension, count(*) AS source_orders, count(orig) AS matched_orders, round(sum(m) / 100, 2) AS refund_total, round(sum(least(m, coalesce(orig, 0))) / 100, 2) AS applied_amount FROM a GROUP BY 1")
def c39(t):
    formal = t.official("order_id", "amount", "receipt_no")
    model = refunds.active_read_model(refunds.ledger_rows(_state(t), formal, "v1", ["order_id", "receipt_no"]), formal)
    out = None
    for label, parts in model.items():
        row = parts["metrics"].withColumn("refund_dimension", F.lit(label)).select("refund_dimension", "source_orders", "matched_orders", "refund_total", "applied_amount")
        out = row if out is None else out.unionByName(row)
    return rounded(out, 2)


@query("C23_version_lifecycle", "WITH e AS (SELECT o_orderkey AS seq, CASE o_orderkey % 3 WHEN 0 THEN 'DEACTIVATE' ELSE 'ACTIVATE' END AS k FROM orders), l AS (SELECT max(seq) AS s, arg_max(k, seq) AS k FROM e) SELECT CASE WHEN k = 'DEACTIVATE' THEN 'INACTIVE' ELSE 'STALE' END AS status, CASE WHEN k <> 'DEACTIVATE' THEN 'v' || s END AS version_id FROM l")
def c23(t):
    seq = F.col("o_orderkey")
    events = t.orders.select(
        seq.alias("seq"), F.when(seq % 3 == 0, F.lit("DEACTIVATE")).otherwise(F.lit("ACTIVATE")).alias("event_type"), F.concat(F.lit("v"), seq.cast("string")).alias("to_version"), F.concat(F.lit("v"), (seq - 1).cast("string")).alias("from_version")
    )
    versions = events.select(F.col("to_version").alias("version_id"), F.lit("old").alias("revenue_token"))
    return refunds.stale_check(refunds.version_status(events), versions, "new").select("status", "version_id")


# --- drivers -------------------------------------------------------------------------------------------------

_LINE = "CASE WHEN source_tag LIKE '%酒店%' THEN '酒店' WHEN source_tag LIKE '%門券%' THEN '門券' WHEN source_tag LIKE '%套票%' THEN '套票' ELSE '旅行團' END"
DRIVER_SQL = f"""{OFFICIAL_SQL}, df AS (SELECT order_id, unified_date AS d, amount, {_LINE} AS product_line, CASE WHEN branch = '{DESK}' THEN '專職通路' ELSE '分社通路' END AS channel, branch, salesperson, CASE WHEN dest_category = '' THEN '未分類' ELSE dest_category END AS dest_category, source_tag,
 CASE WHEN day(unified_date) <= 3 THEN '月初' WHEN day(unified_date) >= 26 THEN '月末' ELSE '月中' END || ' / ' || CASE WHEN isodow(unified_date) >= 6 THEN '週末' ELSE '平日' END AS event_window FROM official),
b AS (SELECT max(d) - 29 AS cs, max(d) AS ce, max(d) - 59 AS bs, max(d) - 30 AS be FROM df), p AS (SELECT df.*, CASE WHEN d BETWEEN cs AND ce THEN amount ELSE 0.0 END AS cur, CASE WHEN d BETWEEN bs AND be THEN amount ELSE 0.0 END AS base FROM df, b WHERE d BETWEEN bs AND ce),
long AS (SELECT dimension, driver, sum(cur) AS c, sum(base) AS b FROM p UNPIVOT (driver FOR dimension IN (product_line, channel, branch, salesperson, dest_category, source_tag, event_window)) GROUP BY 1, 2), tot AS (SELECT sum(cur) - sum(base) AS t FROM p)"""
_DRIVER_ROLES = ("order_id", "receipt_time", "amount", "source_tag", "dest_category", "tour_name", "branch", "salesperson")


def _analytics(t):
    return drivers.driver_analytics(t.official(*_DRIVER_ROLES), DESK)


@query("C24_driver_periods", f"WITH {DRIVER_SQL} SELECT cs::VARCHAR AS current_start, ce::VARCHAR AS current_end, bs::VARCHAR AS baseline_start, be::VARCHAR AS baseline_end FROM b")
def c24(t):
    return texted(_analytics(t)["periods"])


@query(
    "J21_period_contributions",
    f"""WITH {DRIVER_SQL} SELECT dimension, driver, round(c, 2) AS current_amount, round(b, 2) AS baseline_amount, round(c - b, 2) AS delta, round((c - b) / t * 100, 4) AS contribution_rate, CASE WHEN round(c - b, 2) > 0 THEN '拉升' WHEN round(c - b, 2) < 0 THEN '拖累' ELSE '持平' END AS direction FROM long, tot""",
)
def j21(t):
    return rounded(rounded(_analytics(t)["drivers"], 4), 2, "current_amount", "baseline_amount", "delta")


@query("K03_top_drivers", f"WITH {DRIVER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY abs(c - b) DESC, driver) AS rn FROM long) SELECT dimension, driver, round(c - b, 2) AS delta FROM r WHERE rn <= 5")
def k03(t):
    return rounded(_analytics(t)["top_drivers"].select("dimension", "driver", "delta"), 2)


@query("A37_order_concentration", f"""WITH {DRIVER_SQL}, o AS (SELECT 'current' AS period, order_id, sum(cur) AS v FROM p, b WHERE d BETWEEN cs AND ce GROUP BY 2 UNION ALL SELECT 'baseline', order_id, sum(base) FROM p, b WHERE d BETWEEN bs AND be GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY v DESC) AS rn FROM o) SELECT period, round(sum(v) FILTER (rn <= 5) / sum(v), 6) AS top_share, count(*) AS orders FROM r GROUP BY 1""")
def a37(t):
    return rounded(_analytics(t)["order_concentration"], 6)


@query("C25_driver_reconciliation", f"WITH {DRIVER_SQL} SELECT dimension, round(sum(c - b), 2) AS driver_delta, round(any_value(t), 2) AS total_delta, 0.0 AS difference FROM long, tot GROUP BY 1")
def c25(t):
    return rounded(_analytics(t)["reconciliation"], 2)
