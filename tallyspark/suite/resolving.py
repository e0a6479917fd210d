"""Resolve, audit and ingest checks: main sheet = orders, product sheets = line items."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tallyspark.functions.keys import first_per_key
from tallyspark.operators import audit, resolve, suggest
from tallyspark.plans.ingest import process_uploads
from tallyspark.sources import tabular
from tallyspark.suite.base import DESK, NATIONS, RECEIPTS_SQL, RULES, SPECIALISTS, order_code, order_code_sql, query, rounded

# two digits name a branch; "073" is a longer prefix of its own; 25-29 are unmapped; "110" and "111" are excluded
PREFIXES = {**NATIONS, "073": "AIRPORT DESK", "99": DESK}
EXCLUDED = ("110", "111")
INGEST_RULES = replace(
    RULES,
    branch_map=PREFIXES,
    target_branches=(),
    exclude_prefixes=EXCLUDED,
    overrides=(
        {"month": "1997-05", "from_branch": "NATION_3", "to_branch": "EXPO"},
        {"year": "1998", "from_prefix": "05", "to_branch": "EXPO 2"},
        {"month": "1997-06", "from_branch": "EXPO", "to_branch": "NEVER"},
        {"from_branch": "EXPO", "to_branch": "EXPO 3"},
    ),
)

_CASES = " ".join(f"WHEN code LIKE '{p}%' THEN '{n}'" for p, n in sorted(PREFIXES.items(), key=lambda x: -len(x[0])))
_KEPT = f"substring(code, 1, 2) IN ({', '.join(repr(p) for p in NATIONS)}) AND NOT (code LIKE '110%' OR code LIKE '111%')"
MAIN_SQL = f"""main AS (SELECT *, {order_code_sql("o_orderkey")} AS code FROM orders), kept AS (SELECT *, CASE {_CASES} ELSE '未知' END AS branch FROM main WHERE {_KEPT})"""


def _main(t):
    k = F.col("o_orderkey")
    dirty = F.when(k % 3 == 0, F.concat(order_code(k), F.lit(".0"))).when(k % 3 == 1, F.concat(F.lit(" "), order_code(k), F.lit("\xa0"))).otherwise(order_code(k))
    return t.orders.select(
        dirty.alias("order_id"),
        F.concat(F.lit("R"), k.cast("string")).alias("receipt_no"),
        F.concat(F.lit("HK$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("receipt_time"),
        F.concat(F.lit("REP_"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0"), F.lit(" 櫃台")).alias("operator"),
        F.col("o_orderpriority").alias("pay_method"),
        k.alias("k"),
    )


def _secondary(t):
    rows = t.receipts("order_key", "line_no", "part_key", "supplier_key", "receipt_no", "qty", "amount", "trans_time", "sub_branch", "salesperson", "dept", "tour_name", "is_tour", "days", "dest_category")
    k = F.col("order_key")
    return rows.select(
        F.when(k % 2 == 0, order_code(k)).otherwise(F.concat(order_code(k), F.lit(".0"))).alias("secondary_key"),
        F.struct("order_key", "line_no", "part_key", "supplier_key", "qty").alias("src_ordinal"),
        *["line_no", "part_key", "supplier_key", "qty", "days", "dept", "tour_name", "dest_category", "trans_time"],
        F.when(F.col("line_no") == 2, F.col("sub_branch")).otherwise(F.lit("")).alias("branch"),
        F.when(F.col("supplier_key") % 4 == 0, F.regexp_replace("salesperson", "_", "-")).otherwise(F.col("salesperson")).alias("salesperson"),
        F.when(F.col("is_tour"), F.lit("旅行團")).otherwise(F.lit("票務")).alias("source_name"),
    )


# --- prefixes ------------------------------------------------------------------------------------------------


@query("F01_mapped_orders", f"WITH {MAIN_SQL} SELECT code AS order_id FROM kept")
def f01(t):
    rows = t.orders.select(order_code(F.col("o_orderkey")).alias("order_id"))
    return resolve.keep_mapped_orders(rows, INGEST_RULES)


@query("J02_branch_by_prefix", f"WITH {MAIN_SQL} SELECT o_orderkey AS k, CASE {_CASES} ELSE '未知' END AS branch FROM main")
def j02(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), resolve.branch_by_prefix(order_code(F.col("o_orderkey")), PREFIXES).alias("branch"))


# --- joins with product rows ---------------------------------------------------------------------------------

_FIRST_SQL = f"""{RECEIPTS_SQL}, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY line_no, part_key, supplier_key, amount) AS rn FROM receipts) WHERE rn = 1)"""


@query("W01_first_row_per_key", f"WITH {_FIRST_SQL} SELECT order_key, line_no, part_key, supplier_key, amount FROM firsts")
def w01(t):
    rows = t.receipts("order_key", "line_no", "part_key", "supplier_key", "amount")
    return first_per_key(rows, ["order_key"], [F.col("line_no"), F.col("part_key"), F.col("supplier_key"), F.col("amount")])


@query(
    "J01_main_with_first_secondary",
    f"""WITH {_FIRST_SQL} SELECT o_orderkey AS order_key, o_totalprice AS price, f.part_key, f.dept, f.order_key IS NOT NULL AS is_matched FROM orders LEFT JOIN firsts f ON o_orderkey = f.order_key""",
)
def j01(t):
    main = t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"))
    rows = t.receipts("order_key", "line_no", "part_key", "supplier_key", "amount", "dept")
    order = [F.col(c) for c in ("line_no", "part_key", "supplier_key", "amount")]
    return resolve.attach_secondary(main, rows, order, "order_key").select("order_key", "price", "part_key", "dept", "is_matched")


# --- names ---------------------------------------------------------------------------------------------------


# the longest block that two stretches share (the leftmost of equal ones), then the stretches left and right of it
_BLOCK = """list_max(flatten(flatten([[[{{'k': k, 'i': -i, 'j': -j}} FOR k IN range(1, least(a2 - i, b2 - j) + 1) IF substr(a, i + 1, k) = substr(b, j + 1, k)] FOR j IN range(b1, b2)] FOR i IN range(a1, a2)])))"""


def ratio_sql(pairs: str) -> str:
    """Recursive SQL of the similarity of ``pairs(a, b)``: a table ``ratios(a, b, ratio)``."""
    block = _BLOCK.format()
    return f"""blocks AS (SELECT a, b, a1, a2, b1, b2, {block} AS m FROM (SELECT DISTINCT a, b, 0::BIGINT AS a1, length(a) AS a2, 0::BIGINT AS b1, length(b) AS b2 FROM {pairs})
 UNION ALL SELECT a, b, a1, a2, b1, b2, {block} FROM (SELECT a, b, s.a1 AS a1, s.a2 AS a2, s.b1 AS b1, s.b2 AS b2 FROM (SELECT a, b, unnest([{{'a1': a1, 'a2': -m.i, 'b1': b1, 'b2': -m.j}}, {{'a1': m.k - m.i, 'a2': a2, 'b1': m.k - m.j, 'b2': b2}}]) AS s FROM blocks WHERE m IS NOT NULL)
  WHERE s.a1 < s.a2 AND s.b1 < s.b2)),
ratios AS (SELECT a, b, 2 * coalesce(sum(m.k), 0) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b)"""


_LISTED = f"l AS (SELECT unnest([{', '.join(repr(x) for x in SPECIALISTS)}]) AS a)"


def _closest_sql(raw: str, cutoff: float = resolve.NAME_CUTOFF, listed: str = _LISTED) -> str:
    """SQL of ``name_matches`` over the table ``r(name)`` that ``raw`` selects."""
    return f"""{listed}, r AS ({raw}), n AS (SELECT name, trim(name, ' ') AS b, count(*) AS rows FROM r WHERE trim(name, ' ') <> '' GROUP BY name), p AS (SELECT l.a, n.b FROM l CROSS JOIN n), {ratio_sql('p')},
best AS (SELECT b, a FROM ratios WHERE ratio >= {cutoff} QUALIFY row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a DESC) = 1)"""


_FOUND = "CASE WHEN n.b IN (SELECT a FROM l) THEN n.b ELSE coalesce(best.a, n.b) END AS standard_name, CASE WHEN n.b IN (SELECT a FROM l) THEN 'listed' WHEN best.a IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS found_by, rows FROM n LEFT JOIN best ON best.b = n.b"


@query(
    "J03_fuzzy_names",
    f"""WITH RECURSIVE {RECEIPTS_SQL}, {_closest_sql("SELECT CASE WHEN supplier_key % 4 = 0 THEN replace(salesperson, '_', '-') || 'x' ELSE salesperson END AS name FROM receipts")}
SELECT n.name AS salesperson, {_FOUND}""",
)
def j03(t):
    rows = t.receipts("salesperson", "supplier_key").withColumn(
        "salesperson", F.when(F.col("supplier_key") % 4 == 0, F.concat(F.regexp_replace("salesperson", "_", "-"), F.lit("x"))).otherwise(F.col("salesperson"))
    )
    return resolve.name_matches(rows, "salesperson", SPECIALISTS)


_OPERATOR_SQL = f"""{RECEIPTS_SQL}, ops AS (SELECT *, CASE WHEN line_no = 1 AND supplier_key % 60 < 5 THEN salesperson END AS specialist FROM receipts)"""


@query("J04_operator_matches", f"WITH {_OPERATOR_SQL} SELECT DISTINCT operator, specialist FROM ops WHERE line_no = 1 AND specialist IS NOT NULL")
def j04(t):
    # "rep_03 櫃台" has the compact key "REP03櫃台" and the code "REP03" of specialist "REP_03"
    found = resolve.operator_matches(t.receipts("operator").where(F.col("operator").startswith("rep_")), SPECIALISTS)
    return found.where(F.col("stage").isin("key", "code", "prefix")).select("operator", "specialist")


# one or two letters away from a specialist's code, or from none
_SLIPS = ("rexp ", "rrep-", "rpe.", "cash ")
_SLIP_KEYS = "l AS (SELECT unnest([" + ", ".join(repr(x.replace("_", "")) for x in SPECIALISTS) + "]) AS a)"
_SLIP_RAW = f"""SELECT upper(regexp_replace(operator, '[^a-z0-9]', '', 'g')) AS name FROM slips"""


@query(
    "J04_operator_slips",
    f"""WITH RECURSIVE {RECEIPTS_SQL}, slips AS (SELECT [{', '.join(repr(x) for x in _SLIPS)}][supplier_key % 4 + 1] || lpad(CAST(supplier_key % 60 AS VARCHAR), 2, '0') AS operator FROM receipts),
{_closest_sql(_SLIP_RAW, resolve.OPERATOR_CUTOFF, _SLIP_KEYS)}
SELECT DISTINCT operator, 'REP_' || substr(best.a, 4) AS specialist, CASE WHEN best.a IS NOT NULL THEN 'fuzzy' END AS stage FROM slips LEFT JOIN best ON best.b = upper(regexp_replace(operator, '[^a-z0-9]', '', 'g'))""",
)
def j04_slips(t):
    slip = F.get(F.array(*[F.lit(x) for x in _SLIPS]), (F.col("supplier_key") % 4).cast("int"))
    rows = t.receipts("supplier_key").select(F.concat(slip, F.lpad((F.col("supplier_key") % 60).cast("string"), 2, "0")).alias("operator"))
    return resolve.operator_matches(rows, SPECIALISTS)


@query(
    "J05_operator_override",
    f"""WITH {_OPERATOR_SQL} SELECT CASE WHEN specialist IS NOT NULL THEN '{DESK}' ELSE branch END AS branch, CASE WHEN specialist IS NOT NULL THEN specialist ELSE salesperson END AS salesperson, count(*) AS receipts, round(sum(amount), 2) AS amount
FROM ops GROUP BY 1, 2""",
)
def j05(t):
    rows = t.receipts("operator", "branch", "salesperson", "amount", "receipt_no")
    # only codes shared exactly with a specialist may match, so that the fuzzy stage has nothing to do here
    rows = rows.withColumn("operator", F.when(F.col("operator").rlike("rep_0[0-4] "), F.col("operator")).otherwise(F.lit("櫃員")))
    fixed, _ = resolve.override_by_operator(rows, RULES)
    return rounded(fixed.groupBy("branch", "salesperson").agg(F.count(F.lit(1)).alias("receipts"), F.sum("amount").alias("amount")), 2)


@query("J09_stored_operator_repair", f"WITH {_OPERATOR_SQL} SELECT count(*) AS updated FROM ops WHERE specialist IS NOT NULL AND line_no = 1 AND part_key % 2 = 0")
def j09(t):
    rows = t.receipts("operator", "branch", "salesperson", "part_key", "receipt_no")
    rows = rows.withColumn("operator", F.when(F.col("operator").rlike("rep_0[0-4] ") & (F.col("part_key") % 2 == 0), F.col("operator")).otherwise(F.lit("櫃員")))
    rows = rows.withColumn("branch", F.when(F.col("operator") == "櫃員", F.col("branch")).otherwise(F.lit("NATION_1")))  # stored wrongly
    return resolve.repair_stored_operators(rows, RULES)[1]


# --- overrides -----------------------------------------------------------------------------------------------


@query(
    "J06_sub_branch_override",
    f"""WITH {RECEIPTS_SQL}, s AS (SELECT *, CASE WHEN line_no = 2 THEN sub_branch ELSE '' END AS sub FROM receipts) SELECT CASE WHEN sub <> '' AND sub <> branch THEN sub ELSE branch END AS branch, count(*) AS receipts,
 count(*) FILTER (sub <> '' AND sub <> branch) AS changed FROM s GROUP BY 1""",
)
def j06(t):
    rows = t.receipts("order_id", "branch", "sub_branch", "line_no").withColumn("sub_branch", F.when(F.col("line_no") == 2, F.col("sub_branch")).otherwise(F.lit("")))
    fixed, log = resolve.override_by_sub_branch(rows)
    counts = fixed.groupBy("branch").agg(F.count(F.lit(1)).alias("receipts"))
    changes = log.groupBy(F.col("corrected").alias("branch")).agg(F.count(F.lit(1)).alias("changed"))
    return counts.join(changes, "branch", "left").na.fill(0)


_R1 = "strftime(unified_date, '%Y-%m') = '1997-05' AND (branch = 'NATION_3' OR sub_branch = 'NATION_3')"
_R2 = "strftime(unified_date, '%Y') = '1998' AND order_id LIKE '05%'"


@query(
    "J07_reassign_in_order",
    f"""WITH {RECEIPTS_SQL}, a AS (SELECT *, CASE WHEN {_R1} THEN 'EXPO' WHEN {_R2} THEN 'EXPO 2' ELSE branch END AS b FROM receipts) SELECT CASE b WHEN 'EXPO' THEN 'EXPO 3' ELSE b END AS branch, count(*) AS receipts,
 sum(CASE b WHEN 'EXPO' THEN 2 WHEN 'EXPO 2' THEN 1 ELSE 0 END)::BIGINT AS logged FROM a GROUP BY 1""",
)
def j07(t):
    rows = t.receipts("order_id", "branch", "sub_branch", "unified_date")
    fixed, log = resolve.reassign_branches(rows, INGEST_RULES.overrides)
    counts = fixed.groupBy("branch").agg(F.count(F.lit(1)).alias("receipts"))
    # both steps of "EXPO, then EXPO 3" are logged
    target = F.when(F.col("corrected") == "EXPO", F.lit("EXPO 3")).otherwise(F.col("corrected"))
    logged = log.groupBy(target.alias("branch")).agg(F.count(F.lit(1)).alias("logged"))
    return counts.join(logged, "branch", "left").na.fill(0)


@query(
    "J08_repair_first_match",
    f"""WITH {_OPERATOR_SQL}, w AS (SELECT *, CASE WHEN specialist IS NOT NULL AND line_no = 1 THEN '{DESK}' WHEN {_R1} THEN 'EXPO' WHEN {_R2} THEN 'EXPO 2' ELSE sub_branch END AS wanted FROM ops)
SELECT wanted AS branch, count(*) AS receipts, count(*) FILTER (branch <> wanted) AS repaired FROM w GROUP BY 1""",
)
def j08(t):
    rows = t.receipts("order_id", "branch", "sub_branch", "salesperson", "operator", "unified_date")
    rows = rows.withColumn("operator", F.when(F.col("operator").rlike("rep_0[0-4] "), F.col("operator")).otherwise(F.lit("櫃員")))
    fixed = resolve.repair_stored_branches(rows, INGEST_RULES)
    return fixed.groupBy("branch").agg(F.count(F.lit(1)).alias("receipts"), F.count(F.when(F.col("is_repaired"), 1)).alias("repaired"))


# --- ingest --------------------------------------------------------------------------------------------------

# one row per main receipt: first product row, then product branch, rules, operator
INGEST_SQL = f"""{RECEIPTS_SQL}, {MAIN_SQL}, sec AS (SELECT *, CASE WHEN line_no = 2 THEN sub_branch ELSE '' END AS sub, row_number() OVER (PARTITION BY order_key ORDER BY order_key * 10 + line_no, line_no, part_key, supplier_key, qty) AS rn FROM receipts),
j AS (SELECT k.*, s.sub, s.salesperson AS seller, s.supplier_key, s.is_tour, s.order_key IS NOT NULL AS is_matched FROM kept k LEFT JOIN (SELECT * FROM sec WHERE rn = 1) s ON s.order_key = o_orderkey),
b1 AS (SELECT *, CASE WHEN sub <> '' AND sub <> branch THEN sub ELSE branch END AS b, coalesce(sub, '') AS sb, CAST(o_orderdate AS DATE) AS ud FROM j),
b2 AS (SELECT *, CASE WHEN strftime(ud, '%Y-%m') = '1997-05' AND (b = 'NATION_3' OR sb = 'NATION_3') THEN 'EXPO 3' WHEN strftime(ud, '%Y') = '1998' AND code LIKE '05%' THEN 'EXPO 2' ELSE b END AS bb FROM b1),
b3 AS (SELECT *, CASE WHEN o_custkey % 60 < 5 THEN '{DESK}' ELSE bb END AS final_branch FROM b2)"""


@query(
    "C01_process_uploads",
    f"""WITH {INGEST_SQL} SELECT coalesce(is_matched AND is_tour, false) AS is_tour, final_branch AS branch, count(*) AS receipts, round(sum(o_totalprice), 2) AS amount FROM b3 GROUP BY 1, 2""",
)
def c01(t):
    main = _main(t)
    # only operators that carry a specialist's code, so that the result does not hang on the fuzzy stage
    main = main.withColumn("operator", F.when(F.col("operator").rlike("REP_0[0-4] "), F.col("operator")).otherwise(F.lit("櫃員")))
    out = process_uploads(main, _secondary(t).drop("line_no", "part_key", "supplier_key"), INGEST_RULES)
    return rounded(out["receipts"].groupBy("is_tour", "branch").agg(F.count(F.lit(1)).alias("receipts"), F.sum("amount").alias("amount")), 2)


_KEYS_SQL = f"""{MAIN_SQL}, m AS (SELECT code AS k, count(*) AS n FROM kept GROUP BY 1), s AS (SELECT {order_code_sql("l_orderkey")} AS k, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT k, coalesce(m.n, 0) AS mn, coalesce(s.n, 0) AS sn FROM m FULL JOIN s USING (k))"""


def _audit(t):
    from tallyspark.functions.text import clean_document_number

    main = _main(t).withColumn("order_id", clean_document_number(F.col("order_id")))
    return resolve.keep_mapped_orders(main, INGEST_RULES), t.lineitem.select(order_code(F.col("l_orderkey")).alias("secondary_key"), "l_partkey", "l_linenumber")


@query("J26_entity_match", f"WITH {_KEYS_SQL} SELECT k AS entity_key, mn::BIGINT AS main_rows, sn::BIGINT AS secondary_rows FROM e")
def j26(t):
    main, secondary = _audit(t)
    return audit.entity_match(main, secondary, "order_id", "secondary_key")


@query(
    "C09_entity_audit",
    f"""WITH {_KEYS_SQL} SELECT count(*) FILTER (mn > 0) AS main_ids, count(*) FILTER (sn > 0) AS secondary_ids, count(*) FILTER (mn > 0 AND sn > 0) AS matched_ids, coalesce(sum(mn) FILTER (mn > 0 AND sn > 0), 0)::BIGINT AS matched_main_rows,
 coalesce(sum(mn) FILTER (mn > 0 AND sn = 0), 0)::BIGINT AS unmatched_main_rows, count(*) FILTER (mn = 0) AS secondary_only_ids, coalesce(sum(mn) FILTER (mn > 1), 0)::BIGINT AS duplicate_main_rows, coalesce(sum(sn) FILTER (sn > 1), 0)::BIGINT AS duplicate_secondary_rows,
 round(count(*) FILTER (mn > 0 AND sn > 0) / count(*) FILTER (mn > 0), 4) AS match_rate FROM e""",
)
def c09(t):
    main, secondary = _audit(t)
    return audit.ingest_audit(main, secondary, "order_id", "secondary_key")["summary"]


@query(
    "C09_stored_audit",
    f"""WITH {RECEIPTS_SQL}, k AS (SELECT order_id, count(*) AS n FROM receipts GROUP BY 1) SELECT count(*) AS stored_rows, count(DISTINCT order_id) AS unique_orders, count(*) FILTER (source_tag <> '未匹配') AS matched_rows, count(*) FILTER (source_tag = '未匹配') AS unmatched_rows,
 (SELECT sum(n) FROM k WHERE n > 1)::BIGINT AS duplicate_rows, round(count(*) FILTER (source_tag <> '未匹配') / count(*), 4) AS match_rate FROM receipts""",
)
def c09_stored(t):
    return audit.stored_audit(t.receipts("order_id", "source_tag", "amount"))["summary"]


@query("A11_source_breakdown", f"WITH {RECEIPTS_SQL} SELECT source_tag AS source, count(*) AS rows, count(DISTINCT order_id) AS unique_orders, round(sum(amount), 2) AS amount FROM receipts GROUP BY 1")
def a11(t):
    return rounded(audit.source_breakdown(t.receipts("order_id", "source_tag", "amount"), "source_tag"), 2)


@query("A12_duplicate_keys", f"WITH {RECEIPTS_SQL} SELECT 'receipts' AS table_name, order_id AS entity_key, count(*) AS occurrences FROM receipts GROUP BY 2 HAVING count(*) > 1")
def a12(t):
    return audit.duplicate_keys(t.receipts("order_id"), "order_id", "receipts")


@query("U03_id_sets", f"WITH {_KEYS_SQL} SELECT 'union' AS op, count(*) AS n FROM e UNION ALL SELECT 'intersection', count(*) FROM e WHERE mn > 0 AND sn > 0 UNION ALL SELECT 'main minus secondary', count(*) FROM e WHERE sn = 0")
def u03(t):
    main, secondary = _audit(t)
    a, b = main.select("order_id"), secondary.select(F.col("secondary_key").alias("order_id"))
    sets = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "main minus secondary": a.subtract(b)}
    out = None
    for name, frame in sets.items():
        row = frame.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("W15_duplicate_flag", f"WITH {RECEIPTS_SQL} SELECT repeated, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY receipt_no) > 1 AS repeated FROM receipts) GROUP BY 1")
def w15(t):
    counts = t.receipts("receipt_no").groupBy("receipt_no").agg(F.count(F.lit(1)).alias("c"))  # counted, not windowed: a hot key stays cheap
    return counts.groupBy((F.col("c") > 1).alias("repeated")).agg(F.sum("c").alias("n"))


# --- sheets --------------------------------------------------------------------------------------------------


@query("S03_tagged_secondary_union", f"WITH {RECEIPTS_SQL} SELECT CASE WHEN is_tour THEN 'tour' ELSE 'others' END AS source_name, count(*) AS n, count(days) FILTER (is_tour) AS with_days, count(tour_name) FILTER (NOT is_tour) AS with_name FROM receipts GROUP BY 1")
def s03(t):
    tour, others = t.split("order_id", "days", "tour_name")
    union = tabular.union_tagged({"副表_tour.xlsx": tour.select("order_id", "days"), "others.csv": others.select("order_id", "tour_name")})
    return union.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count("days").alias("with_days"), F.count("tour_name").alias("with_name"))


@query("S12_exclusion_ids", f"WITH {_KEYS_SQL} SELECT DISTINCT code AS order_id FROM main")
def s12(t):
    return tabular.exclusion_ids(_main(t).select(F.col("order_id").alias("交易號碼")))


# --- suggestions ---------------------------------------------------------------------------------------------

_SUGGEST_SQL = f"""{RECEIPTS_SQL}, px AS (SELECT substring(regexp_replace(upper(order_id), '[^A-Z0-9]', '', 'g'), 1, 2) AS candidate, count(*) AS n FROM receipts WHERE source_tag = '未匹配' GROUP BY 1),
open_px AS (SELECT * FROM px WHERE CAST(candidate AS INTEGER) >= 25), dp AS (SELECT dept AS candidate, count(*) AS n FROM receipts WHERE tour_name LIKE '%機票%' AND source_tag LIKE '%酒店%' GROUP BY 1),
rows_ AS (SELECT 'BRANCH_MAPPING' AS rule_type, candidate, n, least(82, 45 + n * 5)::DOUBLE AS confidence, '中' AS risk FROM open_px UNION ALL SELECT 'EXCLUDE_PREFIXES', candidate, n, least(78, 42 + n * 2)::DOUBLE, '高' FROM open_px WHERE n >= 20)
SELECT rule_type || '-' || substring(sha1(rule_type || '|' || candidate), 1, 10) AS suggestion_id, rule_type, candidate, n AS rows, round(confidence, 1) AS confidence, CASE WHEN confidence >= 85 THEN '高信心' WHEN confidence >= 70 THEN '中信心' ELSE '觀察' END AS confidence_label,
 risk, confidence >= 75 AS actionable FROM rows_"""


@query("C10_rule_suggestions", f"WITH {_SUGGEST_SQL}")
def c10(t):
    raw = t.receipts("order_id", "branch", "source_tag", "tour_name", "dest_category", "dept")
    log = raw.limit(0).select(F.lit("salesperson").alias("field"), F.lit("").alias("original"), F.lit("").alias("corrected"), F.lit("").alias("status"), F.lit(0).cast("long").alias("rows"))
    return suggest.suggestions(raw, log, RULES)


@query("K08_suggested_names", f"""WITH {RECEIPTS_SQL} SELECT salesperson AS candidate, count(*) AS rows, least(92, 58 + count(*) * 6)::DOUBLE AS confidence FROM receipts WHERE supplier_key % 60 >= 5 GROUP BY 1""")
def k08(t):
    raw = t.receipts("order_id", "branch", "source_tag", "salesperson")
    log = raw.where(~F.col("salesperson").isin(*SPECIALISTS)).groupBy(F.col("salesperson").alias("original")).agg(F.count(F.lit(1)).alias("rows"))
    log = log.select(F.lit("salesperson").alias("field"), "original", F.lit(resolve.LOG_KEPT).alias("corrected"), F.lit(resolve.LOG_NO_MATCH).alias("status"), "rows")
    found = suggest.suggestions(raw.withColumn("source_tag", F.lit("ok")), log, RULES)
    return found.where(F.col("rule_type") == "SALES_REP_LIST").select("candidate", "rows", "confidence")

