"""Scalar expression checks: text, money, dates, labels, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import category, dates, errors, hashing, labels, money, text
from tallyspark.operators import diff, exclusions, refunds
from tallyspark.plans import signals
from tallyspark.roles import normalize_receipts, to_headings, to_roles
from tallyspark.suite.base import RECEIPTS_SQL, order_code, order_code_sql, query, rounded, texted

# raw document numbers with the usual blemishes
_RAW_SQL = f"""raw AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderdate AS d, o_orderstatus AS st, o_orderpriority AS pr, o_custkey AS cust,
 CASE o_orderkey % 5 WHEN 0 THEN 'e' || {order_code_sql("o_orderkey")} WHEN 1 THEN 'E' || {order_code_sql("o_orderkey")} || '.0'
  WHEN 2 THEN '  e' || {order_code_sql("o_orderkey")} || chr(160) WHEN 3 THEN 'nan' ELSE NULL END AS doc FROM orders)"""


def _raw(t):
    k = F.col("o_orderkey")
    code = order_code(k)
    doc = (
        F.when(k % 5 == 0, F.concat(F.lit("e"), code))
        .when(k % 5 == 1, F.concat(F.lit("E"), code, F.lit(".0")))
        .when(k % 5 == 2, F.concat(F.lit("  e"), code, F.lit("\xa0")))
        .when(k % 5 == 3, F.lit("nan"))
    )
    return t.orders.select(
        k.alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"), F.col("o_custkey").alias("cust"), doc.alias("doc"),
    )


_CLEAN = "upper(trim(replace(regexp_replace(doc, '\\.0$', ''), chr(160), '')))"


@query("P01_clean_document_number", f"WITH {_RAW_SQL} SELECT k, {_CLEAN} AS cleaned, coalesce({_CLEAN}, 'NAN') AS cleaned_parity FROM raw")
def p01(t):
    doc = F.col("doc")
    return _raw(t).select("k", text.clean_document_number(doc).alias("cleaned"), text.clean_document_number(doc, parity=True).alias("cleaned_parity"))


@query("F11_valid_entity_keys", f"WITH {_RAW_SQL} SELECT {_CLEAN} AS entity_key FROM raw WHERE {_CLEAN} NOT IN ('', 'NAN', 'NONE')")
def f11(t):
    from tallyspark.operators.audit import valid_keys

    return valid_keys(_raw(t), "doc")


_MONEY_SQL = """m AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'HK$' || CAST(o_totalprice AS VARCHAR) WHEN 1 THEN '1,' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR)
 WHEN 2 THEN 'bad' ELSE CAST(o_totalprice AS VARCHAR) END AS txt FROM orders)"""


def _money(t):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    # plain decimal text, as a sheet shows it
    plain = p.cast("decimal(18,2)").cast("string")
    txt = F.when(k % 4 == 0, F.concat(F.lit("HK$"), plain)).when(k % 4 == 1, F.concat(F.lit("1,"), (F.floor(p) % 1000).cast("string"))).when(k % 4 == 2, F.lit("bad")).otherwise(plain)
    return t.orders.select(k.alias("k"), txt.alias("txt"))


@query("P02_parse_money_text", f"WITH {_MONEY_SQL} SELECT k, round(coalesce(TRY_CAST(regexp_replace(txt, '[^0-9.-]', '', 'g') AS DOUBLE), 0.0), 2) AS amount FROM m")
def p02(t):
    return rounded(_money(t).select("k", money.money_text_to_double(F.col("txt")).alias("amount")), 2)


@query("P03_numeric_coercion", f"WITH {_MONEY_SQL} SELECT k, round(coalesce(TRY_CAST(txt AS DOUBLE), 0.0), 2) AS amount FROM m")
def p03(t):
    return rounded(_money(t).select("k", money.number_or_zero(F.col("txt")).alias("amount")), 2)


_DATE_SQL = """s AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20:30' ELSE 'n/a' END AS txt FROM orders)"""


def _dates(t):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(k.alias("k"), F.when(k % 3 == 0, d).when(k % 3 == 1, F.concat(d, F.lit(" 10:20:30"))).otherwise(F.lit("n/a")).alias("txt"))


@query("P04_month_group", f"WITH {_DATE_SQL} SELECT strftime(TRY_CAST(txt AS TIMESTAMP), '%Y-%m') AS month, count(*) AS n FROM s GROUP BY 1")
def p04(t):
    rows = _dates(t)
    return rows.groupBy(dates.month_key(dates.time_of(rows, "txt")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("P05_calendar_day", f"WITH {_DATE_SQL} SELECT k, strftime(TRY_CAST(txt AS TIMESTAMP), '%Y-%m-%d') AS day FROM s")
def p05(t):
    rows = _dates(t)
    return texted(rows.select("k", dates.to_day(rows, "txt").alias("day")))


@query(
    "P06_branch_kind",
    """WITH b AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN s_name || '分社' WHEN 1 THEN s_name || '服務點' WHEN 2 THEN '展覽' || s_name ELSE s_name END AS b FROM supplier)
SELECT k, CASE WHEN b LIKE '%分社%' THEN '門店' WHEN b LIKE '%服務%' THEN '服務點' WHEN b LIKE '%展覽%' THEN '展覽' ELSE '其他' END AS kind FROM b""",
)
def p06(t):
    k, n = F.col("s_suppkey"), F.col("s_name")
    b = F.when(k % 4 == 0, F.concat(n, F.lit("分社"))).when(k % 4 == 1, F.concat(n, F.lit("服務點"))).when(k % 4 == 2, F.concat(F.lit("展覽"), n)).otherwise(n)
    return t.supplier.select(k.alias("k"), category.branch_kind(b).alias("kind"))


@query(
    "P09_product_line",
    f"""WITH {RECEIPTS_SQL}, x AS (SELECT source_tag || ' ' || dest_category || ' ' || CASE WHEN part_key % 7 = 0 THEN '郵輪' ELSE tour_name END AS txt FROM receipts)
SELECT CASE WHEN txt LIKE '%郵輪%' THEN '郵輪' WHEN txt LIKE '%酒店%' THEN '酒店' WHEN txt LIKE '%門券%' THEN '門券' WHEN txt LIKE '%交通%' THEN '交通' WHEN txt LIKE '%套票%' THEN '套票'
 WHEN txt LIKE '%票務%' THEN '票務' ELSE '旅行團' END AS product_line, count(*) AS receipts FROM x GROUP BY 1""",
)
def p09(t):
    rows = t.receipts("source_tag", "dest_category", "tour_name", "part_key")
    name = F.when(F.col("part_key") % 7 == 0, F.lit("郵輪")).otherwise(F.col("tour_name"))
    line = category.product_line(F.col("source_tag"), F.col("dest_category"), name)
    return rows.groupBy(line.alias("product_line")).agg(F.count(F.lit(1)).alias("receipts"))


_PAIR_SQL = """p AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN '  ' ELSE NULL END AS x, o_orderpriority AS y FROM orders)"""


@query(
    "P10_blank_coalesce",
    f"""WITH {_PAIR_SQL} SELECT k, CASE WHEN x IS NULL OR trim(x) = '' THEN y ELSE x END AS merged, CASE WHEN x IS NOT NULL AND trim(x) = '' THEN y ELSE x END AS merged_parity FROM p""",
)
def p10(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("k"), F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, F.lit("  ")).alias("x"), F.col("o_orderpriority").alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select("k", text.blank_coalesce(x, y).alias("merged"), text.blank_coalesce(x, y, null_blocks=True).alias("merged_parity"))


@query(
    "P11_normalize_receipts",
    f"""WITH {RECEIPTS_SQL} SELECT receipt_no, unified_date::VARCHAR AS unified_date, round(amount, 2) AS amount, qty, 0.0 AS days, '未知' AS branch, '' AS dept, '未分類' AS dest_category, salesperson, '' AS source_tag, '' AS tour_name, order_id FROM receipts""",
)
def p11(t):
    raw = t.receipts("receipt_no", "receipt_time", "qty", "salesperson", "order_id", "amount")
    raw = raw.withColumns({"amount": F.col("amount").cast("decimal(18,2)").cast("string"), "qty": F.col("qty").cast("string")})
    out = normalize_receipts(normalize_receipts(to_roles(to_headings(raw))))  # idempotent, through sheet headings
    names = ["receipt_no", "unified_date", "amount", "qty", "days", "branch", "dept", "dest_category", "salesperson", "source_tag", "tour_name", "order_id"]
    return texted(rounded(out.select(*names), 2))


@query(
    "P12_match_key",
    """WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) || '　劉-' || c_name AS n FROM customer)
SELECT k, regexp_replace(upper(replace(n, '　', ' ')), '[^A-Z0-9一-鿿]+', '', 'g') AS match_key, regexp_extract(regexp_replace(upper(replace(n, '　', ' ')), '[^A-Z0-9一-鿿]+', '', 'g'), '^[A-Z0-9]+') AS code FROM c""",
)
def p12(t):
    n = F.concat(F.lower("c_mktsegment"), F.lit("　劉-"), F.col("c_name"))
    return t.customer.select(F.col("c_custkey").alias("k"), text.match_key(n).alias("match_key"), text.leading_code(n).alias("code"))


@query(
    "P13_branch_text",
    "SELECT s_suppkey AS k, trim(replace(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '　' || s_name || ' ' END, ''), '　', ' ')) AS branch FROM supplier",
)
def p13(t):
    b = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("　"), "s_name", F.lit(" ")))
    return t.supplier.select(F.col("s_suppkey").alias("k"), text.branch_text(b).alias("branch"))


@query(
    "P14_identity_text",
    "SELECT s_suppkey AS k, upper(trim(replace(replace(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '　' || s_name || chr(160) END, ''), '　', ' '), chr(160), ' '))) AS identity FROM supplier",
)
def p14(t):
    b = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("　"), "s_name", F.lit("\xa0")))
    return t.supplier.select(F.col("s_suppkey").alias("k"), text.identity_text(b).alias("identity"))


_SHIFT_SQL = f"""{RECEIPTS_SQL}, sheet AS (SELECT receipt_no, order_id, amount, part_key % 6 = 0 AS moved,
 CASE WHEN part_key % 6 = 0 THEN NULL ELSE 'HKD' END AS original_currency, CASE WHEN part_key % 6 = 0 THEN '港幣' ELSE '1.0' END AS fx_rate,
 CASE WHEN part_key % 6 = 0 THEN 'x' ELSE NULL END AS tail_value, CASE WHEN part_key % 6 = 0 THEN 'HKD' ELSE receipt_type END AS receipt_type,
 CASE WHEN part_key % 6 = 0 THEN receipt_type ELSE pay_method END AS pay_method, CASE WHEN part_key % 6 = 0 THEN pay_method ELSE 's' END AS pay_serial,
 CASE WHEN part_key % 6 = 0 THEN 0.0 ELSE amount END AS seen_amount, amount AS base_amount FROM receipts)"""


def shifted_sheet(t, *extra):
    """Receipts as an export sheet in which every sixth product's rows are displaced by one column."""
    rows = t.receipts("receipt_no", "order_id", "amount", "part_key", "receipt_type", "pay_method", *extra)
    moved = F.col("part_key") % 6 == 0
    return rows.withColumns(
        {
            "original_currency": F.when(~moved, F.lit("HKD")),
            "fx_rate": F.when(moved, F.lit("港幣")).otherwise(F.lit("1.0")),
            "tail_value": F.when(moved, F.lit("x")),
            "base_amount": F.col("amount"),
            "amount": F.when(moved, F.lit(0.0)).otherwise(F.col("amount")),
            "pay_serial": F.when(moved, F.col("pay_method")).otherwise(F.lit("s")),
            "pay_method": F.when(moved, F.col("receipt_type")).otherwise(F.col("pay_method")),
            "receipt_type": F.when(moved, F.lit("HKD")).otherwise(F.col("receipt_type")),
        }
    )


@query("P15_shifted_rows", f"WITH {_SHIFT_SQL} SELECT moved AS is_shifted, count(*) AS n FROM sheet GROUP BY 1")
def p15(t):
    rows = shifted_sheet(t)
    return rows.groupBy(exclusions.is_shifted(rows).alias("is_shifted")).agg(F.count(F.lit(1)).alias("n"))


@query("P16_observed_amount", f"WITH {_SHIFT_SQL} SELECT moved AS is_shifted, round(sum(CASE WHEN moved THEN base_amount ELSE seen_amount END), 2) AS amount FROM sheet GROUP BY 1")
def p16(t):
    rows = shifted_sheet(t)
    return rounded(rows.groupBy(exclusions.is_shifted(rows).alias("is_shifted")).agg(F.sum(exclusions.observed_amount(rows)).alias("amount")), 2)


KIND_SQL = """CASE WHEN receipt_type = '掛賬核銷' THEN 'receipt_type:掛賬核銷' WHEN pay_method = 'TT 退款轉團款' THEN 'payment_method:TT 退款轉團款'
 WHEN moved AND pay_method = '掛賬核銷' THEN 'receipt_type:掛賬核銷' WHEN moved AND pay_serial = 'TT 退款轉團款' THEN 'payment_method:TT 退款轉團款' ELSE '' END"""


@query("P17_exclusion_kind", f"WITH {_SHIFT_SQL} SELECT {KIND_SQL} AS kind, count(*) AS n FROM sheet GROUP BY 1")
def p17(t):
    rows = shifted_sheet(t)
    return rows.groupBy(exclusions.exclusion_kind(rows).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P18_minor_units",
    """WITH m AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '1,' || CAST(o_orderkey % 1000 AS VARCHAR) || '.105' WHEN 1 THEN '-5' WHEN 2 THEN 'bad' ELSE CAST(o_orderkey AS VARCHAR) || '.004' END AS txt FROM orders),
n AS (SELECT k, CASE WHEN TRY_CAST(replace(txt, ',', '') AS DECIMAL(38,10)) >= 0 THEN CAST(round(TRY_CAST(replace(txt, ',', '') AS DECIMAL(38,10)), 2) * 100 AS BIGINT) END AS minor FROM m)
SELECT k, minor, CAST(CAST(minor AS DECIMAL(18,0)) / 100 AS DOUBLE) AS money FROM n""",
)
def p18(t):
    k = F.col("o_orderkey")
    txt = F.when(k % 4 == 0, F.concat(F.lit("1,"), (k % 1000).cast("string"), F.lit(".105"))).when(k % 4 == 1, F.lit("-5")).when(k % 4 == 2, F.lit("bad")).otherwise(F.concat(k.cast("string"), F.lit(".004")))
    minor = money.to_minor(txt)
    return t.orders.select(k.alias("k"), minor.alias("minor"), money.from_minor(minor).cast("double").alias("money"))


@query(
    "P19_nfkc_text",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ABC 123' ELSE source END AS normal FROM documents",
)
def p19(t):
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("ＡＢＣ　１２３")).otherwise(F.col("source")).alias("raw"))
    return rows.select("doc_id", text.nfkc(F.col("raw")).alias("normal"))


@query(
    "P20_canonical_hash",
    """SELECT o_orderkey AS k, sha256('{"amount":' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || ',"date":null,"orderNo":"' || CAST(o_orderkey AS VARCHAR) || '","status":"' || o_orderstatus || '"}') AS h FROM orders""",
)
def p20(t):
    fields = {
        "orderNo": F.col("o_orderkey").cast("string"),
        "status": F.col("o_orderstatus"),
        "amount": F.round(F.col("o_totalprice") * 100).cast("bigint"),
        "date": F.lit(None).cast("string"),
    }
    return t.orders.select(F.col("o_orderkey").alias("k"), hashing.canonical_hash(fields).alias("h"))


_PRINT_ROW = """'{"amount_minor":' || CAST(CAST(round(amount * 100) AS BIGINT) AS VARCHAR) || ',"branch":"' || branch || '","duplicate_ordinal":' || ordinal || ',"receipt_time":"' || strftime(receipt_time, '%Y-%m-%d %H:%M:%S') ||
 '","salesperson":"' || salesperson || '","source_receipt_no":"' || order_id || '","table":"' || CASE WHEN is_tour THEN '旅行團' ELSE '其他業務' END || '"}'"""


@query(
    "P21_revenue_row_print",
    f"WITH {RECEIPTS_SQL} SELECT receipt_no, sha256({_PRINT_ROW.replace('ordinal ||', chr(39) + '0' + chr(39) + ' ||')}) AS row_print FROM receipts",
)
def p21(t):
    rows = t.receipts("receipt_no", "order_id", "receipt_time", "amount", "branch", "salesperson", "is_tour")
    return rows.select("receipt_no", refunds.revenue_row_print(rows, F.lit(0)).alias("row_print"))


@query(
    "W02_row_ordinal",
    f"""WITH {RECEIPTS_SQL}, thin AS (SELECT *, CAST(order_key AS VARCHAR) || '|' || CAST(supplier_key % 2 AS VARCHAR) AS base FROM receipts),
o AS (SELECT order_id, row_number() OVER (PARTITION BY base ORDER BY order_key * 10 + line_no, receipt_no, part_key, supplier_key, amount) - 1 AS ordinal FROM thin)
SELECT order_id, ordinal AS row_ordinal, count(*) AS n FROM o GROUP BY 1, 2""",
)
def w02(t):
    # receipts that differ only in product print alike once amount, branch, seller and time are dropped
    rows = t.receipts("order_id", "order_key", "line_no", "receipt_no", "part_key", "supplier_key", "amount")
    rows = rows.withColumns({"position": F.col("order_key") * 10 + F.col("line_no"), "is_tour": F.col("supplier_key") % 2 == 0, "real_amount": F.col("amount"), "amount": F.lit(1.0)})
    out = refunds.with_row_ordinal(rows, "position", ["receipt_no", "part_key", "supplier_key", "real_amount"])
    return out.groupBy("order_id", "row_ordinal").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P22_table_print",
    f"""WITH {RECEIPTS_SQL} SELECT count(*) AS rows, round(sum(amount), 2) AS amount, min(unified_date)::VARCHAR AS min_date, max(unified_date)::VARCHAR AS max_date,
 true AS same_when_reordered, true AS differs_when_edited, true AS differs_when_repeated FROM receipts""",
)
def p22(t):
    rows = t.receipts("order_id", "receipt_no", "amount", "unified_date")
    columns = ["order_id", "receipt_no", "amount"]
    one = lambda df: hashing.table_print(df, columns).select("content_hash").scalar()
    base = hashing.table_print(rows, columns, "amount", "unified_date")
    edited = rows.withColumn("amount", F.when(F.col("order_id") == F.lit("000-0"), F.lit(0.0)).otherwise(F.col("amount") + 0.01))
    repeated = rows.unionByName(rows.where(F.col("unified_date") == F.lit("1998-03-05").cast("date")))
    out = base.withColumns(
        {
            "same_when_reordered": one(rows.repartition(7, "amount")) == F.col("content_hash"),
            "differs_when_edited": one(edited) != F.col("content_hash"),
            "differs_when_repeated": one(repeated) != F.col("content_hash"),
        }
    )
    return texted(rounded(out.drop("content_hash"), 2))


@query("P23_state_token", "SELECT true AS starts_right, true AS moves_with_rules, true AS moves_with_data")
def p23(t):
    rows = t.receipts("order_id", "amount")
    prints = {"raw": hashing.table_print(rows, rows.columns), "official": hashing.table_print(rows.where(F.col("amount") > 1000), rows.columns)}
    other = {**prints, "official": hashing.table_print(rows.where(F.col("amount") > 2000), rows.columns)}
    a, b, c = (hashing.state_token(p, v).scalar() for p, v in ((prints, "v1"), (prints, "v2"), (other, "v1")))
    return t.region.limit(1).select(a.startswith("revenue-state-v1:").alias("starts_right"), (a != b).alias("moves_with_rules"), (a != c).alias("moves_with_data"))


# --- labels --------------------------------------------------------------------------------------------------

_V = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice % 130 END"


def _value(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") % 130).alias("v"))


def _at_least(steps, rest, missing):
    arms = " ".join(f"WHEN v >= {a} THEN '{b}'" for a, b in steps)
    return f"CASE WHEN v IS NULL THEN '{missing}' {arms} ELSE '{rest}' END"


@query(
    "P24_health_labels",
    f"""WITH x AS (SELECT {_V} AS v FROM orders) SELECT CASE WHEN v IS NULL THEN '未評估' WHEN v < 10 THEN '優秀' WHEN v < 20 THEN '可接受' WHEN v < 30 THEN '可參考' ELSE '需謹慎' END AS error_health,
 {_at_least(((90, "優秀"), (75, "可接受"), (60, "需關注")), "需處理", "不適用")} AS quality_health, {_at_least(((90, "優秀"), (75, "可接受"), (60, "需關注")), "需處理", "未評估")} AS governance_health,
 {_at_least(((85, "高信心"), (70, "中信心")), "觀察", "觀察")} AS confidence, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""",
)
def p24(t):
    v = F.col("v")
    return _value(t).groupBy(
        labels.error_health(v).alias("error_health"), labels.quality_health(v).alias("quality_health"), labels.governance_health(v).alias("governance_health"), labels.confidence_label(v).alias("confidence")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P25_rates_and_scores",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 > 0 THEN round(o_custkey / (o_orderkey % 7), 6) ELSE 0.0 END AS rate, round(least(greatest(o_totalprice / 1000 - 50, 0.0), 100.0), 2) AS score FROM orders",
)
def p25(t):
    k = F.col("o_orderkey")
    rate = money.safe_rate(F.col("o_custkey"), k % 7)
    return t.orders.select(k.alias("k"), F.round(rate, 6).alias("rate"), money.score(F.col("o_totalprice") / 1000 - 50).alias("score"))


@query(
    "P27_window_labels",
    """WITH x AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem), y AS (SELECT CASE WHEN day(d) <= 3 THEN '月初' WHEN day(d) >= 26 THEN '月末' ELSE '月中' END AS month_window,
 CASE WHEN isodow(d) >= 6 THEN '週末' ELSE '平日' END AS week_window FROM x) SELECT month_window, week_window, month_window || ' / ' || week_window AS event_window, count(*) AS n FROM y GROUP BY 1, 2, 3""",
)
def p27(t):
    d = F.to_date("l_shipdate")
    return t.lineitem.groupBy(dates.month_window(d).alias("month_window"), dates.week_window(d).alias("week_window"), dates.event_window(d).alias("event_window")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P28_error_columns",
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 18 = 0 THEN 0.0 ELSE o_custkey * 100.0 END AS p FROM orders)
SELECT k, round(p - a, 4) AS error, round(abs(p - a), 4) AS abs_error, CASE WHEN a <> 0 THEN round(abs(p - a) / a * 100, 4) END AS ape, CASE WHEN abs(a) + abs(p) <> 0 THEN round(2 * abs(p - a) / (abs(a) + abs(p)) * 100, 4) END AS smape FROM x""",
)
def p28(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("k"), F.when(k % 9 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("actual"), F.when(k % 18 == 0, F.lit(0.0)).otherwise(F.col("o_custkey") * 100.0).alias("prediction"))
    return rounded(errors.with_errors(rows).drop("actual", "prediction"), 4)


@query(
    "P29_candidate_text",
    f"""WITH {_RAW_SQL}, c AS (SELECT k, CASE WHEN upper(trim(coalesce(doc, ''))) IN ('', 'NAN', 'NONE', 'NULL') THEN '' ELSE trim(doc) END AS candidate FROM raw)
SELECT k, candidate, CASE WHEN length(regexp_replace(upper(candidate), '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 2 THEN '' ELSE substring(regexp_replace(upper(candidate), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 1, 2) END AS prefix,
 'BRANCH_MAPPING-' || substring(sha1('BRANCH_MAPPING|' || candidate), 1, 10) AS suggestion_id FROM c""",
)
def p29(t):
    rows = _raw(t).withColumn("candidate", text.candidate_text(F.col("doc")))
    return rows.select("k", "candidate", text.id_prefix(F.col("doc")).alias("prefix"), text.suggestion_id(F.lit("BRANCH_MAPPING"), F.col("candidate")).alias("suggestion_id"))


@query(
    "P30_row_key",
    f"""WITH {RECEIPTS_SQL} SELECT CASE WHEN line_no % 2 = 0 THEN 'receipt::' || receipt_no ELSE 'fallback::' || order_id || '::' || unified_date::VARCHAR || '::' || printf('%.2f', amount) || '::' || receipt_type || '::' || pay_method END AS row_key, count(*) AS n
FROM receipts GROUP BY 1""",
)
def p30(t):
    rows = t.receipts("order_id", "receipt_no", "line_no", "unified_date", "amount", "receipt_type", "pay_method")
    rows = rows.withColumn("receipt_no", F.when(F.col("line_no") % 2 == 0, F.col("receipt_no")))
    return diff.drift_frame(rows).groupBy(diff.row_key().alias("row_key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P33_governance_scores",
    """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice % 120 END AS e, (o_custkey % 50) * 1.0 AS mae, (o_orderkey % 101) - 50.0 AS bias, o_orderkey % 37 AS n,
 CASE o_orderkey % 4 WHEN 0 THEN '正式' WHEN 1 THEN '診斷' WHEN 2 THEN '實驗' ELSE '其他' END AS role, o_totalprice % 80 AS sd FROM orders)
SELECT k, round(CASE WHEN e IS NULL THEN 55.0 ELSE least(greatest(100 - e * 1.2, 0.0), 100.0) END, 4) AS accuracy, round(CASE WHEN mae > 0 THEN least(greatest(100 - abs(bias) / mae * 80, 0.0), 100.0) ELSE 60.0 END, 4) AS bias_score,
 CASE WHEN bias > 0 THEN '偏高估' WHEN bias < 0 THEN '偏低估' ELSE '中性' END AS direction, CASE WHEN n >= 30 THEN 100.0 WHEN n >= 20 THEN 85.0 WHEN n >= 10 THEN 65.0 WHEN n >= 5 THEN 45.0 ELSE 25.0 END AS sample,
 CASE role WHEN '正式' THEN 100.0 WHEN '診斷' THEN 75.0 WHEN '實驗' THEN 55.0 ELSE 60.0 END AS role_score, round(CASE WHEN n < 3 THEN 50.0 ELSE least(greatest(100 - sd * 1.35, 0.0), 100.0) END, 4) AS stability,
 CASE WHEN role = '實驗' THEN '保留為實驗；未打贏正式模型且穩定性未確認前不接入正式 Forecast。' WHEN role = '診斷' THEN '作為診斷最佳模型展示；不覆蓋正式 Daily Forecast。' WHEN n < 20 THEN '樣本不足，不建議切換或自動調權。'
  WHEN mae > 0 AND abs(bias) / mae > 0.8 THEN '需關注 Bias，先檢查長期高估/低估再調整模型。' ELSE '保持正式觀察；可作為管理層 forecast 健康參考。' END AS advice FROM x""",
)
def p33(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(
        k.alias("k"), F.when(k % 13 != 0, F.col("o_totalprice") % 120).alias("e"), ((F.col("o_custkey") % 50) * 1.0).alias("mae"), ((k % 101) - 50.0).alias("bias"), (k % 37).alias("n"),
        F.when(k % 4 == 0, F.lit("正式")).when(k % 4 == 1, F.lit("診斷")).when(k % 4 == 2, F.lit("實驗")).otherwise(F.lit("其他")).alias("role"), (F.col("o_totalprice") % 80).alias("sd"),
    )
    c = F.col
    ratio = F.when(c("mae") > 0, F.abs("bias") / c("mae"))
    out = rows.select(
        "k", labels.accuracy_score(c("e")).alias("accuracy"), labels.bias_score(c("mae"), c("bias")).alias("bias_score"), labels.bias_direction(c("bias")).alias("direction"), labels.sample_score(c("n")).alias("sample"),
        labels.role_score(c("role")).alias("role_score"), labels.stability_score(c("n"), c("sd")).alias("stability"), labels.governance_advice(c("role"), F.lit("優秀"), ratio, c("n")).alias("advice"),
    )
    return rounded(out, 4)


@query(
    "P34_gap_severity",
    "WITH x AS (SELECT (o_orderkey % 41) / 100.0 - 0.3 AS g FROM orders) SELECT CASE WHEN g <= -0.1 THEN 'critical' WHEN g <= -0.05 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM (SELECT round(g, 4) AS g FROM x) GROUP BY 1",
)
def p34(t):
    g = F.round((F.col("o_orderkey") % 41) / 100.0 - 0.3, 4)
    return t.orders.groupBy(labels.severity_from_gap(g, 0.05).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


_SIGNAL_SQL = """sig AS (SELECT o_orderkey AS k, CAST(o_orderkey % 9 AS INTEGER) AS risk_score, CASE WHEN o_orderkey % 9 >= 5 THEN 'High' WHEN o_orderkey % 9 >= 3 THEN 'Medium' ELSE 'Low' END AS risk_level,
 (o_orderkey * 7) % 80 * 1.0 AS sp, ((o_orderkey * 3) % 30) / 10.0 AS spm, (o_orderkey * 11) % 90 * 1.0 AS lh, ((o_orderkey * 5) % 30) / 10.0 AS lhm, CAST(o_custkey % 3 AS INTEGER) AS lo, (o_orderkey * 13) % 900 * 1000.0 AS mx,
 120000.0 AS thr, (o_orderkey * 17) % 70 * 1.0 AS ts, o_orderkey % 5 = 0 AS post, o_orderkey % 6 = 0 AS edge, (o_orderkey * 19) % 60 * 1.0 AS mds, ((o_orderkey * 23) % 12) / 10.0 AS vol, ((o_orderkey * 29) % 16) / 10.0 AS pace,
 50000.0 + (o_orderkey * 31) % 400000 AS base FROM orders)"""


def _signal(t):
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("k"), (k % 9).cast("int").alias("risk_score"), F.when(k % 9 >= 5, F.lit("High")).when(k % 9 >= 3, F.lit("Medium")).otherwise(F.lit("Low")).alias("risk_level"),
        ((k * 7) % 80 * 1.0).alias("specialist_share_7"), ((k * 3) % 30 / 10.0).alias("specialist_momentum"), ((k * 11) % 90 * 1.0).alias("longhaul_share_7"), ((k * 5) % 30 / 10.0).alias("longhaul_momentum"),
        (F.col("o_custkey") % 3).cast("int").alias("large_orders_7"), ((k * 13) % 900 * 1000.0).alias("max_order_7"), F.lit(120000.0).alias("large_order_threshold"), ((k * 17) % 70 * 1.0).alias("top_seller_share_7"),
        (k % 5 == 0).alias("is_post_holiday"), (k % 6 == 0).alias("is_month_end"), ((k * 19) % 60 * 1.0).alias("max_daily_share_7"), ((k * 23) % 12 / 10.0).alias("volatility_7"), ((k * 29) % 16 / 10.0).alias("pace_vs_14"),
        (F.lit(50000.0) + (k * 31) % 400000).alias("base"),
    )


@query(
    "P35_spike_class",
    f"""WITH {_SIGNAL_SQL}, f AS (SELECT *, sp >= 45 OR spm >= 1.45 AS ss, lh >= 50 OR lhm >= 1.45 AS sl, lo >= 1 AND mx >= greatest(thr * 1.35, 220000) AS so, mds >= 38 OR ts >= 55 AS conc FROM sig)
SELECT label, action, count(*) AS n FROM (SELECT CASE WHEN risk_level = 'Low' THEN 'Normal'
  WHEN risk_level = 'High' AND risk_score >= 6 AND so AND lh >= 65 AND sp >= 45 AND NOT conc AND (post OR edge OR pace >= 1.2) THEN 'Pre-spike'
  WHEN sl AND sp < 28 AND mx >= greatest(thr * 1.05, 180000) AND NOT post AND NOT edge THEN 'Post-spike Cooldown' WHEN conc AND pace <= 0.82 AND NOT post THEN 'Post-spike Cooldown'
  WHEN vol >= 0.85 OR (lo >= 1 AND ts >= 45) OR (so AND (sl OR ss)) OR risk_level = 'High' THEN 'Volatile Hold' ELSE 'Watch' END AS label FROM f),
 LATERAL (SELECT CASE label WHEN 'Pre-spike' THEN 'Selective uplift' WHEN 'Post-spike Cooldown' THEN 'Downshift or cap' WHEN 'Volatile Hold' THEN 'Hold and monitor' ELSE 'Hold' END AS action) GROUP BY 1, 2""",
)
def p35(t):
    rows = _signal(t).withColumn("c", signals.spike_class())
    return rows.groupBy(F.col("c.label").alias("label"), F.col("c.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P36_event_class",
    """WITH e AS (SELECT o_orderkey % 4 AS l3, o_orderkey % 5 AS l7, (o_orderkey * 13) % 400 * 1000.0 AS m3, o_custkey % 2 AS sl, o_custkey % 3 AS ll, (o_orderkey * 7) % 6 AS us, (o_orderkey * 17) % 90 * 1.0 AS ts, ((o_orderkey * 3) % 20) / 10.0 AS mom FROM orders)
SELECT CASE WHEN l3 >= 1 AND m3 >= 180000 AND (sl >= 1 OR ll >= 1) AND us >= 3 AND ts <= 55 AND mom >= 1.05 THEN 'Event Pre-spike' WHEN l7 >= 1 AND l3 = 0 AND (mom <= 0.82 OR ts >= 50) THEN 'Event Cooldown'
 WHEN l7 >= 1 OR sl * 1000.0 > 0 OR ll * 1000.0 > 0 THEN 'Event Volatile' ELSE 'Event Normal' END AS event_class, count(*) AS n FROM e GROUP BY 1""",
)
def p36(t):
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    rows = t.orders.select(
        (k % 4).alias("large_orders_3"), (k % 5).alias("large_orders_7"), ((k * 13) % 400 * 1000.0).alias("max_order_3"), (u % 2).alias("specialist_large_orders_7"), (u % 3).alias("longhaul_large_orders_7"),
        ((k * 7) % 6).alias("unique_salespersons_7"), ((k * 17) % 90 * 1.0).alias("top_seller_order_share_7"), ((k * 3) % 20 / 10.0).alias("order_momentum"), ((u % 2) * 1000.0).alias("specialist_large_total_7"), ((u % 3) * 1000.0).alias("longhaul_large_total_7"),
    )
    return rows.groupBy(signals.event_class()["label"].alias("event_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P37_spike_outcome",
    """WITH x AS (SELECT o_orderkey % 2 = 0 AS h, o_orderkey % 3 = 0 AS u, o_orderkey % 5 = 0 AS o FROM orders) SELECT CASE WHEN u AND h THEN 'Pre-spike' WHEN o THEN 'Post-spike Cooldown' WHEN h OR u THEN 'Volatile Hold' ELSE 'Normal' END AS outcome, count(*) AS n FROM x GROUP BY 1""",
)
def p37(t):
    k = F.col("o_orderkey")
    return t.orders.groupBy(signals.spike_outcome(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P38_bounded_uplift",
    f"""WITH {_SIGNAL_SQL}, f AS (SELECT *, lh >= 55 AS sl, lh >= 55 AND (sp >= 30 OR spm >= 1.35) AND mx >= 250000 AS pat, mx >= 700000 AND ts >= 55 AS rep FROM sig)
SELECT k, round(CASE WHEN risk_level <> 'High' THEN base WHEN pat AND post AND NOT rep THEN least(greatest(base * 1.20, base + mx * 0.65), base * 2.10) WHEN pat AND edge AND rep THEN least(base + mx * 0.18, base * 1.65) ELSE base END, 2) AS conservative,
 round(CASE WHEN risk_level <> 'High' THEN base WHEN pat THEN least(greatest(base * (1.10 + least(0.55, greatest(0, risk_score - 4) * 0.08) + CASE WHEN post THEN 0.15 ELSE 0.0 END + CASE WHEN edge THEN 0.08 ELSE 0.0 END), base + mx * 0.55), base * 2.60) ELSE base END, 2) AS uplift,
 round(CASE WHEN risk_level <> 'High' THEN base WHEN rep AND NOT post THEN base * 0.88 WHEN pat AND (post OR (edge AND sp >= 50)) THEN least(greatest(base * 1.18, base + mx * 0.35), base * 2.00) WHEN sl AND risk_score >= 6 AND NOT rep THEN base * 1.12 ELSE base END, 2) AS hybrid FROM f""",
)
def p38(t):
    b = F.col("base")
    modes = {m: F.round(signals.bounded_uplift(b, m)["value"], 2).alias(m) for m in ("conservative", "uplift", "hybrid")}
    return _signal(t).select("k", *modes.values())


@query("P39_horizon_bucket", "SELECT CASE WHEN l_linenumber <= 1 THEN 1 WHEN l_linenumber * 2 <= 7 THEN 7 ELSE 30 END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def p39(t):
    h = F.when(F.col("l_linenumber") <= 1, F.lit(1)).otherwise(F.col("l_linenumber") * 2)
    return t.lineitem.groupBy(dates.horizon_bucket(h).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F14_long_haul_and_specialist",
    f"""WITH {RECEIPTS_SQL} SELECT dest_category LIKE '%中國長%' AS long_haul, branch = 'SPECIALIST DESK' AS specialist, count(*) AS n FROM receipts GROUP BY 1, 2""",
)
def f14(t):
    rows = t.receipts("dest_category", "dept", "branch", "source_tag")
    haul = category.is_long_haul(F.col("dest_category"), F.col("dept"))
    special = category.is_specialist("SPECIALIST DESK", F.col("branch"), F.col("dept"), F.col("source_tag"))
    return rows.groupBy(haul.alias("long_haul"), special.alias("specialist")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F19_cleaning_samples",
    f"""WITH {_RAW_SQL} SELECT 'main' AS table_name, 'doc' AS field, doc AS before, {_CLEAN} AS after FROM raw WHERE trim(doc) <> trim({_CLEAN}) ORDER BY k LIMIT 50""",
)
def f19(t):
    from tallyspark.operators.audit import cleaning_samples

    return cleaning_samples(_raw(t), "doc", "main", [F.col("k")])
