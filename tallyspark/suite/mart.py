"""Report mart and dashboard checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.category import route_category, ticket_category
from tallyspark.operators import dashboards as d
from tallyspark.operators import mart as m
from tallyspark.operators.filters import Period
from tallyspark.plans import dashboard as plan
from tallyspark.suite.base import ALL_ROLES, CRUISE_BRANDS, DESK, NATIONS, OFFICIAL_SQL, RULES, SPECIALISTS, TIES, query, rounded, texted

_CRUISE = ", ".join(f"'{b}'" for b in CRUISE_BRANDS)
_TARGETS = ", ".join(f"'{n}'" for n in NATIONS.values())
_ENTITIES = ", ".join(f"('{c}', '{n}')" for c, n in NATIONS.items())
_REPS = ", ".join(f"('{s}', '{s}')" for s in SPECIALISTS)
_REP_LIST = ", ".join(f"'{s}'" for s in SPECIALISTS)

_LINED = f"""lined AS (SELECT *, CASE WHEN NOT is_tour THEN 'ticket' WHEN dept IN ({_CRUISE}) THEN 'cruise' ELSE 'tour' END AS line FROM official),
days AS (SELECT DISTINCT unified_date FROM official)"""


def _facts_sql(name: str, listed: str, key: str, where: str, kind: str) -> str:
    return f"""{name} AS (SELECT code, name AS entity, {kind} AS kind, d.unified_date AS day, strftime(d.unified_date, '%Y-%m') AS month,
 coalesce(tour, 0.0) AS tour, coalesce(cruise, 0.0) AS cruise, coalesce(ticket, 0.0) AS ticket
 FROM (VALUES {listed}) AS e(code, name) CROSS JOIN days d LEFT JOIN (SELECT {key} AS k, unified_date,
   coalesce(sum(amount) FILTER (line = 'tour'), 0.0) AS tour, coalesce(sum(amount) FILTER (line = 'cruise'), 0.0) AS cruise,
   coalesce(sum(amount) FILTER (line = 'ticket'), 0.0) AS ticket FROM lined WHERE {where} GROUP BY 1, 2) s
 ON s.k = e.name AND s.unified_date = d.unified_date)"""


BRANCH_FACTS = _facts_sql("branch_facts", _ENTITIES, "branch", f"branch <> '{DESK}'", "'其他'")
SPECIALIST_FACTS = _facts_sql("specialist_facts", _REPS, "salesperson", f"branch = '{DESK}'", "'專職銷售'")
FACTS_SQL = f"{OFFICIAL_SQL}, {_LINED}, {BRANCH_FACTS}, {SPECIALIST_FACTS}"
_BOTH = """facts AS (SELECT entity, day, tour, cruise, ticket, 'branch' AS channel FROM branch_facts
 UNION ALL SELECT entity, day, tour, cruise, ticket, 'specialist' FROM specialist_facts)"""

_ROUTE = f"""CASE WHEN dept IN ({_CRUISE}) THEN '郵輪' WHEN dest_category LIKE '%海外%' THEN '海外' WHEN dest_category LIKE '%港%' THEN '港澳'
 WHEN dest_category LIKE '%中國長線%' THEN '中國長線' WHEN dest_category = '' THEN '其他' ELSE dest_category END"""
_TICKET = """CASE WHEN source_tag LIKE '%未匹配%' THEN NULL WHEN source_tag LIKE '%酒店%' THEN '酒店' WHEN source_tag LIKE '%套票%' THEN '套票'
 WHEN tour_name LIKE '%機票%' THEN '機票' WHEN tour_name LIKE '%高鐵%' THEN '高鐵' WHEN tour_name LIKE '%船票%' THEN '船票'
 WHEN tour_name LIKE '%巴士%' THEN '巴士票' WHEN source_tag LIKE '%門券%' THEN '其它門券' END"""
_FIRST = f"""first_receipts AS (SELECT *, {_ROUTE} AS route, CAST(trans_time AS DATE) AS tday FROM (SELECT *, row_number() OVER (PARTITION BY order_id
 ORDER BY trans_time NULLS LAST, receipt_time, receipt_no, part_key, supplier_key, amount) AS rn FROM official WHERE is_tour) WHERE rn = 1)"""
_TICKETS = f"tickets AS (SELECT * FROM (SELECT *, {_TICKET} AS ticket, CAST(trans_time AS DATE) AS tday FROM official WHERE NOT is_tour) WHERE ticket IS NOT NULL)"

_TARGET = f"branch IN ({_TARGETS})"
_IS_DESK = f"branch = '{DESK}'"


def _mart(t, *roles: str) -> m.Mart:
    return m.Mart(t.official(*(roles or ALL_ROLES)), RULES, TIES)


_FACT_ROLES = ("branch", "salesperson", "unified_date", "amount", "dept")
_FIRST_ROLES = ("dest_category", "days", "qty", "trans_time", *_FACT_ROLES, *TIES)
_TICKET_ROLES = ("tour_name", "source_tag", "qty", "trans_time", "days", *_FACT_ROLES)


def _facts(t):
    return _mart(t, *_FACT_ROLES).facts()


def _branch(t):
    return d.of_channel(_facts(t), "branch")


# --- scalar categories ---------------------------------------------------------------------------------------


@query(
    "P07_route_category",
    f"WITH {OFFICIAL_SQL} SELECT dept, dest_category, {_ROUTE} AS route, count(*) AS receipts FROM receipts WHERE is_tour GROUP BY 1, 2, 3",
)
def p07(t):
    tour, _ = t.split("dept", "dest_category")
    route = route_category(F.col("dept"), F.col("dest_category"), CRUISE_BRANDS)
    return tour.groupBy("dept", "dest_category", route.alias("route")).agg(F.count(F.lit(1)).alias("receipts"))


@query(
    "P08_ticket_category",
    f"WITH {OFFICIAL_SQL} SELECT tour_name, source_tag, {_TICKET} AS ticket, count(*) AS receipts FROM receipts WHERE NOT is_tour GROUP BY 1, 2, 3",
)
def p08(t):
    _, others = t.split("tour_name", "source_tag")
    ticket = ticket_category(F.col("tour_name"), F.col("source_tag"))
    return others.groupBy("tour_name", "source_tag", ticket.alias("ticket")).agg(F.count(F.lit(1)).alias("receipts"))


# --- mart ----------------------------------------------------------------------------------------------------


def _select_facts(name: str, cte: str = FACTS_SQL) -> str:
    return f"""WITH {cte} SELECT code, entity, kind, day::VARCHAR AS day, month, round(tour, 2) AS tour, round(cruise, 2) AS cruise, round(ticket, 2) AS ticket FROM {name}"""


@query("A01_branch_daily_facts", _select_facts("branch_facts"))
def a01(t):
    return rounded(texted(_mart(t, *_FACT_ROLES).branch_facts()), 2)


@query("A02_specialist_daily_facts", _select_facts("specialist_facts"))
def a02(t):
    return rounded(texted(_mart(t, *_FACT_ROLES).specialist_facts()), 2)


@query(
    "A03_branch_salesperson_daily",
    f"""WITH {OFFICIAL_SQL}, {_LINED}, scoped_first AS (SELECT *, CAST(trans_time AS DATE) AS tday FROM (SELECT *, row_number() OVER (PARTITION BY order_id
 ORDER BY trans_time NULLS LAST, receipt_time, receipt_no, part_key, supplier_key, amount) AS rn FROM official WHERE is_tour AND {_TARGET}) WHERE rn = 1), {_TICKETS},
parts AS (SELECT branch, salesperson, unified_date AS day, line, amount FROM lined WHERE {_TARGET}
 UNION ALL SELECT branch, salesperson, tday, 'people', qty FROM scoped_first
 UNION ALL SELECT branch, salesperson, tday, 'quantity', qty FROM tickets WHERE {_TARGET}),
wide AS (SELECT branch, salesperson, day, coalesce(sum(amount) FILTER (line = 'tour'), 0.0) AS tour, coalesce(sum(amount) FILTER (line = 'cruise'), 0.0) AS cruise,
 coalesce(sum(amount) FILTER (line = 'ticket'), 0.0) AS ticket, coalesce(sum(amount) FILTER (line = 'people'), 0.0) AS tour_people,
 coalesce(sum(amount) FILTER (line = 'quantity'), 0.0) AS ticket_quantity FROM parts GROUP BY 1, 2, 3)
SELECT branch, '其他' AS kind, salesperson, day::VARCHAR AS day, strftime(day, '%Y-%m') AS month, round(tour, 2) AS tour, round(cruise, 2) AS cruise,
 round(ticket, 2) AS ticket, tour_people, ticket_quantity FROM wide WHERE tour <> 0 OR cruise <> 0 OR ticket <> 0 OR tour_people <> 0 OR ticket_quantity <> 0""",
)
def a03(t):
    return rounded(texted(_mart(t).branch_salesperson_facts()), 2)


_DAYS_LABEL = "CASE WHEN days = floor(days) THEN CAST(CAST(days AS BIGINT) AS VARCHAR) ELSE CAST(days AS VARCHAR) END"


def _people_sql(where: str) -> str:
    return f"""WITH {OFFICIAL_SQL}, {_FIRST} SELECT route, {_DAYS_LABEL} AS days, tday::VARCHAR AS day, strftime(tday, '%Y-%m') AS month, sum(qty) AS people
FROM first_receipts WHERE {where} GROUP BY route, days, tday HAVING sum(qty) > 0"""


@query("A04_tour_people_branch", _people_sql(_TARGET))
def a04_branch(t):
    return texted(_mart(t, *_FIRST_ROLES).tour_people("branch"))


@query("A04_tour_people_specialist", _people_sql(_IS_DESK))
def a04_specialist(t):
    return texted(_mart(t, *_FIRST_ROLES).tour_people("specialist"))


_TICKET_RANK = "list_position(['船票','巴士票','機票','高鐵','其它門券','套票','酒店'], ticket)"
_TICKET_RANK_DAILY = "list_position(['其它門券','巴士票','船票','高鐵','機票','酒店','套票'], ticket)"


def _quantity_sql(where: str) -> str:
    return f"""WITH {OFFICIAL_SQL}, {_TICKETS} SELECT ticket, tday::VARCHAR AS day, strftime(tday, '%Y-%m') AS month, sum(qty) AS quantity,
 CAST({_TICKET_RANK} AS BIGINT) AS ticket_rank FROM tickets WHERE {where} GROUP BY ticket, tday HAVING sum(qty) > 0"""


@query("A05_ticket_quantity_branch", _quantity_sql(_TARGET))
def a05_branch(t):
    return texted(_mart(t, *_TICKET_ROLES).ticket_quantity("branch"))


@query("A05_ticket_quantity_specialist", _quantity_sql(_IS_DESK))
def a05_specialist(t):
    return texted(_mart(t, *_TICKET_ROLES).ticket_quantity("specialist"))


@query("A05_ticket_quantity_all", _quantity_sql("true"))
def a05_all(t):
    return texted(_mart(t, *_TICKET_ROLES).ticket_quantity("all"))


def _daily_people_sql(entity: str, where: str) -> str:
    return f"""WITH {OFFICIAL_SQL}, {_FIRST} SELECT * FROM (SELECT {entity} AS entity, tday::VARCHAR AS day, strftime(tday, '%Y-%m') AS month,
 coalesce(sum(qty) FILTER (route <> '郵輪'), 0.0) AS tour_people, coalesce(sum(qty) FILTER (route = '郵輪'), 0.0) AS cruise_people
 FROM first_receipts WHERE {where} GROUP BY {entity}, tday) WHERE tour_people > 0 OR cruise_people > 0"""


@query("A06_daily_people_branch", _daily_people_sql("branch", _TARGET))
def a06_branch(t):
    return texted(_mart(t, *_FIRST_ROLES).daily_people("branch"))


@query("A06_daily_people_specialist", _daily_people_sql("salesperson", _IS_DESK))
def a06_specialist(t):
    return texted(_mart(t, *_FIRST_ROLES).daily_people("specialist"))


def _daily_tickets_sql(entity: str, where: str) -> str:
    return f"""WITH {OFFICIAL_SQL}, {_TICKETS} SELECT {entity} AS entity, ticket, tday::VARCHAR AS day, strftime(tday, '%Y-%m') AS month, sum(qty) AS quantity,
 CAST({_TICKET_RANK_DAILY} AS BIGINT) AS ticket_rank FROM tickets WHERE {where} GROUP BY {entity}, ticket, tday HAVING sum(qty) > 0"""


@query("A07_daily_tickets_branch", _daily_tickets_sql("branch", _TARGET))
def a07_branch(t):
    return texted(_mart(t, *_TICKET_ROLES).daily_tickets("branch"))


@query("A07_daily_tickets_specialist", _daily_tickets_sql("salesperson", _IS_DESK))
def a07_specialist(t):
    return texted(_mart(t, *_TICKET_ROLES).daily_tickets("specialist"))


def _money_sql(table: str, kind: str, column: str) -> str:
    return f"""SELECT branch, {kind} AS {column}, {_DAYS_LABEL} AS days, tday::VARCHAR AS day, strftime(tday, '%Y-%m') AS month, round(sum(amount), 2) AS amount
FROM {table} WHERE {_TARGET} GROUP BY branch, {kind}, days, tday HAVING sum(amount) <> 0"""


@query(
    "A08_branch_route_money",
    f"WITH {OFFICIAL_SQL}, routed AS (SELECT *, {_ROUTE} AS route, CAST(trans_time AS DATE) AS tday FROM official WHERE is_tour) "
    + _money_sql("routed", "route", "route"),
)
def a08_route(t):
    return rounded(texted(_mart(t, *_FIRST_ROLES).branch_route_money()), 2)


@query("A08_branch_ticket_money", f"WITH {OFFICIAL_SQL}, {_TICKETS} " + _money_sql("tickets", "ticket", "ticket"))
def a08_ticket(t):
    return rounded(texted(_mart(t, *_TICKET_ROLES).branch_ticket_money()), 2)


def _route_daily_sql(entity: str, where: str) -> str:
    return f"""WITH {OFFICIAL_SQL}, {_FIRST}, counts AS (SELECT {entity} AS entity, route, unified_date AS day, sum(qty) AS people FROM first_receipts WHERE {where} GROUP BY 1, 2, 3),
money AS (SELECT {entity} AS entity, {_ROUTE} AS route, unified_date AS day, sum(amount) AS amount FROM official WHERE is_tour AND {where} GROUP BY 1, 2, 3)
SELECT * FROM (SELECT entity, route, day::VARCHAR AS day, strftime(day, '%Y-%m') AS month, coalesce(people, 0.0) AS people, round(coalesce(amount, 0.0), 2) AS amount
 FROM counts FULL JOIN money USING (entity, route, day)) WHERE people <> 0 OR amount <> 0"""


@query("A09_route_daily_branch", _route_daily_sql("branch", _TARGET))
def a09_branch(t):
    return rounded(texted(_mart(t, *_FIRST_ROLES).route_daily("branch")), 2)


@query("A09_route_daily_specialist", _route_daily_sql("salesperson", f"{_IS_DESK} AND salesperson IN ({_REP_LIST})"))
def a09_specialist(t):
    return rounded(texted(_mart(t, *_FIRST_ROLES).route_daily("specialist")), 2)


@query(
    "A10_facts_by_line",
    f"""WITH {FACTS_SQL}, both_facts AS (SELECT 'branch' AS channel, * FROM branch_facts UNION ALL SELECT 'specialist', * FROM specialist_facts)
SELECT channel, code, entity, kind, day::VARCHAR AS day, month, line, round(amount, 2) AS amount FROM both_facts UNPIVOT (amount FOR line IN (tour, cruise, ticket))""",
)
def a10(t):
    return rounded(texted(_mart(t, *_FACT_ROLES).facts_long()), 2)


@query(
    "S14_detail_export",
    f"""WITH {OFFICIAL_SQL} SELECT receipt_no, '' AS receipt_state, order_id, branch, receipt_no AS summary_no, '' AS receipt_status, '' AS original_currency, '' AS fx_rate,
 printf('%.2f', amount) AS amount, '' AS base_amount, receipt_type, pay_method, '' AS pay_serial, operator, '' AS customer, '' AS sales_company, salesperson,
 strftime(receipt_time, '%Y-%m-%d %H:%M:%S') AS receipt_time, '' AS receipt_month, '' AS tour_code, tour_name, printf('%.1f', days) AS days, printf('%.1f', qty) AS qty, '' AS currency,
 '' AS receivable, '' AS received, strftime(trans_time, '%Y-%m-%d %H:%M:%S') AS trans_time, '' AS trans_month, '' AS dept_owner, dept, dest_category, '' AS dest_level1, '' AS dest_level2,
 '' AS dest_name, sub_branch, source_tag FROM official""",
)
def s14(t):
    rows = m.export_detail(t.official())
    return rows.withColumn("amount", F.format_string("%.2f", F.col("amount").cast("double")))


# --- read models ---------------------------------------------------------------------------------------------

_TOTAL = "tour + cruise + ticket"


@query(
    "A13_annual_summary",
    f"""WITH {FACTS_SQL}, {_BOTH}, y AS (SELECT year(day) AS year, sum(CASE WHEN channel = 'branch' THEN {_TOTAL} ELSE 0 END) AS b,
 sum(CASE WHEN channel = 'specialist' THEN {_TOTAL} ELSE 0 END) AS s FROM facts GROUP BY 1)
SELECT CAST(year AS INTEGER) AS year, round(b, 2) AS branch_revenue, round(s, 2) AS specialist_revenue, round(b + s, 2) AS combined_revenue,
 CASE WHEN b + s <> 0 THEN round(b / (b + s) * 100, 2) ELSE 0.0 END AS branch_share_pct,
 CASE WHEN b + s <> 0 THEN round(s / (b + s) * 100, 2) ELSE 0.0 END AS specialist_share_pct FROM y""",
)
def a13(t):
    return rounded(d.annual_summary(_facts(t)), 2)


@query(
    "A14_monthly_trend",
    f"""WITH {FACTS_SQL}, {_BOTH} SELECT strftime(day, '%Y-%m') AS month, round(sum(CASE WHEN channel = 'branch' THEN {_TOTAL} ELSE 0 END), 2) AS branch_revenue,
 round(sum(CASE WHEN channel = 'specialist' THEN {_TOTAL} ELSE 0 END), 2) AS specialist_revenue, round(sum({_TOTAL}), 2) AS combined_revenue FROM facts GROUP BY 1""",
)
def a14(t):
    return rounded(d.monthly_trend(_facts(t)), 2)


def _product_sql(source: str) -> str:
    return f"""SELECT product, round(revenue, 2) AS revenue, CASE WHEN total <> 0 THEN round(revenue / total * 100, 2) ELSE 0.0 END AS share_pct
FROM (SELECT sum(tour) AS tour, sum(cruise) AS cruise, sum(ticket) AS ticket, sum({_TOTAL}) AS total FROM {source}) UNPIVOT (revenue FOR product IN (tour, cruise, ticket))"""


@query(
    "A15_product_totals",
    f"""WITH {FACTS_SQL}, {_BOTH} SELECT 'branch' AS channel, * FROM ({_product_sql("branch_facts")})
UNION ALL SELECT 'specialist', * FROM ({_product_sql("specialist_facts")}) UNION ALL SELECT 'combined', * FROM ({_product_sql("facts")})""",
)
def a15(t):
    model = d.facts_read_model(_facts(t))
    out = None
    for channel, name in (("branch", "branch_products"), ("specialist", "specialist_products"), ("combined", "combined_products")):
        part = model[name].withColumn("channel", F.lit(channel))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 2)


@query(
    "A16_revenue_totals",
    f"""WITH {FACTS_SQL}, b AS (SELECT sum({_TOTAL}) AS v FROM branch_facts WHERE year(day) = 1997), s AS (SELECT sum({_TOTAL}) AS v FROM specialist_facts WHERE year(day) = 1997),
one AS (SELECT sum({_TOTAL}) AS v FROM branch_facts WHERE year(day) = 1997 AND entity = 'NATION_7')
SELECT 'all' AS view, round(b.v, 2) AS branch_revenue, round(s.v, 2) AS specialist_revenue, round(b.v + s.v, 2) AS combined_revenue FROM b, s
UNION ALL SELECT 'one branch', round(v, 2), 0.0, round(v, 2) FROM one""",
)
def a16(t):
    facts = _facts(t)
    year = Period(years=(1997,))
    a = d.revenue_totals(facts, year).withColumn("view", F.lit("all"))
    b = d.revenue_totals(facts, year, entity="NATION_7").withColumn("view", F.lit("one branch"))
    return rounded(a.unionByName(b), 2)


@query(
    "A17_kpi_row",
    f"""WITH {FACTS_SQL}, f AS (SELECT sum(tour) AS tour, sum(cruise) AS cruise, sum(ticket) AS ticket, count(DISTINCT entity) AS branch_count FROM branch_facts WHERE year(day) = 1998)
SELECT round(tour, 2) AS tour, round(cruise, 2) AS cruise, round(ticket, 2) AS ticket, branch_count, round({_TOTAL}, 2) AS total,
 (SELECT count(DISTINCT salesperson) FROM official WHERE year(unified_date) = 1998) AS salesperson_count,
 round(tour / ({_TOTAL}) * 100, 1) AS tour_share_pct, round(cruise / ({_TOTAL}) * 100, 1) AS cruise_share_pct, round(ticket / ({_TOTAL}) * 100, 1) AS ticket_share_pct FROM f""",
)
def a17(t):
    mart = _mart(t, *_FACT_ROLES)
    return rounded(d.kpi_row(mart.facts(), mart.receipts, Period(years=(1998,))), 2)


def _ranking_sql(source: str, where: str = "true", limit: str = "", share_over: str = "all_rows") -> str:
    return f""", totals AS (SELECT entity, sum(tour) AS tour, sum(cruise) AS cruise, sum(ticket) AS ticket, sum({_TOTAL}) AS total_revenue FROM {source} WHERE {where} GROUP BY 1),
ranked AS (SELECT row_number() OVER (ORDER BY total_revenue DESC, entity) AS rank, * FROM totals)
SELECT CAST(rank AS INTEGER) AS rank, entity, round(tour, 2) AS tour, round(cruise, 2) AS cruise, round(ticket, 2) AS ticket, round(total_revenue, 2) AS total_revenue,
 CASE WHEN (SELECT sum(total_revenue) FROM ranked {share_over}) <> 0 THEN round(total_revenue / (SELECT sum(total_revenue) FROM ranked {share_over}) * 100, 2) ELSE 0.0 END AS share_pct FROM ranked {limit}"""


@query("W07_branch_ranking", f"WITH {FACTS_SQL}" + _ranking_sql("branch_facts", share_over=""))
def w07(t):
    return rounded(d.ranking(_branch(t)), 2)


@query("W07_specialist_ranking", f"WITH {FACTS_SQL}" + _ranking_sql("specialist_facts", share_over=""))
def w07_specialist(t):
    return rounded(d.ranking(d.of_channel(_facts(t), "specialist")), 2)


@query("W07_share_after_top", f"WITH {FACTS_SQL}" + _ranking_sql("branch_facts", limit="WHERE rank <= 20", share_over="WHERE rank <= 20"))
def w07_after(t):
    return rounded(d.ranking(_branch(t), top=20, share_after_top=True), 2)


@query("K02_top20_ranking", f"WITH {FACTS_SQL}" + _ranking_sql("branch_facts", limit="WHERE rank <= 20", share_over=""))
def k02(t):
    return rounded(d.ranking(_branch(t), top=20), 2)


@query(
    "K01_reports_in_category_order",
    f"""WITH {OFFICIAL_SQL}, {_TICKETS}, s AS (SELECT ticket, tday, sum(qty) AS quantity, {_TICKET_RANK} AS r FROM tickets GROUP BY 1, 2 HAVING sum(qty) > 0)
SELECT CAST(row_number() OVER (ORDER BY r, tday) AS INTEGER) AS position, ticket, tday::VARCHAR AS day, quantity FROM s""",
)
def k01(t):
    from pyspark.sql import Window

    # one row per ticket category and day: the report itself, already aggregated
    rows = _mart(t, *_TICKET_ROLES).ticket_quantity("all")
    position = F.row_number().over(Window.orderBy("ticket_rank", "day")).alias("position")
    return texted(rows.select(position, "ticket", "day", "quantity"))


@query(
    "K10_top_slices",
    f"""WITH {FACTS_SQL}, totals AS (SELECT entity, sum({_TOTAL}) AS v FROM branch_facts GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY v DESC, entity) AS rn, count(*) OVER () AS n FROM totals WHERE v > 0)
SELECT CASE WHEN n > 7 AND rn > 6 THEN '其他' ELSE entity END AS label, round(sum(v), 2) AS value FROM p GROUP BY 1""",
)
def k10(t):
    return rounded(d.top_slices(d.entity_totals(_branch(t)), "entity", "total_revenue"), 2)


@query(
    "A20_reconciliation",
    f"""WITH {FACTS_SQL}, {_BOTH}, b AS (SELECT round(sum({_TOTAL}), 2) AS v FROM branch_facts), s AS (SELECT round(sum({_TOTAL}), 2) AS v FROM specialist_facts), c AS (SELECT round(sum({_TOTAL}), 2) AS v FROM facts)
SELECT k AS check_key, v AS expected, v AS actual, 0.0 AS delta, 'matched' AS status FROM (SELECT unnest(['annual_total', 'monthly_total']) AS k, v FROM c
 UNION ALL SELECT unnest(['branch_ranking_total', 'branch_product_total']), v FROM b UNION ALL SELECT unnest(['specialist_ranking_total', 'specialist_product_total']), v FROM s)""",
)
def a20(t):
    return rounded(d.reconciliation(_facts(t)), 2)


@query(
    "A21_product_drilldown",
    f"""WITH {OFFICIAL_SQL}, {_TICKETS}, routes AS (SELECT {_ROUTE} AS category, sum(amount) AS value FROM official WHERE is_tour AND NOT {_IS_DESK} GROUP BY 1),
t AS (SELECT ticket AS category, sum(qty) AS value FROM tickets WHERE {_IS_DESK} GROUP BY 1)
SELECT 'branch routes by money' AS view, category, round(value, 2) AS value, round(value / (SELECT sum(value) FROM routes) * 100, 4) AS share_pct FROM routes
UNION ALL SELECT 'specialist tickets by quantity', category, round(value, 2), round(value / (SELECT sum(value) FROM t) * 100, 4) FROM t""",
)
def a21(t):
    mart = _mart(t, *_TICKET_ROLES, "dest_category")
    route = route_category(F.col("dept"), F.col("dest_category"), CRUISE_BRANDS)
    ticket = ticket_category(F.col("tour_name"), F.col("source_tag"))
    a = d.drilldown(mart.tour.where(~mart.is_desk()), route, "amount").withColumn("view", F.lit("branch routes by money"))
    b = d.drilldown(mart.others.where(mart.is_desk()), ticket, "qty").withColumn("view", F.lit("specialist tickets by quantity"))
    return rounded(rounded(a.unionByName(b), 2, "value"), 4, "share_pct")


@query(
    "A22_year_summary",
    f"""WITH {FACTS_SQL}, {_BOTH}, long AS (SELECT year(day) AS year, channel, product, revenue FROM facts UNPIVOT (revenue FOR product IN (tour, cruise, ticket)))
SELECT CAST(year AS INTEGER) AS year, coalesce(channel, 'all') AS channel, coalesce(product, 'all') AS product, round(sum(revenue), 2) AS revenue
FROM long GROUP BY ROLLUP (year, channel, product) HAVING year IS NOT NULL""",
)
def a22(t):
    return rounded(d.year_summary(_facts(t)), 2)


@query(
    "A23_upload_batch_summary",
    f"""WITH {OFFICIAL_SQL} SELECT CASE WHEN is_tour THEN 'tour' ELSE 'others' END AS table_name, count(*) AS rows, count(DISTINCT order_id) AS order_ids,
 min(receipt_time)::DATE::VARCHAR AS min_date, max(receipt_time)::DATE::VARCHAR AS max_date, round(sum(amount), 2) AS amount,
 bool_or(unified_date = DATE '1998-03-05') AS has_target_day FROM receipts GROUP BY is_tour""",
)
def a23(t):
    tour, others = t.split("order_id", "receipt_time", "amount")
    return d.batch_summary(tour, "tour", "1998-03-05").unionByName(d.batch_summary(others, "others", "1998-03-05"))


@query(
    "A24_date_source_diagnostics",
    f"""WITH {OFFICIAL_SQL}, m AS (SELECT * FROM receipts WHERE unified_date <> DATE '1998-03-05'),
r AS (SELECT 'main' AS source, 'receipt_time' AS date_column, count(*) AS rows, count(*) FILTER (unified_date = DATE '1998-03-05') AS target_rows, max(unified_date)::VARCHAR AS max_date, round(sum(amount), 2) AS amount FROM m
 UNION ALL SELECT CASE WHEN is_tour THEN 'tour' ELSE 'others' END, 'trans_time', count(*), count(*) FILTER (trans_time::DATE = DATE '1998-03-05'), max(trans_time::DATE)::VARCHAR, NULL FROM receipts GROUP BY is_tour)
SELECT *, (SELECT sum(target_rows) FROM r WHERE source = 'main') = 0 AND (SELECT sum(target_rows) FROM r WHERE source <> 'main') > 0 AS date_mismatch FROM r""",
)
def a24(t):
    tour, others = t.split("receipt_time", "trans_time", "amount", "unified_date")
    main = tour.unionByName(others).where(F.col("unified_date") != F.lit("1998-03-05").cast("date"))
    return d.date_source_diagnostics(main, {"tour": tour, "others": others}, "1998-03-05")


# --- bundles -------------------------------------------------------------------------------------------------


def _sizes(datasets) -> object:
    """Row count per dataset of a bundle."""
    out = None
    for name, frame in datasets.items():
        row = frame.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "C04_analytics_bundle",
    f"""WITH {FACTS_SQL}, {_BOTH}, f AS (SELECT * FROM facts WHERE year(day) = 1997)
SELECT 'annual_summary' AS dataset, count(DISTINCT year(day)) AS rows FROM f UNION ALL SELECT 'monthly_trend', count(DISTINCT strftime(day, '%Y-%m')) FROM f
UNION ALL SELECT 'branch_ranking', count(DISTINCT entity) FROM f WHERE channel = 'branch' UNION ALL SELECT 'specialist_ranking', count(DISTINCT entity) FROM f WHERE channel = 'specialist'
UNION ALL SELECT unnest(['branch_products', 'specialist_products']), 3 UNION ALL SELECT 'reconciliation', 6""",
)
def c04(t):
    return _sizes(d.analytics_bundle(_facts(t), Period(years=(1997,))))


@query("C05_facts_read_model", f"WITH {FACTS_SQL}, {_BOTH} " + _product_sql("facts"))
def c05(t):
    return rounded(d.facts_read_model(_facts(t))["combined_products"], 2)


@query(
    "C06_dashboard_summary",
    f"""WITH {FACTS_SQL} SELECT 'scope_audit' AS dataset, 1 AS rows UNION ALL SELECT unnest(['kpis', 'revenue_totals', 'data_freshness']), 1
UNION ALL SELECT 'branch_ranking', least(20, count(DISTINCT entity)) FROM branch_facts UNION ALL SELECT 'specialist_ranking', least(20, count(DISTINCT entity)) FROM specialist_facts
UNION ALL SELECT 'product_mix', count(*) FROM specialist_facts""",
)
def c06(t):
    facts = plan.build_facts(t.receipts(), RULES, TIES)
    return _sizes(plan.dashboard_summary(facts))


@query(
    "C41_facts_builder",
    f"""WITH {FACTS_SQL} SELECT 'raw' AS frame, count(*) AS rows, round(sum(amount), 2) AS amount FROM receipts UNION ALL SELECT 'official', count(*), round(sum(amount), 2) FROM official
UNION ALL SELECT 'branch_facts', count(*), round(sum({_TOTAL}), 2) FROM branch_facts UNION ALL SELECT 'specialist_facts', count(*), round(sum({_TOTAL}), 2) FROM specialist_facts""",
)
def c41(t):
    facts = plan.build_facts(t.receipts(), RULES, TIES)
    frames = {
        "raw": facts["raw"].select("amount"),
        "official": facts["official"].select("amount"),
        "branch_facts": d.of_channel(facts["facts"], "branch").select(d.line_total().alias("amount")),
        "specialist_facts": d.of_channel(facts["facts"], "specialist").select(d.line_total().alias("amount")),
    }
    out = None
    for name, frame in frames.items():
        row = frame.agg(F.lit(name).alias("frame"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("amount"), 2).alias("amount"))
        out = row if out is None else out.unionByName(row)
    return out
