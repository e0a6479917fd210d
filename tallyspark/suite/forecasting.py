"""Series, calendar, forecast and signal checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.errors import with_errors
from tallyspark.operators import series as s
from tallyspark.plans import backtest as b
from tallyspark.plans import boosting
from tallyspark.plans import forecast as fc
from tallyspark.plans import governance as g
from tallyspark.plans import report as rep
from tallyspark.plans import signals as sg
from tallyspark.session import cut_lineage, written
from tallyspark.sources import calendar as cal
from tallyspark.suite.base import CRUISE_BRANDS, DESK, OFFICIAL_SQL, RECEIPTS_SQL, RULES, query, rounded, texted
from tallyspark.suite.cleaning import _SIGNAL_SQL, _signal

HOLIDAYS = ["01-01", "05-01", "10-01", "12-25", "12-26"]
EXPOS = [("02-20", "02-23"), ("06-12", "06-15")]
_CRUISE = ", ".join(f"'{x}'" for x in CRUISE_BRANDS)

TS_SQL = f"""{OFFICIAL_SQL}, dl AS (SELECT unified_date AS d, sum(amount) AS total, coalesce(sum(amount) FILTER (is_tour AND dept NOT IN ({_CRUISE})), 0.0) AS tour, coalesce(sum(amount) FILTER (is_tour AND dept IN ({_CRUISE})), 0.0) AS cruise, coalesce(sum(amount) FILTER (NOT is_tour), 0.0) AS ticket FROM official GROUP BY 1),
cald AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM dl), wide AS (SELECT d, coalesce(total, 0.0) AS total, coalesce(tour, 0.0) AS tour, coalesce(cruise, 0.0) AS cruise, coalesce(ticket, 0.0) AS ticket FROM cald LEFT JOIN dl USING (d)),
ts AS (SELECT line, d, v, row_number() OVER (PARTITION BY line ORDER BY d) - 1 AS i FROM wide UNPIVOT (v FOR line IN (total, tour, cruise, ticket))), top AS (SELECT max(d) AS m FROM ts)"""

_SERIES_ROLES = ("unified_date", "dept", "amount")


def _series(t):
    return s.daily_series(t.official(*_SERIES_ROLES), CRUISE_BRANDS)


def _calendar(t):
    return cal.recurring_calendar(t.lineitem.select(F.to_date("l_shipdate").alias("d")), "d", HOLIDAYS, EXPOS)


# --- calendar ------------------------------------------------------------------------------------------------

_YEARS = "years AS (SELECT unnest(generate_series((SELECT min(year(l_shipdate)) FROM lineitem), (SELECT max(year(l_shipdate)) FROM lineitem))) AS y)"
_CAL_SQL = f"""{_YEARS}, hol AS (SELECT CAST(y || '-' || unnest({HOLIDAYS}) AS DATE) AS d FROM years),
expo AS (SELECT unnest(generate_series(CAST(y || '-' || a AS DATE), CAST(y || '-' || e AS DATE), INTERVAL 1 DAY))::DATE AS d, a || ' ' || y AS name FROM years, (VALUES {", ".join(f"('{a}', '{e}')" for a, e in EXPOS)}) AS v(a, e))"""


def _flag(day: str, events: str, reach: int) -> str:
    return f"CASE WHEN {day} IN (SELECT d FROM {events}) THEN 1 ELSE 0 END, CASE WHEN {day} NOT IN (SELECT d FROM {events}) AND EXISTS (SELECT 1 FROM {events} e WHERE abs(date_diff('day', e.d, {day})) <= {reach}) THEN 1 ELSE 0 END"


@query("S24_event_days", f"WITH {_CAL_SQL} SELECT d::VARCHAR AS day, name FROM expo")
def s24(t):
    return texted(_calendar(t)[1].select(F.col("date").alias("day"), "name"))


@query("A41_calendar_years", f"WITH {_CAL_SQL}, h AS (SELECT year(d) AS year, count(DISTINCT d) AS a FROM hol GROUP BY 1), x AS (SELECT year(d) AS year, count(DISTINCT d) AS b, count(DISTINCT name) AS c FROM expo GROUP BY 1) SELECT CAST(year AS INTEGER) AS year, a AS public_holiday_days, b AS travel_expo_days, c AS travel_expo_events FROM h JOIN x USING (year)")
def a41(t):
    return cal.calendar_year_summary(_calendar(t))


def _two(text: str, a: str, c: str) -> str:
    first, second = text.split(", CASE", 1)
    return f"{first} AS {a}, CASE{second} AS {c}"


@query("J24_near_event_days", f"WITH {_CAL_SQL}, q AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) SELECT d::VARCHAR AS day, {_two(_flag('q.d', 'hol', 3), 'is_public_holiday', 'is_near_public_holiday')}, {_two(_flag('q.d', 'expo', 7), 'is_travel_expo', 'is_near_travel_expo')} FROM q")
def j24(t):
    days = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    return texted(cal.with_day_flags(days, "day", cal.day_flags(_calendar(t))))


_NEAR_2024 = "DATE '2024-01-01'"


@query(
    "P26_calendar_features",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM events GROUP BY 1), f AS (SELECT *, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CAST(date_diff('day', day, last_day(day)) AS INTEGER) AS left_ FROM d)
SELECT day::VARCHAR AS day, events, weekday, CASE WHEN weekday >= 5 THEN 1 ELSE 0 END AS is_weekend, CAST(month(day) AS INTEGER) AS month, CAST(quarter(day) AS INTEGER) AS quarter, CAST(day(day) AS INTEGER) AS day_of_month, left_ AS days_to_month_end, CASE WHEN day(day) <= 3 THEN 1 ELSE 0 END AS is_month_start_window,
 CASE WHEN day(day) BETWEEN 14 AND 16 THEN 1 ELSE 0 END AS is_month_mid_window, CASE WHEN left_ <= 3 THEN 1 ELSE 0 END AS is_month_end_window, CASE WHEN day = {_NEAR_2024} THEN 1 ELSE 0 END AS is_public_holiday,
 CASE WHEN day <> {_NEAR_2024} AND abs(date_diff('day', day, {_NEAR_2024})) <= 3 THEN 1 ELSE 0 END AS is_near_public_holiday, 0 AS is_travel_expo, 0 AS is_near_travel_expo, CASE WHEN weekday < 5 AND day <> {_NEAR_2024} THEN 1 ELSE 0 END AS is_business_day FROM f""",
)
def p26(t):
    days = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))
    return texted(cal.calendar_features(days, "day", cal.day_flags(cal.default_calendar(t.spark))))


# --- series --------------------------------------------------------------------------------------------------


@query("R01_daily_series", f"WITH {TS_SQL} SELECT 'all' AS series_id, line, d::VARCHAR AS date, round(v, 2) AS revenue FROM ts")
def r01(t):
    return rounded(texted(_series(t)), 2)


@query("U05_series_addition", f"WITH {TS_SQL} SELECT 'all' AS series_id, d::VARCHAR AS date, round(tour + ticket, 2) AS revenue FROM wide WHERE d BETWEEN (SELECT min(d) FROM dl WHERE tour + ticket > 0) AND (SELECT max(d) FROM dl WHERE tour + ticket > 0)")
def u05(t):
    daily = s.daily_lines(t.official(*_SERIES_ROLES), CRUISE_BRANDS)
    a, c = (daily.where(F.col(x) > 0).select("series_id", "date", F.col(x).alias("revenue")) for x in ("tour", "ticket"))
    return rounded(texted(s.add_series(a, c)), 2)


@query("U02_day_sets", f"WITH {RECEIPTS_SQL} SELECT DISTINCT unified_date::VARCHAR AS day FROM receipts")
def u02(t):
    rows = t.receipts("unified_date", "branch")
    a, c = rows.where(F.col("branch") == DESK), rows.where(F.col("branch") != DESK)
    return texted(a.select(F.col("unified_date").alias("day")).union(c.select("unified_date")).distinct())


@query("U06_dedupe", f"WITH {RECEIPTS_SQL} SELECT branch, salesperson, min(unified_date)::VARCHAR AS day FROM receipts GROUP BY 1, 2")
def u06(t):
    from tallyspark.functions.keys import first_per_key

    rows = t.receipts("branch", "salesperson", "unified_date").dropDuplicates()
    return texted(first_per_key(rows, ["branch", "salesperson"], [F.col("unified_date")]).withColumnRenamed("unified_date", "day"))


@query("F17_viable_segments", f"WITH {TS_SQL} SELECT 'all' AS series_id, line, count(*) AS days, count(*) FILTER (v <> 0) AS nonzero_days, count(*) >= 45 AND count(*) FILTER (v <> 0) >= 10 AS is_viable FROM ts GROUP BY 2")
def f17(t):
    return s.viable(_series(t))


_LAGS = ", ".join(f"round(lag(v, {n}) OVER w, 2) AS lag_{n}" for n in s.LAGS)
_ROLLS = ", ".join(
    f"round(CASE WHEN i >= {n} THEN avg(v) OVER (PARTITION BY line ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END, 4) AS rolling_mean_{n}, "
    f"round(CASE WHEN i >= {n} THEN stddev_samp(v) OVER (PARTITION BY line ORDER BY d ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) ELSE 0.0 END, 4) AS rolling_std_{n}"
    for n in s.ROLLING
)


@query("W04_W05_lags_and_rolling", f"WITH {TS_SQL} SELECT 'all' AS series_id, line, d::VARCHAR AS date, round(v, 2) AS revenue, {_LAGS}, {_ROLLS} FROM ts WINDOW w AS (PARTITION BY line ORDER BY d)")
def w0405(t):
    return rounded(texted(s.lag_features(_series(t))), 4)


@query("R02_feature_matrix", f"WITH {TS_SQL}, {_CAL_SQL} SELECT line, d::VARCHAR AS date, round(lag(v, 7) OVER w, 2) AS lag_7, CAST(isodow(d) - 1 AS INTEGER) AS weekday, {_two(_flag('ts.d', 'hol', 3), 'is_public_holiday', 'is_near_public_holiday')} FROM ts WINDOW w AS (PARTITION BY line ORDER BY d)")
def r02(t):
    matrix = fc.feature_matrix(_series(t), _calendar(t))
    return rounded(texted(matrix.select("line", "date", "lag_7", "weekday", "is_public_holiday", "is_near_public_holiday")), 2)


_CUT = "cut AS (SELECT unnest(generate_series((SELECT m FROM top) - 30, (SELECT m FROM top) - 1, INTERVAL 1 DAY))::DATE AS c), h AS (SELECT line, c, d, v, i, date_diff('day', d, c) AS age FROM ts, cut WHERE d <= c)"
STATS_SQL = f"""{TS_SQL}, {_CUT}, st AS (SELECT line, c, count(*) AS n, count(*) FILTER (v <> 0) AS nz, avg(v) AS mean, min(v) AS lo, max(v) AS hi, regr_slope(v, i) AS slope, regr_intercept(v, i) AS icept, sum(v * pow(0.85, age)) / sum(pow(0.85, age)) AS level, avg(v) FILTER (age < 7) AS r7,
 sum(v * (14 - age)) FILTER (age < 14) / 105 AS w14, avg(v) FILTER (age IN (6, 13, 20, 27)) AS wd4, median(v) FILTER (age IN (6, 13, 20, 27, 34, 41, 48, 55)) AS wd8, avg(v) FILTER (date_trunc('month', d) = date_trunc('month', c)) AS mtd FROM h GROUP BY 1, 2),
eff AS (SELECT line, c, isodow(d) - 1 AS w, avg(v) AS m FROM h GROUP BY 1, 2, 3)"""


@query(
    "W10_W13_recent_statistics",
    f"""WITH {STATS_SQL}, q AS (SELECT line, c, quantile_cont(v, 0.9) AS q9 FROM h WHERE age < 21 GROUP BY 1, 2), k AS (SELECT h.line, h.c, v, row_number() OVER (PARTITION BY h.line, h.c ORDER BY d) - 1 AS j, count(*) OVER (PARTITION BY h.line, h.c) AS n FROM h JOIN q USING (line, c) WHERE age < 21 AND v <= q9),
tw AS (SELECT line, c, sum(v * (1 + j / (n - 1))) / sum(1 + j / (n - 1)) AS tw FROM k GROUP BY 1, 2)
SELECT line, c::VARCHAR AS cutoff, round(r7, 4) AS recent_7, round(w14, 4) AS recent_14_weighted, round(wd4, 4) AS same_weekday_4w, round(wd8, 4) AS same_weekday_median, round(mtd, 4) AS mtd_pace, round(tw, 4) AS recent_21_trimmed, round(level, 4) AS level FROM st JOIN tw USING (line, c)""",
)
def w10(t):
    series = _series(t)
    pairs = s.cutoff_days(series, 30, (1,))
    names = ["recent_7", "recent_14_weighted", "same_weekday_4w", "same_weekday_median", "mtd_pace", "recent_21_trimmed", "level"]
    return rounded(texted(fc.stats_at(series, pairs).select("line", "cutoff", *names)), 4)


@query("W17_W18_level_and_trend", f"WITH {STATS_SQL} SELECT line, c::VARCHAR AS cutoff, n AS days_known, round(mean, 6) AS mean_revenue, round(slope, 5) AS slope, round(icept, 2) AS intercept, round(level, 2) AS level FROM st")
def w17(t):
    series = _series(t)
    out = fc.stats_at(series, s.cutoff_days(series, 30, (1,))).select("line", "cutoff", "days_known", "mean_revenue", "slope", "intercept", "level")
    return rounded(rounded(rounded(texted(out), 6, "mean_revenue"), 5, "slope"), 2, "intercept", "level")


@query("W18_linear_trend", f"WITH {TS_SQL} SELECT 'all' AS series_id, line, round(regr_slope(v, i), 6) AS slope, round(regr_intercept(v, i), 4) AS intercept FROM ts GROUP BY 2")
def w18(t):
    return rounded(rounded(s.linear_trend(_series(t)), 6), 4, "intercept")


@query("W19_weekday_effect", f"WITH {TS_SQL} SELECT 'all' AS series_id, line, CAST(isodow(d) - 1 AS INTEGER) AS weekday, round(avg(v) - (SELECT avg(v) FROM ts x WHERE x.line = ts.line), 4) AS effect FROM ts GROUP BY 2, 3")
def w19(t):
    return rounded(s.weekday_effect(_series(t)), 4)


# --- tracks --------------------------------------------------------------------------------------------------

# days ahead that the tracks are checked for
AHEAD = 30
_PRED = f"""{STATS_SQL}, hz AS (SELECT unnest(generate_series(1, {AHEAD})) AS hh), pred AS (SELECT st.line, st.c, hh, greatest(0, level + (coalesce(m, mean) - mean) * 0.9) AS smoothed, greatest(0, slope * (n + hh - 1) + icept + (coalesce(m, mean) - mean) * 1.05) AS trend,
 greatest(lo * 0.4, least(hi * 1.08, mean * 0.96 + (coalesce(m, mean) - mean) * 1.15)) AS bounded, n >= 45 AND nz >= 10 AS ok FROM st CROSS JOIN hz LEFT JOIN eff ON eff.line = st.line AND eff.c = st.c AND eff.w = isodow(st.c + CAST(hh AS INTEGER)) - 1)"""


def _tracks(t, horizons=(1,)):
    series = _series(t)
    pairs = s.cutoff_days(series, 30, (1,)).withColumn("horizon", F.lit(max(horizons)))
    return fc.closed_form_tracks(fc.stats_at(series, pairs))


_SMOOTH = f"""sm AS (SELECT line, c, 0 AS hh, level, NULL::DOUBLE AS value FROM st UNION ALL SELECT sm.line, sm.c, sm.hh + 1, sm.level * 0.85 + greatest(0, sm.level + coalesce(m - mean, 0) * 0.9) * 0.15, greatest(0, sm.level + coalesce(m - mean, 0) * 0.9)
 FROM sm JOIN st ON st.line = sm.line AND st.c = sm.c LEFT JOIN eff ON eff.line = sm.line AND eff.c = sm.c AND eff.w = isodow(sm.c + sm.hh + 1) - 1 WHERE sm.hh < {AHEAD})"""


@query("R03_closed_form_tracks", f"WITH RECURSIVE {_PRED}, {_SMOOTH} SELECT line, c::VARCHAR AS cutoff, CAST(hh AS INTEGER) AS horizon, round(sm.value, 2) AS smoothed, round(trend, 2) AS trend, round(bounded, 2) AS bounded FROM pred JOIN sm USING (line, c, hh)")
def r03(t):
    return rounded(texted(_tracks(t, (AHEAD,)).select("line", "cutoff", "horizon", "smoothed", "trend", "bounded")), 2)


@query(
    "R07_strategy_tracks",
    f"""WITH {_PRED}, p1 AS (SELECT * FROM pred WHERE hh = 1), ok AS (SELECT c, bool_and(ok) AS ok FROM p1 WHERE line <> 'total' GROUP BY 1), l AS (SELECT c, sum(smoothed) AS s, sum(trend) AS t, sum(bounded) AS b FROM p1 WHERE line <> 'total' GROUP BY 1), tt AS (SELECT * FROM p1 WHERE line = 'total')
SELECT 'total' AS strategy, c::VARCHAR AS cutoff, round(smoothed, 2) AS smoothed, round(trend, 2) AS trend, round(bounded, 2) AS bounded FROM tt
UNION ALL SELECT 'by_line', tt.c::VARCHAR, round(CASE WHEN ok.ok THEN l.s ELSE smoothed END, 2), round(CASE WHEN ok.ok THEN l.t ELSE trend END, 2), round(CASE WHEN ok.ok THEN l.b ELSE bounded END, 2) FROM tt JOIN ok USING (c) JOIN l USING (c)""",
)
def r07(t):
    out = fc.strategy_tracks(_tracks(t))
    return rounded(texted(out.select("strategy", "cutoff", "smoothed", "trend", "bounded")), 2)


# the days ahead with their flags, and what the history says at each step of the recursion
_AHEAD = f"""ahead AS (SELECT c, CAST(hh AS INTEGER) AS hh, f, day(f) <= 3 OR date_diff('day', f, last_day(f)) <= 3 AS edge, isodow(f) >= 6 AS we, EXISTS (SELECT 1 FROM hol WHERE hol.d = f) AS ho, EXISTS (SELECT 1 FROM hol WHERE abs(date_diff('day', hol.d, f)) <= 3) AS nh,
 EXISTS (SELECT 1 FROM expo WHERE abs(date_diff('day', expo.d, f)) <= 7) AS ne, EXISTS (SELECT 1 FROM hol WHERE date_diff('day', hol.d, f) BETWEEN 1 AND 3) AS post, EXISTS (SELECT 1 FROM hol WHERE date_diff('day', f, hol.d) BETWEEN 1 AND 3) AS pre
 FROM (SELECT c, hh, c + CAST(hh AS INTEGER) AS f FROM cut, hz)), start AS (SELECT c, list(v ORDER BY d) AS vals FROM h WHERE line = 'total' GROUP BY 1)"""
_AVERAGES = "list_avg(vals[len(vals) - 6:]) AS r7, list_sum([vals[len(vals) - 14 + i] * i FOR i IN range(1, 15)]) / 105 AS w14, list_avg([vals[len(vals) + 1 - 7 * k] FOR k IN [1, 2, 3, 4]]) AS same, list_avg(vals[len(vals) - day(f - 1) + 1:]) AS pace"
_HYBRID = "CASE WHEN edge THEN 0.55 * pace + 0.45 * w14 WHEN nh THEN 0.60 * same + 0.40 * w14 WHEN ne THEN 0.50 * same + 0.30 * w14 + 0.20 * r7 WHEN we THEN 0.65 * same + 0.35 * w14 ELSE 0.45 * same + 0.35 * w14 + 0.20 * r7 END"


@query(
    "R05_baseline_tracks",
    f"""WITH RECURSIVE {_PRED}, {_CAL_SQL}, {_AHEAD}, rec AS (SELECT c, 0 AS hh, vals, NULL::DOUBLE[] AS made FROM start UNION ALL
 SELECT c, hh, list_append(vals, greatest(0, hybrid)), [r7, w14, same, pace, greatest(0, hybrid)] FROM (SELECT *, {_HYBRID} AS hybrid FROM (SELECT rec.c, ahead.hh, vals, edge, nh, ne, we, {_AVERAGES} FROM rec JOIN ahead ON ahead.c = rec.c AND ahead.hh = rec.hh + 1)))
SELECT c::VARCHAR AS cutoff, hh AS horizon, unnest(['recent_7d', 'recent_14d_weighted', 'same_weekday_4w', 'mtd_pace', 'hybrid']) AS model, round(unnest(made), 4) AS prediction FROM rec WHERE hh > 0""",
)
def r05(t):
    return _recursive(t, "baseline")


_ADJUST = """least(base, greatest(q25 * 0.85, least(q75, CASE WHEN low <> 0 THEN low * 1.2 ELSE q75 END))) AS cap, low <= greatest(q25, q50 * 0.72) AS weak, base >= q75 AND low <= q50 AS proud,
 CASE WHEN ho THEN 0.45 * base + 0.55 * least(base, greatest(q25 * 0.75, low)) WHEN nh THEN 0.65 * base + 0.35 * least(base, greatest(q25, low)) WHEN ne THEN 0.78 * base + 0.22 * least(base, greatest(q50, low)) ELSE base END AS damped"""
_RISK = "(CASE WHEN ho THEN 2 WHEN nh THEN 1 ELSE 0 END + edge::INTEGER + weak::INTEGER + proud::INTEGER + (base >= q90 AND same <= q50)::INTEGER)"


@query(
    "R06_adjusted_tracks",
    f"""WITH RECURSIVE {_PRED}, {_CAL_SQL}, {_AHEAD}, prof AS (SELECT c, {', '.join(f"coalesce(quantile_cont(v, {q}) FILTER (v > 0), quantile_cont(v, {q})) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95))} FROM h WHERE line = 'total' GROUP BY 1),
rec AS (SELECT c, 0 AS hh, vals, NULL::DOUBLE[] AS made FROM start UNION ALL
 SELECT c, hh, list_append(vals, greatest(0, cautious)), [greatest(0, CASE WHEN weak OR proud OR edge THEN cap ELSE base END), greatest(0, damped), greatest(0, CASE WHEN post AND NOT we THEN greatest(base, q90, least(CASE WHEN q95 <> 0 THEN q95 * 1.2 ELSE q90 END, greatest(same, w14, pace) * 1.35)) WHEN pre AND NOT ho THEN 0.55 * base + 0.45 * least(base, greatest(q25, low)) ELSE damped END), greatest(0, cautious)]
 FROM (SELECT *, CASE WHEN {_RISK} >= 3 THEN least(base, greatest(q25 * 0.8, 0.7 * low + 0.3 * w14)) WHEN {_RISK} = 2 THEN 0.45 * cap + 0.55 * damped WHEN {_RISK} = 1 THEN 0.75 * base + 0.25 * CASE WHEN low <> 0 THEN least(base, low) ELSE base END ELSE base END AS cautious
  FROM (SELECT *, {_ADJUST} FROM (SELECT *, greatest(0, list_median([same, w14, pace])) AS low
   FROM (SELECT rec.c, ahead.hh, vals, edge, ho, nh, ne, we, post, pre, greatest(0, bounded) AS base, prof.* EXCLUDE (c), {_AVERAGES} FROM rec JOIN ahead ON ahead.c = rec.c AND ahead.hh = rec.hh + 1 JOIN prof ON prof.c = rec.c JOIN pred ON pred.c = rec.c AND pred.hh = ahead.hh AND pred.line = 'total')))))
SELECT c::VARCHAR AS cutoff, hh AS horizon, unnest(['low_day_cap', 'holiday_dampening', 'directional_holiday', 'risk_adjusted']) AS model, round(unnest(made), 4) AS prediction FROM rec WHERE hh > 0""",
)
def r06_tracks(t):
    return _recursive(t, "daily_adjustment")


def _recursive(t, strategy):
    """Recursive tracks of ``AHEAD`` days from each of the last thirty days."""
    series = _series(t)
    pairs = s.cutoff_days(series, 30, (1,)).withColumn("horizon", F.lit(AHEAD))
    stats = fc.stats_at(series, pairs)
    out = fc.recursive_tracks(series, stats, pairs, fc.strategy_tracks(fc.closed_form_tracks(stats)), _calendar(t))
    return rounded(texted(out.where(F.col("strategy") == strategy).select("cutoff", "horizon", "model", "prediction")), 4)


@query(
    "R09_macro_seven_day",
    f"""WITH {_PRED}, p AS (SELECT c, model, sum(v) AS prediction FROM (SELECT c, trend, bounded FROM pred WHERE line = 'total' AND hh <= 7 AND c + 7 <= (SELECT m FROM top)) UNPIVOT (v FOR model IN (trend, bounded)) GROUP BY 1, 2),
a AS (SELECT cut.c, sum(v) AS actual FROM cut JOIN ts ON ts.d BETWEEN cut.c + 1 AND cut.c + 7 WHERE line = 'total' GROUP BY 1) SELECT c::VARCHAR AS cutoff, model, round(actual, 2) AS actual, round(prediction, 2) AS prediction FROM p JOIN a USING (c)""",
)
def r09(t):
    found = b.macro_detail(_series(t))
    last = F.date_sub(F.lit("2001-12-31").cast("date"), 0)
    rows = found.where((F.col("layer") == b.MACRO_7D) & (F.col("strategy") == "total") & (F.col("model") != "smoothed"))
    # the SQL covers cutoffs of the last thirty days; the report goes seven days further back
    newest = rows.agg(F.max("window_end").alias("m")).scalar()
    return rounded(texted(rows.where((F.col("cutoff") >= F.date_sub(newest, 30)) & (F.col("cutoff") < last)).select("cutoff", "model", "actual", "prediction")), 2)


# --- errors over a detail table derived from orders --------------------------------------------------------------

# one prediction per order day, strategy and model: the day's sum times a factor
DETAIL_SQL = f"""{_CAL_SQL}, dd AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS actual FROM orders GROUP BY 1), detail AS (SELECT 'all' AS series_id, d - 1 AS cutoff, d AS actual_date, 1 AS horizon, strategy, model, actual, actual * (0.8 + ((dayofyear(d) * k + s) % 40) / 100.0) AS prediction
 FROM dd, (VALUES ('smoothed', 3), ('trend', 7), ('bounded', 11)) AS m(model, k), (VALUES ('total', 0), ('by_line', 5)) AS st(strategy, s)), de AS (SELECT *, prediction - actual AS error, abs(prediction - actual) AS abs_error, abs(prediction - actual) / actual * 100 AS ape, 2 * abs(prediction - actual) / (actual + prediction) * 100 AS smape FROM detail)"""
_ERR = "round(avg(abs_error), 4) AS mae, round(sum(abs_error) / sum(actual) * 100, 4) AS wape, round(avg(ape), 4) AS mape, round(median(ape), 4) AS median_ape, round(avg(smape), 4) AS smape_avg, round(avg(error), 4) AS bias, count(ape) AS samples"


def _detail(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("actual_date")).agg(F.sum("o_totalprice").alias("actual"))
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.lit(st).alias("strategy"), F.lit(a).alias("s")) for m, k in (("smoothed", 3), ("trend", 7), ("bounded", 11)) for st, a in (("total", 0), ("by_line", 5))]))
    factor = F.lit(0.8) + ((F.dayofyear("actual_date") * F.col("m.k") + F.col("m.s")) % 40) / 100.0
    rows = daily.withColumn("m", models)
    return with_errors(rows.select(F.lit("all").alias("series_id"), F.date_sub("actual_date", 1).alias("cutoff"), "actual_date", F.lit(1).alias("horizon"), "m.strategy", "m.model", "actual", (F.col("actual") * factor).alias("prediction")))


@query("A25_error_summary", f"WITH {DETAIL_SQL} SELECT series_id, strategy, model, horizon, {_ERR} FROM de GROUP BY ALL")
def a25(t):
    return rounded(b.backtest_summary(_detail(t)), 4)


_TRIM = """lim AS (SELECT strategy, model, quantile_cont(actual, 0.95) AS a95, quantile_cont(abs_error, 0.95) AS e95, quantile_cont(actual, 0.9) AS a90, quantile_cont(abs_error, 0.9) AS e90 FROM de GROUP BY ALL),
tr AS (SELECT de.*, r.rule, CASE r.rule WHEN 'All Days' THEN true WHEN 'Trim Actual Top 5%' THEN actual <= a95 WHEN 'Trim AbsError Top 5%' THEN abs_error <= e95 WHEN 'Trim Actual or AbsError Top 5%' THEN actual <= a95 AND abs_error <= e95 ELSE actual <= a90 AND abs_error <= e90 END AS keep
 FROM de JOIN lim USING (strategy, model), (SELECT unnest(['All Days', 'Trim Actual Top 5%', 'Trim AbsError Top 5%', 'Trim Actual or AbsError Top 5%', 'Normal Days - Trim Top 10%']) AS rule) r)"""


@query(
    "A26_robust_errors",
    f"""WITH {DETAIL_SQL}, {_TRIM} SELECT rule, strategy, model, round(avg(abs_error) FILTER (keep), 4) AS mae, round(sum(abs_error) FILTER (keep) / sum(actual) FILTER (keep) * 100, 4) AS wape, round(median(ape) FILTER (keep), 4) AS median_ape, count(*) AS samples, count(*) FILTER (keep) AS kept_samples,
 count(*) FILTER (NOT keep) AS removed_samples, round(coalesce(sum(abs_error) FILTER (NOT keep), 0.0) / sum(abs_error) * 100, 4) AS removed_error_share FROM tr GROUP BY 1, 2, 3""",
)
def a26(t):
    out = b.robust_errors(_detail(t))
    return rounded(out.select("rule", "strategy", "model", "mae", "wape", "median_ape", "samples", "kept_samples", "removed_samples", "removed_error_share"), 4)


_HOL = "EXISTS (SELECT 1 FROM hol h WHERE abs(date_diff('day', h.d, actual_date)) <= 3)"
_EXP = "EXISTS (SELECT 1 FROM expo h WHERE abs(date_diff('day', h.d, actual_date)) <= 7)"


@query(
    "A27_segmented_errors",
    f"""WITH {DETAIL_SQL}, th AS (SELECT quantile_cont(actual, 0.75) AS hi, quantile_cont(actual, 0.25) AS lo FROM dd), cald AS (SELECT d AS actual_date, CASE WHEN d IN (SELECT d FROM hol) THEN 'Public Holiday' WHEN d IN (SELECT d FROM expo) THEN 'Travel Expo' WHEN EXISTS (SELECT 1 FROM hol h WHERE abs(date_diff('day', h.d, dd.d)) <= 3) THEN 'Near Public Holiday'
 WHEN EXISTS (SELECT 1 FROM expo h WHERE abs(date_diff('day', h.d, dd.d)) <= 7) THEN 'Near Travel Expo' ELSE 'Normal Calendar Day' END AS ck FROM dd),
seg AS (SELECT de.*, 'All Days WAPE' AS category, 'All Days' AS segment FROM de UNION ALL SELECT de.*, 'Non-zero Days WAPE', CASE WHEN actual > 0 THEN 'Non-zero Days' ELSE 'Zero Days' END FROM de
 UNION ALL SELECT de.*, 'Revenue Size WAPE', CASE WHEN actual >= hi THEN 'High Revenue Days' WHEN actual <= lo THEN 'Low Revenue Days' ELSE 'Mid Revenue Days' END FROM de, th
 UNION ALL SELECT de.*, 'Weekend / Weekday WAPE', CASE WHEN isodow(actual_date) >= 6 THEN 'Weekend' ELSE 'Weekday' END FROM de
 UNION ALL SELECT de.*, 'Month Window WAPE', CASE WHEN day(actual_date) <= 3 THEN 'Month Start' WHEN day(actual_date) BETWEEN 14 AND 16 THEN 'Month Mid' WHEN date_diff('day', actual_date, last_day(actual_date)) <= 3 THEN 'Month End' ELSE 'Regular Month Days' END FROM de
 UNION ALL SELECT de.*, 'Holiday / Travel Expo Near-window WAPE', ck FROM de JOIN cald USING (actual_date))
SELECT category, segment, strategy, model, {_ERR}, round(sum(actual), 2) AS actual_total, round(sum(abs_error), 2) AS abs_error_total FROM seg GROUP BY 1, 2, 3, 4""",
)
def a27(t):
    out = b.segmented_errors(_detail(t), _calendar(t)).drop("series_id", "horizon")
    return rounded(rounded(out, 4), 2, "actual_total", "abs_error_total")


_W = """wt AS (SELECT strategy, max(w) FILTER (model = 'smoothed') AS ws, max(w) FILTER (model = 'trend') AS wt, max(w) FILTER (model = 'bounded') AS wb FROM (SELECT strategy, model, (1 / greatest(wape, 0.01)) / sum(1 / greatest(wape, 0.01)) OVER (PARTITION BY strategy) AS w FROM (SELECT strategy, model, sum(abs_error) / sum(actual) * 100 AS wape FROM de GROUP BY 1, 2)) GROUP BY 1)"""


@query("R10_inverse_weights", f"WITH {DETAIL_SQL}, {_W} SELECT strategy, round(ws, 6) AS w_smoothed, round(wt, 6) AS w_trend, round(wb, 6) AS w_bounded, true AS same_unbounded FROM wt")
def r10(t):
    summary = b.backtest_summary(_detail(t))
    bounded = b.inverse_weights(summary, ["strategy"])
    free = b.macro_weights(summary, ["strategy"]).select("strategy", *[F.col(f"w_{m}").alias(f"f_{m}") for m in fc.TRACKS])
    joined = bounded.join(free, "strategy")
    same = F.lit(True)
    for m in fc.TRACKS:
        same = same & (F.abs(F.col(f"w_{m}") - F.col(f"f_{m}")) < 1e-9)
    return rounded(joined.select("strategy", *[f"w_{m}" for m in fc.TRACKS], same.alias("same_unbounded")), 6)


@query(
    "R11_fusion",
    f"""WITH {DETAIL_SQL}, {_W}, p AS (SELECT strategy, actual_date, max(actual) AS actual, max(prediction) FILTER (model = 'smoothed') AS s, max(prediction) FILTER (model = 'trend') AS t, max(prediction) FILTER (model = 'bounded') AS b FROM de GROUP BY 1, 2)
SELECT strategy, actual_date::VARCHAR AS actual_date, round(s * ws + t * wt + b * wb, 4) AS prediction, round(s * ws + t * wt + b * wb - actual, 4) AS error FROM p JOIN wt USING (strategy)""",
)
def r11(t):
    out = b.with_fusion(_detail(t)).where(F.col("model") == b.FUSION)
    return rounded(texted(out.select("strategy", "actual_date", "prediction", "error")), 4)


_RANKED = "sm AS (SELECT strategy, model, sum(abs_error) / sum(actual) * 100 AS wape, avg(ape) AS mape, count(*) AS samples FROM de GROUP BY 1, 2)"


@query("K06_best_model", f"WITH {DETAIL_SQL}, {_RANKED} SELECT strategy, model, round(wape, 4) AS wape FROM sm ORDER BY round(wape, 9), round(mape, 9), strategy, model LIMIT 1")
def k06(t):
    return rounded(b.best_models(b.backtest_summary(_detail(t)), ["series_id"]).select("strategy", "model", "wape"), 4)


@query("R20_strategy_comparison", f"WITH {DETAIL_SQL}, {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(wape, 9), round(mape, 9), model) AS rn FROM sm) SELECT 'all' AS series_id, 1 AS horizon, strategy, model AS best_model, round(wape, 4) AS best_wape, round(mape, 4) AS best_mape, samples FROM r WHERE rn = 1")
def r20(t):
    return rounded(b.strategy_comparison(b.backtest_summary(_detail(t))), 4)


@query("W08_spike_days", f"WITH {DETAIL_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY abs_error DESC, cutoff) AS rn FROM de WHERE strategy = 'total' AND model = 'bounded'), q AS (SELECT quantile_cont(actual, 0.75) AS hi FROM r) SELECT actual_date::VARCHAR AS actual_date, round(actual, 2) AS actual, round(abs_error, 2) AS abs_error FROM r, q WHERE actual >= hi OR rn <= 8 ORDER BY r.abs_error DESC, r.actual DESC LIMIT 8")
def w08(t):
    return rounded(texted(sg.spike_days(_detail(t)).select("actual_date", "actual", "abs_error")), 2)


@query(
    "C26_governance_matrix",
    f"""WITH {DETAIL_SQL}, x AS (SELECT CASE strategy WHEN 'total' THEN '正式' ELSE '診斷' END AS role, strategy, model, sum(abs_error) / sum(actual) * 100 AS wape, avg(ape) AS mape, median(ape) AS med, avg(smape) AS sm, avg(abs_error) AS mae, avg(error) AS bias, stddev_samp(ape) AS sd, count(*) AS n FROM de GROUP BY ALL),
z AS (SELECT *, least(greatest(100 - (wape + mape + med + sm) / 4 * 1.2, 0), 100) * 0.35 + least(greatest(100 - abs(bias) / mae * 80, 0), 100) * 0.20 + least(greatest(100 - sd * 1.35, 0), 100) * 0.20 + 100 * 0.15 + CASE role WHEN '正式' THEN 100 ELSE 75 END * 0.10 AS score FROM x)
SELECT role, strategy, model, round(sd, 4) AS ape_std, round(abs(bias) / mae, 4) AS bias_ratio, round(score, 4) AS governance_score, CASE WHEN score >= 90 THEN '優秀' WHEN score >= 75 THEN '可接受' WHEN score >= 60 THEN '需關注' ELSE '需處理' END AS health FROM z""",
)
def c26(t):
    d = _detail(t)
    view = F.lit(g.DAILY_VIEW)
    rows = g.governance_input(d.where(F.col("strategy") == "total"), view, g.OFFICIAL).unionByName(g.governance_input(d.where(F.col("strategy") == "by_line"), view, g.DIAGNOSTIC))
    return rounded(g.governance_matrix(rows).select("role", "strategy", "model", "ape_std", "bias_ratio", "governance_score", "health"), 4)


# --- trailing windows ----------------------------------------------------------------------------------------

_SRC = f"""{OFFICIAL_SQL}, top AS (SELECT max(unified_date) AS m FROM official), cut AS (SELECT unnest(generate_series((SELECT m FROM top) - 30, (SELECT m FROM top) - 1, INTERVAL 1 DAY))::DATE AS c), win AS (SELECT o.*, c, date_diff('day', unified_date, c) AS age FROM official o, cut WHERE unified_date <= c AND unified_date > c - 28)"""
_SIGNAL_ROLES = ("order_id", "unified_date", "amount", "dept", "branch", "salesperson", "dest_category", "source_tag")


def _days(t):
    rows = t.official(*_SIGNAL_ROLES)
    newest = rows.agg(F.max("unified_date").alias("m"))
    cuts = newest.select(F.explode(F.sequence(F.date_sub("m", 30), F.date_sub("m", 1))).alias("cutoff"))
    return sg.order_days(sg.spike_source(rows, RULES)), cuts


_W7 = "sum(amount) FILTER (age < 7)"


@query(
    "J13_A35_window_statistics",
    f"""WITH {_SRC}, daily AS (SELECT c, unified_date, age, sum(amount) AS a FROM win GROUP BY 1, 2, 3), dm AS (SELECT c, max(a) FILTER (age < 7) AS mx, avg(a) FILTER (age < 7) AS av, stddev_pop(a) FILTER (age < 7) AS sd FROM daily GROUP BY 1),
x AS (SELECT c, max(unified_date) AS fm, {_W7} AS t7, sum(amount) FILTER (age < 14) AS t14, sum(amount) AS t28, coalesce({_W7[:-1]} AND branch = '{DESK}'), 0.0) AS s7, coalesce({_W7[:-1]} AND dest_category LIKE '%中國長%'), 0.0) AS h7 FROM win GROUP BY 1)
SELECT c::VARCHAR AS cutoff, fm::VARCHAR AS feature_max_date, round(t7, 2) AS total_7, round(t14, 2) AS total_14, round(t28, 2) AS total_28, round(s7, 2) AS specialist_7, round(h7, 2) AS longhaul_7, round(mx, 2) AS max_daily_7, round(mx / t7 * 100, 4) AS max_daily_share_7, round(sd / av, 4) AS volatility_7, round(t7 / (t14 / 2), 4) AS pace_vs_14 FROM x JOIN dm USING (c)""",
)
def j13(t):
    out = sg.window_stats(*_days(t)).select("cutoff", "feature_max_date", "total_7", "total_14", "total_28", "specialist_7", "longhaul_7", "max_daily_7", "max_daily_share_7", "volatility_7", "pace_vs_14")
    return rounded(rounded(texted(out), 4), 2, "total_7", "total_14", "total_28", "specialist_7", "longhaul_7", "max_daily_7")


_THR = "thr AS (SELECT c, greatest(100000.0, quantile_cont(a, 0.95)) AS th FROM (SELECT c, order_id, sum(amount) AS a FROM official, cut WHERE unified_date <= c GROUP BY 1, 2) GROUP BY 1)"


@query("A33_large_order_threshold", f"WITH {_SRC}, {_THR} SELECT c::VARCHAR AS cutoff, round(th, 2) AS large_order_threshold FROM thr")
def a33(t):
    days, cuts = _days(t)
    return rounded(texted(sg.large_order_threshold(written(days), cuts).drop("series_id")), 2)


@query(
    "A34_A36_order_window_statistics",
    f"""WITH {_SRC}, {_THR}, po AS (SELECT c, order_id, coalesce(sum(amount) FILTER (age < 3), 0.0) AS a3, count(*) FILTER (age < 3) AS n3, coalesce({_W7}, 0.0) AS a7, count(*) FILTER (age < 7) AS n7, count(*) FILTER (age < 14) AS n14, count(*) FILTER (age < 7 AND dest_category LIKE '%中國長%') AS nh, coalesce(sum(amount) FILTER (age < 7 AND dest_category LIKE '%中國長%'), 0.0) AS ah FROM win WHERE age < 14 GROUP BY 1, 2),
se AS (SELECT c, max(o) AS mo, count(*) AS u, max(a) AS ma FROM (SELECT c, salesperson, count(DISTINCT order_id) AS o, sum(amount) AS a FROM win WHERE age < 7 GROUP BY 1, 2) GROUP BY 1)
SELECT c::VARCHAR AS cutoff, count(*) FILTER (n3 > 0) AS orders_3, count(*) FILTER (n7 > 0) AS orders_7, count(*) FILTER (n14 > 0) AS orders_14, count(*) FILTER (n7 > 0 AND a7 >= th / 3) AS large_orders_7, round(coalesce(max(a7) FILTER (n7 > 0), 0.0), 2) AS max_order_7, round(coalesce(sum(a7) FILTER (n7 > 0 AND a7 >= th / 3), 0.0), 2) AS large_total_7,
 count(*) FILTER (nh > 0) AS longhaul_orders_7, round(coalesce(max(ah) FILTER (nh > 0), 0.0), 2) AS longhaul_max_order_7, any_value(u) AS unique_salespersons_7, round(any_value(mo) / count(*) FILTER (n7 > 0) * 100, 4) AS top_seller_order_share_7, round(any_value(ma), 2) AS top_seller_amount_7 FROM po JOIN thr USING (c) JOIN se USING (c) GROUP BY c""",
)
def a34(t):
    days, cuts = _days(t)
    days = written(days)
    limits = sg.large_order_threshold(days, cuts).withColumn("large_order_threshold", F.col("large_order_threshold") / 3)  # a third, so that some orders are large
    out = sg.order_window_stats(days, cuts, limits).select(
        "cutoff", "orders_3", "orders_7", "orders_14", "large_orders_7", "max_order_7", "large_total_7", "longhaul_orders_7", "longhaul_max_order_7", "unique_salespersons_7", "top_seller_order_share_7", "top_seller_amount_7"
    )
    return rounded(rounded(texted(out), 4), 2, "max_order_7", "large_total_7", "longhaul_max_order_7", "top_seller_amount_7")


# --- signals of every series: one per branch and the whole ------------------------------------------------------

# the prediction of a day is the revenue of the same weekday a week before; the last thirty cutoffs of each series; orders are
# large from a third of the limit on, so that some are
_EVERY = f"""{_CAL_SQL}, {OFFICIAL_SQL}, sr AS (SELECT 'all' AS s, * FROM official UNION ALL SELECT branch AS s, * FROM official), dl AS (SELECT s, unified_date AS d, sum(amount) AS v FROM sr GROUP BY 1, 2), ends AS (SELECT s, min(d) AS a, max(d) AS b FROM dl GROUP BY 1),
cut AS (SELECT s, unnest(generate_series(greatest(a, b - 30), b - 1, INTERVAL 1 DAY))::DATE AS c FROM ends WHERE b > a),
det AS (SELECT cut.s, cut.c, cut.c + 1 AS ad, coalesce(x.v, 0.0) AS actual, coalesce(y.v, 0.0) - coalesce(x.v, 0.0) AS err FROM cut LEFT JOIN dl x ON x.s = cut.s AND x.d = cut.c + 1 LEFT JOIN dl y ON y.s = cut.s AND y.d = cut.c - 6),
win AS (SELECT cut.c, date_diff('day', unified_date, cut.c) AS age, sr.*, sr.branch = '{DESK}' AS sp, sr.dest_category LIKE '%中國長%' AS lh FROM cut JOIN sr ON sr.s = cut.s AND unified_date <= cut.c AND unified_date > cut.c - 28),
thr AS (SELECT s, c, greatest(100000.0, quantile_cont(a, 0.95)) / 3 AS th FROM (SELECT cut.s, cut.c, order_id, sum(amount) AS a FROM cut JOIN sr ON sr.s = cut.s AND unified_date <= cut.c GROUP BY 1, 2, 3) GROUP BY 1, 2),
po AS (SELECT s, c, order_id, count(*) FILTER (age < 3) AS n3, count(*) FILTER (age < 7) AS n7, count(*) FILTER (age < 7 AND sp) AS ns, count(*) FILTER (age < 7 AND lh) AS nh, sum(amount) FILTER (age < 3) AS a3, sum(amount) FILTER (age < 7) AS a7, sum(amount) AS a14, sum(amount) FILTER (age < 7 AND sp) AS ps, sum(amount) FILTER (age < 7 AND lh) AS ph FROM win WHERE age < 14 GROUP BY 1, 2, 3),
od AS (SELECT s, c, any_value(th) AS th, count(*) AS o14, count(*) FILTER (n7 > 0) AS o7, count(*) FILTER (n3 > 0) AS o3, count(*) FILTER (n3 > 0 AND a3 >= th) AS l3, count(*) FILTER (n7 > 0 AND a7 >= th) AS l7, count(*) FILTER (a14 >= th) AS l14, count(*) FILTER (ns > 0 AND ps >= th) AS ls, count(*) FILTER (nh > 0 AND ph >= th) AS ll, coalesce(max(a3), 0.0) AS m3, coalesce(max(a7), 0.0) AS m7, coalesce(max(ps), 0.0) AS ms,
 coalesce(sum(a7) FILTER (a7 >= th), 0.0) AS lt, coalesce(sum(ps) FILTER (ps >= th), 0.0) AS lts, coalesce(sum(ph) FILTER (ph >= th), 0.0) AS ltl FROM po JOIN thr USING (s, c) GROUP BY 1, 2),
se AS (SELECT s, c, max(o) AS so, max(a) AS sa, count(*) AS u FROM (SELECT s, c, salesperson, count(DISTINCT order_id) AS o, sum(amount) AS a FROM win WHERE age < 7 GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

# features, points, classes and outcomes of the spike signal
_SPIKES = f"""{_EVERY}, day AS (SELECT s, c, unified_date, sum(amount) AS a FROM win WHERE age < 7 GROUP BY 1, 2, 3), dm AS (SELECT s, c, max(a) AS mx, avg(a) AS av, stddev_pop(a) AS sd FROM day GROUP BY 1, 2),
tot AS (SELECT s, c, sum(amount) FILTER (age < 7) AS t7, sum(amount) FILTER (age < 14) AS t14, sum(amount) FILTER (age < 7 AND sp) AS s7, sum(amount) FILTER (sp) AS s28, sum(amount) FILTER (age < 7 AND lh) AS h7, sum(amount) FILTER (lh) AS h28, max(unified_date) AS fm FROM win GROUP BY 1, 2),
lim AS (SELECT s, coalesce(quantile_cont(actual, 0.75) FILTER (actual > 0), quantile_cont(actual, 0.75)) AS hi, quantile_cont(abs(err), 0.75) AS le FROM det GROUP BY 1),
f AS (SELECT det.*, fm, coalesce(t7, 0.0) AS t7, coalesce(s7, 0.0) AS s7, coalesce(h7, 0.0) AS h7, CASE WHEN t7 > 0 THEN coalesce(s7, 0.0) / t7 * 100 ELSE 0.0 END AS sp, CASE WHEN t7 > 0 THEN coalesce(h7, 0.0) / t7 * 100 ELSE 0.0 END AS lh, CASE WHEN s28 > 0 THEN coalesce(s7, 0.0) / (s28 / 4) END AS spm, CASE WHEN h28 > 0 THEN coalesce(h7, 0.0) / (h28 / 4) END AS lhm,
 coalesce(od.l7, 0) AS lo, coalesce(od.m7, 0.0) AS mx, greatest(coalesce(od.th, 0.0), 100000.0) AS thr, CASE WHEN t7 > 0 THEN coalesce(sa, 0.0) / t7 * 100 ELSE 0.0 END AS ts, CASE WHEN t7 > 0 THEN dm.mx / t7 * 100 ELSE 0.0 END AS mds, coalesce(sd / av, 0.0) AS vol, CASE WHEN t14 > 0 THEN coalesce(t7, 0.0) / (t14 / 2) END AS pace,
 EXISTS (SELECT 1 FROM hol WHERE date_diff('day', hol.d, ad) BETWEEN 1 AND 3) AS post, date_diff('day', ad, last_day(ad)) <= 3 AS edge, actual >= hi AS hd, err < 0 AND abs(err) >= le AS lu, err > 0 AND abs(err) >= le AS lv FROM det JOIN lim USING (s) LEFT JOIN tot USING (s, c) LEFT JOIN dm USING (s, c) LEFT JOIN od USING (s, c) LEFT JOIN se USING (s, c)),
p AS (SELECT *, CAST(CASE WHEN sp >= 50 THEN 2 WHEN sp >= 30 THEN 1 ELSE 0 END + CASE WHEN spm >= 1.35 AND s7 >= 150000 THEN 1 ELSE 0 END + CASE WHEN lh >= 55 THEN 2 WHEN lh >= 35 THEN 1 ELSE 0 END + CASE WHEN lhm >= 1.35 AND h7 >= 150000 THEN 1 ELSE 0 END + CASE WHEN lo >= 1 THEN 1 ELSE 0 END + CASE WHEN mx >= greatest(thr * 1.5, 250000) THEN 1 ELSE 0 END
 + CASE WHEN ts >= 45 THEN 1 ELSE 0 END + CASE WHEN post THEN 1 ELSE 0 END + CASE WHEN edge THEN 1 ELSE 0 END AS INTEGER) AS score, sp >= 45 OR spm >= 1.45 AS ss, lh >= 50 OR lhm >= 1.45 AS sl, lo >= 1 AND mx >= greatest(thr * 1.35, 220000) AS strong, mds >= 38 OR ts >= 55 AS conc FROM f),
sig AS (SELECT *, CASE WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Medium' ELSE 'Low' END AS lvl, CASE WHEN lu AND hd THEN 'Pre-spike' WHEN lv THEN 'Post-spike Cooldown' WHEN hd OR lu THEN 'Volatile Hold' ELSE 'Normal' END AS outcome FROM p)"""


def _series_signals(t):
    # read three times below: written once, as columns, which take less than rows
    rows = written(t.official(*_SIGNAL_ROLES).select(*_SIGNAL_ROLES, "is_tour"))
    series = s.daily_series(rows, CRUISE_BRANDS).unionByName(s.daily_series(rows, CRUISE_BRANDS, F.col("branch")))
    total = series.where(F.col("line") == "total")
    pairs = s.cutoff_days(series, 30, (1,))
    actual = total.select("series_id", F.col("date").alias("actual_date"), F.col("revenue").alias("actual"))
    before = total.select("series_id", F.date_add("date", 7).alias("actual_date"), F.col("revenue").alias("prediction"))
    out = pairs.join(actual, ["series_id", "actual_date"]).join(before, ["series_id", "actual_date"], "left").na.fill(0.0, ["prediction"])
    detail = with_errors(out.withColumns({"strategy": F.lit(fc.STRATEGY_TOTAL), "model": F.lit(fc.BASE_TRACK)}))
    detail, days = cut_lineage(detail), written(sg.order_days(sg.spike_source(rows, RULES), F.col("branch")))
    limits = sg.large_order_threshold(days, detail).withColumn("large_order_threshold", F.col("large_order_threshold") / 3)
    states = cut_lineage(sg.order_window_stats(days, detail, limits))
    return detail, days, states, sg.spike_detail(detail, days, _calendar(t), states)


@query(
    "R12_spike_signals_every_series",
    f"""WITH {_SPIKES} SELECT s AS series_id, c::VARCHAR AS cutoff, fm::VARCHAR AS feature_max_date, round(actual, 2) AS actual, round(t7, 2) AS total_7, round(sp, 4) AS specialist_share_7, round(lh, 4) AS longhaul_share_7, round(lhm, 4) AS longhaul_momentum, round(thr, 6) AS large_order_threshold, lo AS large_orders_7, round(mx, 2) AS max_order_7, round(ts, 4) AS top_seller_share_7, round(mds, 4) AS max_daily_share_7, round(vol, 4) AS volatility_7, round(pace, 4) AS pace_vs_14, post AS is_post_holiday, edge AS is_month_end, score AS risk_score, lvl AS risk_level, outcome,
 CASE WHEN lvl = 'Low' THEN 'Normal' WHEN lvl = 'High' AND score >= 6 AND strong AND lh >= 65 AND sp >= 45 AND NOT conc AND (post OR edge OR pace >= 1.2) THEN 'Pre-spike' WHEN sl AND sp < 28 AND mx >= greatest(thr * 1.05, 180000) AND NOT post AND NOT edge THEN 'Post-spike Cooldown' WHEN conc AND pace <= 0.82 AND NOT post THEN 'Post-spike Cooldown'
 WHEN vol >= 0.85 OR (lo >= 1 AND ts >= 45) OR (strong AND (sl OR ss)) OR lvl = 'High' THEN 'Volatile Hold' ELSE 'Watch' END AS signal_class FROM sig""",
)
def r12_every(t):
    out = _series_signals(t)[3].select(
        "series_id", "cutoff", "feature_max_date", "actual", "total_7", "specialist_share_7", "longhaul_share_7", "longhaul_momentum", "large_order_threshold", F.col("large_orders_7").cast("long").alias("large_orders_7"),
        "max_order_7", "top_seller_share_7", "max_daily_share_7", "volatility_7", "pace_vs_14", "is_post_holiday", "is_month_end", "risk_score", "risk_level", "outcome", "signal_class",
    )
    shares = [f for f in out.columns if f.endswith(("share_7", "momentum")) or f in ("volatility_7", "pace_vs_14")]
    return rounded(rounded(rounded(texted(out), 6, "large_order_threshold"), 4, *shares), 2, "actual", "total_7", "max_order_7")


@query(
    "R13_event_signals_every_series",
    f"""WITH {_SPIKES}, new AS (SELECT s, c, max(unified_date) AS nd FROM win WHERE age < 14 GROUP BY 1, 2), e AS (SELECT sig.s, sig.c, nd, lvl, outcome, greatest(coalesce(od.th, 0.0), 100000.0) AS th, coalesce(o3, 0) AS o3, coalesce(o7, 0) AS o7, coalesce(o14, 0) AS o14, coalesce(l3, 0) AS l3, coalesce(l7, 0) AS l7, coalesce(l14, 0) AS l14, coalesce(ls, 0) AS ls, coalesce(ll, 0) AS ll, coalesce(m3, 0.0) AS m3, coalesce(ms, 0.0) AS ms,
 coalesce(od.lt, 0.0) AS lt, coalesce(od.lts, 0.0) AS lts, coalesce(od.ltl, 0.0) AS ltl, coalesce(u, 0) AS u, CASE WHEN o7 > 0 THEN so / o7 * 100 ELSE 0.0 END AS share, CASE WHEN o14 > 0 THEN o7 / (o14 / 2) END AS mom FROM sig LEFT JOIN od USING (s, c) LEFT JOIN se USING (s, c) LEFT JOIN new USING (s, c))
SELECT s AS series_id, c::VARCHAR AS cutoff, nd::VARCHAR AS feature_max_date, lvl AS risk_level, outcome, round(th, 6) AS large_order_threshold, o3 AS orders_3, o7 AS orders_7, o14 AS orders_14, l3 AS large_orders_3, l7 AS large_orders_7, l14 AS large_orders_14, ls AS specialist_large_orders_7, ll AS longhaul_large_orders_7, round(m3, 2) AS max_order_3, round(ms, 2) AS specialist_max_order_7, round(lt, 2) AS large_total_7, u AS unique_salespersons_7, round(share, 4) AS top_seller_order_share_7, round(mom, 4) AS order_momentum,
 CASE WHEN l3 >= 1 AND m3 >= 180000 AND (ls >= 1 OR ll >= 1) AND u >= 3 AND share <= 55 AND mom >= 1.05 THEN 'Event Pre-spike' WHEN l7 >= 1 AND l3 = 0 AND (mom <= 0.82 OR share >= 50) THEN 'Event Cooldown' WHEN l7 >= 1 OR lts > 0 OR ltl > 0 THEN 'Event Volatile' ELSE 'Event Normal' END AS event_class FROM e""",
)
def r13_every(t):
    _, days, states, signals = _series_signals(t)
    events = sg.event_detail(signals, days, states)
    out = events.select(
        "series_id", "cutoff", "feature_max_date", "risk_level", "outcome", "large_order_threshold", *[F.col(c).cast("long").alias(c) for c in ("orders_3", "orders_7", "orders_14", "large_orders_3", "large_orders_7", "large_orders_14", "specialist_large_orders_7", "longhaul_large_orders_7", "unique_salespersons_7")],
        "max_order_3", "specialist_max_order_7", "large_total_7", "top_seller_order_share_7", "order_momentum", "event_class",
    )
    shares = [f for f in out.columns if f.endswith(("share_7", "momentum")) or f in ("volatility_7", "pace_vs_14")]
    return rounded(rounded(rounded(texted(out), 6, "large_order_threshold"), 4, *shares), 2, "max_order_3", "specialist_max_order_7", "large_total_7")


_EVENTS_OF = "SELECT sig.*, CASE WHEN od.l3 >= 1 AND od.m3 >= 180000 AND (od.ls >= 1 OR od.ll >= 1) AND u >= 3 AND so / o7 * 100 <= 55 AND o7 / (o14 / 2) >= 1.05 THEN 'Event Pre-spike' WHEN od.l7 >= 1 AND od.l3 = 0 AND (o7 / (o14 / 2) <= 0.82 OR so / o7 * 100 >= 50) THEN 'Event Cooldown' WHEN od.l7 >= 1 OR lts > 0 OR ltl > 0 THEN 'Event Volatile' ELSE 'Event Normal' END AS kind FROM sig LEFT JOIN od USING (s, c) LEFT JOIN se USING (s, c)"
# tracks beside the base as factors of it
_BESIDE = ((fc.STRATEGY_TOTAL, fc.BASE_TRACK, 1.0), (fc.STRATEGY_ADJUSTMENT, fc.ADJUSTMENTS[3], 1.1), (fc.STRATEGY_ADJUSTMENT, fc.ADJUSTMENTS[0], 0.9), (fc.STRATEGY_BASELINE, "mtd_pace", 1.05), (fc.STRATEGY_BASELINE, "hybrid", 0.95))


@query(
    "R15_selector_every_series",
    f"""WITH {_SPIKES}, q AS (SELECT *, (err + actual) * 1.1 AS fl, (err + actual) * 0.9 AS lo_, ((err + actual) * 1.05 + (err + actual) * 0.95 + (err + actual) * 1.1) / 3 AS bl, coalesce(lh >= 55 AND (sp >= 30 OR spm >= 1.35) AND mx >= 250000, false) AS pat, mx >= 700000 AND ts >= 55 AS rep FROM sig),
r AS (SELECT s, c, actual, lvl, score, unnest([
 {{'m': 'conservative', 'v': CASE WHEN lvl = 'Low' THEN lo_ WHEN lvl = 'Medium' THEN least(fl, greatest(lo_, bl)) WHEN pat AND post AND NOT rep THEN least(greatest(fl * 1.20, fl + mx * 0.65), fl * 2.10) WHEN pat AND edge AND rep THEN least(fl + mx * 0.18, fl * 1.65) ELSE fl END,
  'r': CASE WHEN lvl = 'Low' THEN 'low-risk-cap' WHEN lvl = 'Medium' THEN 'medium-risk-guardrail' WHEN pat AND post AND NOT rep THEN 'post-holiday-longhaul-specialist-uplift' WHEN pat AND edge AND rep THEN 'month-end-large-order-light-uplift' ELSE 'high-risk-held' END}},
 {{'m': 'uplift', 'v': CASE WHEN lvl = 'Low' THEN fl WHEN lvl = 'Medium' THEN greatest(fl, bl) WHEN pat THEN least(greatest(fl * (1.10 + least(0.55, greatest(0, score - 4) * 0.08) + CASE WHEN post THEN 0.15 ELSE 0.0 END + CASE WHEN edge THEN 0.08 ELSE 0.0 END), fl + mx * 0.55), fl * 2.60) ELSE fl END,
  'r': CASE WHEN lvl = 'Low' THEN 'low-risk-base' WHEN lvl = 'Medium' THEN 'medium-risk-pace-blend' WHEN pat THEN 'broad-high-risk-uplift' ELSE 'high-risk-no-core-pattern' END}},
 {{'m': 'hybrid_selector', 'v': CASE WHEN lvl = 'Low' THEN least(fl, bl * 1.10) WHEN lvl = 'Medium' THEN 0.65 * fl + 0.35 * bl WHEN rep AND NOT post THEN fl * 0.88 WHEN pat AND (post OR (edge AND sp >= 50)) THEN least(greatest(fl * 1.18, fl + mx * 0.35), fl * 2.00) WHEN lh >= 55 AND score >= 6 AND NOT rep THEN fl * 1.12 ELSE fl END,
  'r': CASE WHEN lvl = 'Low' THEN 'low-risk-baseline-guardrail' WHEN lvl = 'Medium' THEN 'medium-risk-hybrid-blend' WHEN rep AND NOT post THEN 'post-spike-cooldown-cap' WHEN pat AND (post OR (edge AND sp >= 50)) THEN 'hybrid-selective-uplift' WHEN lh >= 55 AND score >= 6 AND NOT rep THEN 'hybrid-longhaul-small-uplift' ELSE 'hybrid-held' END}}]) AS x FROM q)
SELECT s AS series_id, c::VARCHAR AS cutoff, x.m AS model, round(actual, 2) AS actual, round(greatest(0.0, x.v), 6) AS prediction, x.r AS selected_rule, lvl AS risk_level FROM r""",
)
def r15_every(t):
    detail, _, _, signals = _series_signals(t)
    tracks = F.explode(F.array(*[F.struct(F.lit(a).alias("strategy"), F.lit(m).alias("model"), F.lit(k).alias("k")) for a, m, k in _BESIDE]))
    wide = detail.drop("strategy", "model").withColumn("m", tracks).withColumns({"strategy": F.col("m.strategy"), "model": F.col("m.model"), "prediction": F.col("prediction") * F.col("m.k")}).drop("m")
    out = sg.spike_aware_selector(wide, signals)
    return rounded(texted(out.select("series_id", "cutoff", "model", "actual", "prediction", "selected_rule", "risk_level")), 6, "prediction").withColumn("actual", F.round("actual", 2))


@query(
    "R17_two_lanes_every_series",
    f"""WITH {_SPIKES}, ev AS ({_EVENTS_OF}), l AS (SELECT s, c, kind, err + actual AS b, lane, (err + actual) * k AS v, mode FROM ev, (VALUES ('downside_guardrail', 0.9), ('tight_guardrail', 0.85), ('bias_guardrail', 1.05), ('quantile_guardrail', 0.95)) AS t(lane, k), (SELECT unnest(['downside_only', 'conservative', 'normal_guardrail']) AS mode))
SELECT s AS series_id, c::VARCHAR AS cutoff, lane, mode AS model, kind AS event_class, round(CASE WHEN kind = 'Event Cooldown' OR (mode <> 'downside_only' AND kind = 'Event Normal') THEN least(b, v) WHEN mode = 'normal_guardrail' AND kind = 'Event Volatile' THEN 0.82 * b + 0.18 * v ELSE b END, 6) AS prediction,
 CASE WHEN mode = 'downside_only' AND kind = 'Event Cooldown' THEN 'cooldown-downside-only' WHEN mode <> 'downside_only' AND kind IN ('Event Cooldown', 'Event Normal') THEN 'cooldown-or-normal-downside' WHEN mode = 'normal_guardrail' AND kind = 'Event Volatile' THEN 'volatile-small-normal-blend' ELSE 'hold-base' END AS rule FROM l""",
)
def r17_every(t):
    detail, days, states, signals = _series_signals(t)
    events = sg.event_detail(signals, days, states)
    lanes = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in zip(sg.LANES, (0.9, 0.85, 1.05, 0.95))]))
    normal = detail.select("series_id", "cutoff", "actual_date", "prediction", lanes.alias("m")).select("series_id", "cutoff", "actual_date", "m.model", (F.col("prediction") * F.col("m.k")).alias("prediction"))
    out = sg.two_lane_detail(events, normal)
    return rounded(texted(out.select("series_id", "cutoff", "lane", "model", "event_class", "prediction", "rule")), 6)


@query(
    "A31_spike_contributors",
    f"""WITH {OFFICIAL_SQL}, dd AS (SELECT unified_date AS d, sum(amount) AS total FROM official GROUP BY 1 ORDER BY 2 DESC LIMIT 8), v AS (SELECT d, dimension, item, sum(amount) AS revenue, count(*) AS records FROM (SELECT d, total, amount, branch, dept, salesperson, source_tag FROM official JOIN dd ON d = unified_date)
 UNPIVOT (item FOR dimension IN (branch, dept, salesperson, source_tag)) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY d, dimension ORDER BY revenue DESC, item) AS rank FROM v)
SELECT d::VARCHAR AS date, dimension, CAST(rank AS INTEGER) AS rank, item, round(revenue, 2) AS revenue, round(revenue / total * 100, 4) AS revenue_share, records FROM r JOIN dd USING (d) WHERE rank <= 8""",
)
def a31(t):
    source = sg.spike_source(t.official(*_SIGNAL_ROLES), RULES)
    days = source.groupBy(F.col("date").alias("actual_date")).agg(F.sum("amount").alias("actual")).orderBy(F.desc("actual")).limit(8)
    out = sg.contributors(days, source, ("branch", "dept", "salesperson", "source_tag"))
    return rounded(rounded(texted(out), 4), 2, "revenue")


@query(
    "A32_top_value_per_day",
    f"""WITH {OFFICIAL_SQL}, x AS (SELECT unified_date AS d, branch, sum(amount) AS a FROM official GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY a DESC, branch) AS rn FROM x), o AS (SELECT d, count(*) AS orders, max(a) AS mx FROM (SELECT unified_date AS d, order_id, sum(amount) AS a FROM official GROUP BY 1, 2) GROUP BY 1)
SELECT d::VARCHAR AS date, branch AS top_branch, round(a, 2) AS top_branch_amount, orders, round(mx, 2) AS max_order FROM r JOIN o USING (d) WHERE rn = 1""",
)
def a32(t):
    source = sg.spike_source(t.official(*_SIGNAL_ROLES), RULES)
    days = source.groupBy(F.col("date").alias("actual_date")).agg(F.sum("amount").alias("actual")).withColumns({"error": F.lit(1.0), "high_threshold": F.lit(0.0)})
    out = sg.spike_day_summary(days, source, _calendar(t))
    return rounded(texted(out.select("date", "top_branch", "top_branch_amount", "orders", "max_order")), 2)


# --- classes over a signal table derived from orders -------------------------------------------------------------

_OUT = f"""{_SIGNAL_SQL}, x AS (SELECT *, k % 2 = 0 AS h, k % 3 = 0 AS u, k % 5 = 0 AS o, base * 1.1 AS actual, base * 0.1 + (k % 7) AS ae FROM sig)"""


def _signals(t):
    k = F.col("k")
    rows = _signal(t).withColumns(
        {"is_high": k % 2 == 0, "is_large_under": k % 3 == 0, "is_large_over": k % 5 == 0, "actual": F.col("base") * 1.1, "abs_error": F.col("base") * 0.1 + (k % 7), "no_future_leak": F.lit(True), "_c": sg.spike_class()}
    )
    return rows.withColumns({"signal_class": F.col("_c.label"), "signal_action": F.col("_c.action"), "outcome": sg.spike_outcome(F.col("is_high"), F.col("is_large_under"), F.col("is_large_over"))}).drop("_c")


@query(
    "A29_risk_summary",
    f"""WITH {_OUT} SELECT risk_level, count(*) AS samples, count(*) FILTER (h) AS high_days, count(*) FILTER (u) AS large_under_days, round(avg(actual), 2) AS avg_actual, round(sum(ae) / sum(actual) * 100, 4) AS wape, round(avg(sp), 4) AS avg_specialist_share_7, true AS no_future_leak,
 round(count(*) FILTER (h) / (SELECT count(*) FROM x WHERE h) * 100, 4) AS high_capture_rate FROM x GROUP BY 1""",
)
def a29(t):
    out = sg.risk_summary(_signals(t)).select("risk_level", "samples", "high_days", "large_under_days", "avg_actual", "wape", "avg_specialist_share_7", "no_future_leak", "high_capture_rate")
    return rounded(rounded(out, 4), 2, "avg_actual")


@query(
    "A30_class_quality",
    f"""WITH {_OUT}, f AS (SELECT *, sp >= 45 OR spm >= 1.45 AS ss, lh >= 50 OR lhm >= 1.45 AS sl, lo >= 1 AND mx >= greatest(thr * 1.35, 220000) AS so, mds >= 38 OR ts >= 55 AS conc FROM x),
c AS (SELECT *, CASE WHEN risk_level = 'Low' THEN 'Normal' WHEN risk_level = 'High' AND risk_score >= 6 AND so AND lh >= 65 AND sp >= 45 AND NOT conc AND (post OR edge OR pace >= 1.2) THEN 'Pre-spike' WHEN sl AND sp < 28 AND mx >= greatest(thr * 1.05, 180000) AND NOT post AND NOT edge THEN 'Post-spike Cooldown'
 WHEN conc AND pace <= 0.82 AND NOT post THEN 'Post-spike Cooldown' WHEN vol >= 0.85 OR (lo >= 1 AND ts >= 45) OR (so AND (sl OR ss)) OR risk_level = 'High' THEN 'Volatile Hold' ELSE 'Watch' END AS p, CASE WHEN u AND h THEN 'Pre-spike' WHEN o THEN 'Post-spike Cooldown' WHEN h OR u THEN 'Volatile Hold' ELSE 'Normal' END AS a FROM f)
SELECT cl AS class_name, count(*) FILTER (p = cl) AS samples, count(*) FILTER (a = cl) AS target_days, count(*) FILTER (p = cl AND a = cl) AS true_positive, count(*) FILTER (p = cl AND a <> cl) AS false_positive, count(*) FILTER (p <> cl AND a = cl) AS false_negative,
 round(CASE WHEN count(*) FILTER (p = cl) > 0 THEN count(*) FILTER (p = cl AND a = cl) / count(*) FILTER (p = cl) * 100 END, 4) AS precision, round(sum(ae) FILTER (p = cl) / sum(actual) FILTER (p = cl) * 100, 4) AS wape
FROM c, (SELECT unnest(['Pre-spike', 'Post-spike Cooldown', 'Volatile Hold', 'Watch', 'Normal']) AS cl) GROUP BY 1""",
)
def a30(t):
    out = sg.spike_class_summary(_signals(t))
    return rounded(out.select("class_name", "samples", "target_days", "true_positive", "false_positive", "false_negative", "precision", "wape"), 4)


@query("K07_latest_snapshots", f"WITH {_OUT} SELECT k::VARCHAR AS cutoff, risk_level, CASE WHEN k % 3 = 0 THEN 'Event Normal' END AS event_class FROM sig")
def k07(t):
    rows = _signals(t).withColumns({"cutoff": F.col("k"), "actual_date": F.col("k"), "feature_max_date": F.col("k"), "total_7": F.lit(1.0), "total_14": F.lit(1.0)})
    events = rows.where(F.col("k") % 3 == 0).select("cutoff", "actual_date", F.lit("Event Normal").alias("event_class"), F.lit("Hold").alias("event_action"), F.lit(1.0).alias("order_momentum"))
    return g.feature_snapshot(rows, events).select(F.col("cutoff").cast("string").alias("cutoff"), "risk_level", "event_class")


@query(
    "C28_target_progress",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS v, CAST(strftime(min(o_orderdate), '%m') AS INTEGER) AS k FROM orders GROUP BY 1), x AS (SELECT month, round(v * (0.9 + k / 50.0), 2) AS target, v AS actual, v * (0.8 + k / 30.0) AS fc FROM m)
SELECT month, target AS target_revenue, round(actual - target, 2) AS gap_amount, round(actual / target * 100, 2) AS attainment_pct, CASE WHEN (fc - target) / target <= -0.05 THEN 'warning' WHEN round(actual / target * 100, 2) >= 100 THEN 'on_track' ELSE 'tracking' END AS status,
 CASE WHEN (fc - target) / target <= -0.1 THEN 'critical' WHEN (fc - target) / target <= -0.05 THEN 'warning' END AS severity FROM x""",
)
def c28(t):
    m = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum("o_totalprice").alias("combined_revenue"))
    k = F.substring("month", 6, 2).cast("int")
    targets = m.select("month", F.round(F.col("combined_revenue") * (F.lit(0.9) + k / 50.0), 2).alias("target_revenue"))
    ahead = m.select("month", (F.col("combined_revenue") * (F.lit(0.8) + k / 30.0)).alias("consensus"))
    return rounded(g.target_progress(targets, m, ahead).select("month", "target_revenue", "gap_amount", "attainment_pct", "status", "severity"), 2)


@query(
    "A43_run_telemetry",
    """WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') SELECT 'stage' AS kind, 'spec' AS name, count(*) FILTER (k % 4 <> 0) AS observed_count, count(*) FILTER (k % 4 = 0) AS unknown_count, sum(CASE WHEN k % 4 <> 0 THEN k ELSE 0 END)::BIGINT AS total_ms, 0 AS failed, 0 AS blocked FROM r
UNION ALL SELECT 'gate', 'task', count(*) FILTER (k % 5 < 3), count(*) FILTER (k % 5 >= 3), 0, count(*) FILTER (k % 5 = 1), count(*) FILTER (k % 5 = 2) FROM r""",
)
def a43(t):
    k = F.col("o_orderkey")
    stage = F.when(k % 4 != 0, F.struct(k.alias("durationMs")))
    gate = F.when(k % 5 == 0, F.struct(F.lit("available").alias("status"), F.lit("passed").alias("state"))).when(k % 5 == 1, F.struct(F.lit("available").alias("status"), F.lit("failed").alias("state"))).when(k % 5 == 2, F.struct(F.lit("blocked").alias("status"), F.lit("open").alias("state")))
    state = F.when(F.col("o_orderstatus") == "F", F.lit("deleted")).otherwise(F.lit("kept"))
    record = F.to_json(F.struct(k.cast("string").alias("runId"), state.alias("retentionState"), F.struct(stage.alias("spec")).alias("stages"), F.struct(gate.alias("task")).alias("gates")))
    return g.run_telemetry(t.orders.select(record.alias("record")), ("spec",), ("task",)).drop("average_ms")


# --- the whole report (no SQL: recursive forecasts and everything judged on them) ------------------------------

_REPORTS: dict = {}


def forget_reports() -> None:
    """Let the next query build its report anew."""
    _REPORTS.clear()


def _report(t) -> rep.BacktestReport:
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _REPORTS:
        _REPORTS[key] = rep.BacktestReport(t.official(), RULES, _calendar(t))
    return _REPORTS[key]


def _macro(t):
    key = (t.spark.sparkContext.applicationId, t.folder, "macro")
    if key not in _REPORTS:
        _REPORTS[key] = rep.macro_report(_report(t).series)
    return _REPORTS[key]


@query("R08_backtest_detail")
def r08(t):
    return _report(t).detail


@query("R06_adjustment_tracks")
def r06(t):
    return _report(t).base_detail.where(F.col("strategy") == "daily_adjustment")


@query("R12_spike_signals")
def r12(t):
    return _report(t).spike_detail


@query("R13_event_signals")
def r13(t):
    return _report(t).event_detail


@query("R14_spike_diagnostics")
def r14(t):
    r = _report(t)
    return sg.spike_day_summary(r.spike_days, r.source, r.calendar)


@query("R15_spike_aware_selector")
def r15(t):
    return _report(t).selector_detail


@query("R16_normal_day_experiment")
def r16(t):
    return _report(t).normal_day_detail


@query("R17_two_lane_selector")
def r17(t):
    return _report(t).two_lane_detail


@query("R18_accuracy_baseline")
def r18(t):
    r = _report(t)
    return sg.accuracy_baseline(r.summary, r.robust, r.risk_summary)


@query("R19_spike_source", f"WITH {OFFICIAL_SQL} SELECT CASE WHEN NOT is_tour THEN '票務' WHEN dept IN ({_CRUISE}) THEN '郵輪' ELSE '旅行團' END AS business_line, branch = '{DESK}' AS at_desk, dest_category LIKE '%中國長%' AS is_long_haul, count(*) AS receipts, round(sum(amount), 2) AS amount FROM official GROUP BY 1, 2, 3")
def r19(t):
    source = sg.spike_source(t.official(*_SIGNAL_ROLES), RULES)
    return rounded(source.groupBy("business_line", "at_desk", "is_long_haul").agg(F.count(F.lit(1)).alias("receipts"), F.sum("amount").alias("amount")), 2)


@query("A28_lane_summaries")
def a28(t):
    r = _report(t)
    a = sg.normal_day_summary(r.normal_day_detail).withColumn("lane", F.lit(""))
    return a.select("strategy", "model", "lane", "wape", "mape", "samples").unionByName(sg.two_lane_summary(r.two_lane_detail).select("strategy", "model", "lane", "wape", "mape", "samples"))


@query("R20_weight_table")
def r20_weights(t):
    return b.weight_table(_report(t).base_summary)


@query("C26_governance_summary")
def c26_summary(t):
    return rep.governance_report(_report(t), _macro(t))["summary"]


@query("C27_feature_health")
def c27(t):
    return rep.feature_report(_report(t))["health"]


@query("R09_macro_summary")
def r09_summary(t):
    return _macro(t)["summary"]


def _ahead(t):
    """Tracks beyond the last day, by the strategy chosen for each horizon."""
    r = _report(t)
    pairs = r.series.where(F.col("line") == "total").agg(F.max("date").alias("cutoff")).select(F.lit("all").alias("series_id"), "cutoff", F.lit(35).alias("horizon"))
    tracks = fc.strategy_tracks(fc.closed_form_tracks(fc.stats_at(r.series, pairs)))
    weights = b.weight_table(r.base_summary)
    return fc.stitched_tracks(tracks, weights.select(F.col("horizon").alias("bucket"), "strategy")), weights


@query("C29_weighted_consensus")
def c29(t):
    return b.consensus(*_ahead(t))


@query("C30_forecast_summary")
def c30(t):
    return b.forecast_summary(b.consensus(*_ahead(t)), _report(t).series)["month_end"]


@query("C40_forecast_read_model")
def c40(t):
    tracks, weights = _ahead(t)
    return g.forecast_read_model(tracks, weights, _report(t).series, _macro(t)["summary"])["daily"]


_LAG_NAMES = tuple(f"lag_{n}" for n in s.LAGS)


@query(
    "R04_first_splits",
    f"""WITH {TS_SQL}, cut AS (SELECT unnest(generate_series((SELECT m FROM top) - 30, (SELECT m FROM top) - 1, INTERVAL 1 DAY))::DATE AS c),
y AS (SELECT d, round(v * 100)::BIGINT AS y FROM ts WHERE line = 'total'), m AS (SELECT d, y, {", ".join(f"lag(y, {n}) OVER (ORDER BY d) AS lag_{n}" for n in s.LAGS)} FROM y),
long AS (SELECT d, y, lag_{max(s.LAGS)} IS NOT NULL AS whole, unnest(range({len(s.LAGS)})) AS feature, unnest([{", ".join(_LAG_NAMES)}])::DOUBLE AS x FROM m),
edges AS (SELECT feature, quantile_cont(x, {[k / boosting.BINS for k in range(1, boosting.BINS)]}) AS e FROM long WHERE d <= (SELECT min(c) FROM cut) GROUP BY 1),
cells AS (SELECT c, feature, len(list_filter(e, lambda q: q < x)) AS bin, sum(y)::BIGINT AS s, count(*) AS n FROM long JOIN edges USING (feature) JOIN cut ON d <= c WHERE whole GROUP BY 1, 2, 3),
u AS (SELECT c, feature, bin, sum(s) OVER w::DOUBLE AS ls, sum(n) OVER w AS ln, sum(s) OVER (PARTITION BY c, feature)::DOUBLE AS s, sum(n) OVER (PARTITION BY c, feature) AS n FROM cells WINDOW w AS (PARTITION BY c, feature ORDER BY bin)),
g AS (SELECT *, ls * ls / ln + (s - ls) * (s - ls) / (n - ln) AS gain FROM u WHERE ln >= {boosting.LEAST_ROWS} AND n - ln >= {boosting.LEAST_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY gain DESC, feature, bin) AS rn FROM g WHERE gain > s * s / n)
SELECT c::VARCHAR AS cutoff, feature::INTEGER AS feature, bin::INTEGER AS bin, ln::BIGINT AS left_rows, ls::BIGINT AS left_sum FROM r WHERE rn = 1""",
)
def r04_splits(t):
    """The first split of every cutoff's model, over the lags."""
    series = _series(t).where(F.col("line") == s.TOTAL)
    cutoffs = s.cutoff_days(series, 30, (1,))
    matrix = cut_lineage(s.lag_features(series.withColumn("revenue", F.round(F.col("revenue") * 100))))
    rows = boosting.training_rows(matrix, _LAG_NAMES, boosting.bin_edges(matrix, _LAG_NAMES, cutoffs), cutoffs)
    best = boosting.best_splits(rows.withColumns({"residual": F.col("label"), "node": F.lit(1)}))
    return texted(best.select("cutoff", "feature", "bin", "left_rows", "left_sum"))


@query("R04_learned_track")
def r04(t):
    """The total, thirty days ahead from each of the last thirty days."""
    series = cut_lineage(_series(t).where(F.col("line") == s.TOTAL))
    return fc.learned_track(series, _calendar(t), s.cutoff_days(series, 30, (1,)), AHEAD)
