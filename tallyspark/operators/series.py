"""Gap-free daily series, their features, and the closed-form statistics forecasts start from.

A series has one row per calendar day, so windows partitioned by series stay as small as the calendar. Many series
(branches, products) spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_key
from tallyspark.operators.mart import LINES
from tallyspark.session import cut_lineage

TOTAL = "total"
LAGS = (1, 2, 7, 14, 28)
ROLLING = (7, 14, 30)
SMOOTHING = 0.15
BLOCK_DAYS = 512
RECENT_DAYS = 56  # the averages below look back eight weeks at most
MIN_DAYS, MIN_NONZERO_DAYS = 45, 10
KEYS = ("series_id", "line")


def daily_lines(receipts: DataFrame, cruise_depts, series: Column | None = None) -> DataFrame:
    """Revenue by series and day, one column per business line and the total. Receipts are aggregated once."""
    line = F.when(~F.col("is_tour"), F.lit("ticket")).when(F.coalesce(F.trim("dept").isin(*cruise_depts), F.lit(False)), F.lit("cruise")).otherwise(F.lit("tour"))
    rows = receipts.select((F.lit("all") if series is None else series).alias("series_id"), F.col("unified_date").alias("date"), line.alias("line"), "amount")
    rows = rows.where(F.col("date").isNotNull() & F.col("series_id").isNotNull())
    sums = [F.coalesce(F.sum(F.when(F.col("line") == x, F.col("amount"))), F.lit(0.0)).alias(x) for x in LINES]
    return rows.groupBy("series_id", "date").agg(*sums, F.sum("amount").alias(TOTAL))


def fill_days(daily: DataFrame, values: list[str]) -> DataFrame:
    """Every day from the series' first to its last, absent days as zero.

    The days are written once: their span and their values are read from there, not worked out from the receipts twice.
    """
    daily = cut_lineage(daily)
    span = daily.groupBy("series_id").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = span.select("series_id", F.explode(F.sequence("_a", "_b")).alias("date"))
    return days.join(daily, ["series_id", "date"], "left").select("series_id", "date", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def daily_series(receipts: DataFrame, cruise_depts, series: Column | None = None) -> DataFrame:
    """``(series_id, line, date, revenue)`` for the total and each line, on one common set of days."""
    filled = fill_days(daily_lines(receipts, cruise_depts, series), [TOTAL, *LINES])
    return filled.unpivot(["series_id", "date"], [TOTAL, *LINES], "line", "revenue").select(*KEYS, "date", "revenue")


def add_series(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sum of two daily series, days of either kept and gaps filled."""
    both = left.select("series_id", "date", "revenue").unionByName(right.select("series_id", "date", "revenue"))
    return fill_days(both.groupBy("series_id", "date").agg(F.sum("revenue").alias("revenue")), ["revenue"])


def viable(series: DataFrame) -> DataFrame:
    """Whether each series is long and busy enough to be modelled on its own."""
    return series.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("days"), F.count(F.when(F.col("revenue") != 0, 1)).alias("nonzero_days")
    ).withColumn("is_viable", (F.col("days") >= MIN_DAYS) & (F.col("nonzero_days") >= MIN_NONZERO_DAYS))


def _by_day() -> Window:
    return Window.partitionBy(*KEYS).orderBy("date")


def lag_features(series: DataFrame) -> DataFrame:
    """Lags, and mean and spread of the preceding days; null until a full window has passed, spread then zero."""
    w = _by_day()
    out = {f"lag_{n}": F.lag("revenue", n).over(w) for n in LAGS}
    for n in ROLLING:
        frame = w.rowsBetween(-n, -1)
        full = F.count("revenue").over(frame) == n
        out[f"rolling_mean_{n}"] = F.when(full, F.avg("revenue").over(frame))
        out[f"rolling_std_{n}"] = F.coalesce(F.when(full, F.stddev_samp("revenue").over(frame)), F.lit(0.0))
    return series.withColumns(out)


def tail(n: int) -> Column:
    """The last ``n`` values up to the row, oldest first."""
    return F.collect_list("revenue").over(_by_day().rowsBetween(-(n - 1), 0))


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def linear_weighted(values: Column) -> Column:
    """Mean with weights 1, 2, 3, … so that the newest value weighs most."""
    n = F.size(values)
    return _sum(F.transform(values, lambda x, i: x * (i + 1))) / (n * (n + 1) / 2)


def trimmed_weighted(values: Column) -> Column:
    """Mean with weights rising from one to two; from eight values on, those above the 90th percentile are left out."""

    def cut(ordered: Column) -> Column:
        position = F.lit(0.9) * (F.size(ordered) - 1)
        low, high = F.floor(position).cast("int"), F.ceil(position).cast("int")
        return ordered[low] + (ordered[high] - ordered[low]) * (position - low)

    def mean(kept: Column) -> Column:
        steps = F.greatest(F.size(kept) - 1, F.lit(1))
        weighted = F.transform(kept, lambda x, i: x * (F.lit(1.0) + i / steps))
        # weights 1 … 2 in equal steps add up to one and a half per value; a single value weighs one
        whole = F.when(F.size(kept) > 1, F.size(kept) * 1.5).otherwise(F.lit(1.0))
        return _sum(weighted) / whole

    kept = let(let(F.array_sort(values), cut), lambda limit: F.filter(values, lambda x: x <= limit))
    return let(F.when(F.size(values) >= 8, kept).otherwise(values), mean)


def array_median(values: Column) -> Column:
    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        return (ordered[F.floor((n - 1) / 2).cast("int")] + ordered[F.floor(n / 2).cast("int")]) / 2

    return F.when(F.size(values) > 0, let(F.array_sort(values), middle))


def with_smoothed_level(series: DataFrame) -> DataFrame:
    """``level``: exponentially weighted mean of all days so far. Needs the day number ``_i`` (a double, from 0).

    Weights are running sums inside blocks of days, so no power leaves the range of a double; the sums of the blocks before
    are carried along, one number each.
    """
    keep = 1 - SMOOTHING
    place = F.col("_i") % BLOCK_DAYS
    inside = Window.partitionBy(*KEYS, F.floor(F.col("_i") / BLOCK_DAYS)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = _by_day().rowsBetween(Window.unboundedPreceding, -1)
    work = series.withColumn("_in", F.sum(F.col("revenue") * F.pow(F.lit(keep), -place)).over(inside) * F.pow(F.lit(keep), place))
    work = work.withColumn("_blocks", F.collect_list(F.when(place == BLOCK_DAYS - 1, F.col("_in"))).over(before))
    carried = F.aggregate("_blocks", F.lit(0.0), lambda acc, x: acc * keep**BLOCK_DAYS + x) * F.pow(F.lit(keep), place + 1)
    whole = (1 - F.pow(F.lit(keep), F.col("_i") + 1)) / SMOOTHING
    return work.withColumn("level", (F.col("_in") + carried) / whole).drop("_in", "_blocks")


def running_stats(series: DataFrame, keep: Column | None = None) -> DataFrame:
    """At every day, what is known up to that day: level, trend, range, weekday effects and recent averages.

    Everything is a running window over one sort of each series, so a grid of cutoffs costs no repeated history.
    ``keep`` picks the days of interest after the windows and before the costlier array arithmetic.
    """
    w = _by_day()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = with_smoothed_level(series.withColumn("_i", (F.row_number().over(w) - 1).cast("double")))
    effects = [F.avg(F.when(F.weekday("date") == k, F.col("revenue"))).over(past) for k in range(7)]
    month = Window.partitionBy(*KEYS, month_key(F.col("date"))).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    windowed = numbered.withColumns(
        {
            "days_known": F.count(F.lit(1)).over(past),
            "nonzero_known": F.count(F.when(F.col("revenue") != 0, 1)).over(past),
            "mean_revenue": F.avg("revenue").over(past),
            "min_revenue": F.min("revenue").over(past),
            "max_revenue": F.max("revenue").over(past),
            "slope": F.regr_slope("revenue", "_i").over(past),
            "intercept": F.regr_intercept("revenue", "_i").over(past),
            **{f"_w{k}": e for k, e in enumerate(effects)},
            "recent_7": F.avg("revenue").over(w.rowsBetween(-6, 0)),
            "_tail": tail(RECENT_DAYS),
            # the month of the next day up to now: a running month mean covers both "month to date" and, on the
            # last day of a month, "the whole month before"
            "mtd_pace": F.avg("revenue").over(month),
        }
    )
    if keep is not None:
        windowed = windowed.where(keep)
    values = F.col("_tail")
    n = F.size(values)

    def newest(count: int) -> Column:
        return F.when(n > count, F.slice(values, -count, count)).otherwise(values)

    def weekdays(weeks: int) -> Column:
        back = F.array(*[F.when(n >= 7 * k, values[n - 7 * k]) for k in range(1, weeks + 1)])
        return F.filter(back, lambda x: x.isNotNull())

    mean = F.col("mean_revenue")
    out = windowed.withColumns(
        {
            "weekday_effects": F.array(*[F.coalesce(F.col(f"_w{k}") - mean, F.lit(0.0)) for k in range(7)]),
            "recent_14_weighted": linear_weighted(newest(14)),
            "recent_21_trimmed": trimmed_weighted(newest(21)),
            "same_weekday_median": array_median(weekdays(8)),
            "_same": let(weekdays(4), lambda v: F.when(F.size(v) > 0, _sum(v) / F.size(v))),
        }
    )
    return out.withColumn("same_weekday_4w", F.coalesce("_same", "recent_14_weighted")).drop("_i", "_tail", "_same", *[f"_w{k}" for k in range(7)])


def weekday_effect(series: DataFrame) -> DataFrame:
    """Mean of each weekday minus the mean of all days."""
    sums = series.groupBy(*KEYS, F.weekday("date").alias("weekday")).agg(F.sum("revenue").alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*KEYS)
    effect = F.col("_s") / F.col("_n") - F.sum("_s").over(whole) / F.sum("_n").over(whole)
    return sums.select(*KEYS, "weekday", effect.alias("effect"))


def linear_trend(series: DataFrame) -> DataFrame:
    first = series.groupBy(*KEYS).agg(F.min("date").alias("_d"))
    numbered = series.join(first, list(KEYS)).withColumn("_i", F.datediff("date", "_d").cast("double"))
    return numbered.groupBy(*KEYS).agg(F.regr_slope("revenue", "_i").alias("slope"), F.regr_intercept("revenue", "_i").alias("intercept"))


def positive_profile(history: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Quantiles of the positive days, or of all days if none is positive.

    One group is the history of one series up to one cutoff: never more rows than calendar days.
    """
    positive = F.when(F.col("revenue") > 0, F.col("revenue"))
    return history.groupBy(*keys).agg(
        *[F.coalesce(F.percentile(positive, q), F.percentile("revenue", q)).alias(name) for name, q in shares.items()]
    )


def cutoff_days(series: DataFrame, window_days: int, horizons: tuple[int, ...]) -> DataFrame:
    """Backtest pairs: the last ``window_days`` cutoffs whose horizon is already known, per series."""
    span = series.where(F.col("line") == TOTAL).groupBy("series_id").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    listed = F.explode(F.array(*[F.lit(h) for h in horizons]))
    pairs = span.select("series_id", "_a", "_b", listed.alias("horizon"))
    last = F.date_sub(F.col("_b"), F.col("horizon"))
    first = F.greatest(F.col("_a"), F.date_sub(last, window_days - 1))
    days = F.when(last >= F.col("_a"), F.sequence(first, last))
    return pairs.select("series_id", F.explode(days).alias("cutoff"), "horizon").withColumn("actual_date", F.date_add("cutoff", F.col("horizon")))


def month_end_cutoffs(series: DataFrame, window_days: int) -> DataFrame:
    """The last ``window_days`` days inside months that are already complete, per series."""
    span = series.where(F.col("line") == TOTAL).groupBy("series_id").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    # the newest complete month ends at _b or at the end of the month before; 3 months always hold enough days
    days = span.select("series_id", "_a", "_b", F.explode(F.sequence(F.greatest(F.col("_a"), F.date_sub("_b", window_days + 62)), F.col("_b"))).alias("cutoff"))
    end = F.last_day("cutoff")
    days = days.where((F.col("cutoff") < end) & (end <= F.col("_b")))
    newest = Window.partitionBy("series_id").orderBy(F.desc("cutoff"))
    ranked = days.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= window_days)
    return ranked.select("series_id", "cutoff", F.last_day("cutoff").alias("month_end"), F.datediff(F.last_day("cutoff"), "cutoff").alias("horizon"))


def history_to(series: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Each cutoff's training rows: days up to it. Cutoffs per series are few and travel as one array."""
    per_series = cutoffs.groupBy("series_id").agg(F.array_sort(F.collect_set("cutoff")).alias("_cutoffs"))
    joined = series.join(per_series, "series_id")
    later = F.filter("_cutoffs", lambda c: c >= F.col("date"))
    return joined.select(*series.columns, F.explode(later).alias("cutoff"))
