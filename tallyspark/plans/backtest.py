"""Rolling backtests: error detail, summaries, weights, fusion and diagnostics.

Detail rows are one per (series, cutoff, horizon, strategy, model): calendar-sized per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import days_to_month_end, is_weekend
from tallyspark.functions.errors import error_aggregates, ratio_pct, summarize_errors, with_errors
from tallyspark.operators.series import TOTAL, cutoff_days, month_end_cutoffs
from tallyspark.plans.forecast import (
    BASE_TRACK,
    STRATEGY_BY_LINE,
    STRATEGY_TOTAL,
    TRACKS,
    all_predictions,
    closed_form_tracks,
    long_tracks,
    stats_at,
    strategy_tracks,
)
from tallyspark.sources.calendar import day_flags, with_day_flags

WINDOW_DAYS = 30
HORIZONS = (1, 7, 30)
FUSION = "fusion"
MACRO_7D, MACRO_MONTH_END = "7-Day Macro", "Month-End Macro"
SUMMARY_KEYS = ["series_id", "strategy", "model", "horizon"]

# The five ways of leaving extreme days out, as (label, actual share, error share).
TRIM_RULES = (
    ("All Days", None, None),
    ("Trim Actual Top 5%", "a95", None),
    ("Trim AbsError Top 5%", None, "e95"),
    ("Trim Actual or AbsError Top 5%", "a95", "e95"),
    ("Normal Days - Trim Top 10%", "a90", "e90"),
)
NORMAL_RULE = "Normal Days - Trim Top 10%"


def _actuals(series: DataFrame) -> DataFrame:
    return series.where(F.col("line") == TOTAL).select("series_id", F.col("date").alias("actual_date"), F.col("revenue").alias("actual"))


def backtest_detail(series: DataFrame, calendar, window_days: int = WINDOW_DAYS, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Predictions of every strategy against what happened, for the last cutoffs of each horizon."""
    pairs = cutoff_days(series, window_days, horizons)
    predicted = all_predictions(series, pairs, calendar).withColumnRenamed("date", "actual_date")
    wanted = predicted.join(pairs.select("series_id", "cutoff", "horizon"), ["series_id", "cutoff", "horizon"], "left_semi")
    joined = wanted.join(_actuals(series), ["series_id", "actual_date"])
    return with_errors(joined.select("series_id", "cutoff", "actual_date", "horizon", "strategy", "model", "actual", "prediction"))


def backtest_summary(detail: DataFrame) -> DataFrame:
    return summarize_errors(detail, SUMMARY_KEYS)


# --- weights and fusion -------------------------------------------------------------------------------------


def _inverse(errors: Column) -> Column:
    """Inverse errors; a missing one counts as the worst known."""
    worst = F.array_max(errors)
    return F.transform(errors, lambda v: F.lit(1.0) / F.greatest(F.coalesce(F.nanvl(v, F.lit(None)), worst), F.lit(0.01)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _bounded_weights(errors: Column, low: float, high: float) -> Column:
    """Shares in proportion to the inverse errors, each within the bounds, adding up to one.

    Every round pins the first free share that is out of bounds to its bound, and what is left is dealt out among the
    others; after as many rounds as there are tracks nothing moves any more. A pinned share is kept in ``pinned``, a
    free one is null there.
    """
    n = len(TRACKS)

    def shares(inverse: Column, pinned: Column) -> Column:
        free = _sum(F.zip_with(inverse, pinned, lambda x, p: F.when(p.isNull(), x).otherwise(0.0)))
        left = F.lit(1.0) - _sum(F.transform(pinned, lambda p: F.coalesce(p, F.lit(0.0))))
        return F.zip_with(inverse, pinned, lambda x, p: F.coalesce(p, x / free * left))

    def pin(inverse: Column, pinned: Column) -> Column:
        now = shares(inverse, pinned)
        off = F.zip_with(now, pinned, lambda x, p: p.isNull() & ((x < low) | (x > high)))
        first = F.array_position(off, True)
        return F.zip_with(F.transform(pinned, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), now, lambda s, x: F.when(s["i"] == first - 1, F.when(x < low, F.lit(low)).otherwise(F.lit(high))).otherwise(s["p"]))

    inverse = _inverse(errors)
    pinned = F.array(*[F.lit(None).cast("double")] * n)
    settled = F.aggregate(F.sequence(F.lit(1), F.lit(n)), pinned, lambda acc, _: pin(inverse, acc), lambda acc: shares(inverse, acc))
    whole = _sum(settled)
    even = F.array(*[F.lit(1.0 / n)] * n)
    return F.when(F.array_max(errors).isNull() | (whole <= 0), even).otherwise(F.transform(settled, lambda w: w / whole))


def _metric_array(metric: str) -> Column:
    """The metric of the three tracks in fixed order, null where one is missing."""
    return F.array(*[F.max(F.when(F.col("model") == m, F.col(metric))) for m in TRACKS])


def inverse_weights(summary: DataFrame, keys: list[str], low: float = 0.10, high: float = 0.65) -> DataFrame:
    """Weights of the three tracks by inverse error, kept within bounds; one row per key."""
    rows = summary.where(F.col("model").isin(*TRACKS)).groupBy(*keys).agg(_metric_array("wape").alias("m"))
    weighted = rows.withColumn("w", _bounded_weights(F.col("m"), low, high))
    return weighted.select(*keys, *[F.col("w")[i].alias(f"w_{m}") for i, m in enumerate(TRACKS)])


def macro_weights(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The same without bounds, as plain expressions."""
    rows = summary.where(F.col("model").isin(*TRACKS)).groupBy(*keys).agg(_metric_array("wape").alias("m"))
    worst = F.array_max("m")
    inverse = F.transform("m", lambda v: F.lit(1.0) / F.greatest(F.coalesce(v, worst), F.lit(0.01)))
    rows = rows.withColumn("w", inverse).withColumn("_sum", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    return rows.select(*keys, *[F.coalesce(F.col("w")[i] / F.col("_sum"), F.lit(1.0 / len(TRACKS))).alias(f"w_{m}") for i, m in enumerate(TRACKS)])


def fuse(detail: DataFrame, weights: DataFrame, point: list[str], weight_keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Weighted mean of the three tracks at each point that has all of them."""
    wide = detail.where(F.col("model").isin(*TRACKS)).groupBy(*point).agg(
        F.max("actual").alias("actual"),
        *[F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in TRACKS],
        *[F.max(c).alias(c) for c in extra or []],
    )
    complete = wide.where(F.col(TRACKS[0]).isNotNull() & F.col(TRACKS[1]).isNotNull() & F.col(TRACKS[2]).isNotNull())
    joined = complete.join(weights, weight_keys)
    prediction = sum((F.col(m) * F.col(f"w_{m}") for m in TRACKS[1:]), F.col(TRACKS[0]) * F.col(f"w_{TRACKS[0]}"))
    out = joined.select(*point, *(extra or []), F.lit(FUSION).alias("model"), "actual", prediction.alias("prediction"))
    return with_errors(out)


def with_fusion(detail: DataFrame) -> DataFrame:
    weights = inverse_weights(backtest_summary(detail), ["series_id", "horizon", "strategy"])
    point = ["series_id", "cutoff", "actual_date", "horizon", "strategy"]
    return detail.unionByName(fuse(detail, weights, point, ["series_id", "horizon", "strategy"]).select(*detail.columns))


def _best(summary: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the smallest ``order`` values; missing errors come last.

    Errors are compared to nine decimals, so that sums added in another order do not change the choice.
    """
    rest = [c for c in summary.columns if c not in keys]
    numeric = {f.name for f in summary.schema.fields if f.dataType.typeName() == "double"}
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.round(c, 9) if c in numeric else F.col(c))])
    return summary.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(*keys, "b.*")


def best_models(summary: DataFrame, keys: list[str]) -> DataFrame:
    return _best(summary, keys, ["wape", "mape", "strategy", "model"])


def strategy_comparison(summary: DataFrame) -> DataFrame:
    """Best track of either strategy per horizon."""
    tracks = summary.where(F.col("model").isin(*TRACKS) & F.col("strategy").isin(STRATEGY_TOTAL, STRATEGY_BY_LINE))
    best = _best(tracks, ["series_id", "horizon", "strategy"], ["wape", "mape", "model"])
    return best.select("series_id", "horizon", "strategy", F.col("model").alias("best_model"), F.col("wape").alias("best_wape"), F.col("mape").alias("best_mape"), "samples")


def weight_table(summary: DataFrame) -> DataFrame:
    """Recommended strategy per horizon with the track weights in percent."""
    tracks = summary.where(F.col("model").isin(*TRACKS) & F.col("wape").isNotNull())
    recommended = _best(tracks, ["series_id", "horizon"], ["wape", "mape", "strategy", "model"]).select("series_id", "horizon", "strategy")
    weights = inverse_weights(summary, ["series_id", "horizon", "strategy"])
    samples = tracks.groupBy("series_id", "horizon", "strategy").agg(F.max("samples").alias("samples"))
    best = strategy_comparison(summary).select("series_id", "horizon", "strategy", "best_wape")
    keys = ["series_id", "horizon", "strategy"]
    joined = recommended.join(weights, keys).join(samples, keys, "left").join(best, keys, "left")
    return joined.select(*keys, *[(F.col(f"w_{m}") * 100).alias(m) for m in TRACKS], "samples", "best_wape")


# --- robust and segmented errors ----------------------------------------------------------------------------


def robust_errors(detail: DataFrame) -> DataFrame:
    """Next-day errors under five trimming rules; thresholds are quantiles within each model.

    A group is one model of one series over the backtest window, so its exact quantiles stay small.
    """
    base = detail.where(F.col("horizon") == 1)
    limits = base.groupBy(*SUMMARY_KEYS).agg(
        F.percentile("actual", 0.95).alias("a95"),
        F.percentile("abs_error", 0.95).alias("e95"),
        F.percentile("actual", 0.90).alias("a90"),
        F.percentile("abs_error", 0.90).alias("e90"),
    )
    missing = F.lit(None).cast("double")
    rules = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("rule"),
                    (F.col(a) if a else missing).alias("actual_threshold"),
                    (F.col(e) if e else missing).alias("abs_error_threshold"),
                )
                for label, a, e in TRIM_RULES
            ]
        )
    )
    flagged = base.join(limits, SUMMARY_KEYS).withColumn("r", rules).select(*base.columns, "r.*")
    keep = F.coalesce(F.col("actual") <= F.col("actual_threshold"), F.col("actual_threshold").isNull()) & F.coalesce(
        F.col("abs_error") <= F.col("abs_error_threshold"), F.col("abs_error_threshold").isNull()
    )
    flagged = flagged.withColumn("_keep", keep)
    kept, removed = F.col("_keep"), ~F.col("_keep")

    def total(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0.0))

    return flagged.groupBy("rule", *SUMMARY_KEYS, "actual_threshold", "abs_error_threshold").agg(
        *error_aggregates(kept)[:-1],
        F.count(F.lit(1)).alias("samples"),
        F.count(F.when(kept, 1)).alias("kept_samples"),
        F.count(F.when(removed, 1)).alias("removed_samples"),
        total(removed, "actual").alias("removed_actual"),
        total(removed, "abs_error").alias("removed_abs_error"),
        ratio_pct(total(removed, "abs_error"), F.sum("abs_error")).alias("removed_error_share"),
    )


def segmented_errors(detail: DataFrame, calendar) -> DataFrame:
    """Errors by six overlapping segmentations of the predicted days."""
    per_day = detail.groupBy("series_id", "actual_date").agg(F.first("actual").alias("_actual"))
    positive = per_day.where(F.col("_actual") > 0).groupBy("series_id").agg(
        F.percentile("_actual", 0.75).alias("_high"), F.percentile("_actual", 0.25).alias("_low")
    )
    work = with_day_flags(detail.join(positive, "series_id", "left"), "actual_date", day_flags(calendar))
    day, actual = F.col("actual_date"), F.col("actual")
    high, low = F.coalesce("_high", F.lit(0.0)), F.coalesce("_low", F.lit(0.0))
    number, left = F.dayofmonth(day), days_to_month_end(day)
    segments = {
        "All Days WAPE": F.lit("All Days"),
        "Non-zero Days WAPE": F.when(actual > 0, F.lit("Non-zero Days")).otherwise(F.lit("Zero Days")),
        "Revenue Size WAPE": F.when(actual >= high, F.lit("High Revenue Days"))
        .when((actual > 0) & (actual <= low), F.lit("Low Revenue Days"))
        .when(actual == 0, F.lit("Zero Days"))
        .otherwise(F.lit("Mid Revenue Days")),
        "Weekend / Weekday WAPE": F.when(is_weekend(day), F.lit("Weekend")).otherwise(F.lit("Weekday")),
        "Month Window WAPE": F.when(number <= 3, F.lit("Month Start"))
        .when(number.between(14, 16), F.lit("Month Mid"))
        .when(left <= 3, F.lit("Month End"))
        .otherwise(F.lit("Regular Month Days")),
        "Holiday / Travel Expo Near-window WAPE": F.when(F.col("is_public_holiday") == 1, F.lit("Public Holiday"))
        .when(F.col("is_travel_expo") == 1, F.lit("Travel Expo"))
        .when(F.col("is_near_public_holiday") == 1, F.lit("Near Public Holiday"))
        .when(F.col("is_near_travel_expo") == 1, F.lit("Near Travel Expo"))
        .otherwise(F.lit("Normal Calendar Day")),
    }
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("segment")) for k, v in segments.items()]))
    long = work.withColumn("g", pairs).select(*detail.columns, "g.*")
    return summarize_errors(
        long, ["category", "segment", *SUMMARY_KEYS], [F.sum("actual").alias("actual_total"), F.sum("abs_error").alias("abs_error_total")]
    )


# --- macro --------------------------------------------------------------------------------------------------


def macro_detail(series: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Seven-day totals and month-end landings of the closed-form tracks, against what happened."""
    week = cutoff_days(series, window_days, (7,)).select("series_id", "cutoff", "horizon")
    month = month_end_cutoffs(series, window_days)
    pairs = week.unionByName(month.select("series_id", "cutoff", "horizon"))
    daily = long_tracks(strategy_tracks(closed_form_tracks(stats_at(series, pairs))))
    actual = _actuals(series)
    keys = ["series_id", "cutoff", "strategy", "model"]

    ahead = daily.where(F.col("horizon") <= 7).join(week.select("series_id", "cutoff"), ["series_id", "cutoff"], "left_semi")
    seven = ahead.groupBy(*keys).agg(F.sum("prediction").alias("prediction"))
    known = week.join(actual, "series_id").where(F.col("actual_date").between(F.date_add("cutoff", 1), F.date_add("cutoff", 7)))
    known = known.groupBy("series_id", "cutoff").agg(F.sum("actual").alias("actual"))
    seven = seven.join(known, ["series_id", "cutoff"]).select(
        *keys,
        F.lit(MACRO_7D).alias("layer"),
        F.date_add("cutoff", 1).alias("window_start"),
        F.date_add("cutoff", 7).alias("window_end"),
        F.lit(7).alias("horizon"),
        "actual",
        "prediction",
    )

    month_start = F.trunc("cutoff", "month")
    spans = month.join(actual, "series_id").where(F.col("actual_date").between(month_start, F.col("month_end")))
    landed = spans.groupBy("series_id", "cutoff", "month_end", "horizon").agg(
        F.sum("actual").alias("actual"), F.coalesce(F.sum(F.when(F.col("actual_date") <= F.col("cutoff"), F.col("actual"))), F.lit(0.0)).alias("mtd_actual")
    )
    remaining = daily.withColumnRenamed("horizon", "_step").join(landed, ["series_id", "cutoff"]).where(F.col("_step") <= F.col("horizon"))
    ends = remaining.groupBy(*keys, "month_end", "horizon", "actual", "mtd_actual").agg(F.sum("prediction").alias("_rest"))
    ends = ends.select(
        *keys,
        F.lit(MACRO_MONTH_END).alias("layer"),
        month_start.alias("window_start"),
        F.col("month_end").alias("window_end"),
        "horizon",
        "actual",
        (F.col("mtd_actual") + F.col("_rest")).alias("prediction"),
    )
    return with_errors(seven.unionByName(ends))


def macro_summary(detail: DataFrame) -> DataFrame:
    return summarize_errors(detail, ["series_id", "layer", "strategy", "model"], [F.avg("horizon").alias("avg_horizon")])


def macro_with_fusion(detail: DataFrame) -> DataFrame:
    weights = macro_weights(macro_summary(detail), ["series_id", "layer", "strategy"])
    point = ["series_id", "cutoff", "window_start", "window_end", "layer", "horizon", "strategy"]
    return detail.unionByName(fuse(detail, weights, point, ["series_id", "layer", "strategy"]).select(*detail.columns))


# --- consensus and forecast summary -------------------------------------------------------------------------


def consensus(tracks: DataFrame, weights: DataFrame, band: float = 0.15) -> DataFrame:
    """Weighted consensus of stitched tracks by horizon bucket, with a band around it.

    ``weights`` is the weight table; a bucket without weights takes the longest one known, else equal parts.
    """
    from tallyspark.functions.dates import horizon_bucket

    share = F.col(TRACKS[0]) + F.col(TRACKS[1]) + F.col(TRACKS[2])
    table = weights.where(share > 0).select("series_id", F.struct(F.col("horizon").alias("bucket"), *[(F.col(m) / share).alias(m) for m in TRACKS]).alias("w"))
    per_series = table.groupBy("series_id").agg(F.collect_list("w").alias("_w"))  # one entry per horizon bucket
    joined = tracks.join(per_series, "series_id", "left").withColumn("bucket", horizon_bucket(F.col("horizon")))

    def pick(b: Column) -> Column:
        return F.try_element_at(F.filter("_w", lambda w: w["bucket"] == b), F.lit(1))

    joined = joined.withColumn("_pick", F.coalesce(pick(F.col("bucket")), pick(F.lit(30)), pick(F.lit(7)), pick(F.lit(1))))
    third = F.lit(1.0 / len(TRACKS))
    value = sum((F.col(m) * F.coalesce(F.col(f"_pick.{m}"), third) for m in TRACKS[1:]), F.col(TRACKS[0]) * F.coalesce(F.col(f"_pick.{TRACKS[0]}"), third))
    out = joined.withColumn("consensus", value)
    return out.select(
        "series_id", "cutoff", "horizon", "bucket", "date", *TRACKS, "consensus", (F.col("consensus") * (1 - band)).alias("lower"), (F.col("consensus") * (1 + band)).alias("upper")
    )


def forecast_summary(agreed: DataFrame, series: DataFrame) -> dict[str, DataFrame]:
    """Totals of the next seven days, and where the month of the first forecast day will land."""
    parts = [*TRACKS, "consensus", "lower", "upper"]
    seven = agreed.where(F.col("horizon") <= 7).groupBy("series_id").agg(
        F.min("date").alias("window_start"), F.max("date").alias("window_end"), *[F.sum(c).alias(c) for c in parts]
    )
    first = agreed.groupBy("series_id").agg(F.min("date").alias("_first"), F.max("cutoff").alias("_cutoff"))
    month = F.date_format("_first", "yyyy-MM")
    to_date = _actuals(series).join(first, "series_id").where(
        (F.trunc("actual_date", "month") == F.trunc("_first", "month")) & (F.col("actual_date") <= F.col("_cutoff"))
    )
    to_date = to_date.groupBy("series_id").agg(F.sum("actual").alias("mtd_actual"))
    rest = agreed.join(first, "series_id").where(F.col("date") <= F.last_day("_first"))
    rest = rest.groupBy("series_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("remaining_days"),
        F.sum("consensus").alias("remaining_prediction"),
        F.sum("lower").alias("_lower"),
        F.sum("upper").alias("_upper"),
    )
    mtd = F.coalesce("mtd_actual", F.lit(0.0))
    ends = rest.join(to_date, "series_id", "left").select(
        "series_id",
        "month",
        mtd.alias("mtd_actual"),
        "remaining_days",
        "remaining_prediction",
        (mtd + F.col("remaining_prediction")).alias("consensus"),
        (mtd + F.col("_lower")).alias("lower"),
        (mtd + F.col("_upper")).alias("upper"),
    )
    return {"seven_day": seven, "month_end": ends}


def reference_rows(detail: DataFrame) -> DataFrame:
    """Next-day rows of the base track of the total: what the signals are judged against."""
    return detail.where((F.col("horizon") == 1) & (F.col("strategy") == STRATEGY_TOTAL) & (F.col("model") == BASE_TRACK))

