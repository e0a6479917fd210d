"""Trailing states per series, keyed by day and read by a lookup of each cutoff's day.

Receipts are reduced once to a row per series, day, order, seller and flags. What a trailing window holds of an order or a
seller changes on few days only: when a row enters it and when that row leaves it. Between those days it is one *span*, so
the work grows with the rows and not with the number of cutoffs. Spans are folded by their two ends before they are laid over
the days, which leaves a calendar-sized table that the cutoffs meet by equality.

Windows add up the rows inside them; nothing is subtracted, so no rounding is carried from day to day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.keys import attach_one_row
from tallyspark.session import cut_lineage, written

SERIES, WHOLE = "series_id", "all"
AT = [SERIES, "cutoff"]
UNKNOWN_VALUE = "未知"
LARGE_ORDER_FLOOR = 100_000.0
LARGE_ORDER_SHARE = 0.95
GRID = 1000  # marks of the sketch that brackets the rank
# order states: subset of the receipts and days of the window
ORDER_STATES = (("", 3), ("", 7), ("", 14), ("specialist_", 7), ("longhaul_", 7))
SELLER_DAYS = 7


def with_series(df: DataFrame) -> DataFrame:
    """Rows that name no series belong to the series of everything."""
    return df if SERIES in df.columns else df.withColumn(SERIES, F.lit(WHOLE))


def order_days(source: DataFrame, series: Column | None = None) -> DataFrame:
    """Receipts as one row per series, order, day, seller and flags; everything below starts from these.

    Every receipt counts in the series ``all`` and, with ``series``, in the series that expression names (none if null).
    """
    keys = ["date", "order_id", "salesperson", "at_desk", "is_specialist", "is_long_haul"]
    measures = [F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("receipts")]
    if series is None:
        return source.groupBy(*keys).agg(*measures).select(F.lit(WHOLE).alias(SERIES), *keys, "amount", "receipts")
    # summed by the name first, so that the copy for the series of everything is made of sums
    sums = source.withColumn("_named", series).groupBy("_named", *keys).agg(*measures)
    rows = sums.withColumn(SERIES, F.explode(F.array_distinct(F.array_compact(F.array(F.lit(WHOLE), "_named")))))
    return rows.groupBy(SERIES, *keys).agg(F.sum("amount").alias("amount"), F.sum("receipts").alias("receipts"))


def _asked(cutoffs: DataFrame) -> DataFrame:
    return with_series(cutoffs).select(*AT).distinct()


def _with_own(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Rows with the one row that ``own`` holds of their series.

    The few rows of ``own`` are sent to the rows. A join that deals both sides out by the series puts all rows of a large
    series into one task, and what is aggregated after it stays there.
    """
    return rows.join(F.broadcast(own), SERIES)


def _near(days: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """Rows that some window of the series can hold."""
    reach = asked.groupBy(SERIES).agg(F.date_sub(F.min("cutoff"), width - 1).alias("_first"), F.max("cutoff").alias("_last"))
    # a plain range over all series first: it reaches below the aggregation, so old days are never summed
    whole = attach_one_row(days, reach.agg(F.min("_first").alias("_from"), F.max("_last").alias("_to")))
    whole = whole.where(F.col("date").between(F.col("_from"), F.col("_to"))).select(*days.columns)
    return _with_own(whole, reach).where(F.col("date").between(F.col("_first"), F.col("_last"))).select(*days.columns)


def _track(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.unix_date("date"))


def _last_days(track, width: int):
    return track.rangeBetween(-(width - 1), 0)


def spans(rows: DataFrame, keys: list[str], states: dict[str, tuple[str, int]]) -> DataFrame:
    """State of trailing windows per key as spans ``date <= day < until`` on which nothing changes.

    ``states`` maps a name to a value column and a number of days: ``n_<name>`` counts the values inside, ``a_<name>`` adds
    them up. Null values are not inside. A key's rows lie in one task, so ``rows`` holds one row per key and day.
    """
    values = list(dict.fromkeys(value for value, _ in states.values()))
    enter = F.struct("date", *values)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    leave = [
        F.struct(F.date_add("date", width).alias("date"), *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
        for width in sorted({width for _, width in states.values()})
    ]
    marks = rows.select(*keys, F.explode(F.array(enter, *leave)).alias("_m")).select(*keys, "_m.*")
    track = _track(*keys)
    inside = {}
    for name, (value, width) in states.items():
        inside[f"n_{name}"] = F.count(value).over(_last_days(track, width))
        inside[f"a_{name}"] = F.sum(value).over(_last_days(track, width))
    out = marks.withColumns({**inside, "until": F.lead("date").over(track)}).drop(*values)
    # marks of the same day share their state; only the last of them has a later day behind it
    return out.where(F.col("until") > F.col("date"))


def _on_cutoffs(folded: DataFrame, asked: DataFrame) -> DataFrame:
    """Spans folded by their ends, laid over the days that are cutoffs of the series."""
    days = F.explode(F.sequence("date", F.date_sub("until", 1))).alias("cutoff")
    kept = [c for c in folded.columns if c not in ("date", "until")]
    return folded.select(*kept, days).join(asked, AT)


# --- days ---------------------------------------------------------------------------------------------------


def _sum_if(cond: Column, value: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0))


def _looked_up(daily: DataFrame, asked: DataFrame, states: dict[str, Column]) -> DataFrame:
    """Running states over the days of each series, at its cutoffs. A cutoff without rows of its own is a mark among them."""
    marks = asked.select(SERIES, F.col("cutoff").alias("date"), F.lit(True).alias("_asked"))
    track = daily.withColumn("_there", F.col("date")).unionByName(marks, allowMissingColumns=True)
    return track.withColumns(states).where("_asked").withColumnRenamed("date", "cutoff")


def newest_day(days: DataFrame, cutoffs: DataFrame, width: int) -> DataFrame:
    """Last day with receipts within ``width`` days up to each cutoff; cutoffs without one are left out."""
    asked = _asked(cutoffs)
    daily = _near(with_series(days), asked, width).select(SERIES, "date").distinct()
    newest = F.max("_there").over(_last_days(_track(SERIES), width))
    out = _looked_up(daily, asked, {"feature_max_date": newest}).select(*AT, "feature_max_date")
    return out.where(F.col("feature_max_date").isNotNull())


def window_stats(days: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Totals of the last 7, 14 and 28 days, specialist and long-haul parts, and the daily profile of the week, per series."""
    asked = _asked(cutoffs)
    daily = _near(with_series(days), asked, 28).groupBy(SERIES, "date").agg(
        F.sum("amount").alias("total"), _sum_if(F.col("at_desk")).alias("specialist"), _sum_if(F.col("is_long_haul")).alias("longhaul")
    )
    track = _track(SERIES)
    week = _last_days(track, 7)
    kinds = ("total", "specialist", "longhaul")
    states = {f"{k}_{n}": F.coalesce(F.sum(k).over(_last_days(track, n)), F.lit(0.0)) for n in (7, 14, 28) for k in kinds}
    states["feature_max_date"] = F.max("_there").over(_last_days(track, 28))
    states |= {"_max": F.max("total").over(week), "_mean": F.avg("total").over(week), "_std": F.stddev_pop("total").over(week)}
    out = _looked_up(daily, asked, states).where(F.col("feature_max_date").isNotNull())
    return out.select(
        *AT,
        "feature_max_date",
        *[f"{k}_{n}" for n in (7, 14, 28) for k in kinds],
        F.coalesce("_max", F.lit(0.0)).alias("max_daily_7"),
        pct(F.coalesce("_max", F.lit(0.0)), F.col("total_7")).alias("max_daily_share_7"),
        F.when(F.col("_mean") != 0, F.col("_std") / F.col("_mean")).otherwise(F.lit(0.0)).alias("volatility_7"),
        F.when(F.col("total_14") != 0, F.col("total_7") / (F.col("total_14") / 2)).alias("pace_vs_14"),
    )


# --- orders -------------------------------------------------------------------------------------------------


def large_order_threshold(days: DataFrame, cutoffs: DataFrame, floor: float = LARGE_ORDER_FLOOR) -> DataFrame:
    """Per series and cutoff: the 95th percentile of order totals known by then, at least ``floor``.

    Orders without a receipt after the first cutoff have one total for all cutoffs and stay one row; only the others get a
    row for each cutoff. A sketch of the settled totals brackets all wanted ranks, since the moving orders shift a rank by
    their number at most; what lies under the bracket is a count, and only the bracket is ranked for each cutoff.
    """
    asked = _asked(cutoffs)
    listed = asked.groupBy(SERIES).agg(F.array_sort(F.collect_set("cutoff")).alias("_cutoffs"))
    ends = listed.select(SERIES, F.col("_cutoffs")[0].alias("_first"), F.element_at("_cutoffs", -1).alias("_last"))
    work = _with_own(with_series(days).select(SERIES, "order_id", "date", "amount"), ends)
    early = F.col("date") <= F.col("_first")
    # days inside the cutoff span stay apart, one row each; all before them goes straight into one sum an order
    between = work.where(~early & (F.col("date") <= F.col("_last"))).groupBy(SERIES, "order_id", "date").agg(F.sum("amount").alias("amount"))
    before = work.where(early).select(SERIES, "order_id", F.lit(None).cast("date").alias("date"), "amount")
    per_order = before.unionByName(between).groupBy(SERIES, "order_id").agg(
        F.sum(F.when(F.col("date").isNull(), F.col("amount"))).alias("_base"),
        F.collect_list(F.when(F.col("date").isNotNull(), F.struct("date", "amount"))).alias("_later"),
    )
    # read four times below: written once, an order a row, without its number
    per_order = written(per_order.drop("order_id"))
    settled = per_order.where((F.size("_later") == 0) & F.col("_base").isNotNull()).select(SERIES, F.col("_base").alias("v"))
    moving = _with_own(per_order.where(F.size("_later") > 0), listed).select(SERIES, "_base", "_later", F.explode("_cutoffs").alias("cutoff"))
    known = F.filter("_later", lambda x: x["date"] <= F.col("cutoff"))
    later = F.aggregate(known, F.lit(0.0), lambda a, x: a + x["amount"])
    moving = moving.where(F.col("_base").isNotNull() | (F.size(known) > 0)).select(*AT, (F.coalesce("_base", F.lit(0.0)) + later).alias("v"))

    marks = settled.groupBy(SERIES).agg(F.count(F.lit(1)).alias("_s"), F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("_marks"))
    sizes = moving.groupBy(*AT).agg(F.count(F.lit(1)).alias("_m"))
    wanted = asked.join(sizes, AT, "left").join(marks, SERIES, "left").na.fill(0, ["_m", "_s"])
    wanted = wanted.withColumn("_rank", (F.col("_s") + F.col("_m") - 1) * LARGE_ORDER_SHARE).where(F.col("_rank") >= 0)
    low = F.floor((F.col("_rank") - F.col("_m") - 2) / F.greatest(F.col("_s"), F.lit(1)) * GRID).cast("int") - 1
    high = F.ceil((F.col("_rank") + 2) / F.greatest(F.col("_s"), F.lit(1)) * GRID).cast("int") + 1
    wanted = wanted.select(
        *AT,
        "_rank",
        F.coalesce(F.when(low >= 0, F.get("_marks", low)), F.lit(float("-inf"))).alias("_lo"),
        F.coalesce(F.get("_marks", high), F.lit(float("inf"))).alias("_hi"),
    )
    # read three times below: written once, a cutoff a row
    wanted = cut_lineage(wanted)
    bracket = wanted.groupBy(SERIES).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    under, inside = F.col("v") < F.col("_lo"), F.col("v") <= F.col("_hi")
    # what lies under the bracket is one row of minus infinity
    value = F.when(under, F.lit(float("-inf"))).otherwise(F.col("v")).alias("v")
    shared = _with_own(settled, bracket).where(inside).groupBy(SERIES, value).agg(F.count(F.lit(1)).alias("n"))
    own = _with_own(moving, bracket).where(inside).groupBy(*AT, value).agg(F.count(F.lit(1)).alias("n"))
    each = _with_own(shared, listed).select(SERIES, F.explode("_cutoffs").alias("cutoff"), "v", "n").unionByName(own)
    order = Window.partitionBy(*AT).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.groupBy(*AT, "v").agg(F.sum("n").alias("n")).withColumn("_cum", F.sum("n").over(order)).join(wanted.select(*AT, "_rank"), AT)
    sides = ranked.groupBy(*AT, "_rank").agg(
        F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col("v"))).alias("_a"), F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col("v"))).alias("_b")
    )
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank"))
    return sides.select(*AT, F.greatest(F.lit(floor), q).alias("large_order_threshold"))


def _large_orders(held: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts and sums of the orders above the limit of each cutoff: only those spans are laid over cutoffs one by one."""
    per_series = limits.groupBy(SERIES).agg(F.array_sort(F.collect_list(F.struct("cutoff", "large_order_threshold"))).alias("_limits"))
    most = F.greatest(*[F.col(f"a_{name}{n}") for name, n in ORDER_STATES])
    hit = F.filter("_limits", lambda x: (x["cutoff"] >= F.col("date")) & (x["cutoff"] < F.col("until")) & (x["large_order_threshold"] <= most))
    rows = _with_own(held, per_series).withColumn("_l", F.explode(hit))
    out = []
    for name, n in ORDER_STATES:
        amount = F.col(f"a_{name}{n}")
        large = (F.col(f"n_{name}{n}") > 0) & (amount >= F.col("_l.large_order_threshold"))
        out += [F.count(F.when(large, 1)).alias(f"{name}large_orders_{n}"), F.coalesce(F.sum(F.when(large, amount)), F.lit(0.0)).alias(f"{name}large_total_{n}")]
    return rows.groupBy(SERIES, F.col("_l.cutoff").alias("cutoff")).agg(*out)


def _sellers(near: DataFrame, asked: DataFrame) -> DataFrame:
    """Sellers of the week: how many, the most orders and the largest amount of one. Orders are counted exactly."""
    name = F.trim(F.coalesce("salesperson", F.lit("")))
    name = F.when(name == "", F.lit(UNKNOWN_VALUE)).otherwise(name)
    keys = [SERIES, "_seller"]
    daily = near.groupBy(SERIES, name.alias("_seller"), "order_id", "date").agg(F.sum("amount").alias("v"))
    held = spans(daily, [*keys, "order_id"], {"order": ("v", SELLER_DAYS)}).where(F.col("n_order") > 0)
    one = F.when(F.col("order_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    # an order counts from the first day of a span on and no longer counts from its end; every mark of the week is an end of one
    moves = held.select(*keys, F.explode(F.array(F.struct("date", one.alias("_move")), F.struct(F.col("until").alias("date"), (-one).alias("_move")))).alias("_m"))
    moves = moves.groupBy(*keys, F.col("_m.date").alias("date")).agg(F.sum("_m._move").alias("_move"))
    paid = daily.groupBy(*keys, "date").agg(F.sum("v").alias("v"))
    track = _track(*keys)
    states = moves.unionByName(paid, allowMissingColumns=True).withColumns(
        {
            "orders": F.coalesce(F.sum("_move").over(track.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)),
            "_n": F.count("v").over(_last_days(track, SELLER_DAYS)),
            "amount": F.sum("v").over(_last_days(track, SELLER_DAYS)),
            "until": F.lead("date").over(track),
        }
    )
    states = states.where((F.col("until") > F.col("date")) & (F.col("_n") > 0))
    folded = states.groupBy(SERIES, "date", "until").agg(F.max("orders").alias("_o"), F.max("amount").alias("_a"), F.count(F.lit(1)).alias("_c"))
    return _on_cutoffs(folded, asked).groupBy(*AT).agg(
        F.max("_o").alias("_top_orders"), F.sum("_c").alias("unique_salespersons_7"), F.max("_a").alias("top_seller_amount_7")
    )


def order_window_stats(days: DataFrame, cutoffs: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Order-level measures of the last 3, 7 and 14 days per series: counts, large orders, and seller concentration.

    Cutoffs without a receipt in the last 14 days are left out.
    """
    asked, limits = _asked(cutoffs), with_series(thresholds)
    near = _near(with_series(days), asked, 14)
    subsets = {"": F.lit(True), "specialist_": F.col("is_specialist"), "longhaul_": F.col("is_long_haul")}
    sums = [F.sum(F.when(cond, F.col("amount"))).alias(f"v_{name}") for name, cond in subsets.items()]
    daily = near.groupBy(SERIES, "order_id", "date").agg(*sums)
    held = spans(daily, [SERIES, "order_id"], {f"{name}{n}": (f"v_{name}", n) for name, n in ORDER_STATES}).where(F.col("n_14") > 0)
    counts, tops = [], []
    for name, n in ORDER_STATES:
        there = F.col(f"n_{name}{n}") > 0
        counts.append(F.count(F.when(there, 1)).alias(f"{name}orders_{n}"))
        tops.append(F.max(F.when(there, F.col(f"a_{name}{n}"))).alias(f"{name}max_order_{n}"))
    folded = held.groupBy(SERIES, "date", "until").agg(*counts, *tops)
    stats = _on_cutoffs(folded, asked).groupBy(*AT).agg(
        *[F.sum(f"{name}orders_{n}").alias(f"{name}orders_{n}") for name, n in ORDER_STATES],
        *[F.coalesce(F.max(f"{name}max_order_{n}"), F.lit(0.0)).alias(f"{name}max_order_{n}") for name, n in ORDER_STATES],
    )
    joined = limits.select(*AT, "large_order_threshold").join(stats, AT).join(_large_orders(held, limits), AT, "left").join(_sellers(near, asked), AT, "left")
    joined = joined.na.fill(0, [f"{name}large_orders_{n}" for name, n in ORDER_STATES] + ["_top_orders", "unique_salespersons_7"])
    joined = joined.na.fill(0.0, [f"{name}large_total_{n}" for name, n in ORDER_STATES] + ["top_seller_amount_7"])
    return joined.withColumn("top_seller_order_share_7", pct(F.col("_top_orders"), F.col("orders_7"))).drop("_top_orders")
