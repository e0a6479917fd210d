"""Period-over-period drivers: which products, channels, branches, sellers and windows moved revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.category import product_line
from tallyspark.functions.dates import event_window, month_window, to_day, week_window
from tallyspark.functions.keys import attach_one_row
from tallyspark.roles import UNCLASSIFIED

# Channel and direction labels.
SPECIALIST_CHANNEL, BRANCH_CHANNEL, NO_CHANNEL = "專職通路", "分社通路", "未分類通路"
UP, DOWN, FLAT = "拉升", "拖累", "持平"
DEFAULT_DAYS = 30
TOP_DRIVERS, TOP_ORDERS = 5, 5
DIMENSIONS = ("product_line", "channel", "branch", "salesperson", "dest_category", "source_tag", "event_window")
_LINE_TEXTS = ("source_tag", "source_name", "route", "product_category", "dest_category", "tour_name")


def driver_frame(receipts: DataFrame, desk: str) -> DataFrame:
    """Receipts with a day, as date, amount and the seven dimensions. Blank dimension values become one label."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _LINE_TEXTS if c in receipts.columns]
    day = to_day(receipts, "receipt_time")
    channel = (
        F.when(F.col("branch") == desk, F.lit(SPECIALIST_CHANNEL)).otherwise(F.lit(BRANCH_CHANNEL))
        if "branch" in receipts.columns
        else F.lit(NO_CHANNEL)
    )
    derived = {"product_line": product_line(*texts), "channel": channel, "event_window": event_window(day)}

    def dimension(name: str) -> Column:
        c = derived.get(name, F.col(name) if name in receipts.columns else F.lit(None).cast("string"))
        return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(UNCLASSIFIED)).otherwise(c).alias(name)

    out = receipts.select(
        "order_id",
        day.alias("date"),
        F.coalesce("amount", F.lit(0.0)).alias("amount"),
        *[dimension(d) for d in DIMENSIONS],
        month_window(day).alias("month_window"),
        week_window(day).alias("week_window"),
    )
    return out.where(F.col("date").isNotNull())


def default_periods(frame: DataFrame) -> DataFrame:
    """One row: the latest thirty days against the days before them, else the two halves of the days present."""
    daily = frame.groupBy("date").agg(F.count(F.lit(1)).alias("n"))  # one row per calendar day from here on
    days = daily.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.array_sort(F.collect_list("date")).alias("days"))
    current_start = F.greatest("first", F.date_sub("last", DEFAULT_DAYS - 1))
    row = days.withColumn("current_start", current_start)
    baseline_end = F.date_sub("current_start", 1)
    row = row.withColumn("baseline_end", baseline_end)
    length = F.datediff("last", "current_start")
    row = row.withColumn("baseline_start", F.greatest("first", F.date_sub("baseline_end", length)))
    has_baseline = F.exists("days", lambda d: (d >= F.col("baseline_start")) & (d <= F.col("baseline_end")))
    halves = (~has_baseline | (F.col("baseline_end") < F.col("first"))) & (F.size("days") >= 2)
    middle = F.floor(F.size("days") / 2).cast("int")
    day = F.col("days")
    return row.select(
        F.when(halves, day[middle]).otherwise(F.col("current_start")).alias("current_start"),
        F.col("last").alias("current_end"),
        F.when(halves, day[0]).otherwise(F.col("baseline_start")).alias("baseline_start"),
        F.when(halves, day[middle - 1]).otherwise(F.col("baseline_end")).alias("baseline_end"),
    )


def in_periods(frame: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of either period with their amount in two columns."""
    work = attach_one_row(frame, periods)
    current = F.col("date").between(F.col("current_start"), F.col("current_end"))
    baseline = F.col("date").between(F.col("baseline_start"), F.col("baseline_end"))
    work = work.withColumns(
        {
            "current_amount": F.when(current, F.col("amount")).otherwise(F.lit(0.0)),
            "baseline_amount": F.when(baseline, F.col("amount")).otherwise(F.lit(0.0)),
            "is_current": current,
            "is_baseline": baseline,
        }
    )
    return work.where(F.col("is_current") | F.col("is_baseline")).drop(*periods.columns)


def contributions(frame: DataFrame, periods: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Current, baseline and change by value of every dimension; all dimensions in one aggregation."""
    work = in_periods(frame, periods)
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("driver")) for d in dimensions]))
    sums = work.select(pairs.alias("p"), "current_amount", "baseline_amount").groupBy("p.dimension", "p.driver").agg(
        F.sum("current_amount").alias("current_amount"), F.sum("baseline_amount").alias("baseline_amount")
    )
    sums = sums.withColumn("delta", F.col("current_amount") - F.col("baseline_amount"))
    total = work.agg(F.sum(F.col("current_amount") - F.col("baseline_amount")).alias("_total"))
    out = attach_one_row(sums, total)
    direction = F.when(F.col("delta") > 0, F.lit(UP)).when(F.col("delta") < 0, F.lit(DOWN)).otherwise(F.lit(FLAT))
    rate = F.when(F.abs("_total") > 1e-9, F.col("delta") / F.col("_total") * 100)
    return out.select("dimension", "driver", "current_amount", "baseline_amount", "delta", rate.alias("contribution_rate"), direction.alias("direction"))


def top_drivers(table: DataFrame, limit: int = TOP_DRIVERS, dimensions=DIMENSIONS) -> DataFrame:
    """The largest moves of each dimension. The rank is limited, so every task drops all but its own largest rows before
    any are moved."""
    order = Window.partitionBy("dimension").orderBy(F.desc(F.abs("delta")), "driver")
    ranked = table.where(F.col("dimension").isin(*dimensions)).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def change_summary(frame: DataFrame, periods: DataFrame) -> DataFrame:
    sums = in_periods(frame, periods).agg(
        F.coalesce(F.sum("current_amount"), F.lit(0.0)).alias("current_amount"),
        F.coalesce(F.sum("baseline_amount"), F.lit(0.0)).alias("baseline_amount"),
    )
    delta = F.col("current_amount") - F.col("baseline_amount")
    rate = F.when(F.col("baseline_amount") > 0, delta / F.col("baseline_amount")).otherwise(F.lit(0.0))
    return attach_one_row(sums.withColumns({"delta": delta, "change_rate": rate}), periods)


def reconcile_dimensions(table: DataFrame, summary: DataFrame) -> DataFrame:
    """Each single dimension must add up to the total change."""
    sums = table.groupBy("dimension").agg(F.sum("delta").alias("driver_delta"))
    joined = attach_one_row(sums, summary.select(F.col("delta").alias("total_delta")))
    return joined.withColumn("difference", F.col("driver_delta") - F.col("total_delta"))


def order_concentration(frame: DataFrame, periods: DataFrame, top: int = TOP_ORDERS) -> DataFrame:
    """Share of the largest orders in either period."""
    work = in_periods(frame, periods)
    out = None
    for name, flag, amount in (("baseline", "is_baseline", "baseline_amount"), ("current", "is_current", "current_amount")):
        orders = work.where(flag).groupBy("order_id").agg(F.sum(amount).alias("v"))
        largest = orders.orderBy(F.desc("v")).limit(top).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("top"))
        row = attach_one_row(orders.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("all"), F.count(F.lit(1)).alias("orders")), largest)
        share = F.when(F.col("all") > 0, F.col("top") / F.col("all")).otherwise(F.lit(0.0))
        row = row.select(F.lit(name).alias("period"), share.alias("top_share"), "orders")
        out = row if out is None else out.unionByName(row)
    return out


def driver_analytics(receipts: DataFrame, desk: str, periods: DataFrame | None = None) -> dict[str, DataFrame]:
    frame = driver_frame(receipts, desk)
    periods = default_periods(frame) if periods is None else periods
    table, summary = contributions(frame, periods), change_summary(frame, periods)
    return {
        "periods": periods,
        "change_summary": summary,
        "drivers": table,
        "top_drivers": top_drivers(table),
        "event_window": table.where(F.col("dimension") == "event_window"),
        "order_concentration": order_concentration(frame, periods),
        "reconciliation": reconcile_dimensions(table, summary),
    }
