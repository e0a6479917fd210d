"""Dashboard read models over the daily facts: totals, rankings, shares, trends and reconciliation.

The facts hold one row per configured entity and day, so everything after the first aggregate is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_key, time_of, to_day
from tallyspark.functions.keys import attach_one_row
from tallyspark.operators.filters import Period
from tallyspark.operators.mart import LINES
from tallyspark.session import cut_lineage

TOLERANCE = 1.0
OTHER_SLICE = "其他"


def line_total() -> Column:
    return F.col("tour") + F.col("cruise") + F.col("ticket")


def filtered(facts: DataFrame, period: Period, entity: str | None = None, seller: str | None = None) -> DataFrame:
    """Facts of a period; ``entity`` narrows the branch channel, ``seller`` the specialist channel."""
    out = facts.where(period.predicate(F.col("day")))
    for channel, name in (("branch", entity), ("specialist", seller)):
        if name is not None:
            out = out.where((F.col("channel") != channel) | (F.trim("entity") == name.strip()))
    return out


def of_channel(facts: DataFrame, channel: str) -> DataFrame:
    return facts.where(F.col("channel") == channel)


def _channel_sum(channel: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("channel") == channel, line_total())), F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def _channel_totals(facts: DataFrame, keys: list[Column]) -> DataFrame:
    sums = facts.groupBy(*keys).agg(
        _channel_sum("branch").alias("branch_revenue"), _channel_sum("specialist").alias("specialist_revenue")
    )
    return sums.withColumn("combined_revenue", F.col("branch_revenue") + F.col("specialist_revenue"))


def annual_summary(facts: DataFrame) -> DataFrame:
    totals = _channel_totals(facts, [F.year("day").alias("year")])
    return totals.withColumns(
        {
            "branch_share_pct": _share(F.col("branch_revenue"), F.col("combined_revenue")),
            "specialist_share_pct": _share(F.col("specialist_revenue"), F.col("combined_revenue")),
        }
    )


def monthly_trend(facts: DataFrame) -> DataFrame:
    return _channel_totals(facts, [month_key(F.col("day")).alias("month")])


def revenue_totals(facts: DataFrame, period: Period = Period(), entity: str | None = None, seller: str | None = None) -> DataFrame:
    """One row of channel totals; choosing a branch empties the specialist side."""
    rows = filtered(facts, period, entity, seller)
    return _channel_totals(rows if entity is None else of_channel(rows, "branch"), [])


def entity_totals(facts: DataFrame) -> DataFrame:
    sums = facts.groupBy("entity").agg(*[F.sum(c).alias(c) for c in LINES])
    return sums.withColumn("total_revenue", line_total())


def ranking(facts: DataFrame, top: int | None = None, share_after_top: bool = False) -> DataFrame:
    """Entities by total revenue with rank and share.

    ``share_after_top`` takes the share within the listed top only, as one older report does. The windows run
    over configured entities, not over receipts.
    """
    totals = entity_totals(facts)
    by_value = [F.desc("total_revenue"), F.asc("entity")]
    if top is not None and share_after_top:
        totals = totals.orderBy(*by_value).limit(top)
    by_rank = Window.orderBy(*by_value)
    every = by_rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumns({"rank": F.row_number().over(by_rank), "_all": F.sum("total_revenue").over(every)})
    ranked = ranked.select("rank", "entity", *LINES, "total_revenue", _share(F.col("total_revenue"), F.col("_all")).alias("share_pct"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def product_totals(facts: DataFrame) -> DataFrame:
    """The three lines with their share, one row each."""
    sums = facts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in LINES]).withColumn("_all", line_total())
    long = sums.unpivot(["_all"], list(LINES), "product", "revenue")
    return long.select("product", "revenue", _share(F.col("revenue"), F.col("_all")).alias("share_pct"))


def year_summary(facts: DataFrame) -> DataFrame:
    """Totals by year, channel and product with every subtotal level, in one pass."""
    long = facts.unpivot(["day", "channel"], list(LINES), "product", "revenue")
    cube = long.select(F.year("day").alias("year"), "channel", "product", "revenue").rollup("year", "channel", "product")
    out = cube.agg(F.sum("revenue").alias("revenue"))
    return out.where(F.col("year").isNotNull()).select(
        "year", F.coalesce("channel", F.lit("all")).alias("channel"), F.coalesce("product", F.lit("all")).alias("product"), "revenue"
    )


def reconciliation(facts: DataFrame) -> DataFrame:
    """Six totals computed along different paths must agree within one unit.

    The grid (entities by days) is written once, so the receipts behind it are read once and not for every total.
    """
    facts = cut_lineage(facts.select("channel", "entity", "day", "month", *LINES))

    def total(df: DataFrame, value: Column) -> Column:
        return df.agg(F.coalesce(F.sum(value), F.lit(0.0))).scalar()

    def in_channel(channel: str, value: str) -> Column:
        return F.when(F.col("channel") == channel, F.col(value))

    by_entity = facts.groupBy("channel", "entity").agg(F.sum(line_total()).alias("v"))
    long = facts.unpivot(["channel"], list(LINES), "product", "amount")
    by_product = long.groupBy("channel", "product").agg(F.sum("amount").alias("v"))
    base = facts.agg(_channel_sum("branch").alias("branch"), _channel_sum("specialist").alias("specialist"), F.coalesce(F.sum(line_total()), F.lit(0.0)).alias("combined"))
    checks = {
        "annual_total": ("combined", total(annual_summary(facts), F.col("combined_revenue"))),
        "monthly_total": ("combined", total(monthly_trend(facts), F.col("combined_revenue"))),
        "branch_ranking_total": ("branch", total(by_entity, in_channel("branch", "v"))),
        "specialist_ranking_total": ("specialist", total(by_entity, in_channel("specialist", "v"))),
        "branch_product_total": ("branch", total(by_product, in_channel("branch", "v"))),
        "specialist_product_total": ("specialist", total(by_product, in_channel("specialist", "v"))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check_key"), F.col(e).alias("expected"), a.alias("actual")) for k, (e, a) in checks.items()])
    out = base.select(F.explode(rows).alias("r")).select("r.*")
    delta = F.round(F.col("actual") - F.col("expected"), 2)
    return out.withColumns({"delta": delta, "status": F.when(F.abs(delta) < TOLERANCE, F.lit("matched")).otherwise(F.lit("drift"))})


def kpi_row(facts: DataFrame, receipts: DataFrame, period: Period = Period(), entity: str | None = None, seller: str | None = None) -> DataFrame:
    """One row: line totals and shares, distinct branches and distinct salespeople in view."""
    view = of_channel(filtered(facts, period, entity), "branch")
    sums = view.agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in LINES], F.countDistinct("entity").alias("branch_count")
    ).withColumn("total", line_total())
    people = period.apply(receipts, "unified_date")
    if entity is not None:
        people = people.where(F.trim("branch") == entity.strip())
    if seller is not None:
        people = people.where(F.trim("salesperson") == seller.strip())
    people = people.select(F.trim("salesperson").alias("s"))
    row = attach_one_row(sums, people.where(F.col("s") != "").agg(F.countDistinct("s").alias("salesperson_count")))
    shares = {f"{c}_share_pct": F.when(F.col("total") != 0, F.round(F.col(c) / F.col("total") * 100, 1)).otherwise(F.lit(0.0)) for c in LINES}
    return row.withColumns(shares)


def drilldown(df: DataFrame, category: Column, measure: str) -> DataFrame:
    """A measure by category with its share; rows without a category do not count."""
    sums = df.select(category.alias("category"), F.col(measure).alias("_m")).where(F.col("category").isNotNull())
    sums = sums.groupBy("category").agg(F.sum("_m").alias("value"))
    whole = attach_one_row(sums, sums.agg(F.sum("value").alias("_all")))
    return whole.select("category", "value", F.when(F.col("_all") != 0, F.col("value") / F.col("_all") * 100).otherwise(F.lit(0.0)).alias("share_pct"))


def top_slices(totals: DataFrame, label: str, value: str, limit: int = 7, keep: int = 6) -> DataFrame:
    """Positive slices, largest first; beyond ``limit`` of them the tail is summed as one slice.

    Only the ``keep`` largest are ranked, so the tail may be of any length.
    """
    positive = totals.where(F.col(value) > 0).select(F.col(label).alias("label"), F.col(value).alias("value"))
    head = positive.orderBy(F.desc("value"), "label").limit(keep).withColumn("_head", F.lit(True))
    marked = positive.join(head.select("label", "_head"), "label", "left")
    size = positive.agg(F.count(F.lit(1)).alias("_n"))
    marked = attach_one_row(marked, size)
    folded = F.when((F.col("_n") > limit) & F.col("_head").isNull(), F.lit(OTHER_SLICE)).otherwise(F.col("label"))
    return marked.select(folded.alias("label"), "value").groupBy("label").agg(F.sum("value").alias("value"))


def batch_summary(df: DataFrame, label: str, target_day: str) -> DataFrame:
    """One row about an upload batch."""
    stamp = time_of(df, "receipt_time")
    return df.agg(
        F.lit(label).alias("table_name"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.when(F.trim("order_id") != "", F.trim("order_id"))).alias("order_ids"),
        F.date_format(F.min(stamp), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max(stamp), "yyyy-MM-dd").alias("max_date"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("amount"),
        F.coalesce(F.max(F.to_date(stamp) == F.lit(target_day).cast("date")), F.lit(False)).alias("has_target_day"),
    )


def date_source_diagnostics(main: DataFrame, secondary: dict[str, DataFrame], target_day: str) -> DataFrame:
    """Coverage of a target day in the main sheet and in each product sheet, with the mismatch flag."""

    def row(df: DataFrame, label: str, column: str, amount: Column) -> DataFrame:
        day = to_day(df, column)
        return df.agg(
            F.lit(label).alias("source"),
            F.lit(column).alias("date_column"),
            F.count(F.lit(1)).alias("rows"),
            F.count(F.when(day == F.lit(target_day).cast("date"), 1)).alias("target_rows"),
            F.date_format(F.max(day), "yyyy-MM-dd").alias("max_date"),
            amount.alias("amount"),
        )

    out = row(main, "main", "receipt_time", F.round(F.sum("amount"), 2)).withColumn("_main", F.lit(True))
    for label, frame in secondary.items():
        out = out.unionByName(row(frame, label, "trans_time", F.lit(None).cast("double")).withColumn("_main", F.lit(False)))
    verdict = out.agg(
        ((F.sum(F.when(F.col("_main"), F.col("target_rows"))) == 0) & (F.sum(F.when(~F.col("_main"), F.col("target_rows"))) > 0)).alias("date_mismatch")
    )
    return attach_one_row(out.drop("_main"), verdict)


def analytics_bundle(facts: DataFrame, period: Period = Period(), entity: str | None = None, seller: str | None = None) -> dict[str, DataFrame]:
    """Annual, monthly, ranking, product and reconciliation datasets under one set of filters."""
    view = cut_lineage(filtered(facts, period, entity, seller))
    branch, specialist = of_channel(view, "branch"), of_channel(view, "specialist")
    return {
        "annual_summary": annual_summary(view),
        "monthly_trend": monthly_trend(view),
        "branch_ranking": ranking(branch),
        "specialist_ranking": ranking(specialist),
        "branch_products": product_totals(branch),
        "specialist_products": product_totals(specialist),
        "reconciliation": reconciliation(view),
    }


def facts_read_model(facts: DataFrame) -> dict[str, DataFrame]:
    """The all-time bundle plus combined product totals. The grid is written once; every part reads it from there."""
    facts = cut_lineage(facts)
    return {**analytics_bundle(facts), "combined_products": product_totals(facts)}
