"""Data-quality scorecards over normalised receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import time_of
from tallyspark.functions.keys import attach_one_row
from tallyspark.functions.labels import quality_health
from tallyspark.functions.money import safe_rate, score, try_double
from tallyspark.functions.quantile import top_share_sum
from tallyspark.functions.text import clean_document_number, is_valid_id
from tallyspark.roles import UNMATCHED

REQUIRED = ("order_id", "receipt_time", "amount", "branch", "salesperson", "trans_time", "source_tag")
# Names of the five dimensions.
DIMENSIONS = ("Date Coverage", "Field Completeness", "Entity Resolution", "Official Scope Health", "Amount Health")


def _usable(df: DataFrame, name: str) -> Column:
    if name == "amount":
        return try_double(F.col(name)).isNotNull()
    c = F.col(name)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def daily_profile(df: DataFrame, required=REQUIRED, time: str = "receipt_time") -> DataFrame:
    """One row per day with every count the dimensions of dates, fields and amounts need.

    The counts travel as one array, so that whatever reads them reads the same aggregate, and the rows are read once.
    """
    present = [c for c in required if c in df.columns]
    value = try_double(F.col("amount")) if "amount" in df.columns else F.lit(None).cast("double")
    filled = F.coalesce(value, F.lit(0.0))
    conditions = [F.lit(True), value.isNull(), filled == 0, filled < 0, *[_usable(df, c) for c in present]]
    counts = F.array(*[F.count(F.when(c, 1)) for c in conditions])
    day = F.to_date(time_of(df, time)) if time in df.columns else F.lit(None).cast("date")
    return df.groupBy(day.alias("day")).agg(F.struct(counts.alias("n"), F.sum(filled).alias("amount")).alias("p"))


def _total(i: int) -> Column:
    return F.coalesce(F.sum(F.col("p.n")[i]), F.lit(0))


def date_coverage(df: DataFrame, time: str = "receipt_time", profile: DataFrame | None = None) -> DataFrame:
    """Span, days present and missing, unparseable rows."""
    daily = daily_profile(df, time=time) if profile is None else profile
    has_day = F.col("day").isNotNull()
    row = daily.agg(
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
        F.count("day").alias("valid_days"),
        _total(0).alias("total_rows"),
        F.coalesce(F.sum(F.when(~has_day, F.col("p.n")[0])), F.lit(0)).alias("invalid_rows"),
    )
    span = F.datediff("max_date", "min_date") + 1
    missing = F.when(F.col("valid_days") > 0, span - F.col("valid_days")).otherwise(F.lit(0))
    row = row.withColumns({"missing_days": missing.cast("long"), "invalid_rate": safe_rate(F.col("invalid_rows"), F.col("total_rows"))})
    missing_rate = safe_rate(F.col("missing_days"), span)
    value = score(100 - F.col("invalid_rate") * 80 - missing_rate * 20)
    return row.withColumn("score", F.when(F.col("valid_days") > 0, value).otherwise(F.lit(0.0)))


def field_completeness(df: DataFrame, required=REQUIRED, profile: DataFrame | None = None) -> DataFrame:
    """One row per required field; absent fields are listed but not scored."""
    present = [c for c in required if c in df.columns]
    daily = daily_profile(df, required) if profile is None else profile
    counts = daily.agg(_total(0).alias("total_rows"), *[_total(4 + i).alias(c) for i, c in enumerate(present)])
    entries = [
        F.struct(
            F.lit(c).alias("field"),
            F.lit("evaluated" if c in present else "not_applicable").alias("status"),
            (F.col(c) if c in present else F.lit(None)).cast("long").alias("complete_rows"),
        )
        for c in required
    ]
    rows = counts.select("total_rows", F.explode(F.array(*entries)).alias("e")).select("e.*", "total_rows")
    return rows.withColumn(
        "complete_rate", F.when(F.col("status") == "evaluated", safe_rate(F.col("complete_rows"), F.col("total_rows")))
    )


def entity_health(df: DataFrame) -> DataFrame:
    """Distinct, repeated and unmatched orders; one row per order first, so no hot order stays whole."""
    key = clean_document_number(F.col("order_id"))
    unmatched = F.coalesce(F.trim("source_tag"), F.lit("")) == UNMATCHED
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    work = df.select(F.when(is_valid_id(key), key).alias("k"), unmatched.alias("u"), amount.alias("a"))
    per_key = work.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("u").cast("long")).alias("un"), F.sum("a").alias("a"), F.sum(F.when(F.col("u"), F.col("a"))).alias("ua")
    )
    zero = F.lit(0)
    row = per_key.agg(
        F.coalesce(F.sum("n"), zero).alias("total_rows"),
        F.count("k").alias("unique_orders"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull() & (F.col("n") > 1), F.col("n"))), zero).alias("duplicate_rows"),
        F.coalesce(F.sum("un"), zero).alias("unmatched_rows"),
        F.coalesce(F.sum("ua"), F.lit(0.0)).alias("unmatched_amount"),
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("total_amount"),
    )
    rates = {
        "duplicate_rate": safe_rate(F.col("duplicate_rows"), F.col("total_rows")),
        "unmatched_rate": safe_rate(F.col("unmatched_rows"), F.col("total_rows")),
        "unmatched_amount_rate": safe_rate(F.col("unmatched_amount"), F.col("total_amount")),
    }
    row = row.withColumns(rates)
    return row.withColumn("score", score(100 - F.col("unmatched_rate") * 60 - F.col("duplicate_rate") * 40))


def scope_health(audit: DataFrame) -> DataFrame:
    """Exclusions are business rules, so only a large excluded amount lowers the score a little."""
    row = audit.withColumns(
        {
            "excluded_row_rate": safe_rate(F.col("excluded_rows"), F.col("raw_rows")),
            "excluded_amount_rate": safe_rate(F.col("excluded_amount"), F.col("raw_amount")),
        }
    )
    return row.withColumn("score", score(100 - F.least(F.col("excluded_amount_rate") / 0.25, F.lit(1.0)) * 20))


def amount_health(df: DataFrame, concentration: bool = True, profile: DataFrame | None = None) -> DataFrame:
    """Missing, zero and negative amounts, and how much the largest 5 % of rows hold.

    ``concentration=False`` is the service variant: no concentration penalty, zero and negative counted once.
    """
    value = try_double(F.col("amount"))
    daily = daily_profile(df) if profile is None else profile
    row = daily.agg(
        _total(0).alias("total_rows"),
        _total(1).alias("missing_rows"),
        _total(2).alias("zero_rows"),
        _total(3).alias("negative_rows"),
        F.coalesce(F.sum("p.amount"), F.lit(0.0)).alias("total_amount"),
    )
    missing = safe_rate(F.col("missing_rows"), F.col("total_rows"))
    weak = safe_rate(F.col("zero_rows") + F.col("negative_rows"), F.col("total_rows"))
    base = 100 - missing * 50 - weak * 40
    if not concentration:
        return row.withColumn("score", score(base))
    sizes = df.select(F.abs(value).alias("v"))
    top = top_share_sum(sizes, "v", 0.05, lambda n: F.greatest(F.lit(1), F.floor(n * 0.05)))
    row = attach_one_row(row, top.select(F.col("top_rows").alias("top5_rows"), F.col("top_sum").alias("top5_amount"), F.col("all_sum").alias("_abs")))
    row = row.withColumn("top5_rate", safe_rate(F.col("top5_amount"), F.col("_abs"))).drop("_abs")
    penalty = F.greatest(F.lit(0.0), F.col("top5_rate") - 0.6) / 0.4 * 10
    return row.withColumn("score", score(base - penalty))


def scorecard(raw: DataFrame, audit: DataFrame, concentration: bool = True) -> dict[str, DataFrame]:
    """Five dimensions and their mean. ``concentration`` chooses the detailed or the service variant."""
    profile = daily_profile(raw)
    dates, fields, entity = date_coverage(raw, profile=profile), field_completeness(raw, profile=profile), entity_health(raw)
    scope, amount = scope_health(audit), amount_health(raw, concentration, profile)
    field_score = fields.agg(score(F.avg(F.col("complete_rate") * 100)).alias("score"))
    parts = (
        (dates, F.concat(F.lit("latest "), F.date_format("max_date", "yyyy-MM-dd"), F.lit(" / missing "), F.col("missing_days").cast("string"))),
        (field_score, F.lit("required fields")),
        (entity, F.concat(F.lit("unmatched "), F.col("unmatched_rows").cast("string"), F.lit(" / repeated "), F.col("duplicate_rows").cast("string"))),
        (scope, F.format_string("excluded amount %.2f%%", F.col("excluded_amount_rate") * 100)),
        (amount, F.concat(F.lit("zero or negative "), (F.col("zero_rows") + F.col("negative_rows")).cast("string"))),
    )
    dimensions = None
    for name, (frame, metric) in zip(DIMENSIONS, parts):
        row = frame.select(F.lit(name).alias("dimension"), "score", quality_health(F.col("score")).alias("health"), metric.alias("metric"))
        dimensions = row if dimensions is None else dimensions.unionByName(row)
    overall = dimensions.agg(score(F.avg("score")).alias("overall_score"))
    overall = overall.withColumn("overall_health", quality_health(F.col("overall_score")))
    return {
        "overall": overall,
        "dimensions": dimensions,
        "date": dates,
        "fields": fields,
        "entity": entity,
        "scope": scope,
        "amount": amount,
    }
