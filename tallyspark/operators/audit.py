"""Entity audit: which ids match, repeat, or were changed by cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.keys import first_per_key
from tallyspark.functions.money import number_or_zero, safe_rate
from tallyspark.functions.text import clean_document_number, is_valid_id
from tallyspark.roles import UNMATCHED

# Wording of the unmatched report.
MAIN_ONLY = ("主表有 / 副表無", "正式營收保留，但副表資訊未補充")
SECONDARY_ONLY = ("副表有 / 主表無", "副表-only，不進正式營收")


def valid_keys(df: DataFrame, column: str) -> DataFrame:
    ids = df.select(clean_document_number(F.col(column)).alias("entity_key"))
    return ids.where(is_valid_id(F.col("entity_key")))


def key_counts(df: DataFrame, column: str) -> DataFrame:
    return valid_keys(df, column).groupBy("entity_key").agg(F.count(F.lit(1)).alias("occurrences"))


def duplicate_keys(df: DataFrame, column: str, label: str) -> DataFrame:
    repeated = key_counts(df, column).where(F.col("occurrences") > 1)
    return repeated.select(F.lit(label).alias("table_name"), "entity_key", "occurrences")


def cleaning_samples(df: DataFrame, column: str, label: str, order: list[Column], limit: int = 50) -> DataFrame:
    """The first ``limit`` cells, in row order, that cleaning changed."""
    raw = F.col(column).cast("string")
    cleaned = clean_document_number(F.col(column))
    changed = df.where(F.trim(raw) != F.trim(cleaned))
    return changed.orderBy(*order).limit(limit).select(
        F.lit(label).alias("table_name"), F.lit(column).alias("field"), raw.alias("before"), cleaned.alias("after")
    )


def source_breakdown(df: DataFrame, source: str = "source_name", amount: str = "amount", default: str = UNMATCHED) -> DataFrame:
    """Rows, distinct valid orders and amount by source."""
    name = F.when(F.coalesce(F.trim(F.col(source)), F.lit("")) == "", F.lit(default)).otherwise(F.col(source))
    key = clean_document_number(F.col("order_id"))
    work = df.select(
        name.alias("source"), F.when(is_valid_id(key), key).alias("_id"), number_or_zero(F.col(amount)).alias("_amount")
    )
    # first per (source, order): a hot source is reduced before the per-source step
    per_order = work.groupBy("source", "_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum("_amount").alias("_amount"))
    return per_order.groupBy("source").agg(
        F.sum("_rows").alias("rows"), F.count("_id").alias("unique_orders"), F.sum("_amount").alias("amount")
    )


def entity_match(main: DataFrame, secondary: DataFrame, main_key: str, secondary_key: str) -> DataFrame:
    """One row per id with its row count on either side; a union and one aggregate, no join."""
    a = key_counts(main, main_key).withColumnRenamed("occurrences", "main_rows")
    b = key_counts(secondary, secondary_key).withColumnRenamed("occurrences", "secondary_rows")
    both = a.unionByName(b, allowMissingColumns=True)
    return both.groupBy("entity_key").agg(
        F.coalesce(F.sum("main_rows"), F.lit(0)).alias("main_rows"),
        F.coalesce(F.sum("secondary_rows"), F.lit(0)).alias("secondary_rows"),
    )


def match_summary(matches: DataFrame) -> DataFrame:
    m, s = F.col("main_rows"), F.col("secondary_rows")

    def rows(cond: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, value)), F.lit(0))

    totals = matches.agg(
        F.count(F.when(m > 0, 1)).alias("main_ids"),
        F.count(F.when(s > 0, 1)).alias("secondary_ids"),
        F.count(F.when((m > 0) & (s > 0), 1)).alias("matched_ids"),
        rows((m > 0) & (s > 0), m).alias("matched_main_rows"),
        rows((m > 0) & (s == 0), m).alias("unmatched_main_rows"),
        F.count(F.when((m == 0) & (s > 0), 1)).alias("secondary_only_ids"),
        rows(m > 1, m).alias("duplicate_main_rows"),
        rows(s > 1, s).alias("duplicate_secondary_rows"),
    )
    return totals.withColumn("match_rate", F.round(safe_rate(F.col("matched_ids"), F.col("main_ids")), 4))


def unmatched_entities(matches: DataFrame) -> DataFrame:
    main_only = F.col("secondary_rows") == 0
    return matches.where(main_only | (F.col("main_rows") == 0)).select(
        "entity_key",
        F.when(main_only, F.lit(MAIN_ONLY[0])).otherwise(F.lit(SECONDARY_ONLY[0])).alias("direction"),
        F.when(main_only, F.lit(MAIN_ONLY[1])).otherwise(F.lit(SECONDARY_ONLY[1])).alias("handling"),
    )


def secondary_only_rows(secondary: DataFrame, key: str, matches: DataFrame, order: list[Column]) -> DataFrame:
    """One product row for each id the main sheet lacks."""
    keyed = secondary.withColumn("entity_key", clean_document_number(F.col(key)))
    lonely = matches.where(F.col("main_rows") == 0).select("entity_key")
    return first_per_key(keyed.join(lonely, "entity_key", "left_semi"), ["entity_key"], order)


def stored_audit(df: DataFrame, source: str = "source_tag") -> dict[str, DataFrame]:
    """The audit over rows already stored, where only the source tag tells matched from unmatched."""
    unmatched = F.coalesce(F.trim(F.col(source)), F.lit("")) == UNMATCHED
    key = clean_document_number(F.col("order_id"))
    work = df.select("*", unmatched.alias("_unmatched"), F.when(is_valid_id(key), key).alias("_key"))
    per_key = work.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.col("_unmatched").cast("long")).alias("_unmatched_rows")
    )
    has_key = F.col("_key").isNotNull()
    total = F.coalesce(F.sum("_rows"), F.lit(0))
    open_rows = F.coalesce(F.sum("_unmatched_rows"), F.lit(0))
    summary = per_key.agg(
        total.alias("stored_rows"),
        F.count("_key").alias("unique_orders"),
        (total - open_rows).alias("matched_rows"),
        open_rows.alias("unmatched_rows"),
        F.coalesce(F.sum(F.when(has_key & (F.col("_rows") > 1), F.col("_rows"))), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("match_rate", F.round(safe_rate(F.col("matched_rows"), F.col("stored_rows")), 4))
    return {
        "summary": summary,
        "source_breakdown": source_breakdown(df, source, default="旅行團/已匹配"),
        "duplicates": duplicate_keys(df, "order_id", "stored"),
        "unmatched": work.where("_unmatched").drop("_unmatched", "_key"),
    }


def ingest_audit(main: DataFrame, secondary: DataFrame, main_key: str, secondary_key: str) -> dict[str, DataFrame]:
    matches = entity_match(main, secondary, main_key, secondary_key)
    return {
        "summary": match_summary(matches),
        "unmatched": unmatched_entities(matches),
        "duplicates": duplicate_keys(main, main_key, "財務主表").unionByName(duplicate_keys(secondary, secondary_key, "副表")),
    }

