"""Baseline gates: fixed expectations checked against computed totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.keys import attach_one_row
from tallyspark.rules import SCOPE_LABEL

AMOUNT_TOLERANCE = 1.0

_REGISTRY_FILE = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("population", T.StringType()),
        T.StructField("amountTolerance", T.DoubleType()),
        T.StructField("requiredStableUploadCycles", T.IntegerType()),
        T.StructField(
            "baselines",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("month", T.StringType()),
                        T.StructField("expectedTotal", T.DoubleType()),
                        T.StructField("displayTotal", T.LongType()),
                        T.StructField("mode", T.StringType()),
                        T.StructField("legacyCore", T.BooleanType()),
                    ]
                )
            ),
        ),
    ]
)


@dataclass(frozen=True)
class CoreBaseline:
    """Expectation of one month: its total, and the freshness marks seen when it was set."""

    month: str
    expected_total: float
    expected_max_date: str
    expected_analysis_rows: int
    expected_excluded_rows: int
    tolerance: float = AMOUNT_TOLERANCE
    scope: str = SCOPE_LABEL


def _check(key: str, expected: Column, actual: Column, matched: Column, miss: str) -> Column:
    return F.struct(
        F.lit(key).alias("check_key"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
        F.when(F.coalesce(matched, F.lit(False)), F.lit("matched")).otherwise(F.lit(miss)).alias("status"),
    )


def stability_checks(totals: DataFrame, freshness: DataFrame, baseline: CoreBaseline) -> DataFrame:
    """Core checks (amount, scope) may drift; freshness checks may only be updated.

    ``totals`` has ``combined_revenue``; ``freshness`` has ``max_date``, ``analysis_rows``, ``excluded_rows``, ``scope``.
    """
    row = attach_one_row(totals.select("combined_revenue"), freshness.select("max_date", "analysis_rows", "excluded_rows", "scope"))
    total = F.col("combined_revenue")
    expected_total = F.lit(float(baseline.expected_total))
    core = [
        _check(
            "combined_revenue",
            F.format_string("%.2f", expected_total),
            F.format_string("%.2f", total),
            F.abs(total - expected_total) < baseline.tolerance,
            "drift",
        ),
        _check("revenue_scope", F.lit(baseline.scope), F.col("scope"), F.col("scope") == baseline.scope, "drift"),
    ]
    fresh = [
        _check(name, F.lit(value), F.col(name), F.col(name) == F.lit(value), "updated")
        for name, value in (
            ("max_date", baseline.expected_max_date),
            ("analysis_rows", baseline.expected_analysis_rows),
            ("excluded_rows", baseline.expected_excluded_rows),
        )
    ]
    groups = F.array(*[F.struct(F.lit("core").alias("check_group"), c.alias("c")) for c in core], *[F.struct(F.lit("freshness").alias("check_group"), c.alias("c")) for c in fresh])
    return row.select(F.explode(groups).alias("g")).select("g.check_group", "g.c.*")


def gate_summary(checks: DataFrame) -> DataFrame:
    """One row: the gate matches when no core check drifts."""
    core = F.col("check_group") == "core"
    drift = F.count(F.when(core & (F.col("status") == "drift"), 1))
    updated = F.count(F.when(~core & (F.col("status") == "updated"), 1))
    return checks.agg(
        F.when(drift == 0, F.lit("matched")).otherwise(F.lit("drift")).alias("status"),
        F.count(F.when(core, 1)).alias("total_checks"),
        F.count(F.when(core & (F.col("status") == "matched"), 1)).alias("matched_checks"),
        drift.alias("drift_check_count"),
        F.when(updated == 0, F.lit("stable")).otherwise(F.lit("updated")).alias("freshness_status"),
        updated.alias("freshness_update_count"),
    )


def load_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Registry rows, one per month; a month listed twice or left blank is an error."""
    raw = spark.read.schema(_REGISTRY_FILE).json(path, multiLine=True)
    rows = raw.select("version", "scope", F.col("amountTolerance").alias("tolerance"), F.col("requiredStableUploadCycles").alias("required_cycles"), F.explode("baselines").alias("b"))
    return check_baselines(
        rows.select(
            "version",
            "scope",
            "tolerance",
            "required_cycles",
            F.col("b.month").alias("month"),
            F.col("b.expectedTotal").alias("expected_total"),
            F.coalesce("b.mode", F.lit("monitoring")).alias("mode"),
            F.coalesce("b.legacyCore", F.lit(False)).alias("legacy_core"),
        )
    )


def check_baselines(registry: DataFrame) -> DataFrame:
    """The registry itself, failing at run time if its months are not unique and filled."""
    months = registry.groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    bad = months.where((F.col("n") > 1) | F.col("month").isNull() | (F.col("month") == "")).agg(F.count(F.lit(1))).scalar()
    guard = F.when(bad > 0, F.raise_error(F.lit("baseline months must be unique and filled"))).otherwise(F.col("month"))
    return registry.withColumn("month", guard.cast("string"))


def evaluate_baselines(registry: DataFrame, monthly: DataFrame, scope: str = SCOPE_LABEL) -> DataFrame:
    """Each registered month against the monthly trend; months without revenue count as zero."""
    actual = monthly.select("month", "branch_revenue", "specialist_revenue", "combined_revenue")
    joined = registry.join(actual, "month", "left").na.fill(0.0, ["branch_revenue", "specialist_revenue", "combined_revenue"])
    delta = F.col("combined_revenue") - F.col("expected_total")
    matched = (F.abs(delta) < F.col("tolerance")) & (F.col("scope") == scope)
    return joined.select(
        F.concat(F.lit("monthlyRevenue:"), "month").alias("check_key"),
        "month",
        "mode",
        "legacy_core",
        "expected_total",
        F.col("combined_revenue").alias("actual_total"),
        "branch_revenue",
        "specialist_revenue",
        F.round(delta, 2).alias("delta_amount"),
        F.when(matched, F.lit("matched")).otherwise(F.lit("drift")).alias("status"),
    )


def evaluation_summary(evaluation: DataFrame) -> DataFrame:
    matched = F.col("status") == "matched"
    blocking_drift = F.count(F.when((F.col("mode") == "blocking") & ~matched, 1))
    return evaluation.agg(
        F.count(F.when(matched, 1)).alias("matched_count"),
        F.count(F.lit(1)).alias("total_checks"),
        (F.count(F.when(~matched, 1)) == 0).alias("all_matched"),
        F.when(blocking_drift == 0, F.lit("matched")).otherwise(F.lit("drift")).alias("blocking_status"),
        (F.count(F.when(F.col("mode") != "blocking", 1)) == 0).alias("all_blocking"),
    )


def governed_checks(checks: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Gate checks with the blocking months merged in; the month of the core check is not counted twice."""
    extra = evaluation.where((F.col("mode") == "blocking") & ~F.col("legacy_core")).select(
        F.lit("core").alias("check_group"),
        "check_key",
        F.format_string("%.2f", "expected_total").alias("expected"),
        F.format_string("%.2f", "actual_total").alias("actual"),
        "status",
    )
    return checks.unionByName(extra)


def baseline_governance(summary: DataFrame, history: DataFrame, required_cycles: int, version: str) -> DataFrame:
    """Whether monitoring months may be promoted.

    ``history`` has ``id``, ``upload_status``, ``rollback_status``, ``registry_version`` and ``all_matched``; the
    newest accepted record of this registry version decides.
    """
    eligible = history.where(
        (F.col("upload_status") == "accepted") & (F.col("rollback_status") == "not_required") & (F.col("registry_version") == version)
    )
    latest = eligible.agg(F.max("id").alias("record_id"), F.max_by("all_matched", "id").alias("record_matched"))
    row = attach_one_row(summary, latest)
    stable = F.when(F.coalesce("record_matched", F.lit(False)) & F.col("all_matched"), F.lit(required_cycles)).otherwise(F.lit(0))
    row = row.withColumn("stable_cycles", stable)
    ready = ~F.col("all_blocking") & (F.col("stable_cycles") >= required_cycles)
    status = (
        F.when(F.col("all_blocking"), F.when(F.col("blocking_status") == "matched", F.lit("blocking")).otherwise(F.lit("drift")))
        .when(~F.col("all_matched"), F.lit("drift"))
        .when(ready, F.lit("promotion_ready"))
        .otherwise(F.lit("monitoring"))
    )
    return row.select(
        status.alias("status"),
        "stable_cycles",
        ready.alias("promotion_ready"),
        F.when(ready, F.col("record_id")).alias("eligible_record_id"),
        "matched_count",
        "total_checks",
        "blocking_status",
    )
