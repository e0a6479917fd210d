"""Governance of forecasts, features and decisions on top of the backtest results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.keys import attach_one_row
from tallyspark.functions.labels import (
    GOVERNANCE_WEIGHTS,
    accuracy_score,
    bias_direction,
    bias_score,
    error_health,
    governance_advice,
    governance_health,
    role_score,
    sample_score,
    severity_from_gap,
    stability_score,
)
from tallyspark.plans.backtest import consensus, forecast_summary

# Governance roles.
OFFICIAL, DIAGNOSTIC, EXPERIMENT = "正式", "診斷", "實驗"
DAILY_VIEW = "Daily Forecast"
KEYS = ["view", "role", "strategy", "model", "lane"]


def governance_input(detail: DataFrame, view: Column, role: str, lane: Column | None = None) -> DataFrame:
    """Detail rows of one table, labelled for the governance matrix."""
    names = ["actual", "prediction", "error", "abs_error", "ape", "smape", "horizon"]
    return detail.select(view.alias("view"), F.lit(role).alias("role"), "strategy", "model", (lane if lane is not None else F.lit("")).alias("lane"), *names)


def governance_matrix(rows: DataFrame) -> DataFrame:
    """Scores, health and advice per model. Error figures and the spread of the error come from one aggregation."""
    whole = F.sum("actual")
    summary = rows.groupBy(*KEYS).agg(
        F.avg("abs_error").alias("mae"),
        F.when(whole != 0, F.sum("abs_error") / whole * 100).alias("wape"),
        F.avg("ape").alias("mape"),
        F.percentile("ape", 0.5).alias("median_ape"),
        F.avg("smape").alias("smape_avg"),
        F.avg("error").alias("bias"),
        F.count("ape").alias("samples"),
        F.stddev_samp("ape").alias("ape_std"),
        F.avg("horizon").alias("avg_horizon"),
    )
    metrics = F.filter(F.array("wape", "mape", "median_ape", "smape_avg"), lambda x: x.isNotNull())
    average = F.when(F.size(metrics) > 0, F.aggregate(metrics, F.lit(0.0), lambda a, x: a + x) / F.size(metrics))
    scored = summary.withColumns(
        {
            "accuracy_score": accuracy_score(average),
            "bias_score": bias_score(F.col("mae"), F.col("bias")),
            "stability_score": stability_score(F.col("samples"), F.col("ape_std")),
            "sample_score": sample_score(F.col("samples")),
            "role_score": role_score(F.col("role")),
            "bias_ratio": F.when(F.col("mae") > 0, F.abs("bias") / F.col("mae")),
            "bias_direction": bias_direction(F.col("bias")),
        }
    )
    total = sum((F.col(f"{name}_score") * weight for name, weight in GOVERNANCE_WEIGHTS.items()), F.lit(0.0))
    scored = scored.withColumn("governance_score", total)
    scored = scored.withColumn("health", governance_health(F.col("governance_score")))
    return scored.withColumn("advice", governance_advice(F.col("role"), F.col("health"), F.col("bias_ratio"), F.col("samples")))


def governance_summary(matrix: DataFrame) -> DataFrame:
    """The representative model of every view: official rows first, then the best score."""
    order = F.struct((F.col("role") != OFFICIAL).cast("int"), -F.round("governance_score", 9), F.round("wape", 9), F.col("strategy"), F.col("model"), F.col("lane"))
    rest = ["governance_score", "health", "strategy", "model", "wape", "bias_direction", "samples"]
    return matrix.groupBy("view").agg(F.min_by(F.struct(*rest), order).alias("b")).select("view", "b.*")


def overall_governance(summary: DataFrame) -> DataFrame:
    row = summary.agg(F.avg("governance_score").alias("overall_score"))
    return row.withColumn("overall_health", governance_health(F.col("overall_score")))


def recommendations(matrix: DataFrame) -> DataFrame:
    return matrix.select("view", "role", "strategy", "model", "health", "advice").dropDuplicates()


# --- feature snapshots --------------------------------------------------------------------------------------

SNAPSHOT_COLUMNS = (
    "cutoff",
    "actual_date",
    "feature_max_date",
    "no_future_leak",
    "total_7",
    "total_14",
    "specialist_share_7",
    "specialist_momentum",
    "longhaul_share_7",
    "longhaul_momentum",
    "large_orders_7",
    "max_order_7",
    "top_seller_share_7",
    "volatility_7",
    "pace_vs_14",
    "risk_level",
    "signal_class",
    "signal_action",
)
HEALTH_FEATURES = (
    "specialist_share_7",
    "specialist_momentum",
    "longhaul_share_7",
    "longhaul_momentum",
    "large_orders_7",
    "max_order_7",
    "top_seller_share_7",
    "volatility_7",
    "pace_vs_14",
    "risk_level",
    "signal_class",
    "event_class",
    "order_momentum",
)
# Readiness labels.
READY, WATCHING, AUDIT = "可用", "觀察", "需稽核"


def feature_snapshot(signals: DataFrame, events: DataFrame, rows: int | None = None) -> DataFrame:
    """Signal rows with their event signal, newest first; ``rows`` cuts a view for display."""
    extra = events.select("cutoff", "actual_date", "event_class", "event_action", "order_momentum")
    joined = signals.select(*SNAPSHOT_COLUMNS).join(extra, ["cutoff", "actual_date"], "left")
    ordered = joined.orderBy(F.desc("actual_date"), F.desc("cutoff"))
    return ordered if rows is None else ordered.limit(rows)


def feature_health(snapshot: DataFrame, parity: bool = False) -> DataFrame:
    """Null rate and readiness of each feature.

    Rates are percentages here. ``parity=True`` compares the fraction with the percentage limits, as the old rule
    does, under which no feature ever looks incomplete.
    """
    texts = [F.struct(F.lit(f).alias("feature"), F.col(f).isNotNull().alias("filled")) for f in HEALTH_FEATURES]
    long = snapshot.select("no_future_leak", "feature_max_date", F.explode(F.array(*texts)).alias("f"))
    out = long.groupBy("f.feature").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count(F.when(F.col("f.filled"), 1)).alias("filled"),
        (F.avg(F.col("no_future_leak").cast("int")) * 100).alias("leak_pass_rate"),
        F.date_format(F.max("feature_max_date"), "yyyy-MM-dd").alias("latest_feature_date"),
    )
    rate = (F.col("samples") - F.col("filled")) / F.col("samples")
    out = out.withColumn("missing_rate", rate if parity else rate * 100)
    ready = (F.col("samples") >= 20) & (F.col("missing_rate") <= 20) & (F.col("leak_pass_rate") >= 100)
    bad = (F.col("missing_rate") > 50) | (F.col("leak_pass_rate") < 100)
    return out.withColumn("readiness", F.when(bad, F.lit(AUDIT)).when(ready, F.lit(READY)).otherwise(F.lit(WATCHING)))


def signal_readiness(summaries: dict[str, DataFrame]) -> DataFrame:
    """Sample size and best error of each signal family (frames with ``samples`` and ``wape``)."""
    out = None
    for name, frame in summaries.items():
        row = frame.agg(F.lit(name).alias("signal_family"), F.coalesce(F.max("samples"), F.lit(0)).alias("samples"), F.min("wape").alias("best_wape"))
        out = row if out is None else out.unionByName(row)
    best = F.col("best_wape")
    status = F.when(F.col("samples") == 0, F.lit("no_data")).when(best.isNotNull() & (F.col("samples") >= 20), F.lit("diagnostic")).otherwise(F.lit("observe"))
    return out.withColumns({"status": status, "worth_lane_test": F.coalesce(best < 35, F.lit(False))})


# --- decisions ----------------------------------------------------------------------------------------------

DEFAULT_THRESHOLDS = {"forecast_gap_pct": 0.05, "quality_warning": 90.0, "quality_critical": 75.0}


def target_progress(targets: DataFrame, monthly: DataFrame, month_end: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Approved targets against actual revenue and the month-end forecast.

    ``targets`` has ``month`` and ``target_revenue``; ``monthly`` has ``month`` and ``combined_revenue``;
    ``month_end`` has ``month`` and ``consensus``.
    """
    limit = {**DEFAULT_THRESHOLDS, **(thresholds or {})}["forecast_gap_pct"]
    actual = monthly.select("month", F.col("combined_revenue").alias("actual_revenue"))
    ahead = month_end.select("month", F.col("consensus").alias("forecast_revenue"))
    joined = targets.join(actual, "month", "left").join(ahead, "month", "left")
    goal = F.col("target_revenue")
    gap_pct = F.when(goal != 0, (F.col("forecast_revenue") - goal) / goal)
    joined = joined.withColumns(
        {
            "gap_amount": F.round(F.col("actual_revenue") - goal, 2),
            "attainment_pct": F.when(goal != 0, F.round(F.col("actual_revenue") / goal * 100, 2)),
            "projected_gap": F.round(F.col("forecast_revenue") - goal, 2),
            "projected_gap_pct": gap_pct,
        }
    )
    behind = F.coalesce(F.col("projected_gap_pct") <= -limit, F.lit(False))
    status = (
        F.when(behind, F.lit("warning"))
        .when(F.col("actual_revenue").isNull(), F.lit("pending"))
        .when(F.coalesce("attainment_pct", F.lit(0.0)) >= 100, F.lit("on_track"))
        .otherwise(F.lit("tracking"))
    )
    severity = F.when(behind, severity_from_gap(F.col("projected_gap_pct"), limit))
    return joined.withColumns({"status": status, "severity": severity})


def decision_alerts(progress: DataFrame, overall_quality: DataFrame, state: dict, thresholds: dict | None = None) -> DataFrame:
    """Alerts by rule: targets at risk, no target, weak data quality, system health, baseline drift, no forecast.

    ``state`` holds ``health_status``, ``core_status``, ``rollback_status`` and ``forecast_status``.
    """
    limits = {**DEFAULT_THRESHOLDS, **(thresholds or {})}

    def alert(code: str, severity: Column, detail: Column) -> list[Column]:
        return [F.lit(code).alias("code"), severity.alias("severity"), detail.alias("detail")]

    out = progress.where(F.col("severity").isNotNull()).select(*alert("forecast_below_target", F.col("severity"), F.col("month")))
    none = progress.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    out = out.unionByName(none.select(*alert("target_not_configured", F.lit("info"), F.lit(""))))
    score = F.col("overall_score")
    level = F.when(score < limits["quality_critical"], F.lit("critical")).when(score < limits["quality_warning"], F.lit("warning"))
    weak = overall_quality.select(*alert("data_quality_low", level, score.cast("string"))).where(F.col("severity").isNotNull())
    out = out.unionByName(weak)
    spark = progress.sparkSession
    fixed = []
    health = state.get("health_status")
    if health in ("critical", "degraded"):
        fixed.append((f"system_health_{health}", "critical" if health == "critical" else "warning", health))
    if state.get("core_status") == "drift" or state.get("rollback_status") == "rollback_failed":
        fixed.append(("baseline_or_rollback_risk", "critical", str(state.get("core_status"))))
    if state.get("forecast_status") != "ready":
        fixed.append(("forecast_not_ready", "warning", str(state.get("forecast_status"))))
    return out.unionByName(spark.createDataFrame(fixed, "code string, severity string, detail string")) if fixed else out


def decisions(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("severity") != "info").select(F.concat(F.lit("decision-"), "code").alias("decision_id"), F.col("severity").alias("priority"), "detail")


# --- forecast read model ------------------------------------------------------------------------------------

FORECAST_DAYS = 30


def best_macro(macro: DataFrame) -> DataFrame:
    """Best model and health per macro layer."""
    found = macro.where(F.col("wape").isNotNull()).groupBy("layer").agg(
        F.min_by(F.struct("wape", "strategy", "model"), F.struct(F.round("wape", 9), F.col("strategy"), F.col("model"))).alias("b")
    )
    return found.select("layer", "b.wape", error_health(F.col("b.wape")).alias("health"), F.concat_ws(" / ", "b.strategy", "b.model").alias("model"))


def forecast_read_model(tracks: DataFrame, weights: DataFrame, series: DataFrame, macro: DataFrame) -> dict[str, DataFrame]:
    """Thirty daily rows with bucket and band, the next week, the month end, and macro health."""
    agreed = consensus(tracks, weights)
    chosen = weights.select("series_id", F.col("horizon").alias("bucket"), "strategy")
    daily = agreed.where(F.col("horizon") <= FORECAST_DAYS).join(chosen, ["series_id", "bucket"], "left")
    return {"daily": daily, **forecast_summary(agreed, series), "health": best_macro(macro), "weights": weights}


def run_telemetry(runs: DataFrame, stages: tuple[str, ...], gates: tuple[str, ...]) -> DataFrame:
    """Stage durations, gate failures and unknown counts over JSON run records (``record`` text)."""
    stage_type = ",".join(f"{s}:struct<durationMs:bigint>" for s in stages)
    gate_type = ",".join(f"{g}:struct<status:string,state:string>" for g in gates)
    parsed = runs.select(F.from_json("record", f"runId string, retentionState string, stages struct<{stage_type}>, gates struct<{gate_type}>").alias("r")).select("r.*")
    kept = parsed.where(F.coalesce("retentionState", F.lit("")) != "deleted")
    entries = []
    for s in stages:
        ms = F.col(f"stages.{s}.durationMs")
        ok = F.coalesce(ms >= 0, F.lit(False))
        entries.append(F.struct(F.lit("stage").alias("kind"), F.lit(s).alias("name"), ok.alias("observed"), F.when(ok, ms).alias("ms"), F.lit(False).alias("failed"), F.lit(False).alias("blocked")))
    for g in gates:
        status, state = F.col(f"gates.{g}.status"), F.col(f"gates.{g}.state")
        observed = F.coalesce(status.isin("available", "blocked") & state.isNotNull(), F.lit(False))
        failed = F.coalesce((status == "available") & (state == "failed"), F.lit(False))
        blocked = F.coalesce((status == "blocked") & state.isNotNull(), F.lit(False))
        entries.append(F.struct(F.lit("gate").alias("kind"), F.lit(g).alias("name"), observed.alias("observed"), F.lit(None).cast("bigint").alias("ms"), failed.alias("failed"), blocked.alias("blocked")))
    long = kept.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return long.groupBy("kind", "name").agg(
        F.count(F.when(F.col("observed"), 1)).alias("observed_count"),
        F.count(F.when(~F.col("observed"), 1)).alias("unknown_count"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"),
        F.round(F.avg("ms"), 0).alias("average_ms"),
        F.count(F.when(F.col("failed"), 1)).alias("failed"),
        F.count(F.when(F.col("blocked"), 1)).alias("blocked"),
    )


def snapshot_overview(snapshot: DataFrame) -> DataFrame:
    row = snapshot.agg(F.count(F.lit(1)).alias("rows"), (F.avg(F.col("no_future_leak").cast("int")) * 100).alias("leak_pass_rate"), F.max("feature_max_date").alias("latest_feature_date"))
    return row.withColumn("no_future_leak_ok", F.coalesce(F.col("leak_pass_rate") >= 100, F.lit(True)))


def merge_overview(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for row in rows[1:]:
        out = attach_one_row(out, row)
    return out
