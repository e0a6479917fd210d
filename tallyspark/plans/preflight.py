"""Dry runs: what an upload or a revocation would do to the gate, before anything is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_key
from tallyspark.functions.keys import attach_one_row
from tallyspark.operators.diff import drift_diagnosis
from tallyspark.operators.exclusions import proposal, proposal_fingerprint, restored_receipts
from tallyspark.operators.gates import check_baselines, evaluate_baselines, evaluation_summary
from tallyspark.operators.scope import official_rows
from tallyspark.session import cut_lineage, written
from tallyspark.sources.store import upsert

READY, PROPOSAL, BLOCKED = "ready", "proposal", "blocked"


def monthly_revenue(receipts: DataFrame, desk: str) -> DataFrame:
    """Official revenue by month, of the branches, of the desk, and of both."""
    at_desk = F.col("branch") == desk
    amount = F.coalesce(F.col("amount"), F.lit(0.0))
    months = official_rows(receipts).groupBy(month_key(F.col("unified_date")).alias("month")).agg(
        F.sum(F.when(at_desk, F.lit(0.0)).otherwise(amount)).alias("branch_revenue"),
        F.sum(F.when(at_desk, amount).otherwise(F.lit(0.0))).alias("specialist_revenue"),
    )
    return months.withColumn("combined_revenue", F.col("branch_revenue") + F.col("specialist_revenue"))


def month_gate(receipts: DataFrame, registry: DataFrame, desk: str) -> tuple[DataFrame, DataFrame]:
    """Every registered month against ``receipts``, and one row: drifting months, their delta, and the blocking status."""
    # a month a row, read once for each figure below
    evaluation = cut_lineage(evaluate_baselines(check_baselines(registry), monthly_revenue(receipts, desk)))
    drifting = F.col("status") != "matched"
    row = evaluation.agg(
        F.count(F.when(drifting, 1)).alias("drifting_months"), F.coalesce(F.sum(F.when(drifting, F.col("delta_amount"))), F.lit(0.0)).alias("delta_amount")
    )
    return evaluation, cut_lineage(attach_one_row(row, evaluation_summary(evaluation).select("blocking_status")))


def upload_preflight(live: DataFrame, incoming: DataFrame, registry: DataFrame, desk: str, context: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Run an upload on a copy: the merged receipts, the gate over them, what explains a drift, and the exclusions it suggests.

    Nothing is stored; the merged receipts are written as a table in the checkpoint folder. The verdict is ``ready`` if no blocking month drifts, ``proposal`` if one does but every exclusion
    behind the drift is unambiguous, else ``blocked``. One row of the gate comes to the driver, to choose the diagnosis.
    """
    candidate = written(upsert(live, incoming))
    evaluation, gate = month_gate(candidate, registry, desk)
    seen = gate.first()
    drift = {"status": "drift" if seen["drifting_months"] else "matched", "delta_amount": seen["delta_amount"] or 0.0}
    diagnosis = drift_diagnosis(live, candidate, drift)
    out = {"candidate": candidate, "evaluation": evaluation, "gate": gate, **diagnosis}
    none = gate.select(F.lit(0).cast("long").alias("drifting_orders"), F.lit(0).cast("long").alias("candidates"), F.lit(False).alias("stands"), F.lit(None).cast("string").alias("fingerprint"))
    found = none
    if "top_drivers" in diagnosis:
        named = proposal(diagnosis["top_drivers"], candidate, candidate)
        out["proposal"] = named
        orders = diagnosis["candidate_orders"].select(F.col("candidate_order_count").alias("drifting_orders"))
        # one row; as a plan it would be worked out again for each of its columns
        found = cut_lineage(attach_one_row(orders, proposal_fingerprint(named, context or {})))
    status = (
        F.when(F.col("blocking_status") == "matched", F.lit(READY))
        .when(F.col("stands") & (F.col("candidates") > 0), F.lit(PROPOSAL))
        .otherwise(F.lit(BLOCKED))
    )
    out["verdict"] = attach_one_row(gate, found).withColumn("status", status)
    return out


def revocation_preflight(live: DataFrame, evidence: DataFrame, schema: str, registry: DataFrame, desk: str) -> dict[str, DataFrame]:
    """Put quarantined receipts back into a copy and run the gate again: ``ready`` if no blocking month drifts, else ``blocked``."""
    back = restored_receipts(evidence, schema).drop("target_table")
    candidate = written(upsert(live, back))
    evaluation, gate = month_gate(candidate, registry, desk)
    rows = candidate.agg(F.count(F.lit(1)).alias("rows"))
    status = F.when(F.col("blocking_status") == "matched", F.lit(READY)).otherwise(F.lit(BLOCKED))
    return {"candidate": candidate, "evaluation": evaluation, "verdict": attach_one_row(rows, gate).withColumn("status", status)}
