"""Rule suggestions from what cleaning could not resolve. Nothing here changes a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.keys import first_per_key
from tallyspark.functions.labels import confidence_label
from tallyspark.functions.money import clamp
from tallyspark.functions.text import candidate_text, clean_document_number, id_prefix, suggestion_id
from tallyspark.operators.resolve import LOG_NO_MATCH
from tallyspark.roles import UNKNOWN, UNMATCHED
from tallyspark.rules import BusinessRules

# The rows a candidate needs.
MIN_ROWS, RISKY_ROWS = 3, 20
CRUISE_TEXT = "(?i)郵輪|游輪|cruise"


def _row(rule: str, candidate: Column, rows: Column, confidence: Column, risk: str, actionable: Column | None = None) -> list[Column]:
    sure = clamp(confidence, 0, 100)
    return [
        suggestion_id(F.lit(rule), candidate).alias("suggestion_id"),
        F.lit(rule).alias("rule_type"),
        candidate.alias("candidate"),
        rows.alias("rows"),
        F.round(sure, 1).alias("confidence"),
        confidence_label(sure).alias("confidence_label"),
        F.lit(risk).alias("risk"),
        (sure >= 70 if actionable is None else actionable).alias("actionable"),
    ]


def _open(rows: DataFrame, candidate: Column, known: list[str], weight: Column | None = None) -> DataFrame:
    """Rows behind every candidate that no rule knows yet. Known ones go before anything is counted."""
    named = rows.select(candidate.alias("candidate"), (F.lit(1) if weight is None else weight).alias("_w")).where(F.col("candidate") != "")
    return named.where(~F.col("candidate").isin(*known)).groupBy("candidate").agg(F.sum("_w").alias("n"))


def suggestions(raw: DataFrame, name_log: DataFrame, rules: BusinessRules, per_rule: int | None = None) -> DataFrame:
    """Unknown sellers, unknown order prefixes, risky exclusions and cruise departments, best first.

    All candidates are returned; ``per_rule`` cuts a view to the most frequent ones of each rule.
    """
    n = F.col("n")
    texts = [c for c in ("source_tag", "source_name", "tour_name", "dest_category", "dest_level1", "dest_level2") if c in raw.columns]
    branch = F.coalesce(F.trim("branch"), F.lit(""))
    unknown = (F.coalesce(F.trim("source_tag"), F.lit("")) == UNMATCHED) | branch.isin("", UNKNOWN, "nan", "None")
    taken = [p.upper() for p in (*rules.branch_map, *rules.exclude_prefixes)]
    names = _open(name_log.where(F.col("status") == LOG_NO_MATCH), candidate_text(F.col("original")), list(rules.specialists), F.col("rows"))
    prefixes = _open(raw.where(unknown), F.upper(id_prefix(clean_document_number(F.col("order_id")))), taken)
    # rule, candidates, base and step of the confidence, its ceiling, risk, and where a reader may act on it
    kinds = [
        ("SALES_REP_LIST", names.where(n >= MIN_ROWS), 58, 6, 92, "中", 70),
        ("BRANCH_MAPPING", prefixes, 45, 5, 82, "中", 75),
        ("EXCLUDE_PREFIXES", prefixes.where(n >= RISKY_ROWS), 42, 2, 78, "高", 75),
    ]
    if "dept" in raw.columns and texts:
        signal = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in texts])
        depts = _open(raw.where(signal.rlike(CRUISE_TEXT)), candidate_text(F.col("dept")), list(rules.cruise_depts))
        kinds.append(("CRUISE_DEPTS", depts.where(n >= MIN_ROWS), 60, 5, 90, "低", 70))
    out = None
    for rule, candidates, base, step, ceiling, risk, enough in kinds:
        sure = F.least(F.lit(ceiling), base + n * step).cast("double")
        if per_rule is not None:
            candidates = candidates.orderBy(F.desc("n"), "candidate").limit(per_rule)
        rows = candidates.select(*_row(rule, F.col("candidate"), n, sure, risk, sure >= enough))
        out = rows if out is None else out.unionByName(rows)
    once = first_per_key(out, ["rule_type", "candidate"], [F.col("suggestion_id")])
    return once.orderBy(F.desc("actionable"), F.desc("confidence"), F.desc("rows"), "suggestion_id")


def suggestion_metrics(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("actionable"), 1)).alias("actionable"),
        F.count(F.when(~F.col("actionable"), 1)).alias("observation"),
        F.round(F.avg("confidence"), 2).alias("avg_confidence"),
    )
