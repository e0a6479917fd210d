"""Raw sheets to official detail tables, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.dates import month_key, time_of
from tallyspark.functions.money import money_text_to_double, number_or_zero
from tallyspark.functions.text import clean_document_number
from tallyspark.operators import audit, resolve
from tallyspark.roles import UNMATCHED, normalize_receipts
from tallyspark.rules import BusinessRules

# Product columns taken over from the secondary sheets, and the tag of tour sheets.
SECONDARY_ROLES = (
    "days",
    "qty",
    "currency",
    "receivable",
    "received",
    "trans_time",
    "dept_owner",
    "dept",
    "dest_category",
    "dest_level1",
    "dest_level2",
    "dest_name",
    "branch",
    "salesperson",
    "tour_name",
    "tour_code",
    "source_name",
)
TOUR_SOURCE = "旅行團"
MONEY_ROLES = ("amount", "base_amount", "receivable", "received")


def process_uploads(
    main: DataFrame,
    secondary: DataFrame,
    rules: BusinessRules,
    main_key: str = "order_id",
    secondary_key: str = "secondary_key",
    row_order: str = "src_ordinal",
    parity: bool = False,
) -> dict[str, DataFrame]:
    """Clean, attribute and correct an upload. Order of the overrides: names, product branch, rules, operator.

    ``receipts`` holds both tables with an ``is_tour`` flag; ``tour`` and ``others`` are its two parts.

    ``secondary`` is the tagged union of the product sheets with a ``source_name`` and a row order column.
    """
    cleaned = main.withColumn("order_id", clean_document_number(F.col(main_key), parity))
    kept = resolve.keep_mapped_orders(cleaned, rules)
    kept = kept.withColumn("branch", resolve.branch_by_prefix(F.col("order_id"), rules.branch_map))
    if "receipt_time" in kept.columns:
        stamp = time_of(kept, "receipt_time")
        kept = kept.withColumns({"receipt_time": stamp, "receipt_month": month_key(stamp)})
    products = secondary.withColumn("order_id", clean_document_number(F.col(secondary_key), parity))
    carried = [c for c in SECONDARY_ROLES if c in products.columns]
    slim = products.select("order_id", F.col(row_order).alias("_row"), *carried)
    if "branch" in slim.columns:
        slim = slim.withColumnRenamed("branch", "sub_branch")
    joined = resolve.attach_secondary(kept, slim, [F.col("_row")]).drop("_row")
    joined = joined.withColumns({c: money_text_to_double(F.col(c)) for c in MONEY_ROLES if c in joined.columns})
    joined = joined.withColumns({c: number_or_zero(F.col(c)) for c in ("days", "qty") if c in joined.columns})
    if "trans_time" in joined.columns:
        stamp = time_of(joined, "trans_time")
        joined = joined.withColumns({"trans_time": stamp, "trans_month": month_key(stamp)})
    joined = normalize_receipts(
        joined.withColumn("source_tag", F.coalesce("source_name", F.lit(UNMATCHED))), parity
    )
    is_tour = F.col("is_matched") & (F.col("source_name") == TOUR_SOURCE)
    work = joined.withColumn("_is_tour", F.coalesce(is_tour, F.lit(False))).drop("source_name")
    # names and operators are listed from the sheets, not from the joined rows, which would be computed again
    sheets = [f.select("salesperson") for f in (kept, products) if "salesperson" in f.columns]
    names = sheets[0].unionByName(sheets[-1]) if len(sheets) > 1 else (sheets[0] if sheets else None)
    fixed, name_log = resolve.standardize_names(work, "salesperson", rules.specialists, names)
    fixed, sub_log = resolve.override_by_sub_branch(fixed)
    fixed, rule_log = resolve.reassign_branches(fixed, rules.overrides, "unified_date")
    operator_log = None
    if "operator" in fixed.columns:
        operators = kept.select("operator") if "operator" in kept.columns else None
        fixed, operator_log = resolve.override_by_operator(fixed, rules, operators)
    log = name_log.drop("rows")
    for part in (sub_log, rule_log, operator_log):
        log = log if part is None else log.unionByName(part)
    return {
        "receipts": fixed.withColumnRenamed("_is_tour", "is_tour").drop("is_matched"),
        "tour": fixed.where("_is_tour").drop("_is_tour", "is_matched", "source_tag"),
        "others": fixed.where(~F.col("_is_tour")).drop("_is_tour", "is_matched"),
        "anomalies": log,
        "name_log": name_log,
        **{f"audit_{k}": v for k, v in audit.ingest_audit(kept, secondary, "order_id", secondary_key).items()},
        "audit_sources": audit.source_breakdown(joined),
    }
