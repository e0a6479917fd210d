"""Official revenue scope: an order leaves as a whole if any of its receipts is of an excluded kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.keys import attach_one_row
from tallyspark.rules import EXCLUDED_PAY_METHODS, EXCLUDED_RECEIPT_TYPES, SCOPE_LABEL


def is_excluded_receipt(
    df: DataFrame, types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS
) -> Column:
    hit = F.lit(False)
    if "receipt_type" in df.columns and types:
        hit = hit | F.coalesce(F.trim("receipt_type").isin(*types), F.lit(False))
    if "pay_method" in df.columns and methods:
        hit = hit | F.coalesce(F.trim("pay_method").isin(*methods), F.lit(False))
    return hit


def excluded_orders(frames: list[DataFrame], types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS) -> DataFrame:
    """Distinct order ids poisoned by any receipt in any frame."""
    out = None
    for frame in frames:
        ids = frame.where(is_excluded_receipt(frame, types, methods)).select(F.trim("order_id").alias("order_id"))
        out = ids if out is None else out.unionByName(ids)
    return out.where(F.col("order_id").isNotNull() & (F.col("order_id") != "")).distinct()


def drop_orders(df: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows of orders that are not listed. Rows without an order id stay."""
    listed = orders.select(F.col("order_id").alias("_excluded_id"))
    return df.join(listed, F.trim(F.col("order_id")) == F.col("_excluded_id"), "left_anti")


def official_scope(
    tour: DataFrame, others: DataFrame, types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS
) -> tuple[DataFrame, DataFrame]:
    if not types and not methods:
        return tour, others
    out = excluded_orders([tour, others], types, methods)
    return drop_orders(tour, out), drop_orders(others, out)


def official_rows(
    receipts: DataFrame, types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS, key: str | None = None
) -> DataFrame:
    """The same over one frame that holds both tables.

    ``key`` may name a column that stands for the order number, one to one. Rows that already lie by that key need not be
    dealt out again by the text of the number.
    """
    if not types and not methods:
        return receipts
    if key is None:
        return drop_orders(receipts, excluded_orders([receipts], types, methods))
    named = F.col("order_id").isNotNull() & (F.trim("order_id") != "")
    out = receipts.where(is_excluded_receipt(receipts, types, methods) & named).select(F.col(key).alias("_excluded_key")).distinct()
    return receipts.join(out, F.col(key) == F.col("_excluded_key"), "left_anti")


def scope_audit(receipts: DataFrame, types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS) -> DataFrame:
    """One row: orders out, rows and amount before, after and out.

    Rows shrink to one per order before anything else, so the audit needs no second read and no join.
    """
    per_order = receipts.groupBy(F.trim("order_id").alias("order_id")).agg(
        F.max(is_excluded_receipt(receipts, types, methods)).alias("_bad"),
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_amount"),
    )
    out = F.col("_bad") & F.col("order_id").isNotNull() & (F.col("order_id") != "")
    kept = F.coalesce(~out, F.lit(True))
    zero = F.lit(0)
    return per_order.agg(
        F.lit(SCOPE_LABEL).alias("scope_label"),
        F.count(F.when(out, 1)).alias("excluded_order_count"),
        F.coalesce(F.sum("_rows"), zero).alias("raw_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("_rows"))), zero).alias("analysis_rows"),
        F.coalesce(F.sum(F.when(~kept, F.col("_rows"))), zero).alias("excluded_rows"),
        F.coalesce(F.sum("_amount"), F.lit(0.0)).alias("raw_amount"),
        F.coalesce(F.sum(F.when(kept, F.col("_amount"))), F.lit(0.0)).alias("analysis_amount"),
        F.coalesce(F.sum(F.when(~kept, F.col("_amount"))), F.lit(0.0)).alias("excluded_amount"),
    )


def filter_upload(new: DataFrame, stored_receipts: DataFrame, types=EXCLUDED_RECEIPT_TYPES, methods=EXCLUDED_PAY_METHODS) -> DataFrame:
    """Drop incoming excluded receipts, unless that receipt number is already stored."""
    if "receipt_no" not in new.columns:
        return new.where(~is_excluded_receipt(new, types, methods))
    bad = is_excluded_receipt(new, types, methods)
    suspects = new.where(bad)
    known = stored_receipts.select(F.col("receipt_no").alias("_known")).distinct()
    readmitted = suspects.join(known, F.trim("receipt_no") == F.col("_known"), "left_semi")
    return new.where(~bad).unionByName(readmitted)


def exclude_listed(receipts: DataFrame, listed: DataFrame) -> dict[str, DataFrame]:
    """Take listed orders out of both tables and report which listed ids matched anything."""
    ids = listed.select("order_id").distinct()
    present = receipts.select("order_id").distinct()
    return {
        "kept": drop_orders(receipts, ids),
        "excluded": receipts.join(ids, "order_id", "left_semi"),
        "matched": ids.join(present, "order_id", "left_semi"),
        "unmatched": ids.join(present, "order_id", "left_anti"),
    }


def freshness(official: DataFrame, audit: DataFrame) -> DataFrame:
    """Date span of the official rows next to the audit counts."""
    span = official.agg(
        F.date_format(F.min("unified_date"), "yyyy-MM-dd").alias("min_date"),
        F.date_format(F.max("unified_date"), "yyyy-MM-dd").alias("max_date"),
    )
    return attach_one_row(span, audit.select("raw_rows", "analysis_rows", "excluded_rows", F.col("scope_label").alias("scope")))
