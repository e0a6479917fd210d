"""Fingerprints. Row hashes are canonical JSON; table prints are commutative, so no global sort is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with the keys in name order and nulls kept."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def row_text_hash(columns: list[str]) -> Column:
    texts = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in sorted(columns)]
    return F.xxhash64(*texts)


def table_print(df: DataFrame, columns: list[str], amount: str | None = None, day: str | None = None) -> DataFrame:
    """One row: count, amount, date span and an order-independent content hash.

    Equal multisets of rows give equal prints. Two independent sums over 32-bit halves plus the xor keep
    duplicates visible, and every part combines map-side.
    """
    hashed = df.select(
        row_text_hash(columns).alias("_h"),
        (F.col(amount) if amount else F.lit(0.0)).alias("_amount"),
        (F.col(day) if day else F.lit(None)).cast("date").alias("_day"),
    )
    low = F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("_h", 32)
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.coalesce(F.sum("_amount"), F.lit(0.0)), 2).alias("amount"),
        F.min("_day").alias("min_date"),
        F.max("_day").alias("max_date"),
        F.sum(low.cast("decimal(20,0)")).alias("_low"),
        F.sum(high.cast("decimal(20,0)")).alias("_high"),
        F.bit_xor("_h").alias("_xor"),
    ).select(
        "rows",
        "amount",
        "min_date",
        "max_date",
        F.sha2(
            F.concat_ws("|", F.lit(",".join(sorted(columns))), "rows", "_low", "_high", "_xor"), 256
        ).alias("content_hash"),
    )


def state_token(prints: dict[str, DataFrame], rule_version: str) -> DataFrame:
    """One token over several table prints and the rule version."""
    tagged = None
    for name in sorted(prints):
        part = prints[name].select(F.lit(name).alias("name"), "content_hash")
        tagged = part if tagged is None else tagged.unionByName(part)
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "name", "content_hash")))  # a handful of rows
    return tagged.agg(
        F.concat(F.lit("revenue-state-v1:"), F.sha2(F.concat_ws("|", F.lit(rule_version), F.concat_ws("|", parts)), 256)).alias(
            "token"
        )
    )
