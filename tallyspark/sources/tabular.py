"""Sheets in, datasets out. Every scanned value is text; roles and types come later."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import clean_document_number, is_valid_id

# Headings that may hold the document number, best first, and parts that hint at one.
KEY_HEADINGS = (
    "來源單據號",
    "交易號碼",
    "交易号码",
    "來源單號",
    "單據號",
    "单据号",
    "訂單號",
    "订单号",
    "收款單號",
    "收款单号",
    "團代號",
    "团代号",
    "單號",
    "单号",
)
KEY_HINTS = ("單", "单", "號", "号", "交易", "團")
# What is cut from a file name to get its tag.
TAG_NOISE = r"副表_|\.(xlsx|xls|csv|parquet|json)$"


def as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_sheet(source: DataFrame | str, spark: SparkSession | None = None) -> DataFrame:
    """A frame is passed through; a path is scanned by its suffix, all columns as text."""
    if isinstance(source, DataFrame):
        return source
    lowered = source.lower().rstrip("/")
    if lowered.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(source)  # no inference: every column is text
    if lowered.endswith((".json", ".jsonl")):
        return as_text(spark.read.option("primitivesAsString", True).json(source))
    return as_text(spark.read.parquet(source))


def file_tag(name: Column) -> Column:
    return F.regexp_replace(name, TAG_NOISE, "")


def union_tagged(parts: Mapping[str, DataFrame], tag_column: str = "source_name") -> DataFrame:
    """Union of secondary sheets with their columns merged, each row tagged with its sheet."""
    if not parts:
        raise ValueError("at least one secondary sheet is needed")
    union = None
    for name, frame in parts.items():
        tagged = frame.withColumn(tag_column, file_tag(F.lit(name)))
        union = tagged if union is None else union.unionByName(tagged, allowMissingColumns=True)
    return union


def read_secondary(spark: SparkSession, paths: list[str], tag_column: str = "source_name") -> DataFrame:
    parts = {path.rstrip("/").rsplit("/", 1)[-1]: read_sheet(path, spark) for path in paths}
    return union_tagged(parts, tag_column)


def resolve_key_column(columns: list[str], preferred: str, fallback_index: int = 2) -> str:
    """Which column holds the document number: by name, alias, hint, then position."""
    if preferred in columns:
        return preferred
    if not columns:
        raise ValueError("the sheet has no columns")
    squeezed = {c.replace(" ", "").replace("　", ""): c for c in columns}
    for heading in KEY_HEADINGS:
        if heading in squeezed:
            return squeezed[heading]
    for name, original in squeezed.items():
        if any(hint in name for hint in KEY_HINTS):
            return original
    return columns[fallback_index] if len(columns) > fallback_index else columns[0]


def exclusion_ids(df: DataFrame, preferred: str = "交易號碼") -> DataFrame:
    """Distinct cleaned ids of a list sheet, sorted; the named column else the first."""
    column = preferred if preferred in df.columns else df.columns[0]
    ids = df.select(clean_document_number(F.col(f"`{column}`")).alias("order_id"))
    return ids.where(is_valid_id(F.col("order_id"))).distinct().orderBy("order_id")


def synthetic_upload(spark: SparkSession, rows: int) -> tuple[DataFrame, DataFrame]:
    """A dry-run upload: one main receipt and one matching product row per number, by headings of roles."""
    base = spark.range(max(1, int(rows))).withColumn("n", F.lpad((F.col("id") + 1).cast("string"), 6, "0"))
    amount = F.lit(1000.0) + F.col("id")
    stamp = F.concat(
        F.lit("2026-07-02 "),
        F.lpad((F.lit(10) + F.col("id") % 8).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((F.col("id") % 60).cast("string"), 2, "0"),
        F.lit(":00"),
    )
    main = base.select(
        F.concat(F.lit("17DRY"), "n").alias("order_id"),
        F.concat(F.lit("DRY260702"), "n").alias("receipt_no"),
        F.lit("旅費").alias("receipt_type"),
        F.lit("現金").alias("pay_method"),
        amount.alias("amount"),
        amount.alias("base_amount"),
        stamp.alias("receipt_time"),
        F.lit("DRYRUN").alias("operator"),
    )
    product = base.select(
        F.concat(F.lit("17DRY"), "n").alias("secondary_key"),
        stamp.alias("trans_time"),
        F.lit("3").alias("days"),
        F.lit("2").alias("qty"),
        F.lit("HKD").alias("currency"),
        amount.alias("receivable"),
        amount.alias("received"),
        F.lit("DRYRUN").alias("dept_owner"),
        F.lit("測試部門").alias("dept"),
        *[F.lit("測試").alias(c) for c in ("dest_category", "dest_level1", "dest_level2", "dest_name")],
        F.lit("沙田分社").alias("branch"),
        F.lit("DRYRUN").alias("salesperson"),
        F.lit("DRYRUN").alias("tour_name"),
        F.concat(F.lit("DRY"), "n").alias("tour_code"),
    )
    return main, product


def write_bundle(datasets: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> dict[str, str]:
    """One directory per dataset under ``folder``; returns where each went."""
    written = {}
    for name, frame in datasets.items():
        target = f"{folder.rstrip('/')}/{name}"
        writer = frame.write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).csv(target)
        elif fmt == "json":
            writer.json(target)
        else:
            writer.parquet(target)
        written[name] = target
    return written


def bundle_manifest(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and an order-independent content hash per dataset."""
    from tallyspark.functions.hashing import table_print

    out = None
    for name, frame in datasets.items():
        row = table_print(frame, frame.columns).select(F.lit(name).alias("dataset"), "rows", "content_hash")
        out = row if out is None else out.unionByName(row)
    return out
