"""Snapshot tables: immutable version folders plus an append-only log that names the current one.

A writer fills a new folder first and creates its log file last, so a lost executor or a failed job leaves the
published version untouched. Readers follow the newest log file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.dates import to_day

DETAIL_TABLES = ("tour_data", "others_data")
MONTH = "_month"


TRIES = 20


class SnapshotStore:
    """Versions of each table as folders, and a log of one small file for each version.

    The log file of a version is named by its sequence number and created only if no file of that name exists, so of two
    writers that saw the same state one fails, reads the newer state and tries again. Its row lists the folders that make
    up the version: a version may share folders of months it did not touch with the one before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- files, by way of Spark's own file system layer -----------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _exists(self, name: str) -> bool:
        files, path = self._path(name)
        return files.exists(path)

    def _create(self, name: str, text: str) -> bool:
        """Writes a small file that must not exist; False if it does."""
        files, path = self._path(name)
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if files.exists(path):
                return False
            raise error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    # --- log ------------------------------------------------------------------------------------------------------

    def versions(self, table: str) -> DataFrame | None:
        """The log ``(sequence, version_id, folders, published_at)``; None before the first publish.

        Only a log that is not there counts as empty. One that cannot be read raises, for a table taken as empty would be
        overwritten by the next upload.
        """
        if not self._exists(f"{table}/_log"):
            return None
        schema = "sequence long, version_id string, folders map<string,string>, published_at string"
        log = self.spark.read.schema(schema).option("mode", "FAILFAST").json(f"{self.root}/{table}/_log")
        return log.where("sequence > 0")

    def _newest(self, table: str):
        log = self.versions(table)
        if log is None:
            return None
        row = log.orderBy(F.desc("sequence")).first()
        if row is None or not row["version_id"]:
            raise ValueError(f"the log of {table} holds no version")
        return row

    def current_version(self, table: str) -> str | None:
        row = self._newest(table)
        return None if row is None else row["version_id"]

    def load(self, table: str, version_id: str | None = None) -> DataFrame | None:
        """The published rows of ``table``; ``None`` before the first publish."""
        row = self._newest(table)
        if row is not None and version_id is not None and row["version_id"] != version_id:
            row = self.versions(table).where(F.col("version_id") == version_id).first()
            if row is None:
                raise ValueError(f"unknown version {version_id}")
        return None if row is None else self._read(table, row["folders"])

    def _read(self, table: str, folders: dict[str, str], months: list[str] | None = None) -> DataFrame | None:
        """Rows of the folders of some months, or of all; a version published whole has one folder, of no month."""
        paths = [f"{self.root}/{table}/{f}" for m, f in sorted(folders.items()) if months is None or m in months]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def _commit(self, table: str, build: Callable[[object], dict[str, str]]) -> str:
        """Names a new version that ``build`` made from the newest log row, unless another writer was faster."""
        for _ in range(TRIES):
            newest = self._newest(table)
            sequence = 1 + (0 if newest is None else newest["sequence"])
            version = f"v{sequence:06d}-{uuid.uuid4().hex[:8]}"
            row = {"sequence": sequence, "version_id": version, "folders": build(newest), "published_at": datetime.now(timezone.utc).isoformat()}
            if self._create(f"{table}/_log/{sequence:09d}.json", json.dumps(row)):
                return version
        raise RuntimeError(f"{table}: {TRIES} other writers were faster")

    def _write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{table}/{folder}")
        return folder

    # --- writing --------------------------------------------------------------------------------------------------

    def publish(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write ``df`` as a whole new version and make it current, whatever was current before."""
        folder = self._write(table, df, partition_by)
        return self._commit(table, lambda _: {"": folder})

    def update(self, table: str, change: Callable[[DataFrame | None], DataFrame], partition_by: list[str] | None = None) -> str:
        """Publish ``change`` of the current rows; worked out again if another writer published meanwhile."""

        def build(newest) -> dict[str, str]:
            rows = None if newest is None else self._read(table, newest["folders"])
            return {"": self._write(table, change(rows), partition_by)}

        return self._commit(table, build)

    def replace_keys(self, table: str, new: DataFrame, key: str = "order_id", day: str = "unified_date") -> str:
        """Replace whole keys by month: stored rows of any incoming key go, all incoming rows come in.

        Only months that hold an incoming row, or a stored row of an incoming key, are written anew; the folders of all
        others are taken over by name. A writer that was overtaken works from the newer state.
        """
        keys = key_set(new, key)

        def by_month(df: DataFrame) -> DataFrame:
            month = F.date_format(to_day(df, day), "yyyy-MM") if day in df.columns else F.lit(None).cast("string")
            return df.withColumn(MONTH, F.coalesce(month, F.lit("none")))

        incoming = by_month(new)

        def build(newest) -> dict[str, str]:
            folders = {} if newest is None else dict(newest["folders"])
            stored = self._read(table, folders)
            touched = incoming.select(MONTH)
            if stored is not None:
                ids = by_month(stored).select(MONTH, F.trim(F.col(key).cast("string")).alias(key))
                # a version published whole is dealt out by month on the first replacement
                touched = touched.union(ids.select(MONTH) if "" in folders else ids.join(keys, key, "left_semi").select(MONTH))
            # one row for each month at most
            months = sorted(r[0] for r in touched.distinct().collect())
            if not months:
                return folders
            rows = self._read(table, folders, ["", *months])
            merged = incoming if rows is None else append_compatible(delete_keys(by_month(rows), keys, key), incoming)
            folder = self._write(table, merged.repartition(MONTH), [MONTH])
            written = {m: f"{folder}/{MONTH}={m}" for m in months}
            return {m: f for m, f in folders.items() if m and m not in months} | {m: f for m, f in written.items() if self._exists(f"{table}/{f}")}

        return self._commit(table, build)

    def roll_back(self, table: str, version_id: str) -> None:
        """Make the state of an older version current again, as a new version."""
        log = self.versions(table)
        old = None if log is None else log.where(F.col("version_id") == version_id).first()
        if old is None:
            raise ValueError(f"unknown version {version_id}")
        self._commit(table, lambda _: dict(old["folders"]))

    def append(self, table: str, df: DataFrame) -> None:
        """Append facts to a plain growing table; new columns are merged on read."""
        df.write.mode("append").parquet(f"{self.root}/{table}/facts")

    def facts(self, table: str) -> DataFrame | None:
        """The appended rows; None if nothing was ever appended. A table that cannot be read raises."""
        if not self._exists(f"{table}/facts"):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{table}/facts")


def append_compatible(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if existing is None else existing.unionByName(new, allowMissingColumns=True)


def key_set(df: DataFrame, key: str = "order_id") -> DataFrame:
    ids = df.select(F.trim(F.col(key).cast("string")).alias(key))
    return ids.where(F.col(key).isNotNull() & (F.col(key) != "")).distinct()


def delete_keys(existing: DataFrame, keys: DataFrame, key: str = "order_id") -> DataFrame:
    """Rows whose key is not listed; rows without a key stay."""
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def overlap_stats(existing: DataFrame, keys: DataFrame, key: str = "order_id") -> DataFrame:
    """How many listed keys are already stored, and on how many rows."""
    counts = existing.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    hit = counts.join(keys.select(key).distinct(), key, "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("overlap_order_ids"), F.coalesce(F.sum("rows"), F.lit(0)).alias("deleted_rows"))


def table_stats(df: DataFrame, time: str = "receipt_time", amount: str = "amount") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.col(time)).alias("max_date"),
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"),
    )


def receipt_numbers(df: DataFrame, column: str = "receipt_no") -> DataFrame:
    numbers = df.select(F.trim(F.col(column).cast("string")).alias(column))
    return numbers.where(F.col(column) != "").distinct()


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "order_id") -> DataFrame:
    """Replace whole keys: stored rows of any incoming key go, all incoming rows come in."""
    if existing is None:
        return new
    return append_compatible(delete_keys(existing, key_set(new, key), key), new)


def upsert_pair(
    existing: dict[str, DataFrame | None], new: dict[str, DataFrame], key: str = "order_id", parity: bool = False
) -> dict[str, DataFrame]:
    """Upsert both detail tables.

    One key space by default: an order that moves to the other table leaves its old one. ``parity=True`` keeps
    the per-table rule, under which it stays in both.
    """
    if parity:
        return {name: upsert(existing.get(name), new[name], key) for name in new}
    incoming = None
    for frame in new.values():
        ids = key_set(frame, key)
        incoming = ids if incoming is None else incoming.unionByName(ids)
    out = {}
    for name, frame in new.items():
        old = existing.get(name)
        out[name] = frame if old is None else append_compatible(delete_keys(old, incoming, key), frame)
    return out


def upsert_summary(existing: DataFrame, new_raw: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """One row: before, after, filtered, overlapping, deleted and appended rows of one table."""
    from tallyspark.functions.keys import attach_one_row

    def prefixed(df: DataFrame, prefix: str) -> DataFrame:
        return df.select([F.col(c).alias(prefix + c) for c in df.columns])

    row = prefixed(table_stats(existing), "before_")
    row = attach_one_row(row, prefixed(table_stats(upsert(existing, new)), "after_"))
    row = attach_one_row(row, new_raw.agg(F.count(F.lit(1)).alias("input_rows")))
    row = attach_one_row(row, new.agg(F.count(F.lit(1)).alias("write_rows")))
    row = attach_one_row(row, overlap_stats(existing, key_set(new)))
    return row.select(
        F.lit(label).alias("table_name"),
        "before_rows",
        "after_rows",
        "before_max_date",
        "after_max_date",
        "input_rows",
        (F.col("input_rows") - F.col("write_rows")).alias("filtered_rows"),
        "write_rows",
        "overlap_order_ids",
        "deleted_rows",
        F.col("write_rows").alias("inserted_rows"),
    )


def with_month_partition(df: DataFrame, day: str = "unified_date") -> DataFrame:
    """A month column to partition detail tables by, so period filters prune folders."""
    return df.withColumn("month_key", F.date_format(to_day(df, day), "yyyy-MM"))


# JSON columns of the gate history.
HISTORY_JSON = ("source_files", "batch_summary", "upsert_summary", "drift_diagnosis", "gate", "monthly_baseline")


def history_row(spark: SparkSession, record: dict) -> DataFrame:
    """One gate record as a row; nested parts become JSON text, missing counters 0."""
    flat = {k: (json.dumps(v, ensure_ascii=False, default=str) if k in HISTORY_JSON else v) for k, v in record.items()}
    row = {
        "upload_status": flat.get("upload_status") or "unknown",
        "upload_message": flat.get("upload_message") or "",
        "core_status": flat.get("core_status") or "unknown",
        "baseline_month": flat.get("baseline_month"),
        "delta_amount": float(flat.get("delta_amount") or 0),
        "matched_checks": int(flat.get("matched_checks") or 0),
        "total_checks": int(flat.get("total_checks") or 0),
        "drift_check_count": int(flat.get("drift_check_count") or 0),
        "freshness_status": flat.get("freshness_status") or "unknown",
        "latest_data_date": flat.get("latest_data_date"),
        "rollback_status": flat.get("rollback_status"),
        "operation_id": flat.get("operation_id"),
        **{f"{name}_json": flat.get(name) or ("[]" if name in HISTORY_JSON[:2] else "{}") for name in HISTORY_JSON},
    }
    types = {"delta_amount": "double", "matched_checks": "long", "total_checks": "long", "drift_check_count": "long"}
    schema = ", ".join(f"{k} {types.get(k, 'string')}" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).withColumn("created_at", F.current_timestamp())


def record_history(store: SnapshotStore, record: dict, table: str = "gate_history") -> None:
    old = store.facts(table)
    next_id = 1 if old is None else (old.agg(F.max("id")).first()[0] or 0) + 1
    store.append(table, history_row(store.spark, record).withColumn("id", F.lit(next_id).cast("long")))


def latest_history(history: DataFrame, limit: int | None = None, json_schemas: dict[str, str] | None = None) -> DataFrame:
    """Newest records first, all of them or the first ``limit``; named JSON columns are decoded, bad JSON gives null."""
    rows = history.orderBy(F.desc("id"))
    if limit is not None:
        rows = rows.limit(max(1, int(limit)))
    for column, schema in (json_schemas or {}).items():
        rows = rows.withColumn(column.removesuffix("_json"), F.from_json(column, schema))
    return rows
