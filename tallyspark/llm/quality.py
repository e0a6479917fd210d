"""Quality selection by importance resampling over hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, mix, prepare
from tallyspark.llm.sketches import word_hashes

BUCKETS = 1 << 14
SMOOTHING = 1.0
KEEP = 0.8
SLICES = 16
BINS = 4096
FEW = 10_000


def ngram_buckets(text: str) -> np.ndarray:
    """Hashed buckets of the words and word pairs of ``text``, with repeats; ASCII case makes no difference."""
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8))
    pairs = mix(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])
    return (np.concatenate([words, pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of the target rows and of all rows of a partition, cut into slices."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for text, target in zip(b.column("text").to_pylist(), b.column("target").to_pylist()):
            found = np.bincount(ngram_buckets(text), minlength=BUCKETS)
            counts[1] += found
            if target:
                counts[0] += found
    if counts.any():
        parts = counts.reshape(2, SLICES, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([parts[:, i].tobytes() for i in range(SLICES)], pa.binary())], names=["slice", "counts"]
        )


def _total(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, name = np.zeros(2 * BUCKETS // SLICES, np.int64), 0
    for b in group:
        for i, blob in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
            name, total = i, total + np.frombuffer(blob, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def log_ratios(rows: DataFrame) -> np.ndarray:
    """Log ratio of the target model to the raw model in each bucket, from all rows ``(text, target)``.

    A task folds its rows into one vector of fixed size; the driver gets the summed vector. Without any target word
    the models are taken as equal.
    """
    sums = rows.mapInArrow(_count, "slice int, counts binary").groupBy("slice").applyInArrow(_total, "slice int, counts binary").collect()
    counts = np.zeros((2, SLICES, BUCKETS // SLICES))
    for r in sums:
        counts[:, r["slice"]] = np.frombuffer(bytes(r["counts"]), np.int64).reshape(2, -1)
    target, raw = counts.reshape(2, -1)
    if not target.any():
        return np.zeros(BUCKETS)
    target, raw = target + SMOOTHING * raw / raw.sum() * 1000, raw + SMOOTHING
    return np.log((target + 1e-9) / target.sum()) - np.log(raw / raw.sum())


def log_weights(text: Column, ratios: np.ndarray) -> Column:
    """Log importance weight of each text: the sum of the ratios of its n-grams; 0 for an empty text."""

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        return pa.array([float(ratios[ngram_buckets(t)].sum()) for t in texts.to_pylist()], pa.float64())

    return weigh(F.coalesce(text, F.lit("")))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The exact ``k``-th largest value of a double column without nulls; None if ``k`` is 0.

    The bracket is narrowed by histograms of a fixed size until it holds few values, so the driver sees a bounded number.
    """
    if k <= 0:
        return None
    c = F.col(column)
    low, high, n = values.agg(F.min(c), F.max(c), F.count("*")).first()
    above, inside = 0, n  # rows over the bracket, rows in it
    k = min(k, n)
    while inside > FEW and low < high:
        width = (high - low) / BINS
        slot = F.least(F.floor((c - low) / width), F.lit(BINS - 1))
        counts = values.where((c >= low) & (c <= high)).groupBy(slot.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        before = (low, high)
        for r in sorted(counts.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high, inside = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
        if (low, high) == before:
            break
    if low == high:
        return low
    rest = values.where((c >= low) & (c <= high)).groupBy(c.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("v")).collect()
    for r in rest:
        above += r["n"]
        if above >= k:
            return r["v"]
    return low


def resampled(
    docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, seed: int = 17
) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, selected)`` for every row: the ``floor(keep * rows)`` rows with the largest keys are selected.

    The raw model counts every row, the target model those whose id is in ``target_ids(doc_id)``. The key is the log
    weight plus Gumbel noise drawn from a hash of id and text, so the top keys are a sample without replacement in
    proportion to the weights, the same in every run. Rows equal in id and text share a key; where such rows tie at the
    edge, all of them are selected. Null texts are empty (weight 1); rows with a null id are no target; an empty table
    gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("target")).where("doc_id IS NOT NULL").distinct()
    # one plan for all sizes: both sides grow with the corpus
    ratios = log_ratios(rows.join(wanted.hint("merge"), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    noise = -F.log(-F.log(uniform))
    weighed = rows.select("doc_id", log_weights(F.col("text"), ratios).alias("log_weight"), noise.alias("noise"))
    keyed = materialised(weighed.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise")).alias("gumbel_key")))
    edge = kth_largest(keyed, "gumbel_key", int(keep * keyed.count()))
    chosen = F.lit(False) if edge is None else F.col("gumbel_key") >= F.lit(edge)
    return keyed.withColumn("selected", chosen)


def quality_query(spark: SparkSession, folder: str) -> DataFrame:
    good = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").select("doc_id")
    return resampled(spark.read.parquet(f"{folder}/documents.parquet"), good)
