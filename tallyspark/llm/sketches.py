"""Document fingerprints: bottom-k sketches of word-shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Powers, mix, prefix_sums, prepare, span_hashes

K = 256
WIDTH = 5
HASH_BITS = 48
ROWS_TOGETHER = 2000

BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = Powers(0xA0761D6478BD642F)
_WORDS = Powers(0xE7037ED1A0B428DB)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not blank."""
    edges = np.diff(np.concatenate([[0], (~_BLANK[data]).view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(data)
    return mix(span_hashes(prefix_sums(BYTE_VALUES[data], _BYTES), starts, ends, _BYTES) + (ends - starts).astype(np.uint64))


def sketch(text: str, k: int = K, width: int = WIDTH) -> np.ndarray:
    """The ``k`` smallest distinct hashes of the word shingles, ascending; all of them if there are fewer.

    ASCII case and white space make no difference. Fewer words than ``width`` are one shingle; no word gives an empty sketch.
    """
    words = word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8))
    if not len(words):
        return words
    width = min(width, len(words))
    at = np.arange(len(words) - width + 1)
    hashes = mix(span_hashes(prefix_sums(words, _WORDS), at, at + width, _WORDS) + np.uint64(width)) >> np.uint64(64 - HASH_BITS)
    return np.unique(hashes)[:k]


def encode(values: np.ndarray) -> str:
    """A sketch as text: its hashes, ascending, 48 bits big-endian each, in base 64."""
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two shingle sets, from theirs alone."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of shared over all shingles; exact while both sketches are complete. Two empty sets are the same."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles: counted if the sketch is complete, else estimated from its largest hash."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << HASH_BITS) / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has; an empty set is contained in any."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, shared / distinct_shingles(a, k))


def fingerprint_column(text: Column, k: int = K, width: int = WIDTH) -> Column:
    @F.arrow_udf("string")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([encode(sketch(t, k, width)) for t in texts.to_pylist()], pa.string())

    return make(F.coalesce(text, F.lit("")))


def merged(parts: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint for each key, that of all its parts together.

    Only the ``k`` smallest hashes of a key leave any task, so a key with a large share of all rows does no harm.
    """

    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([decode(t).astype(np.int64) if t else [] for t in texts.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("string")
    def join(values: pa.Array) -> pa.Array:
        return pa.array([encode(np.array(v, np.uint64)) for v in values.to_pylist()], pa.string())

    each = parts.select(*keys, F.explode_outer(hashes(F.col(fingerprint))).alias("_h")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last())
    least = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias("_hs")).select(*keys, join("_hs").alias(fingerprint))


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(doc_id, text, _last)`` in partitions sorted so that each document stands before the next one.

    Ranges of ids are dealt out whole. After the last row of a range comes a copy of the first row of the next one
    (``_last``), found through one id for each range. The only thing that passes the driver is the range bounds.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    total = rows.count()
    if not total:
        return rows.select("doc_id", "text", F.lit(False).alias("_last"))
    n = max(1, min(10_000, total // ROWS_TOGETHER))
    cuts = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    # a range starts at its cut, so rows with the same id are never parted
    ranged = rows.withColumn("_range", _position(F.col("_key"), cuts))
    firsts = [tuple(r) for r in ranged.groupBy("_range").agg(F.min("_key")).orderBy("_range").collect()]
    after = docs.sparkSession.createDataFrame(
        [(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)], "_range int, _key long"
    )
    # one row per range, 10,000 at most; of rows that share the id, the first by text
    heads = rows.join(F.broadcast(after), "_key").groupBy("_range", "_key").agg(F.min("text").alias("text"))
    heads = heads.select("_range", F.lit(None).cast("long").alias("doc_id"), "text", "_key", F.lit(True).alias("_last"))
    every = ranged.select("_range", "doc_id", "text", "_key", F.lit(False).alias("_last")).union(heads)
    dealt = every.repartition("_range").sortWithinPartitions("_range", "_last", "_key", "text")
    return dealt.select("doc_id", "text", "_last")


def _position(key: Column, cuts: list[int]) -> Column:
    """Number of the sorted ``cuts`` that are not above ``key``."""
    bounds = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def search(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    return search(key)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; a row is settled when the next one is read."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles"]
    before = None
    for b in batches:
        out = []
        for doc, text, last in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "_last"))):
            own = sketch(text)
            if before is not None:
                prior, prior_text, prior_sketch = before
                half = len(prior_text) // 2
                edited = prior_text[: len(prior_text) - half] + text[:half]
                changed = sketch(edited)
                out.append(
                    (prior, len(prior_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encode(prior_sketch), encode(changed), resemblance(prior_sketch, changed), resemblance(prior_sketch, own), distinct_shingles(prior_sketch))
                )
            before = None if last else (doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half is the start of the next text by id.

    Null texts are empty (no shingles; two empty texts are alike); null ids come first; rows that share an id follow each
    other by text; after the last row comes the first; an empty table gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double"
    return _with_next(docs, id_col, text_col).mapInArrow(_edits, schema)


def fingerprint_query(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))
