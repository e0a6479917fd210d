"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

ORDERS = (3, 4, 5)
BITS = 18
SLICES = 32
SMOOTHING = 1.0
SAMPLE_PER_LABEL = 2500  # rows of each label the linear weights are fitted on; the ratios use every labelled row
ROUNDS = 80
PENALTY = 1e-3
SLICE_CHARS = 1 << 20
PART_IDS = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def feature_ids(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted hashed ids of the character n-grams that ``text`` has. ``seen`` is an all-false scratch of 2**BITS flags.

    Upper and lower case count as one; a very long text is read in slices, so memory stays bounded.
    """
    longest = max(ORDERS)
    text = f" {text.lower()} ".ljust(longest)  # so that an empty text has features as well
    for at in range(0, len(text), SLICE_CHARS):
        codes = np.frombuffer(text[at : at + SLICE_CHARS + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, longest + 1):
            h = h[: len(codes) - n + 1] * np.uint64(_BASE) + codes[n - 1 :] + np.uint64(n)
            if not len(h):
                break
            if n in ORDERS:
                seen[(h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)] = True
    ids = np.flatnonzero(seen)
    seen[ids] = False
    return ids


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # of the scaled features, already times their ratio
    scale: np.ndarray  # squared ratio of each feature, for the length of a document's vector
    intercept: float

    def score(self, ids: np.ndarray) -> float:
        length = float(np.sqrt(self.scale[ids].sum())) or 1.0
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[ids].sum() / length, -30, 30))))


def _count_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each feature, by label, summed over the partition and cut into slices of features."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    rows = np.zeros(2, np.int64)
    seen = np.zeros(1 << BITS, bool)
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
            counts[label][feature_ids(text, seen)] += 1
            rows[label] += 1
    if rows.any():
        parts = counts.reshape(2, SLICES, -1)
        blobs = [parts[:, i].astype("<i8").tobytes() for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary()), pa.array([int(rows[0])] * SLICES, pa.int64()), pa.array([int(rows[1])] * SLICES, pa.int64())],
            names=["slice", "counts", "n0", "n1"],
        )


def _sum_slice(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice at a time, one blob of a fixed size at a time."""
    total, rows, name = np.zeros((2 << BITS) // SLICES, np.int64), [0, 0], 0
    for b in group:
        for i, blob, n0, n1 in zip(*(b.column(c).to_pylist() for c in ("slice", "counts", "n0", "n1"))):
            name, rows = i, [rows[0] + n0, rows[1] + n1]
            total += np.frombuffer(blob, "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([rows[0]]), pa.array([rows[1]])], names=["slice", "counts", "n0", "n1"])


SLICE_SCHEMA = "slice int, counts binary, n0 long, n1 long"


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """Naive Bayes log-count ratio of each feature over all rows ``(text, label)``, and the rows of each label.

    Each task folds its rows into one fixed vector; the driver gets 2**BITS sums, however many rows there are.
    """
    parts = labelled.mapInArrow(_count_slices, SLICE_SCHEMA)
    sums = parts.groupBy("slice").applyInArrow(_sum_slice, SLICE_SCHEMA).collect()
    if not sums:
        return np.zeros(1 << BITS, np.float32), 0, 0
    slices = [np.frombuffer(bytes(r["counts"]), "<i8").reshape(2, -1) for r in sorted(sums, key=lambda r: r["slice"])]
    clean, toxic = np.concatenate(slices, axis=1) + SMOOTHING
    n0, n1 = sums[0]["n0"], sums[0]["n1"]
    return np.log((toxic / toxic.sum()) / (clean / clean.sum())).astype(np.float32), n0, n1


def fit_weights(texts: list[str], labels: np.ndarray, ratios: np.ndarray) -> ToxicityModel:
    """Penalised logistic regression on the scaled features, by accelerated gradient steps from zero.

    Both labels weigh the same, so a score of 0.5 is where the text itself speaks as much for one as for the other.
    """
    seen = np.zeros(1 << BITS, bool)
    sizes = np.zeros(len(texts), np.int64)
    squares = ratios.astype(np.float64) ** 2
    # a part is a run of documents whose ids, and the few vectors of that length a step needs, take little memory
    parts: list[tuple[int, int, np.ndarray]] = []
    held: list[np.ndarray] = []
    first = 0
    for i, text in enumerate(texts):
        held.append(feature_ids(text, seen).astype(np.int32))
        sizes[i] = len(held[-1])
        if sizes[first : i + 1].sum() >= PART_IDS or i + 1 == len(texts):
            parts.append((first, i + 1, np.concatenate(held)))
            held, first = [], i + 1

    def by_document(values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the features of each document."""
        out = np.zeros(len(texts))
        for s, e, ids in parts:
            out[s:e] = np.add.reduceat(values[ids], np.concatenate([[0], np.cumsum(sizes[s : e - 1])]))
        return out

    def by_feature(values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the documents that have each feature."""
        out = np.zeros(1 << BITS)
        for s, e, ids in parts:
            out += np.bincount(ids, np.repeat(values[s:e], sizes[s:e]), minlength=1 << BITS)
        return out

    lengths = np.sqrt(by_document(squares))
    lengths[lengths == 0] = 1
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    w = np.zeros(1 << BITS)
    ahead, shift, shift_ahead, pace = w.copy(), 0.0, 0.0, 1.0
    step = 4.0  # rows have length 1, so the loss bends by at most a quarter
    for _ in range(ROUNDS):
        margin = by_document(ahead * ratios) / lengths + shift_ahead
        error = (1 / (1 + np.exp(-margin)) - labels) * share
        gradient = by_feature(error / lengths) * ratios + PENALTY * ahead / len(labels)
        new, new_shift = ahead - step * gradient, shift_ahead - step * error.sum()
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, shift_ahead = new + (pace - 1) / following * (new - w), new_shift + (pace - 1) / following * (new_shift - shift)
        w, shift, pace = new, new_shift, following
    return ToxicityModel((w * ratios).astype(np.float32), squares.astype(np.float32), float(shift))


def held_out(id_col: str | Column) -> Column:
    """Rows kept from training: crc32 of the id as text divides by 5."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Model from all documents ``(doc_id, text)`` with a label ``(doc_id, toxic)`` that are not held out.

    The ratios count every such document. The linear weights are fitted on ``sample_per_label`` documents of each label,
    those with the smallest id hashes. Null ids and labels are left out; a document with several labels is toxic if one
    says so; null texts are empty. Without rows of both labels, every score is the smoothed share of label 1.
    """
    prepare(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    known = known.where(~held_out("doc_id"))
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one plan for all sizes: both sides grow with the corpus
    ratios, n0, n1 = log_count_ratios(texts.join(known.hint("merge"), "doc_id").select("text", "label"))
    if not n0 or not n1:
        prior = (n1 + 0.5) / (n0 + n1 + 1)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("label") == y).orderBy(*order).limit(sample_per_label) for y in (0, 1)]
    # at most twice sample_per_label ids; repeated document rows are cut to the same bound
    wanted = F.broadcast(picked[0].union(picked[1]))
    rows = texts.join(wanted, "doc_id").orderBy(*order, "text").limit(2 * sample_per_label).collect()
    return fit_weights([r["text"] for r in rows], np.array([r["label"] for r in rows]), ratios)


def score_column(spark: SparkSession, text: Column, model: ToxicityModel) -> Column:
    """Score of each text; a null text is empty. The model has a fixed size."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        seen = np.zeros(1 << BITS, bool)
        return pa.array([sent.value.score(feature_ids(t, seen)) for t in texts.to_pylist()], pa.float64())

    return score(F.coalesce(text, F.lit("")))


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; ids may be null or repeat, an empty table gives no rows."""
    spark = prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score_column(spark, F.col(f"`{text_col}`"), model).alias("score"))


def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
