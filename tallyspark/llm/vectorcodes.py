"""Vector codes: each part of a vector becomes the number of its codebook's nearest entry, found by Orchard's search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import materialised, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 16
CHUNK = 8192
LIMB = 40
EXACT = 1 << 53
LONG = (1 << 63) - 1


def _whole(x: float) -> int:
    """``floor(SCALE * x)`` of any finite number."""
    return int(x) * SCALE if abs(x) >= EXACT else math.floor(SCALE * x)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``floor(SCALE * x)``, zero-padded to ``width``: doubles where sums of squares of differences stay exact in them,
    Python integers otherwise."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.arange(len(values)) + np.repeat(np.cumsum(width - lengths) - (width - lengths), lengths)
    if not len(values) or np.abs(values).max() < 1 << 20:
        out = np.zeros(len(lengths) * width)
        out[at] = np.floor(SCALE * values)
    else:
        out = np.zeros(len(lengths) * width, object)
        out[at] = [_whole(x) for x in values.tolist()]
    return out.reshape(len(lengths), width)


def _fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances between the rows are exact in doubles."""
    most = max((int(abs(a).max()) for a in arrays if a.size), default=0)
    return 4 * most * most * max(1, arrays[0].shape[1]) < EXACT


class Codebook:
    """Entries of one part position, each with all others sorted by their distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries if entries.dtype == object and not _fits(entries) else entries.astype(np.float64)
        k = len(entries)
        self.gaps = np.zeros((k, k - 1), self.entries.dtype)
        self.order = np.zeros((k, k - 1), np.int64)
        others = np.arange(k)
        for i in range(k):
            gap = ((self.entries - self.entries[i]) ** 2).sum(axis=1)
            rest = others[others != i]
            rest = rest[np.argsort(gap[rest], kind="stable")]
            self.order[i], self.gaps[i] = rest, gap[rest]
        # a first guess: the entry next to a point along the coordinate in which entries differ most
        spread = self.entries.astype(np.float64)
        self.axis = int(np.argmax(spread.max(axis=0) - spread.min(axis=0))) if spread.shape[1] else -1
        if self.axis >= 0:
            self.along = np.argsort(spread[:, self.axis], kind="stable")
            self.steps = spread[self.along, self.axis]

    def _guess(self, points: np.ndarray) -> np.ndarray:
        if self.axis < 0:
            return np.zeros(len(points), np.int64)
        at = np.searchsorted(self.steps, points[:, self.axis].astype(np.float64))
        return self.along[np.minimum(at, len(self.along) - 1)].copy()

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index, squared distance)`` of the nearest entry of each point; of equal ones the lowest index.

        Each point walks the list of its current entry, ``BLOCK`` unmarked entries at a time; a nearer one (or an equal one
        of lower index) becomes current and its list is walked from the start. Entries once held against a point are marked
        and not looked at again. The walk ends where the list does, or at an entry that is further than twice the current
        distance from the current one: what follows is further from the point than the current entry is.
        """
        entries = self.entries
        if entries.dtype == object or points.dtype == object:
            if _fits(points, entries):
                points, entries = points.astype(np.float64), entries.astype(np.float64)
            else:
                points, entries = points.astype(object), np.array([[int(x) for x in e] for e in entries], object).reshape(entries.shape)
                points = np.array([[int(x) for x in p] for p in points], object).reshape(points.shape)
        elif not _fits(points, entries):
            return Codebook.nearest(self, np.array([[int(x) for x in p] for p in points], object).reshape(points.shape))
        n, (k, last) = len(points), self.order.shape
        current = self._guess(points)
        best = ((points - entries[current]) ** 2).sum(axis=1)
        marked = np.zeros((n, k), bool)
        marked[np.arange(n), current] = True
        place = np.zeros(n, np.int64)
        walking = np.arange(n) if last else np.zeros(0, np.int64)
        ahead = np.arange(BLOCK)
        while len(walking):
            at = place[walking][:, None] + ahead
            on = at < last
            at = np.minimum(at, last - 1)
            here = current[walking][:, None]
            others = self.order[here, at]
            on &= self.gaps[here, at] <= 4 * best[walking][:, None]
            row, column = np.nonzero(on & ~marked[walking[:, None], others])
            point, other = walking[row], others[row, column]
            far = ((points[point] - entries[other]) ** 2).sum(axis=1)
            marked[point, other] = True
            better = (far < best[point]) | ((far == best[point]) & (other < current[point]))
            point, other, far = point[better], other[better], far[better]
            place[walking] += BLOCK
            if len(point):
                # of several nearer ones in the block the nearest is taken
                sort = np.lexsort((other, far, point)) if far.dtype != object else np.array(sorted(range(len(far)), key=lambda i: (point[i], far[i], other[i])))
                first = sort[np.flatnonzero(np.diff(point[sort], prepend=-1))]
                current[point[first]], best[point[first]], place[point[first]] = other[first], far[first], 0
            # the list goes on only behind a block that lay within reach
            goes = on[:, -1] & (place[walking] < last)
            goes |= place[walking] == 0
            walking = walking[goes]
        return current, best


def _parts(numbers: np.ndarray) -> list[np.ndarray]:
    return np.split(numbers, PARTS, axis=1)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, CHUNK):
        yield batch.slice(at, CHUNK)


def kept(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Rows whose vector and all its components are there and finite."""
    odd = F.exists(F.col(f"`{vec_col}`"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col(f"`{vec_col}`").isNotNull() & ~F.coalesce(odd, F.lit(False)))


def _moved(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: every entry that parts are assigned to becomes the floor of their mean.

    A task sends one sum per number of the codebooks, in limbs so that any magnitude is exact; the driver gets as many
    sums as the codebooks have numbers, whatever the number of rows.
    """
    k, part = len(books[0]), width // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        total = np.zeros((PARTS * k, part), object)
        count = np.zeros(PARTS * k, np.int64)
        for whole in batches:
            for b in _chunks(whole):
                for p, points in enumerate(_parts(whole_numbers(b.column("vector"), width))):
                    code, _ = search[p].nearest(points)
                    count[p * k : (p + 1) * k] += np.bincount(code, minlength=k)
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    if len(used) and part:
                        added = np.add.reduceat(points[order], first, axis=0)
                        total[p * k + used] += np.array([[int(x) for x in r] for r in added], object).reshape(added.shape)
        slots, limbs, values = [], [], []
        for slot, value in enumerate([*count.tolist(), *total.ravel().tolist()]):
            sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
            while value:
                slots.append(slot)
                limbs.append(limb)
                values.append(sign * (value & ((1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], names=["slot", "limb", "value"])

    told = [0] * (PARTS * k * (1 + part))
    for slot, limb, value in rows.select("vector").mapInArrow(sums, "slot long, limb int, value long").groupBy("slot", "limb").agg(F.sum("value")).collect():
        told[slot] += value << (LIMB * limb)
    out = []
    for p in range(PARTS):
        book = books[p].astype(object)
        for e in range(k):
            n, at = told[p * k + e], PARTS * k + (p * k + e) * part
            if n:
                book[e] = [s // n for s in told[at : at + part]]
        out.append(book)
    return out


def codebooks(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Codebooks of the part positions after all rounds, from ``rows(vec_id, vector)``; at most ``ENTRIES`` rows start them."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().column("vector").combine_chunks()
    books = [b.astype(object) for b in _parts(np.array([[int(x) for x in r] for r in whole_numbers(first, width)], object).reshape(len(first), width))]
    for _ in range(ROUNDS):
        books = _moved(rows, books, width)
    return books


def compressed(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector without missing or non-finite components.

    Vectors shorter than the longest, or than the next multiple of the number of parts, count as padded with zeros. Rows
    with a null id come last in the choice of first entries, rows that share an id in the order of their vectors; all are
    coded. With fewer than ``ENTRIES`` vectors the codebooks are as small. Numbers of any magnitude are exact; an error beyond
    a long is null, as is the sum over a label that has one. Empty tables give no rows. Other columns are not read.
    """
    prepare(vectors.sparkSession)
    names = [F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").cast("array<double>").alias("vector")]
    rows = kept(vectors, vec_col).select(*names)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    schema = rows.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    if longest is None:
        books, coded = [], vectors.sparkSession.createDataFrame([], schema)
    else:
        width = -(-longest // PARTS) * PARTS
        books = codebooks(rows, width)

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = [Codebook(b) for b in books]
            for whole in batches:
                for b in _chunks(whole):
                    code, error = np.zeros((b.num_rows, PARTS), np.uint8), np.zeros(b.num_rows, object)
                    for p, points in enumerate(_parts(whole_numbers(b.column("vector"), width))):
                        code[:, p], far = search[p].nearest(points)
                        error += np.array([int(x) for x in far], object)
                    spelled = code.tobytes().hex()
                    texts = [spelled[i : i + 2 * PARTS] for i in range(0, len(spelled), 2 * PARTS)]
                    errors = pa.array([e if e <= LONG else None for e in error.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(texts, pa.string()), errors], names=["vec_id", "label", "code", "error"])

        coded = materialised(rows.mapInArrow(codes, schema))
    printed = hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    fits = (F.count("error") == F.count("*")) & (whole <= F.lit(LONG))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.when(fits, whole).cast("long").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(printed).alias("codebooks_sha256")
    )


def vectorcode_query(spark: SparkSession, folder: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _sql() -> str:
    """Rounds as steps over (row, part, position) numbers."""
    steps = [
        f"""k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM k),
w AS (SELECT CAST(max(len(embedding)) // {PARTS} AS BIGINT) AS n FROM k),
v AS (SELECT r, i // n AS p, i % n AS i, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u, w),
b0 AS (SELECT p, r AS e, i, x FROM v WHERE r < {ENTRIES})"""
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""f{n} AS (SELECT r, v.p, e, CAST(sum((v.x - b{n}.x) * (v.x - b{n}.x)) AS BIGINT) AS d FROM v JOIN b{n} ON v.p = b{n}.p AND v.i = b{n}.i GROUP BY r, v.p, e),
a{n} AS MATERIALIZED (SELECT r, p, e, d FROM f{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)""")
        if n < ROUNDS:
            steps.append(f"""m{n} AS (SELECT a{n}.p, e, i, CAST(floor(sum(x)::HUGEINT // count(*) - CASE WHEN sum(x)::HUGEINT % count(*) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS x
  FROM a{n} JOIN v ON a{n}.r = v.r AND a{n}.p = v.p GROUP BY a{n}.p, e, i),
b{n + 1} AS MATERIALIZED (SELECT b{n}.p, b{n}.e, b{n}.i, coalesce(m{n}.x, b{n}.x) AS x FROM b{n} LEFT JOIN m{n} ON b{n}.p = m{n}.p AND b{n}.e = m{n}.e AND b{n}.i = m{n}.i)""")
    return f"""WITH {", ".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM k JOIN c ON k.r = c.r"""


VECTORCODE_SQL = _sql()
