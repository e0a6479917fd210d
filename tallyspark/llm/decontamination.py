"""Benchmark leaks in training documents: BM25 over an inverted index of test items with block-max bounds."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import prepare

K1, B = 1.2, 0.75
UNIT_WORDS = 128  # longer items are cut into units of so many words
STEPS = (64, UNIT_WORDS)  # passages are two of these long, of those the smallest that a unit fits into
SHARD_UNITS = 1024  # mean number of units in one index, so an index has a bounded size
BLOCK = 8
SCORE = 0.5  # share of an item's own score that a passage must reach
OVERLAP = 0.4  # share of the word triples of the question, and of the answer, that the passage must have
GRAM = 3
BATCH_CELLS = 4_000_000
LEAK = "array<struct<item_id:long,unit:int,score:double,question_overlap:double,answer_overlap:double,first_word:long>>"

# one byte per byte: A-Z lowered, other ASCII that is no letter or digit blank, all else kept
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _grams(words: list[bytes]) -> list[tuple[bytes, ...]]:
    n = min(GRAM, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def _share(part: list[bytes], passage: list[bytes]) -> float:
    wanted = _grams(part)
    n = len(wanted[0])
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return sum(g in there for g in wanted) / len(wanted)


@dataclass
class Index:
    """Inverted index of up to a few thousand units: postings of normalised impacts, and their maxima by block of units."""

    items: list[tuple[int, int]]
    words: list[list[bytes]]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]  # by unit: sorted term numbers
    impacts: list[np.ndarray]  # by unit: BM25 weight of each term over the unit's own score
    block_max: np.ndarray  # (terms + 1, blocks); the last row is for words outside the vocabulary
    step: int

    @classmethod
    def build(cls, units: list[tuple[int, int, list[bytes]]], frequency: dict[bytes, int], total: int, mean: float, step: int) -> Index:
        vocabulary = {t: i for i, t in enumerate(sorted({w for _, _, ws in units for w in ws}))}
        block_max = np.zeros((len(vocabulary) + 1, -(-len(units) // BLOCK)), np.float32)
        terms, impacts = [], []
        for u, (_, _, ws) in enumerate(units):
            counts = sorted((vocabulary[w], n, frequency[w]) for w, n in Counter(ws).items())
            ids = np.array([c[0] for c in counts], np.int64)
            tf, df = (np.array([c[i] for c in counts], np.float64) for i in (1, 2))
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            terms.append(ids)
            impacts.append(weight / weight.sum())
            block_max[ids, u // BLOCK] = np.maximum(block_max[ids, u // BLOCK], impacts[-1])
        return cls([(i, n) for i, n, _ in units], [ws for _, _, ws in units], vocabulary, terms, impacts, block_max, step)

    def search(self, texts: list[str]) -> list[list[dict]]:
        """Leaks of each text. Every passage (two steps of words, one step apart) is a query, so that each unit's length
        fits whole into some passage. A block of units is scored only where its bound reaches the threshold."""
        out: list[list[dict]] = [[] for _ in texts]
        get, none = self.vocabulary.get, len(self.vocabulary)
        room = max(2_000, BATCH_CELLS // max(1, self.block_max.shape[1]) // 2)
        waiting: list[tuple[int, int, np.ndarray, list[bytes]]] = []
        held = 0
        for d, text in enumerate(texts):
            words = words_of(text)
            ids = np.array([get(w, none) for w in words], np.int64)
            for at in range(0, max(1, len(words) - self.step), self.step):
                passage = ids[at : at + 2 * self.step]
                waiting.append((d, at, passage, words))
                held += len(passage)
                if held >= room:
                    self._settle(waiting, out)
                    waiting, held = [], 0
        self._settle(waiting, out)
        return out

    def _settle(self, passages: list[tuple[int, int, np.ndarray, list[bytes]]], out: list[list[dict]]) -> None:
        if not passages:
            return
        size = self.block_max.shape[0]
        sizes = np.array([len(p[2]) for p in passages])
        pairs = np.unique(np.repeat(np.arange(len(passages)), sizes) * size + np.concatenate([p[2] for p in passages]))
        pairs = pairs[pairs % size != size - 1]
        owner, term = pairs // size, pairs % size
        if not len(owner):
            return
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        ends = np.append(starts[1:], len(owner))
        bounds = np.add.reduceat(self.block_max[term], starts, axis=0)
        have = np.zeros(size, bool)
        for row, block in np.argwhere(bounds >= SCORE - 1e-4).tolist():
            d, at, ids, words = passages[owner[starts[row]]]
            here = term[starts[row] : ends[row]]
            have[here] = True
            for u in range(block * BLOCK, min((block + 1) * BLOCK, len(self.terms))):
                score = float(self.impacts[u] @ have[self.terms[u]])
                if score >= SCORE - 1e-9:
                    self._verify(d, at, u, score, words[at : at + len(ids)], out)
            have[here] = False

    def _verify(self, d: int, at: int, u: int, score: float, passage: list[bytes], out: list[list[dict]]) -> None:
        """The leading two thirds of a unit are its question, the rest is its answer; both must be there."""
        words = self.words[u]
        cut = max(1, min(len(words) - 1, -(-2 * len(words) // 3)))
        question, answer = words[:cut], words[cut:] or words[:cut]
        q, a = _share(question, passage), _share(answer, passage)
        if q < OVERLAP or a < OVERLAP:
            return
        item, unit = self.items[u]
        row = {"item_id": item, "unit": unit, "score": score, "question_overlap": q, "answer_overlap": a, "first_word": at}
        for i, old in enumerate(out[d]):
            if (old["item_id"], old["unit"]) == (item, unit):
                if (q + a, score) > (old["question_overlap"] + old["answer_overlap"], old["score"]):
                    out[d][i] = row
                return
        out[d].append(row)


def _unit_rows(batches):
    for b in batches:
        rows = []
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            words = words_of(text)
            rows += [(item, k, words[at : at + UNIT_WORDS]) for k, at in enumerate(range(0, len(words), UNIT_WORDS))]
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["item_id", "unit", "words"])


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[Index]:
    """Indexes over all items by passage length, about ``SHARD_UNITS`` units each; term statistics are those of all items together.

    Items without a word cannot leak and are left out; repeated items are indexed once.
    """
    prepare(benchmark.sparkSession)
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    units = items.mapInArrow(_unit_rows, "item_id long, unit int, words array<binary>").distinct()
    total, mean = units.agg(F.count("*"), F.avg(F.size("words"))).first()
    if not total:
        return []
    step = F.lit(STEPS[-1])
    for s in reversed(STEPS[:-1]):
        step = F.when(F.size("words") <= s, s).otherwise(step)
    units = units.withColumn("_step", step)
    sizes = {r["_step"]: -(-r["count"] // SHARD_UNITS) for r in units.groupBy("_step").count().collect()}
    out = []
    for step, n in sorted(sizes.items()):
        own = units.where(F.col("_step") == step).withColumn("_shard", F.pmod(F.xxhash64("item_id", "unit"), F.lit(n)))
        for s in range(n):
            rows = own.where(F.col("_shard") == s).orderBy("item_id", "unit", "words").collect()
            here = own.where(F.col("_shard") == s).select(F.explode("words").alias("w")).distinct()
            single = units.select(F.explode(F.array_distinct("words")).alias("w"))
            df = {bytes(r["w"]): r["df"] for r in single.join(here, "w", "left_semi").groupBy("w").agg(F.count("*").alias("df")).collect()}
            out.append(Index.build([(r["item_id"], r["unit"], [bytes(w) for w in r["words"]]) for r in rows], df, total, mean, step))
    return out


def _search_udf(sent):
    kind = pa.list_(
        pa.struct(
            [("item_id", pa.int64()), ("unit", pa.int32()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]
        )
    )

    @F.arrow_udf(LEAK)
    def search(texts: pa.Array) -> pa.Array:
        return pa.array(sent.value.search(texts.to_pylist()), kind)

    return search


def leaks(spark: SparkSession, text: Column, indexes: list[Index]) -> Column:
    """Array of the leaks in ``text``, empty if there are none."""
    found = [_search_udf(spark.sparkContext.broadcast(index))(F.coalesce(text, F.lit(""))) for index in indexes]
    return F.concat(*found) if found else F.expr(f"cast(array() as {LEAK})")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, unit, score, question_overlap, answer_overlap, first_word)`` for each item found in a document.

    ``score`` is the BM25 score of the best passage over the item's own score, ``first_word`` where that passage starts.
    Null and empty texts leak nothing; documents with null or repeated ids give rows like any other; empty tables give none.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaks(spark, F.col(f"`{text_col}`"), shards(benchmark)).alias("leak"))
    return rows.select("doc_id", F.explode("leak").alias("leak")).select("doc_id", "leak.*")


def decontamination_query(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
