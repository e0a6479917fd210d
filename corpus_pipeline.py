"""Corpus pipeline: toxic documents go, near-duplicates keep one, benchmark leaks go, personal data is masked, the rest is packed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common, copies, decontamination, packing, pii, simhash, toxicity


def _unused(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a model that learns from the labelled documents of ``docs``. Null texts are empty."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(spark, F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest id, then the first by
    text hash; repeated rows are one.

    Texts whose SimHash fingerprints differ in 3 or fewer bits, as in ``op3_simhash``, are held against each other first;
    shared rare shingles find the copies that lie further apart. Both are verified and chained."""
    key, tie = _unused("_key", docs), _unused("_tie", docs)
    least = F.lit(-(1 << 63))
    heads = copies.representatives(docs, candidates=simhash.text_links(docs)).select(F.coalesce("doc_id", least).alias(key), F.col("tie").alias(tie))
    rows = docs.withColumns({key: F.coalesce(F.col("doc_id"), least), tie: F.xxhash64(common.utf8("text"))})
    return rows.join(heads.hint("merge"), [key, tie], "left_semi").dropDuplicates([key, tie]).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    common.prepare(spark)
    indexes = decontamination.shards(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.where(F.size(decontamination.leaks(spark, F.col("text"), indexes)) == 0)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text where that changed it."""
    field = pii.train(docs)
    masked = pii.redacted(spark, F.col("text"), field)
    name = _unused("_masked", docs)
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    n_chars = F.when(changed, F.length(name).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": F.col(name).alias("text"), "n_chars": n_chars.alias("n_chars")}
    return docs.withColumn(name, masked).select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # SQL expresses none of the stages; tests/llm holds each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared checkpoint folder and read again."""
    folder = f"{common.prepare(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
