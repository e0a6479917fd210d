"""The pipeline's stages, each on its own input, and the whole run."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
from test_copies import check as check_copies
from test_texts import check_packing, plain_spans

import corpus_pipeline
from tallyspark.llm import decontamination, pii, toxicity

STAGES = dict(corpus_pipeline.STAGES)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_the_asked_ones_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns
    kept = set(by_id(out))
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    tested = [(d in kept, y) for d, y in labels if int(toxicity_fold(d))]
    assert sum(k != bool(y) for k, y in tested) / len(tested) > 0.9
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept == {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < 0.5}


def toxicity_fold(doc):
    import zlib

    return zlib.crc32(str(doc).encode()) % 5 == 0


def test_one_document_of_each_group_stays(spark, frame, sample, small):
    docs = frame(sample)
    out = STAGES["simhash"](spark, docs, small)
    assert out.columns == docs.columns
    check_copies(sample, [(r.doc_id, r.text) for r in out.collect()])


def test_documents_with_benchmark_passages_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = by_id(STAGES["decontamination"](spark, docs, small))
    found = {r.doc_id for r in decontamination.contaminated(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert found and set(out) == set(by_id(docs)) - found
    items = [b" ".join(decontamination.words_of(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    assert not any(i in b" ".join(decontamination.words_of(r.text)) for r in out.values() for i in items)


def test_personal_data_is_masked_and_clean_texts_are_untouched(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before, after = by_id(docs), by_id(STAGES["pii"](spark, docs, small))
    assert set(before) == set(after)
    for doc, old in before.items():
        new = after[doc]
        if plain_spans(old.text):
            assert not plain_spans(new.text) and "[" in new.text and new.n_chars == len(new.text)
        else:
            assert new == old


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, frame, sample, small, name):
    docs = frame(sample)
    out = STAGES[name](spark, docs, small)
    rows = out.collect()
    if name == "packing":
        check_packing(rows, sample)
    else:
        assert out.columns == docs.columns
        texts = Counter((i, t) for i, t in sample)
        assert name == "pii" or not Counter((r.doc_id, r.text) for r in rows) - texts
        # near-duplicates: a null text is a copy of an empty one
        assert name == "simhash" or (any(r.text is None for r in rows) and any(r.doc_id is None for r in rows))
    assert STAGES[name](spark, docs.limit(0), small).collect() == []


def test_run_applies_every_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    left = [(r.doc_id, r.text) for r in docs.collect()]
    rows = corpus_pipeline.run(spark, small).collect()
    check_packing(rows, left)
    assert not any(pii.base_spans(t) for _, t in left)


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        (tmp_path / name).write_text(open(f"{root}/{name}").read())
    (tmp_path / "tallyspark").mkdir()
    for name in os.listdir(f"{root}/tallyspark"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/tallyspark/{name}", tmp_path / "tallyspark" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
