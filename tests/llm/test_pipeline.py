"""The pipeline's stages in turn: that each does what its operator says to all rows, and to odd ones."""

from __future__ import annotations

import collections

import corpus_pipeline
import pytest
from barspark.llm import minhash, repetition, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = {r.doc_id: r.text for r in docs.collect()}

    docs = corpus_pipeline.quality_rules(spark, docs, FOLDER).cache()
    kept = {r.doc_id for r in repetition.quality(spark.read.parquet(f"{FOLDER}/documents.parquet")).filter("kept").collect()}
    after = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and set(after) == kept and all(after[i] == before[i] for i in after)

    docs = corpus_pipeline.near_duplicates(spark, docs, FOLDER).cache()
    assert docs.columns == columns and minhash.link(docs).filter("NOT kept").count() == 0

    docs = corpus_pipeline.secret_scan(spark, docs, FOLDER).cache()
    assert docs.columns == columns and secrets.find_secrets(docs).filter("exists(spans, s -> s.kind IN ('access', 'hex'))").count() == 0
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    ids = {r.doc_id for r in docs.collect()}

    docs = corpus_pipeline.source_mixing(spark, docs, FOLDER).cache()
    times = collections.Counter(r.doc_id for r in docs.collect())
    assert docs.columns == columns and set(times) == ids and max(times.values()) <= 2

    coded = corpus_pipeline.byte_bpe(spark, docs, FOLDER).collect()
    assert collections.Counter(r.doc_id for r in coded) == times and all(r.n_tokens == len(r.ids) for r in coded)
    assert len(names) == 5


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() > 0 and got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


@pytest.mark.parametrize("name", ["documents"])
def test_empty_documents(spark, tmp_path, name):
    spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_tables(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, clashing columns, no n_chars."""
    good = "The quick brown fox number {} jumps over a lazy dog while seven other animals watch it from far away and say nothing {}."
    texts = [good.format(k, k * 7) for k in range(30)]
    long = " ".join(f"w{k % 9973}x{k}" for k in range(60_000))
    rows = [(k, t, "a" if k % 3 else None, None, 7, "kept") for k, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, 7, "kept")] * 2 + [(None, good.format("none", "id"), "b", None, None, None), (None, None, None, None, None, None), (50, "", "a", None, 1, None), (51, None, "a", None, 1, None), (52, long, "b", None, 1, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, epoch int, place string")
    columns = docs.columns

    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER).cache()
    assert kept.columns == columns and kept.filter("text IS NULL OR text = ''").count() == 0 and kept.filter("doc_id = 3").count() == 3
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.secret_scan, corpus_pipeline.source_mixing):
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == columns
        if stage is not corpus_pipeline.near_duplicates:  # every row is there
            assert collections.Counter(map(tuple, out.collect())).keys() == collections.Counter(map(tuple, docs.collect())).keys()
        assert out.filter("doc_id = 52").first().text == long and out.filter("doc_id IS NULL AND text IS NULL").count() >= 1
    mixed = corpus_pipeline.source_mixing(spark, docs, FOLDER)
    assert mixed.filter("epoch = 7 AND place = 'kept'").count() >= 30
    coded = corpus_pipeline.byte_bpe(spark, docs, FOLDER).collect()
    assert len(coded) == len(rows) and {r.n_tokens for r in coded if r.doc_id in (50, 51)} == {0}


def test_stages_keep_an_empty_table_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long, block string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
