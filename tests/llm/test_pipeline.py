from __future__ import annotations

import corpus_pipeline
from fieldframe.llm.common import Scratch


def test_stages(spark, sf):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf), name)
        assert docs.columns == cols
        left = docs.select("doc_id").distinct().count()
        assert 0 < left <= n
        n = left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == n


def test_odd_documents(spark, odd, sf):
    docs = odd
    scratch = Scratch(spark, "odd")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, sf), name)
    assert docs.count() > 0


def test_empty_documents(spark, empty, sf):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
