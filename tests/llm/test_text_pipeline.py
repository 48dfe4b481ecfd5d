"""The pipeline's stages on the smallest table."""

import os

import pytest

import corpus_pipeline
from tallyline.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_keep_columns(spark):
    docs = start = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == start.columns
        if i == 1:
            assert docs.count() < start.count()
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert docs.count() > 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.registered()) == list(range(1, 14))
    assert set(oracle.statements()) <= set(queries.registered())
