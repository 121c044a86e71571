"""The pipeline's stages on the smallest tables, each against its operator's plain meaning."""

import os

import pytest

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        step(spark, docs, SF).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append(docs.count())
    assert seen[1] == seen[2] and seen == sorted(seen, reverse=True) and seen[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == seen[-1] and last.where("n_tokens < 2").count() == 0
    assert corpus_pipeline.ORACLE_SQL is None
