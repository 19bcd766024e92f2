"""The pipeline over the smallest tables: each stage against what it promises."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).persist()
        out[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    assert out["line_dedup"].count() == out["toxicity"].count()
    assert out["line_dedup"].filter(F.col("n_chars") != F.char_length("text")).count() == 0
    near = out["simhash_dedup"]
    assert near.select("doc_id").distinct().count() == near.count() <= out["line_dedup"].count()
    mixed = out["source_mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mixed <= 3
    packed = out["best_fit_pack"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.filter("n <> end or n > 2048").count() == 0
    assert out["best_fit_pack"].select("doc_id").distinct().count() == out["source_mix"].select("doc_id").distinct().count()
