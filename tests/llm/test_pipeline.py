"""The stages in a row, over the smallest tables."""

import corpus_pipeline
from lodestar.llm import store


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.table(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert counts[1] >= counts[2] >= counts[3] > 0 and counts[4] > 0
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
