"""The pipeline's near-dedup stage against all pairs of texts, without the operator's own candidates."""

import corpus_pipeline
from test_near_copies import brute, corpus


def test_stage_keeps_and_drops_what_all_pairs_say(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    near = spark.createDataFrame([(10_000_000 + i, t) for i, t in corpus().items()], "doc_id long, text string")
    docs = corpus_pipeline.drop_copies(spark, docs.unionByName(near, allowMissingColumns=True), data).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    root, alone = brute(texts, 0.8)
    dropped = set(texts) - {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, data).collect()}
    due = {i for i, r in root.items() if i != r}
    assert len(due) > 40 and len(dropped & due) >= 0.99 * len(due)
    assert not dropped & alone and len(dropped - due) <= 0.01 * len(due)
