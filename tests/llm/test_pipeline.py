"""The pipeline against a plain walk through its rules, and the registered SQL of this part."""

import corpus_pipeline
import pytest
from oracle import connection, rows
from test_near_copies import brute

from loamgraph.llm import queries as registered


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql(spark, data, name):
    got, want = registered.QUERIES[name](spark, data).toPandas(), connection(data).sql(registered.ORACLES[name]).to_df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def check_packed(frame, docs):
    """Every word of every document once; bins within their size, without two documents of a source; each shard as a plain search for the tightest bin packs it."""
    size, held = registered.SEQUENCE_TOKENS, docs.set_index("doc_id")
    words = held.text.fillna("").map(lambda t: max(1, len(t.split())))
    spans = frame.sort_values(["doc_id", "start"]).groupby("doc_id")
    for i, own in spans:
        ends = (own.start + own.n_tokens).tolist()
        assert own.start.tolist() == [0, *ends[:-1]] and ends[-1] == words[i]
    assert (frame.groupby("bin_id").n_tokens.sum() <= size).all()
    known = frame.assign(source=frame.doc_id.map(held.source), shard=frame.bin_id.str.split("-").str[0])
    assert not known[known.source.notna()].duplicated(["bin_id", "source"]).any()
    for _, own in known.groupby("shard"):
        order = own[own.n_tokens < size].sort_values(["doc_id"], kind="stable").sort_values("n_tokens", ascending=False, kind="stable")
        bins = []
        for n, source in zip(order.n_tokens, order.source, strict=True):
            fits = [(size - sum(x for x, _ in b) - n, k) for k, b in enumerate(bins) if sum(x for x, _ in b) + n <= size and source not in [s for _, s in b]]
            if fits:
                bins[min(fits)[1]].append((n, source))
            else:
                bins.append([(n, source)])
        rest = own[own.n_tokens < size].groupby("bin_id").n_tokens.sum()
        assert sorted(sum(n for n, _ in b) for b in bins) == sorted(rest)


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before, held = docs.toPandas(), [len(docs.toPandas())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        frame = out.toPandas()
        if k < 4:
            assert out.columns == before.columns.tolist() and set(frame.doc_id) <= set(before.doc_id)
        if k == 1:
            norm = before.text.fillna("").str.split().str.join(" ")
            first = before.doc_id.groupby(norm.values).min()
            assert sorted(frame.doc_id) == sorted(first)
        if k == 2:
            root, _ = brute(dict(zip(before.doc_id, before.text, strict=True)), corpus_pipeline.NEAR)
            assert sorted(frame.doc_id) == sorted(i for i, r in root.items() if i == r)
        if k == 4:
            assert set(frame.doc_id) == set(before.doc_id)
            check_packed(frame, before)
        docs, before = out, frame
        held.append(len(frame))
    assert sum(a > b for a, b in zip(held, held[1:4], strict=False)) >= 2
    assert corpus_pipeline.run(spark, data).count() == held[-1]
