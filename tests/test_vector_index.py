"""The vector index: recall, cells read, the exact search, zeros, odd rows and batches in blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.operators import search, vector_index
from loamgraph.operators.vector_index import VectorIndex
from loamgraph.plans import search_queries


def brute(x, q, k):
    d = 1 - vector_index.units(q) @ vector_index.units(x).T
    return [np.lexsort((np.arange(len(x)), row))[:k].tolist() for row in d]


def test_recall_with_a_quarter_of_the_cells(spark, tmp_path):
    """All vectors with an id divisible by 100, against all; no more than a quarter of the folders is wanted by a query."""
    data = "/root/testdata/sf0.01"
    v = search_queries.vectors(spark, data)
    index, asked = VectorIndex.build(v, str(tmp_path)), search_queries.asked(spark, data)
    assert index.table("vectors").count() == v.count() and index.table("codes").count() == 3 * v.count()
    got = {(r["qid"], r["id"]) for r in index.search(asked, 10, probes=index.cells // 4).collect()}
    want = {(q["qid"], r["id"]) for q in asked.collect() for r in search.knn(v, list(q["vector"]), 10).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_exact_search_is_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 7)  # several blocks
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 5)) for c in rng.normal(0, 3, (6, 5))])
    x[50] = x[10]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [1.0]), (1002, [float("nan")] * 5)]
    index = VectorIndex.build(spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path), cells=12, copies=1)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 360, 20)] + [(1, [0.0])], "qid long, vector array<double>")
    got = {}
    for r in index.search_exact(queries, 5).orderBy("rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    asked = list(range(0, 360, 20))
    assert got == dict(zip(asked, brute(x, x[asked], 5), strict=True))
    seen = []
    plain = VectorIndex._candidates
    monkeypatch.setattr(VectorIndex, "_candidates", lambda self, name, ids, q, wanted, keep: seen.append(wanted.mean()) or plain(self, name, ids, q, wanted, keep))
    index.search_exact(queries, 5).collect()
    assert max(seen) < 0.6  # most cells of clustered vectors are left out


def test_zeros_strings_and_nothing(spark, tmp_path):
    rows = [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 2.0])]
    frame = spark.createDataFrame(rows, "id string, embedding array<float>")
    index = VectorIndex.build(frame, str(tmp_path / "i"), cells=2)
    queries = spark.createDataFrame([("q", [3.0, 0.1])], "qid string, vector array<double>")
    for found in (index.search(queries, 2, probes=2), index.search_exact(queries, 2)):
        assert [r["id"] for r in found.orderBy("rank").collect()] == ["a", "b"]
    assert index.search(queries.limit(0), 2).collect() == [] == index.search_exact(queries.limit(0), 2).collect()
    none = VectorIndex.build(frame.limit(0), str(tmp_path / "n"))
    assert none.cells == 1 and none.search_exact(queries.withColumn("vector", F.array_repeat(F.lit(1.0), 16)), 2).collect() == []
    with pytest.raises(Exception, match="model"):
        VectorIndex(spark, str(tmp_path / "missing"))
