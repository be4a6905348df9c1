"""Requests at size: they write what they look into, and nothing beside it."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_engine import snapshot_frames
from test_star import held

from loamgraph.functions import embedding
from loamgraph.functions.ids import node_id_of
from loamgraph.operators import search, snapshot
from loamgraph.operators.ingest import GraphData, Progress, graph_views, nearest, records
from loamgraph.schema import REGISTRY
from loamgraph.service import Engine


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "lake"), embed=embedding.hashing_embedding(16))


def documents(spark, kind, rows):
    """(number, embedding, embedding id)"""
    spec = REGISTRY.entity(kind)
    number = "issue_number" if kind == "issuedoc" else "pr_number"
    return GraphData().add(spec, records(spark, spec, [{"project_url": "u", number: n, "text": f"text {n}", "embedding": v, "embedding_id": e, "chunk_order": 0} for n, v, e in rows]))


def test_search_by_vectors_makes_no_text_index(engine, spark, tmp_path):
    engine.sync.process(documents(spark, "issuedoc", [(n, [float(n % 3), 1.0, *[0.0] * 14], f"e{n}") for n in range(9)]))
    assert len(engine.hybrid_all("text", "issuedoc,prdoc", 0.5, 4).collect()) == 4
    assert not os.path.exists(tmp_path / "lake" / "gold")


@pytest.mark.parametrize("best", [1, 5, 12, 40])
def test_nearest_are_those_of_all_rows(engine, spark, best):
    """With many ties, ids of the index's own, rows that the index has lost and vectors of another size."""
    rng = random.Random(5)
    spec, index = REGISTRY.entity("issuedoc"), engine.lake.table(REGISTRY.entity("issuedoc").index_table, ["embedding_id"])
    index.write(spark.createDataFrame([(f"e{n}", node_id_of("own", n=n)) for n in range(0, 60, 4)], "embedding_id string, vector_uuid string").withColumn("updated_at", F.current_timestamp()))
    for kind in ("issuedoc", "prdoc"):
        rows = [(n, [float(rng.randrange(3)), 1.0] if n % 7 else [1.0], f"e{n - n % 10 if n % 6 == 5 else n}") for n in range(60)]
        engine.sync.process(documents(spark, kind, rows))
    index.delete(F.col("embedding_id").isin([f"e{n}" for n in range(1, 60, 3)]))
    query = [0.0, 1.0]
    vectors = graph_views(engine.lake)[2].filter(F.size("embedding") == 2)
    held = vectors.select("id", "label", search.similarity(F.col("embedding"), query).alias("similarity"), "text").collect()
    near, rows = nearest(engine.lake, [spec, REGISTRY.entity("prdoc"), REGISTRY.entity("codechunk")], query, best)
    for kind in ("issuedoc", "prdoc"):
        want = sorted(((-r["similarity"], r["id"]) for r in held if r["label"] == kind))[:best]
        assert sorted((-r["similarity"], r["id"]) for r in near.filter(F.col("label") == kind).collect()) == want
        ids = {i for _, i in want}
        assert {(r["id"], r["text"]) for r in rows.collect() if r["label"] == kind and r["id"] in ids} == {(r["id"], r["text"]) for r in held if r["label"] == kind and r["id"] in ids}


def test_text_searches_need_no_index(engine, spark, tmp_path):
    """The answers of a pass over the texts are those of the index, also where rows share an id, have none, or share a key."""
    rng, spec = random.Random(6), REGISTRY.entity("project")
    words = "alpha beta gamma delta Épsilon zeta7".split()
    names = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(60)]
    engine.sync.process(GraphData().add(spec, records(spark, spec, [{"url": f"u{n % 50}", "name": x, "stars": n} for n, x in enumerate(names)])))
    engine.sync.process(GraphData().add(REGISTRY.entity("label"), records(spark, REGISTRY.entity("label"), [{"project_url": "alpha", "name": x} for x in words])))
    asked = [("project", "alpha", 5), ("project", "Beta zeta7 nothing", 80), ("label", "alpha", 3), ("project", "none", 4), ("project", " . ", 4)]
    answers = lambda: [[(r["id"], r["label"], round(r["score"], 9)) for r in engine.bm25(*a).collect()] for a in asked]
    mixed = lambda: [(r["id"], round(r["score"], 9)) for r in engine.hybrid_all("alpha delta", "project,issuedoc", 0.5, 6).collect()]
    before, scanned, both = held(spark), answers(), mixed()
    assert not os.path.exists(tmp_path / "lake" / "gold") and held(spark) - before < 1000
    index = engine.text_index()
    assert index.documents == 56 and (answers(), mixed()) == (scanned, both) and [len(a) > 0 for a in scanned] == [True, True, True, False, False]


def test_a_scan_counts_each_id_once(spark):
    docs = [("a", "x", "one two two"), ("a", "y", "two"), ("b", "x", "one"), (None, "x", "one one"), ("c", "x", None), ("d", "x", "three")]
    with search.scan(spark.createDataFrame(docs, "id string, label string, text string"), "one TWO") as found:
        assert (found.documents, found.average) == (4, 3 / 4)
        assert sorted(map(tuple, found.postings.collect())) == [("one", "b", "x", 1, 1), ("two", "a", "y", 1, 1)]


def tables_of(e):
    out = {}
    for name, _ in e.tables():
        rows = e.show(name, 0)
        kept = [c for c in rows.columns if c not in ("created_at", "updated_at")]
        out[name] = sorted(map(str, rows.select(*kept).collect()))
    return out


def test_batches_in_parts_are_the_batches(spark, tmp_path):
    def graph():
        repos, people, issues, pulls, readme = snapshot_frames(spark)
        return snapshot.snapshot_graph(repos, people, issues, pulls, readme, snapshot.Options(embed=embedding.hashing_embedding(16)))

    whole, parts = (Engine(spark, str(tmp_path / n), buckets=2) for n in ("whole", "parts"))
    whole.sync.process(graph())
    batches, progress = graph(), Progress()
    for kinds in (("silver/vectors/issuedoc", "silver/index_vector/issuedoc"), ("silver/edges/documents",), ("silver/index/label",)):
        parts.sync.process(batches, set(kinds), progress)
        assert all(parts.lake.table(k).exists() for k in kinds)
    assert {n for n, _ in parts.tables()} == {"silver/vectors/issuedoc", "silver/index_vector/issuedoc", "silver/vectors/prdoc", "silver/edges/documents", "silver/entities/label", "silver/index/label"}
    parts.sync.process(batches, None, progress)
    assert tables_of(parts) == tables_of(whole)
    versions = {n: parts.lake.table(n).version() for n, _ in parts.tables()}
    parts.sync.process(batches, None, progress)
    assert versions == {n: parts.lake.table(n).version() for n, _ in parts.tables()}
