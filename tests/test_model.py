"""Identifiers, schema, store, catalog."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.functions import ids
from loamgraph.schema import REGISTRY, Category, Registry, canonical_edge, canonical_entity, parse_columns
from loamgraph.sources.catalog import Catalog
from loamgraph.sources.store import Conflict, Lake, VersionedTable, last_wins


def test_uuid5_is_the_standard_one(spark):
    names = ["", "project|url=https://x/y", "é|k=ü", "a" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", ids.uuid5(F.col("n")).alias("o"), ids.uuid5(F.col("n"), ids.NAMESPACE_URL).alias("u"),
    ).collect()
    for r in got:
        assert r["o"] == str(uuid.uuid5(uuid.NAMESPACE_OID, r["n"]))
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"]))


def test_ids_of_driver_and_columns_agree(spark):
    row = spark.range(1).select(
        ids.node_id(
            "issue", [("project_url", F.lit("u")), ("number", F.lit(7))],
        ).alias("n"), ids.edge_id("edge_x", F.lit("a"), F.lit("b")).alias("e"), ids.node_id("issue", [("project_url", F.lit(None).cast("string"))]).alias("none")
    ).first()
    assert row["n"] == ids.node_id_of("issue", project_url="u", number=7)
    assert row["e"] == ids.edge_id_of("edge_x", "a", "b")
    assert row["none"] is None


def test_declared_types():
    assert [len(REGISTRY.entities(c)) for c in (Category.NODE, Category.VECTOR, Category.EDGE)] == [16, 4, 27]
    assert sum(len(s.endpoints) for s in REGISTRY.entities(Category.EDGE)) == 41
    assert REGISTRY.entity("PULL_REQUEST").keys == ("project_url", "number")
    assert REGISTRY.edge("HAS_VERSION") is REGISTRY.edge("edge_hasversion") is REGISTRY.edge("hasversion")
    assert REGISTRY.entity("readmechunk").schema["embedding"].dataType == T.ArrayType(T.FloatType())
    assert len(REGISTRY.entity("developer").schema) == 11 and len(REGISTRY.edge("calls").schema) == 7
    assert REGISTRY.vector_index("codechunk") == "silver/index_vector/codechunk" and REGISTRY.vector_index("file") is None
    assert Registry.declared(extra_edges=True).edge("TESTS_FUNCTION").entity_type == "edge_tests_function"
    assert canonical_entity("PullRequest") == "pullrequest" and canonical_edge("X_Y") == "edge_xy"
    assert Category.parse("Node") is Category.NODE
    with pytest.raises(ValueError):
        Category.parse("NODE")


def test_types_of_columns():
    schema, keys = parse_columns("a* u64, b [f32], c u8, d time")
    assert keys == ("a",) and [f.dataType.simpleString() for f in schema] == ["decimal(20,0)", "array<float>", "smallint", "timestamp"]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


@pytest.mark.parametrize("buckets", [1, 4])
def test_store_life(spark, folder, buckets):
    t = VersionedTable(spark, f"{folder}/t", ["id"], buckets)
    assert not t.exists() and t.version() == -1 and t.read(schema=T.StructType([T.StructField("id", T.StringType())])).count() == 0
    frame = lambda *rows: spark.createDataFrame(rows, "id string, v string")
    assert t.write(frame(), nothing=True) == -1
    assert t.write(frame(("1", "alpha"), ("1", "again"), (None, "n"))) == 0  # a first write keeps all its rows
    assert t.write(frame(("1", "beta"), (None, "m"))) == 1
    assert sorted(r["v"] for r in t.read().collect()) == ["beta", "m", "n"]
    assert sorted(r["v"] for r in t.read(0).collect()) == ["again", "alpha", "n"]
    assert [v for v, _ in t.changes_since(-1)] == [0, 1] and [v for v, _ in t.changes_since(0)] == [1] and t.changes_since(1) == []
    t.delete(F.col("v") == "beta")
    assert sorted(r["v"] for r in t.read().collect()) == ["m", "n"]
    with pytest.raises(Conflict):
        t._commit(1, [], [], t.live()[1])


def test_upsert_rewrites_only_its_buckets(spark, folder):
    t = VersionedTable(spark, f"{folder}/t", ["id"], 8, merge=False)
    t.write(spark.range(200).select(F.col("id"), F.lit("a").alias("v")))
    t.write(spark.createDataFrame([(3, "b")], "id long, v string"))
    assert len(t.entry(1)["remove"]) == 1 and t.read().count() == 200
    assert [(r["id"], r["_change"]) for r in t.net_changes(0).collect()] == [(3, "update")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99)), min_size=1, max_size=6, unique_by=lambda x: x[0]), min_size=1, max_size=3))
def test_upserts_are_a_dictionary(spark, tmp_path_factory, batches):
    t = VersionedTable(spark, str(tmp_path_factory.mktemp("t")) + "/x", ["k"], 2)
    want: dict[int, int] = {}
    for b in batches:
        t.write(spark.createDataFrame(b, "k int, v int"))
        t.write(spark.createDataFrame(b, "k int, v int"))  # again: nothing changes
        want |= dict(b)
    assert {r["k"]: r["v"] for r in t.read().collect()} == want


def test_lake_lists_tables(spark, folder):
    lake = Lake(spark, folder)
    lake.table("silver/edges/calls", ["id"]).write(spark.createDataFrame([("1", 2)], "id string, b int"))
    lake.table("silver/entities/file").write(spark.createDataFrame([("1",)], "a string"))
    assert [n for n, _ in lake.list_tables()] == ["silver/edges/calls", "silver/entities/file"]
    assert lake.list_tables("silver/edges")[0][1] == [("b", "int", True), ("id", "string", True)]
    assert lake.types_below("silver/edges") == ["calls"] and lake.open("nothing") is None and lake.types_below("no") == []


def test_last_wins_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "k string, v int")
    assert sorted(r["v"] for r in last_wins(rows, ["k"], [F.col("v")]).collect()) == [2, 3, 4]


def test_catalog(spark):
    c = Catalog()
    assert c.offset("t") == -1
    c.ensure_offset("t", "file", "node", ["a"])
    c.set_offset("t", 3)
    c.ensure_offset("t", "file", "node", ["a"])
    assert c.offset("t") == 3
    c.set_readiness("u", "project", 10, {"x": 1}, now=5)
    c.set_anchor("u", "f", "k", "v1")
    c.set_anchor("u", "f", "k", "v2")
    c.set_budget("e", 7, 9)
    task = c.start_task("sync")
    c.end_task(task, "SUCCESS")
    assert c.anchor("u", "f", "k") == "v2" and c.budget("e")["requests_left"] == 7 and c.readiness("u")["ttl_seconds"] == 10
    assert c.rows("task_logs")[0]["status"] == "SUCCESS"
    assert c.frame(spark, "ingestion_offsets").first()["last_version"] == 3 and c.frame(spark, "source_anchors").count() == 1
