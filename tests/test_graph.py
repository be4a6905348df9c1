"""Graph operators on a small graph, against plain Python."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from loamgraph.functions.ids import edge_id_of, node_id_of
from loamgraph.operators import graph, lookup
from loamgraph.operators.graph import InvalidArgument

NAMES = ["root", "child", "leaf", "lone", "loop"]
ID = {n: node_id_of("function", name=n) for n in NAMES}
GONE = node_id_of("function", name="gone")
PAIRS = [("root", "child", "calls"), ("child", "leaf", "calls"), ("leaf", "root", "calls"), ("loop", "loop", "calls"), ("root", "leaf", "uses")]


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(ID[n], "function", f'{{"name":"function::{n}"}}') for n in NAMES], "id string, label string, properties string")
    rows = [(edge_id_of(f"edge_{k}", ID[a], ID[b]), f"edge_{k}", ID[a], ID[b]) for a, b, k in PAIRS]
    rows.append(("dangling", "edge_calls", ID["root"], GONE))
    edges = spark.createDataFrame(
        [(*r, "function", "function") for r in rows],
        "id string, label string, from_node_id string, to_node_id string, from_node_type string, to_node_type string",
    )
    return nodes.cache(), edges.cache(), rows


def twin(rows, start, depth, types=None):
    """Breadth first by the book."""
    if start not in ID.values():
        return {}, set()
    level, used, queue = {start: 0}, set(), deque([start])
    while queue:
        n = queue.popleft()
        if level[n] >= depth:
            continue
        for e, label, a, b in rows:
            if a == n and b in ID.values() and (not types or label in types):
                used.add(e)
                if b not in level:
                    level[b] = level[n] + 1
                    queue.append(b)
    return level, used


@pytest.mark.parametrize(
    ("start", "depth", "types"),
    [("root", 0, None), ("root", 1, None), ("root", 2, None), ("root", 5, None), ("root", 3, ["calls"]), ("loop", 2, None), ("lone", 2, None)],
)
def test_bfs(small, start, depth, types):
    nodes, edges, rows = small
    got = graph.subgraph_bfs(edges, nodes, ID[start], types, depth)
    level, used = twin(rows, ID[start], depth, types and [f"edge_{t}" for t in types])
    assert {r["id"]: r["level"] for r in got.nodes.collect()} == level
    assert {r["id"] for r in got.edges.collect()} == used


def test_bfs_caps_and_errors(small):
    nodes, edges, _ = small
    got = graph.subgraph_bfs(edges, nodes, ID["root"], None, 3, 2, 1)
    assert got.nodes.count() <= 2 and got.edges.count() <= 1
    assert graph.subgraph_bfs(edges, nodes, ID["root"], None, 3, 1, 0).nodes.count() == 1
    assert graph.subgraph_bfs(edges, nodes, ID["root"], None, 3, 2, 0).nodes.count() == 2
    assert graph.subgraph_bfs(edges, nodes, GONE, None, 2).nodes.count() == 0
    with pytest.raises(InvalidArgument):
        graph.subgraph_bfs(edges, nodes, "no", None, 1)


def test_neighbours(small):
    nodes, edges, _ = small
    ask = lambda *a, **k: [(r["orientation"], r["node_id"]) for r in graph.neighbours(edges, nodes, *a, **k).collect()]
    assert sorted(ask(ID["loop"])) == [("incoming", ID["loop"]), ("outgoing", ID["loop"])]
    assert len(ask(ID["root"])) == 4 and ("outgoing", GONE) in ask(ID["root"])
    assert len(ask(ID["child"], limit=1)) == 1 and ask(ID["child"], limit=1)[0][0] == "outgoing"
    assert ask(ID["root"], types=["USES"], direction="outgoing") == [("outgoing", ID["leaf"])]
    assert ask(ID["lone"]) == []
    with pytest.raises(InvalidArgument):
        graph.neighbours(edges, nodes, ID["root"], direction="sideways")


def test_paths(small):
    nodes, edges, _ = small
    assert graph.shortest_path(edges, nodes, ID["root"], ID["leaf"])["length"] == 1
    path = graph.shortest_path(edges, nodes, ID["root"], ID["leaf"], "calls")
    assert path["nodes"] == [ID["root"], ID["child"], ID["leaf"]] and path["length"] == 2 and len(path["edges"]) == 2
    assert graph.shortest_path(edges, nodes, ID["root"], ID["lone"]) is None
    assert graph.shortest_path(edges, nodes, ID["root"], GONE) is None
    assert graph.shortest_path(edges, nodes, ID["root"], ID["root"])["length"] == 0
    with pytest.raises(InvalidArgument):
        graph.shortest_path(edges, nodes, "x", ID["leaf"])


def test_traversal_and_statistics(small):
    nodes, edges, _ = small
    t = graph.Traversal(nodes, edges)
    assert {r["id"] for r in t.from_ids(ID["root"]).out("calls").out("calls").ids().collect()} == {ID["leaf"]}
    assert {r["id"] for r in t.from_ids(ID["leaf"]).into().ids().collect()} == {ID["child"], ID["root"]}
    assert t.from_ids(ID["root"]).out_edges("uses").count() == 1
    assert graph.graph_counts(nodes, edges).first().asDict() == {"num_nodes": 5, "num_edges": 6, "num_vectors": 0}
    assert {r["id"]: r["component"] for r in graph.connected_components(nodes, edges.filter("id <> 'dangling'")).collect()} == {
        **dict.fromkeys([ID["root"], ID["child"], ID["leaf"]], min(ID["root"], ID["child"], ID["leaf"])), ID["lone"]: ID["lone"], ID["loop"]: ID["loop"]
    }
    tri = {r["node_id"]: r["triangles"] for r in graph.triangles(edges.filter("id <> 'dangling'")).collect()}
    assert tri == {ID["root"]: 1, ID["child"]: 1, ID["leaf"]: 1}
    assert abs(graph.page_rank(nodes, edges.filter("id <> 'dangling'"), 20).agg(F.sum("rank")).first()[0] - 1) < 1e-6


def test_lookup(small):
    nodes, _, _ = small
    assert lookup.node_by_id(nodes, None, ID["leaf"]).first()["label"] == "function"
    assert lookup.node_by_id(nodes, None, GONE).first() is None
    vectors = nodes.limit(1).select(F.lit("v").alias("id"), F.lit(None).cast("string").alias("label"), "properties")
    assert lookup.node_by_id(nodes, vectors, "v").first()["label"] == "VECTOR"
    names = [r["display_name"] for r in lookup.node_view(nodes).collect()]
    assert sorted(names) == sorted(f"function::{n}" for n in NAMES)


def test_index_search(spark):
    rows = spark.createDataFrame([("1", "Alpha_x", 1), ("2", "alphaQx", 2), ("3", None, 3)], "id string, name string, updated_at int")
    ask = lambda q, n=9, **k: [r["id"] for r in lookup.index_search(rows, q, n, **k).collect()]
    assert ask(" ALPHA ") == ["2", "1"] and ask("a_x") == ["1"] and ask("a_x", raw=True) == ["2", "1"]
    assert ask("") == [] and ask("alpha", 0) == [] and ask("3") == ["3"] and ask("alpha", 1) == ["2"]


def test_filters_and_parsers(spark):
    rows = spark.createDataFrame([("a", 1, True), ("b", 2, None)], "s string, n int, f boolean")
    count = lambda f: lookup.filtered_scan(rows, f).count()
    assert count([("s", "a"), ("n", "1")]) == 1 and count([("n", "x")]) == 0 and count([("f", "true")]) == 1 and count([("f", None)]) == 1 and count([]) == 2
    assert lookup.parse_edge_types(" a, b;c\td ") == ["a", "b", "c", "d"] and lookup.parse_edge_types("") == []
    assert lookup.parse_list(" a ,, b ") == ["a", "b"] and lookup.parse_key_value("a=b=c") == ("a", "b=c")
    for bad in ("=x", "x"):
        with pytest.raises(InvalidArgument):
            lookup.parse_key_value(bad)


def test_pairs_contracted_in_place():
    """Against a union-find, pair by pair."""
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        u, v = (rng.integers(0, 30, 40) for _ in range(2))
        u, v = u[u != v], v[u != v]
        parent = {int(x): int(x) for x in (*u, *v)}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        got = sorted(zip(*(x.tolist() for x in graph.stars(u, v)), strict=True))
        assert got == sorted((x, root(x)) for x in parent if root(x) != x)
