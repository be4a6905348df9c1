"""The star graph is searched by its tables' keys; nothing of its size is written."""

import os

import numpy as np
import pytest

from loamgraph.operators import graph
from loamgraph.plans import load
from loamgraph.session import keep, shared_dir


def held(spark) -> int:
    root = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(root) for f in names)


@pytest.mark.parametrize("name", ["neighbors_out", "neighbors_both", "endpoint_filter_hop", "two_hop_exists"])
def test_searches_write_no_copy_of_the_graph(spark, data, tmp_path, name):
    folder = tmp_path / "data"  # a path that no query has seen
    folder.symlink_to(data)
    before = held(spark)
    assert load().QUERIES[name](spark, str(folder)).count()
    assert held(spark) - before < 50_000


def test_whole_graph_computations_keep_less_than_their_edges_as_text(spark, data, tmp_path):
    folder = tmp_path / "data"
    folder.symlink_to(data)
    edges = load().QUERIES["stable_edge_ids"](spark, str(folder))
    before = held(spark)
    keep(edges)
    whole = held(spark) - before
    for name in ("connected_components", "page_rank", "label_propagation", "triangle_counts"):
        before = held(spark)
        assert load().QUERIES[name](spark, str(folder)).count()
        assert held(spark) - before < whole / 2, name


def test_triangles_in_parts(spark):
    """A part at a time, against counting all triples; wedges whose ends can't be linked don't change the result."""
    pairs = {(i * 7 % 23, (i * i + 3 * i) % 29) for i in range(120)}
    made = graph.triangles(spark.createDataFrame(sorted(pairs), "from_node_id long, to_node_id long"), wedges=500).collect()
    linked = {frozenset(p) for p in pairs if p[0] != p[1]}
    nodes = sorted({x for p in linked for x in p})
    due = dict.fromkeys(nodes, 0)
    for i, a in enumerate(nodes):
        for j, b in enumerate(nodes[i + 1 :], i + 1):
            for c in nodes[j + 1 :]:
                if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= linked:
                    for x in (a, b, c):
                        due[x] += 1
    assert sum(due.values()) and {r["node_id"]: r["triangles"] for r in made} == due


def random_edges():
    rng = np.random.default_rng(3)
    return sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (240, 2))})


def test_page_rank_in_slices(spark):
    """Slices of the nodes, each with its own edges, against a plain walk; some nodes have no edges, some edges end outside."""
    n, pairs = 70, [*random_edges(), (3, 1000)]
    made = graph.page_rank(spark.range(n), spark.createDataFrame(pairs, "from_node_id long, to_node_id long"), 4, most=40).collect()
    out = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    rank = dict.fromkeys(range(n), 1 / n)
    for _ in range(4):
        lost = sum(r for i, r in rank.items() if i not in out)
        rank = {i: 0.15 / n + 0.85 * (sum(rank[a] / out[a] for a, b in pairs if b == i) + lost / n) for i in rank}
    got = {r["id"]: r["rank"] for r in made}
    assert len(made) == n and all(abs(got[i] - r) < 1e-12 for i, r in rank.items())


def test_labels_in_slices(spark):
    """Communities that nodes begin with are told apart from their ids; ties fall to the smallest community."""
    pairs, begin = random_edges(), {i: (i * 37) % 71 for i in range(70)}
    nodes = spark.createDataFrame(sorted(begin.items()), "id long, community long")
    made = graph.label_propagation(nodes, spark.createDataFrame(pairs, "from_node_id long, to_node_id long"), 3, votes=100).collect()
    now = begin
    for _ in range(3):
        heard = {i: [now[b] for a, b in pairs if a == i != b] + [now[a] for a, b in pairs if b == i != a] for i in now}
        now = {i: min(heard[i], key=lambda c, own=heard[i]: (-own.count(c), c)) if heard[i] else c for i, c in now.items()}
    assert len(made) == 70 and {r["id"]: r["community"] for r in made} == now


def test_components_of_many_shapes(spark, monkeypatch):
    """A long path in odd order, a star whose middle is the largest, rings and a clique, in many small chunks, against a walk."""
    monkeypatch.setattr(graph, "HEAVY", 8)
    rng = np.random.default_rng(6)
    path = rng.permutation(400).tolist()
    pairs = list(zip(path, path[1:], strict=False)) + [(5000, 1000 + k) for k in range(60)] + [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)]
    pairs += [(3000 + a, 3000 + b) for a in range(12) for b in range(a)] + [(4000, 4000), (4001, 4002), (4002, 4001), (6001, 6000), (6001, 2)]
    root = {x: x for p in pairs for x in p}
    for a, b in pairs:
        lo, hi = sorted((root[a], root[b]))
        root = {i: lo if r == hi else r for i, r in root.items()}
    root.pop(4000)  # linked with itself only
    frame = spark.createDataFrame([pairs[k] for k in rng.permutation(len(pairs)).tolist()], "u long, v long")
    for many in (1, 40):
        got = [tuple(r) for r in graph.contract(frame.repartition(many)).collect()]
        assert sorted(got) == sorted(root.items())
    assert graph.contract(frame.limit(0)).count() == 0


def test_components_shuffle_what_chunks_share(spark, data, tmp_path):
    """Of the star graph, rounds move what is the smallest of its component in a chunk, and no ids: the rows that are kept take a few bytes a node."""
    folder = tmp_path / "data"
    folder.symlink_to(data)
    moved, joined = [], graph.with_lowest
    before = held(spark)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "with_lowest", lambda pairs, rows: moved.append(rows) or joined(pairs, rows))
        nodes = load().QUERIES["connected_components"](spark, str(folder)).count()
    assert sum(moved) < nodes
    assert held(spark) - before < 24 * nodes
