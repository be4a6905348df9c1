"""Graph operators over two frames, or over a stored graph.

nodes: id, label, properties (JSON text or any further columns). edges: id, label, from_node_id, to_node_id, from_node_type, to_node_type.
Searches go over ``graph_store.Frames`` or ``graph_store.GraphStore``; the latter keeps edges by either end, so that expansion by one level reads
the frontier's buckets alone.

Iterations are level-synchronous; a level's small frontier is kept in the plan, a large one reliably checkpointed, so neither lineage nor recomputation grows
with depth. Caps need an order: level, place of the source node, label, edge id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions.ids import is_uuid
from loamgraph.schema import canonical_edge
from loamgraph.session import SMALL, discard, keep, pin, settle
from loamgraph.sources.graph_store import ENDS, Frames, GraphStore, small

Graph = Frames | GraphStore


class InvalidArgument(ValueError):
    """A request that cannot be answered as it is put."""


def canonical_labels(types: list[str] | None) -> list[str]:
    return [canonical_edge(t) for t in types or []]


def with_labels(edges: DataFrame, types: list[str] | None) -> DataFrame:
    names = canonical_labels(types)
    return edges.filter(F.col("label").isin(names)) if names else edges


# -- neighbours ---------------------------------------------------------------------------------------


def neighbours(edges: DataFrame, nodes: DataFrame, node: str, types: list[str] | None = None, direction: str = "both", limit: int = 0) -> DataFrame:
    return neighbours_in(Frames(nodes, edges), node, types, direction, limit)


def neighbours_in(graph: Graph, node: str, types: list[str] | None = None, direction: str = "both", limit: int = 0) -> DataFrame:
    """orientation, edge_id, label, node_id, node_label, exists; outgoing first, then by type as asked for, then edge id.

    ``limit`` 0: no cap. A self-loop comes twice under ``both``. A neighbour without a node has a null node_label.
    """
    if direction not in ("out", "in", "both", "outgoing", "incoming"):
        raise InvalidArgument(f"no such direction: {direction}")
    names = canonical_labels(types)
    place = F.array_position(F.array(*map(F.lit, names)), F.col("label")) if names else F.lit(0).cast("long")
    start = graph.spark.createDataFrame([(node,)], "id string")
    parts = []
    for rank, (side, name) in enumerate((("out", "outgoing"), ("in", "incoming"))):
        if direction == "both" or name.startswith(direction):
            own = graph.step(side, start, 1, names)
            parts.append(own.select(
                F.lit(name).alias("orientation"), F.lit(rank).alias("_side"), place.alias("_place"), F.col("id").alias("edge_id"), "label",
                F.col(ENDS[side][1]).alias("node_id"),
            ))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if limit:
        found = found.orderBy("_side", "_place", "label", "edge_id").limit(limit)
    if not isinstance(graph, Frames):
        found, n = settle(found)
        known = graph.known(found.select(F.col("node_id").alias("id")).distinct(), n)
    else:
        known = graph.nodes.select("id", "label")
    known = known.select(F.col("id").alias("node_id"), F.col("label").alias("node_label"))
    return found.join(known, "node_id", "left").select("orientation", "edge_id", "label", "node_id", "node_label", F.col("node_label").isNotNull().alias("exists"))


# -- breadth-first subgraph ---------------------------------------------------------------------------


@dataclass
class Subgraph:
    nodes: DataFrame  # id, label, level, place
    edges: DataFrame  # id, label, from_node_id, to_node_id, level


#: The order in which a level's edges are met.
STEP_ORDER = ("_source", "label", "id")


def subgraph_bfs(edges: DataFrame, nodes: DataFrame, start: str, types: list[str] | None = None, depth: int = 1, node_limit: int = 0, edge_limit: int = 0) -> Subgraph:
    return bfs(Frames(nodes, edges), start, types, depth, node_limit, edge_limit)


def bfs(graph: Graph, start: str, types: list[str] | None = None, depth: int = 1, node_limit: int = 0, edge_limit: int = 0) -> Subgraph:
    """What is reached from ``start`` along outgoing edges in ``depth`` steps; 0 is the start alone. Limits of 0 don't limit.

    Edges among nodes already reached are part of the result; edges out of nodes of the last level are not; edges without an
    existing target are not.
    """
    if not is_uuid(start):
        raise InvalidArgument(f"not a UUID: {start}")
    labels = canonical_labels(types)
    first = graph.known(graph.spark.createDataFrame([(start,)], "id string"), 1).limit(1)
    seen, rows = settle(first.select("id", "label", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")))
    frontier, reached, used, n_edges = seen, rows, [], 0
    for level in range(depth):
        if not rows or (node_limit and reached >= node_limit):
            break
        stepped = graph.step("out", frontier.select("id", F.col("place").alias("_source")), rows, labels)
        step, found = with_targets(graph, stepped, rows, edge_limit - n_edges if edge_limit else 0)
        if node_limit:
            step, found = settle(up_to_last_node(step, seen, node_limit - reached), found > SMALL)
        if not found:
            break
        used.append(step.select("id", "label", "from_node_id", "to_node_id", F.lit(level).alias("level")))
        n_edges += found
        met = F.min(F.struct("_source", F.col("label").alias("label_e"), F.col("id").alias("edge_id"))).alias("first")
        new = step.groupBy(F.col("to_node_id").alias("node"), "to_label").agg(met).select(F.col("node").alias("id"), F.col("to_label").alias("label"), "first")
        new = new.join(seen.select("id"), "id", "left_anti")
        if node_limit:
            new = new.orderBy("first").limit(max(0, node_limit - reached))
        # places only order capped traversals; the rank needs one sort of the level, which a cap bounds
        place = F.row_number().over(Window.orderBy("first", "id")).cast("long") + reached if node_limit or edge_limit else F.lit(0).cast("long")
        frontier, rows = settle(new.select("id", "label", F.lit(level + 1).alias("level"), place.alias("place")), found > SMALL)
        reached += rows
        seen = seen.unionByName(frontier)
        if edge_limit and n_edges >= edge_limit:
            break
    if not used:
        used = [graph.spark.createDataFrame([], "id string, label string, from_node_id string, to_node_id string, level int")]
    edges = used[0]
    for more in used[1:]:
        edges = edges.unionByName(more)
    return Subgraph(seen, edges)


def with_targets(graph: Graph, stepped: DataFrame, rows: int, cap: int) -> tuple[DataFrame, int]:
    """(edges whose target exists, with to_label; their number). With a cap only the first edges by order are fetched, more of them if targets are missing."""
    take = 4 * cap
    while True:
        picked = stepped.orderBy(*STEP_ORDER).limit(take) if cap else stepped
        held, n = settle(picked, rows > SMALL and not cap)
        targets = held.select(F.col("to_node_id").alias("id")).distinct()
        known = graph.known(targets, n).select(F.col("id").alias("to_node_id"), F.col("label").alias("to_label"))
        whole, found = settle(held.join(known, "to_node_id"), n > SMALL)
        if not cap or n < take or found >= cap:
            break
        take *= 4
    if cap and found > cap:
        return settle(whole.orderBy(*STEP_ORDER).limit(cap))
    return whole, found


def up_to_last_node(stepped: DataFrame, seen: DataFrame, room: int) -> DataFrame:
    """The level's edges in order, up to the edge that brings the last node there is room for."""
    met = F.struct(*STEP_ORDER)
    new = stepped.join(seen.select(F.col("id").alias("to_node_id")), "to_node_id", "left_anti").groupBy("to_node_id").agg(F.min(met).alias("at"))
    last = new.orderBy("at").limit(room).agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n")).first()
    if last["n"] < room:
        return stepped
    at = last["at"]
    return stepped.filter(met <= F.struct(F.lit(at["_source"]).alias("_source"), F.lit(at["label"]).alias("label"), F.lit(at["id"]).alias("id")))


# -- paths --------------------------------------------------------------------------------------------


def shortest_path(edges: DataFrame, nodes: DataFrame, source: str, target: str, label: str | None = None) -> dict | None:
    return path_between(Frames(nodes, edges), source, target, label)


def path_between(graph: Graph, source: str, target: str, label: str | None = None) -> dict | None:
    """The shortest directed path: {length, nodes, edges} with ids in order, or None. Of several edges into a node the smallest id counts.

    Level-synchronous from both ends: the side with the smaller frontier grows, until they meet or one has nowhere to go.
    """
    for x in (source, target):
        if not is_uuid(x):
            raise InvalidArgument(f"not a UUID: {x}")
    ends = graph.spark.createDataFrame([(x,) for x in {source, target}], "id string")
    if graph.known(ends, 2).select("id").distinct().count() < len({source, target}):
        return None
    if source == target:
        return {"length": 0, "nodes": [source], "edges": []}
    labels = canonical_labels([label] if label else None)
    sides = {}
    for side, node in (("out", source), ("in", target)):
        first = graph.spark.createDataFrame([(node, None, None)], "id string, edge string, prev string")
        sides[side] = {"seen": first, "front": first, "rows": 1, "all": 1, "level": 0}
    while True:
        side = min(sides, key=lambda s: sides[s]["rows"])
        s, (own, other) = sides[side], ENDS[side]
        grown = graph.step(side, s["front"].select("id"), s["rows"], labels)
        best = grown.groupBy(F.col(other).alias("node")).agg(F.min(F.struct(F.col("id").alias("edge"), F.col(own).alias("prev"))).alias("by"))
        fresh = best.select(F.col("node").alias("id"), "by.edge", "by.prev").join(s["seen"].select("id"), "id", "left_anti")
        fresh, n = settle(fresh, s["rows"] > SMALL)
        s["front"], s["rows"] = settle(fresh.join(graph.known(fresh.select("id"), n).select("id").distinct(), "id"), n > SMALL)
        if not s["rows"]:
            return None
        s["seen"], s["all"], s["level"] = s["seen"].unionByName(s["front"]), s["all"] + s["rows"], s["level"] + 1
        if s["level"] % 8 == 0:  # a long way doesn't become a deep plan
            s["seen"], _ = settle(s["seen"], s["all"] > SMALL)
        met = s["front"].join(sides["in" if side == "out" else "out"]["seen"].select("id"), "id", "left_semi").agg(F.min("id").alias("id")).first()["id"]
        if met is not None:
            break
    path, used = [met], []
    for side, add_node, add_edge in (("out", lambda x: path.insert(0, x), lambda e: used.insert(0, e)), ("in", path.append, used.append)):
        node, seen = met, sides[side]["seen"]
        held = {r["id"]: r for r in seen.collect()} if sides[side]["all"] <= SMALL else None
        while node != (source if side == "out" else target):
            row = held[node] if held is not None else seen.filter(F.col("id") == node).first()
            add_edge(row["edge"])
            add_node(node := row["prev"])
    return {"length": len(used), "nodes": path, "edges": used}


# -- a fluent traversal --------------------------------------------------------------------------------


class Traversal:
    """Steps over the graph that compile to joins: ``Traversal(nodes, edges).nodes_of("function").where(...).out("calls").ids()``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, current: DataFrame | None = None):
        self.all_nodes, self.all_edges = nodes, edges
        self.current = nodes if current is None else current

    def _at(self, current: DataFrame) -> Traversal:
        return Traversal(self.all_nodes, self.all_edges, current)

    def from_ids(self, *ids: str) -> Traversal:
        return self._at(self.all_nodes.filter(F.col("id").isin(*ids)))

    def nodes_of(self, label: str) -> Traversal:
        return self._at(self.current.filter(F.col("label") == label))

    def where(self, condition) -> Traversal:
        return self._at(self.current.filter(condition))

    def _step(self, label: str | None, own: str, other: str) -> Traversal:
        edges = with_labels(self.all_edges, [label] if label else None)
        hop = edges.join(self.current.select(F.col("id").alias(own)).distinct(), own, "left_semi").select(F.col(other).alias("id")).distinct()
        hop, n = settle(hop)  # so that few ends don't shuffle all nodes
        return self._at(self.all_nodes.join(small(hop, n), "id", "left_semi"))

    def out(self, label: str | None = None) -> Traversal:
        return self._step(label, "from_node_id", "to_node_id")

    def into(self, label: str | None = None) -> Traversal:
        return self._step(label, "to_node_id", "from_node_id")

    def out_edges(self, label: str | None = None) -> DataFrame:
        edges = with_labels(self.all_edges, [label] if label else None)
        return edges.join(self.current.select(F.col("id").alias("from_node_id")).distinct(), "from_node_id", "left_semi")

    def having(self, step) -> Traversal:
        """Nodes from which ``step`` (a function from a traversal to a traversal) reaches something; one hop of a join per node."""
        edges = step(self.all_edges)
        return self._at(self.current.join(edges.select(F.col("from_node_id").alias("id")).distinct(), "id", "left_semi"))

    def ids(self) -> DataFrame:
        return self.current.select("id")


# -- statistics ----------------------------------------------------------------------------------------


def graph_counts(nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """num_nodes, num_edges, num_vectors."""
    parts = [nodes.select(F.lit("n").alias("k")), edges.select(F.lit("e").alias("k"))]
    if vectors is not None:
        parts.append(vectors.select(F.lit("v").alias("k")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.agg(*[F.count(F.when(F.col("k") == k, 1)).alias(name) for k, name in (("n", "num_nodes"), ("e", "num_edges"), ("v", "num_vectors"))])


def edge_statistics(edges: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """row_count by label, with the table's version if ``versions`` (label, version) is given."""
    counts = edges.groupBy("label").agg(F.count(F.lit(1)).alias("row_count"))
    return counts if versions is None else counts.join(F.broadcast(versions), "label", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """out_degree, in_degree, degree by node."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("from_node_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_node_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e"))
    return ends.groupBy("e.node_id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed density: edges / (nodes * (nodes - 1))."""
    c = graph_counts(nodes, edges)
    n = F.col("num_nodes").cast("double")
    return c.select("num_nodes", "num_edges", F.when(n > 1, F.col("num_edges") / (n * (n - 1))).otherwise(0.0).alias("density"))


#: Neighbours beyond which a node's rows are not brought together in one task.
HEAVY = 256


def with_lowest(pairs: DataFrame, rows: int) -> DataFrame:
    """``pairs`` (u, v) with m, the smallest of u and its v's. Nodes with many rows (fewer than 2^16 whatever the size) are not shuffled: their m is broadcast."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
    heavy = F.col("n") > max(HEAVY, rows >> 16)
    few = F.broadcast(low.filter(heavy).select("u", "m"))
    return pairs.join(few, "u").unionByName(pairs.join(few, "u", "left_anti").join(low.filter(~heavy).select("u", "m"), "u"))


#: Pairs that are contracted in memory at a time.
CHUNK = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among these pairs), but for the smallest ones."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            own = label != np.arange(len(names))
            return names[own], names[label[own]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def forest(pairs: DataFrame) -> DataFrame:
    """Fewer pairs (u, v), v the smaller, with the same components: what a task holds is contracted in place, ``CHUNK`` pairs at a time, before anything is shuffled. Each v is also paired with
    itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            tops = np.unique(v)
            return pa.RecordBatch.from_arrays([pa.array(np.append(u, tops)), pa.array(np.append(v, tops))], ["u", "v"])

        for b in batches:
            held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
            size += b.num_rows
            if size >= CHUNK:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return pairs.select("u", "v").mapInArrow(run, "u long, v long")


def contract(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``pairs`` (u, v); root is the component's smallest node.

    Each task first contracts its own pairs. Then small-star and large-star contraction in turn: each round links neighbours to the smallest neighbour. A node that has one smaller neighbour left and is no
    other's is set aside with it, so that the next rounds move the others only: at first those that are the smallest of their component in some task. It ends when none is left: edges only ever move to smaller
    nodes, and the rounds grow with the logarithm of the size. Then those set aside take their neighbours' roots, the last first.
    """
    spark, own, levels = pairs.sparkSession, Window.partitionBy("u"), []
    now, at = keep(forest(pairs.filter("u <> v")), "zstd")
    while True:
        # a node has as many rows as chunks have it, whatever its degree
        seen = now.select("u", "v", F.min("v").over(own).alias("m"), F.max("v").over(own).alias("top"), F.row_number().over(own.orderBy("v")).alias("k"))
        moved, moved_at = keep(seen.filter("m < u AND (k = 1 OR v > m AND v < u)").selectExpr("IF(k = 1, u, v) AS u", "m AS v", "k = 1 AND top < u AS leaf"), "zstd")
        discard(spark, at)
        levels.append((moved.filter("leaf").select("u", "v"), moved_at))
        left, left_at = keep(forest(moved.filter("NOT leaf")).filter("u <> v").distinct(), "zstd")
        n = left.count()
        if not n:
            break
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, at = keep(forest(with_lowest(both, 2 * n).select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).filter("u <> v")), "zstd")
        discard(spark, left_at)
    found, old = levels[-1][0].select(F.col("u").alias("node"), F.col("v").alias("root")), None
    for level, _ in reversed(levels[:-1]):
        found, new = keep(followed(level, found).unionByName(found), "zstd")
        if old is not None:
            discard(spark, old)
        old = new
    for _, path in levels[:-1]:
        discard(spark, path)
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def followed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of the pairs' u: the root of its v by ``found`` (node, root), else v. The roots of v's with many rows (fewer than 2^16) are broadcast, as in ``with_lowest``."""
    to = found.select(F.col("node").alias("v"), "root")
    if found.count() <= SMALL:
        placed = pairs.join(F.broadcast(to), "v", "left")
    else:
        hot = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HEAVY, pairs.count() >> 16)).select("v")
        few = F.broadcast(hot.join(to, "v", "left").select("v", F.coalesce("root", "v").alias("root")))
        placed = pairs.join(few, "v").unionByName(pairs.join(few, "v", "left_anti").join(to, "v", "left"))
    return placed.select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), weakly connected; component is the smallest id. Ends are numbered first: the rounds move numbers instead of ids."""
    ends = edges.select(F.explode(F.array("from_node_id", "to_node_id")).alias("id")).distinct()
    numbered = pin(pin(ends).withColumn("n", F.monotonically_increasing_id()))
    u, v = (numbered.select(F.col("id").alias(c), F.col("n").alias(k)) for c, k in (("from_node_id", "u"), ("to_node_id", "v")))
    roots = contract(edges.select("from_node_id", "to_node_id").join(u, "from_node_id").join(v, "to_node_id").select("u", "v"))
    return smallest_of(nodes, numbered.join(roots.withColumnRenamed("node", "n"), "n", "left").select("id", F.coalesce("root", "n").alias("root")))


def smallest_of(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, component) of the nodes from their roots: ``placed`` (id, root)."""
    placed, _ = keep(placed)
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))  # partial sums first, so a component that has most nodes is no hot key
    of = placed.join(small(smallest, smallest.count()), "root").select("id", "component")
    return nodes.select("id").join(of, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Edges that are shuffled at a time.
SLICE = 1 << 24


def slice_of(df: DataFrame, by: str, k: int, parts: int) -> DataFrame:
    """One of ``parts`` slices of ``df``: rows alike in ``by`` are in the same one."""
    return df.filter(F.pmod(F.xxhash64(by), F.lit(parts)) == k) if parts > 1 else df


def together(slices: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), slices)


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85, rows: int | None = None, most: int = SLICE) -> DataFrame:
    """(id, rank). Nodes without out-edges give their rank to all.

    Edges are kept in slices by their target, nodes in the same slices: each round ranks a slice at a time, so that about ``most`` edges are shuffled at once. ``rows``: the edges' number or an upper bound
    of it, where counting them is dear.
    """
    spark, hops = edges.sparkSession, edges.select(F.col("from_node_id").alias("id"), F.col("to_node_id").alias("to"))
    parts = max(1, -(-(hops.count() if rows is None else rows) // most))
    heard = [keep(slice_of(hops, "to", k, parts).sortWithinPartitions("to", "id"), "zstd") for k in range(parts)]
    out = together([df for df, _ in heard]).groupBy("id").agg(F.count(F.lit(1)).alias("out"))
    base = [keep(slice_of(nodes.select("id").distinct(), "id", k, parts).join(slice_of(out, "id", k, parts), "id", "left"), "zstd")[0] for k in range(parts)]
    n = together(base).count()
    ranks, old = [df.withColumn("rank", F.lit(1.0 / max(1, n))) for df in base], []
    for _ in range(rounds):
        now = together(ranks)
        lost = now.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("s")).first()["s"]
        shares, made = now.filter("out is not null").select("id", (F.col("rank") / F.col("out")).alias("share")), []
        for (hops, _), own in zip(heard, base, strict=True):
            got = hops.join(shares, "id").groupBy(F.col("to").alias("id")).agg(F.sum("share").alias("got"))
            made.append(keep(own.join(got, "id", "left").select(
                "id", "out", (F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / max(1, n)))).alias("rank"),
            ), "zstd"))
        for path in old:
            discard(spark, path)
        ranks, old = [df for df, _ in made], [at for _, at in made]
    for _, at in heard:
        discard(spark, at)
    return together(ranks).select("id", "rank")


#: Wedges that are shuffled at a time, at most.
WEDGES = 1 << 26


def triangles(edges: DataFrame, wedges: int = WEDGES) -> DataFrame:
    """(node_id, triangles, clustering) of the undirected simple graph.

    Every edge points to its end of higher degree, so wedges are formed at low degrees: their number stays near edges ^ 1.5 even where a node
    has most edges. Of a wedge's ends the lower must point to the higher one, so it is formed only if some arc of the lower one reaches that degree. Wedges are closed for some of
    the nodes at a time.
    """
    spark = edges.sparkSession
    pairs, pairs_at = keep(
        edges.select(F.least("from_node_id", "to_node_id").alias("a"), F.greatest("from_node_id", "to_node_id").alias("b")).filter("a <> b").distinct()
    )
    deg, _ = keep(pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d")))
    ranked = pairs.join(deg.select(F.col("n").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("n").alias("b"), F.col("d").alias("db")), "b")
    low, high = F.struct(F.col("da").alias("d"), F.col("a").alias("n")), F.struct(F.col("db").alias("d"), F.col("b").alias("n"))
    arcs, arcs_at = keep(ranked.select(F.least(low, high).n.alias("u"), F.greatest(low, high).n.alias("v"), F.greatest(low, high).d.alias("dv")))
    discard(spark, pairs_at)
    reach, reach_at = keep(arcs.groupBy("u").agg(F.min("dv").alias("least")).withColumnRenamed("u", "x"))
    left, left_at = keep(arcs.select("u", F.col("v").alias("x"), F.col("dv").alias("dx")).join(reach, "x"))
    right, closed = arcs.select("u", F.col("v").alias("y"), F.col("dv").alias("dy")), arcs.select(F.col("u").alias("x"), F.col("v").alias("y"))
    closed, closed_at = keep(closed.join(left.select("x").distinct(), "x", "left_semi"))
    per = left.groupBy("u").agg(F.count(F.lit(1)).alias("l")).join(arcs.groupBy("u").agg(F.count(F.lit(1)).alias("r")), "u")
    parts = -(-(per.agg(F.sum(F.col("l") * F.col("r"))).first()[0] or 0) // wedges)
    counts = []
    for k in range(parts):
        own = [side.filter(F.pmod(F.xxhash64("u"), F.lit(parts)) == k) for side in (left, right)]
        formed = own[0].join(own[1], "u").filter((F.col("dy") >= F.col("least")) & (F.struct("dx", "x") < F.struct("dy", "y"))).select("u", "x", "y")
        hit = formed.join(closed, ["x", "y"]).select(F.explode(F.array("u", "x", "y")).alias("n"))
        counts.append(keep(hit.groupBy("n").agg(F.count(F.lit(1)).alias("t")))[0])
    for path in (arcs_at, reach_at, left_at, closed_at):
        discard(spark, path)
    found = reduce(lambda a, b: a.unionByName(b), counts) if counts else deg.limit(0).withColumnRenamed("d", "t")
    found = found.groupBy("n").agg(F.sum("t").alias("t"))
    d = F.col("d").cast("double")
    return deg.join(found, "n", "left").select(
        F.col("n").alias("node_id"), F.coalesce("t", F.lit(0)).alias("triangles"),
        F.when(d > 1, 2 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("clustering"),
    )


#: Votes that are shuffled at a time.
VOTES = 1 << 24


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5, votes: int = VOTES, rows: int | None = None) -> DataFrame:
    """(id, community): each round a node takes its neighbours' most frequent community, the smallest on ties.

    Nodes begin with their column ``community``, without one with their ids. About ``votes`` votes are shuffled at a time, those of a slice of the nodes. ``rows``: the edges' number or an upper
    bound of it, where counting them is dear.
    """
    spark, ends = edges.sparkSession, edges.select(F.col("from_node_id").alias("a"), F.col("to_node_id").alias("b")).filter("a <> b")
    parts = max(1, -(-2 * (ends.count() if rows is None else rows) // votes))
    held = [keep(slice_of(ends, "b", k, parts).sortWithinPartitions("b", "a"), "zstd") for k in range(parts)]
    ends = together([df for df, _ in held])
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, old = nodes.select("id", F.col("community" if "community" in nodes.columns else "id").alias("community")), []
    for _ in range(rounds):
        said, made = now.select(F.col("id").alias("b"), "community"), []
        for k in range(parts):
            # by node at once: both counts go without another shuffle
            heard = slice_of(both, "a", k, parts).join(said, "b").select("a", "community").repartition("a")
            counted = heard.groupBy("a", "community").agg(F.count(F.lit(1)).alias("n"))
            best = counted.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("m")).select(F.col("a").alias("id"), F.col("m.community").alias("best"))
            made.append(keep(slice_of(now, "id", k, parts).join(best, "id", "left").select("id", F.coalesce("best", "community").alias("community")), "zstd"))
        for path in old:
            discard(spark, path)
        now, old = together([df for df, _ in made]), [at for _, at in made]
    for _, at in held:
        discard(spark, at)
    return now
