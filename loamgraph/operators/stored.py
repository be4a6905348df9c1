"""The stored graph queries: writes of nodes, edges and vectors in batches, and read queries over calls, files, tests and handlers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.functions.ids import edge_id, node_id, node_id_of
from loamgraph.operators import search
from loamgraph.operators.graph import Graph, Traversal, canonical_labels, with_labels
from loamgraph.operators.ingest import GraphData, Synchronizer, conform, records
from loamgraph.operators.lookup import json_field
from loamgraph.schema import EntitySpec, Registry
from loamgraph.session import SMALL, pin, settle
from loamgraph.sources.graph_store import ENDS, Frames, GraphStore, small

# -- writes -------------------------------------------------------------------------------------------


def create_nodes(sync: Synchronizer, kind: str, rows: list[dict]) -> None:
    """Projects, versions, files, functions, classes, data models, tests, endpoints."""
    spec = sync.registry.entity(kind)
    sync.process(GraphData().add(spec, records(sync.spark, spec, rows)))


def edge_rows(spec: EntitySpec, pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Edges between ids: ``pairs`` has from_node_id and to_node_id."""
    now = F.current_timestamp()
    own = edge_id(spec.entity_type, F.col("from_node_id"), F.col("to_node_id"))
    return pairs.select(
        own.alias("id"), "from_node_id", "to_node_id", F.lit(source).alias("from_node_type"), F.lit(target).alias("to_node_type"), now.alias("created_at"),
        now.alias("updated_at"),
    )


def create_edges(sync: Synchronizer, edge: str, pairs: list[tuple[str, str]], source: str, target: str) -> None:
    """Calls, tests of functions, classes and endpoints, handlers, any other type."""
    spec = sync.registry.edge(edge)
    if pairs:
        frame = sync.spark.createDataFrame(pairs, "from_node_id string, to_node_id string")
        sync.process(GraphData().add(spec, edge_rows(spec, frame, source, target)))


def create_contained(sync: Synchronizer, kind: str, rows: list[dict], parent: str, parent_type: str) -> None:
    """Nodes and the edges by which their parent contains them: files of a version, functions of a file and so on."""
    spec = sync.registry.entity(kind)
    frame = records(sync.spark, spec, rows)
    if frame is None:
        return
    contains = sync.registry.edge("contains")
    pairs = frame.select(F.lit(parent).alias("from_node_id"), node_id(kind, [(k, F.col(k)) for k in spec.keys]).alias("to_node_id"))
    sync.process(GraphData().add(spec, frame).add(contains, edge_rows(contains, pairs, parent_type, kind)))


def create_version(sync: Synchronizer, project_url: str, version: dict, commit: dict) -> None:
    """A version with its commit and the edges from the project and to the commit."""
    create_nodes(sync, "version", [version])
    create_nodes(sync, "commit", [commit])
    project, made, done = node_id_of("project", url=project_url), node_id_of("version", sha=version["sha"]), node_id_of("commit", sha=commit["sha"])
    create_edges(sync, "hasversion", [(project, made)], "project", "version")
    create_edges(sync, "iscommit", [(made, done)], "version", "commit")


def embed_chunks(sync: Synchronizer, rows: list[dict]) -> None:
    """Code chunks of functions and classes; their edges follow from the vector rules."""
    spec = sync.registry.entity("codechunk")
    sync.process(GraphData().add(spec, records(sync.spark, spec, rows)))


def delete_version(sync: Synchronizer, sha: str, registry: Registry | None = None) -> None:
    """A version, what was found in it, and the edges at either end of that."""
    registry = registry or sync.registry
    gone: list[DataFrame] = []
    for spec in registry.entities():
        column = "sha" if spec.entity_type == "version" else "version_sha"
        table = sync.lake.open(spec.table)
        if table is not None and spec.category.value == "node" and column in spec.schema.names and spec.entity_type != "commit":
            gone.append(conform(table.read(), spec).filter(F.col(column) == sha).select(node_id(spec.entity_type, [(k, F.col(k)) for k in spec.keys]).alias("id")))
    if not gone:
        return
    ids = pin(reduce(lambda a, b: a.unionByName(b), gone).distinct())
    for spec in registry.entities():
        table = sync.lake.open(spec.table)
        if table is None:
            continue
        if spec.category.value == "edge":
            table.delete_matching(ids, ["from_node_id", "to_node_id"])
        elif spec.category.value == "node" and spec.entity_type != "commit":
            column = "sha" if spec.entity_type == "version" else "version_sha"
            if column in spec.schema.names:
                table.delete(F.col(column) == sha)


# -- reads --------------------------------------------------------------------------------------------


def find_project_by_url(nodes: DataFrame, url: str) -> DataFrame:
    return nodes.filter((F.col("label") == "project") & (json_field(F.col("properties"), "url") == url)).select("id")


def with_ancestors(found: DataFrame, edges: DataFrame, nodes: DataFrame, steps: list[tuple[str, Column | None]]) -> DataFrame:
    return ancestors_in(Frames(nodes, edges), found, steps)


def ancestors_in(graph: Graph, found: DataFrame, steps: list[tuple[str, Column | None]]) -> DataFrame:
    """Nodes with a chain of parents: each step is an edge type and a condition on the parent. From the last parents down; few of them don't shuffle the graph."""
    reach: DataFrame | None = None
    for label, condition in reversed(steps):
        if condition is None and reach is not None:
            parents = graph.known(reach, n).select("id")
        else:
            parents = graph.nodes if condition is None else graph.nodes.filter(condition)
            parents = (parents if reach is None else parents.join(small(reach, n), "id", "left_semi")).select("id")
        parents, n = settle(parents.distinct())
        reach, n = settle(graph.step("out", parents, n, canonical_labels([label])).select(F.col("to_node_id").alias("id")).distinct())
    return found.join(small(reach, n), "id", "left_semi")


def find_function_details(nodes: DataFrame, edges: DataFrame, name: str, path: str, sha: str) -> DataFrame:
    """Functions of this name in a file of this path in a version of this sha."""
    named = nodes.filter((F.col("label") == "function") & (json_field(F.col("properties"), "name") == name))
    field = lambda f, v: json_field(F.col("properties"), f) == v
    return with_ancestors(named, edges, nodes, [("contains", field("path", path)), ("contains", field("sha", sha))])


def whole(graph: Graph, ids: DataFrame, rows: int) -> DataFrame:
    """The nodes in ``ids`` (column id): of a stored graph their buckets' files only, while they are few."""
    if isinstance(graph, GraphStore) and rows <= SMALL:
        return graph.nodes_of([r["id"] for r in ids.select("id").collect()])
    return graph.nodes.join(small(ids.select("id"), rows), "id", "left_semi")


def hop_with_parent(graph: Graph, node: str, label: str, direction: str, parent_label: str = "contains") -> DataFrame:
    """The nodes one edge away, with the parents of each: id, label, properties, parent_id, parent. Over a stored graph nothing is read but the buckets of these nodes and edges."""
    start = graph.spark.createDataFrame([(node,)], "id string")
    ends, n = settle(graph.step(direction, start, 1, canonical_labels([label])).select(F.col(ENDS[direction][1]).alias("id")).distinct())
    up = graph.step("in", ends, n, canonical_labels([parent_label])).select(F.col("to_node_id").alias("id"), F.col("from_node_id").alias("parent_id"))
    above, m = settle(up)
    found = whole(graph, ends, n).select("id", "label", "properties")
    parents = whole(graph, above.select(F.col("parent_id").alias("id")).distinct(), m)
    return found.join(small(above, m), "id").join(parents.select(F.col("id").alias("parent_id"), F.col("properties").alias("parent")), "parent_id")


def function_callees(graph: Graph, function: str) -> DataFrame:
    return hop_with_parent(graph, function, "calls", "out").withColumn("path", json_field(F.col("parent"), "path"))


def function_callers(graph: Graph, function: str) -> DataFrame:
    return hop_with_parent(graph, function, "calls", "in").withColumn("path", json_field(F.col("parent"), "path"))


def tests_for_function(nodes: DataFrame, edges: DataFrame, function: str) -> DataFrame:
    return Traversal(nodes, edges).from_ids(function).into("tests_function").current


def endpoint_handler(nodes: DataFrame, edges: DataFrame, path: str, method: str) -> DataFrame:
    props = F.col("properties")
    ends = Traversal(nodes, edges).nodes_of("endpoint").where((json_field(props, "path") == path) & (json_field(props, "http_method") == method))
    return ends.out("handler").current


def files_in_version(nodes: DataFrame, edges: DataFrame, version: str) -> DataFrame:
    return Traversal(nodes, edges).from_ids(version).out("contains").nodes_of("file").current


def similar_chunks(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, query: list[float], limit: int, kind: str = "function", metric: str = "cosine") -> DataFrame:
    """The functions (or classes) whose code chunks are nearest."""
    hits = search.knn(vectors, query, limit, "codechunk", metric)
    up = with_labels(edges, ["embeds"]).join(small(hits.select(F.col("id").alias("to_node_id")), limit), "to_node_id", "left_semi")
    return nodes.filter(F.col("label") == kind).join(up.select(F.col("from_node_id").alias("id")).distinct(), "id", "left_semi")


def relevant_docs(vectors: DataFrame, query: list[float], limit: int, kind: str = "readmechunk", metric: str = "cosine") -> DataFrame:
    return search.knn(vectors, query, limit, kind, metric)


def relevant_callees(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, function: str, query: list[float], limit: int) -> DataFrame:
    """Callees of a function that are among the functions with the nearest chunks."""
    return function_callees(Frames(nodes, edges), function).join(similar_chunks(nodes, edges, vectors, query, limit).select("id"), "id", "left_semi")
