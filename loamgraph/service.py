"""The engine as one object, and its request-level rules: defaults, limits kept within bounds, errors. No web server comes with it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.embedding import Provider, null_embedding
from loamgraph.operators import graph, lookup, search
from loamgraph.operators.graph import InvalidArgument
from loamgraph.functions.ids import node_id_of
from loamgraph.operators.ingest import Synchronizer, graph_views, nearest, refresh_graph, refresh_text
from loamgraph.operators.segments import SegmentedIndex
from loamgraph.operators.sqlapi import table_sql
from loamgraph.schema import REGISTRY, Category, Registry, canonical_entity
from loamgraph.session import settle
from loamgraph.sources.catalog import Catalog
from loamgraph.styles import type_styles
from loamgraph.sources.graph_store import GraphStore
from loamgraph.sources.store import Lake


class NotFound(LookupError):
    """What was asked for isn't there."""


#: Rows of each best list, by rows asked for.
OVERFETCH = 2
STATUS = {InvalidArgument: 400, NotFound: 404}


def status_of(error: Exception) -> int:
    return next((code for kind, code in STATUS.items() if isinstance(error, kind)), 500)


def within(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


class Engine:
    def __init__(self, spark: SparkSession, root: str, catalog: str = ":memory:", embed: Provider = null_embedding, registry: Registry = REGISTRY, buckets: int = 1):
        self.spark, self.embed, self.registry = spark, embed, registry
        self.lake, self.catalog = Lake(spark, root), Catalog(catalog)
        self.sync = Synchronizer(spark, self.lake, self.catalog, registry, buckets)
        self.root, self.buckets = root.rstrip("/"), buckets

    # -- views

    def views(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph_views(self.lake, self.registry)

    def graph(self) -> GraphStore:
        """Nodes (vectors too) and edges by either end, kept beside the tables and brought up to them."""
        return refresh_graph(self.sync, f"{self.root}/gold/graph", max(self.buckets, 4))

    def text_index(self, with_vectors: bool = False) -> SegmentedIndex:
        """BM25 over nodes' properties and labels, vector texts if asked for. Kept beside the tables and brought up to them by their net changes."""
        return refresh_text(self.sync, f"{self.root}/gold/text{'_and_vectors' if with_vectors else ''}", with_vectors, max(self.buckets, 4))

    @contextmanager
    def texts(self, query: str) -> Iterator[SegmentedIndex | search.TextIndex]:
        """What a search for ``query`` needs of the nodes' texts: ``text_index`` once that has been made, else a pass over them. An index takes many times the space of the tables, which
        pays when there are many searches and not for one."""
        if SegmentedIndex(self.spark, f"{self.root}/gold/text").exists():
            yield self.text_index()
            return
        nodes = self.views()[0].select("id", "label", F.concat_ws(" ", "properties", "label").alias("text"))
        with search.scan(nodes, query) as index:
            yield index

    def embed_query(self, text: str) -> list[float]:
        row = self.spark.createDataFrame([(text,)], "t string").select(self.embed(F.col("t")).alias("e")).first()
        return list(row["e"] or [])

    # -- tables

    def tables(self, prefix: str = "") -> list:
        return self.lake.list_tables(prefix)

    def query_table(self, name: str, filters: list[tuple[str, object]], limit: int | None = None) -> DataFrame:
        return lookup.filtered_scan(self._table(name), filters, limit)

    def sql(self, name: str, text: str) -> DataFrame:
        return table_sql(self._table(name), name, text)

    def show(self, name: str, rows: int = 20) -> DataFrame:
        """``rows`` 0: all."""
        table = self._table(name)
        return table.limit(rows) if rows else table

    def row_count(self, name: str) -> int:
        return self._table(name).count()

    def schema(self, name: str) -> list[tuple[str, str, bool]]:
        return sorted((f.name, f.dataType.simpleString(), f.nullable) for f in self._table(name).schema.fields)

    def _table(self, name: str) -> DataFrame:
        table = self.lake.open(name)
        if table is None:
            raise NotFound(name)
        return table.read()

    def search_index(self, kind: str, query: str, limit: int, raw: bool = False) -> DataFrame:
        table = self.lake.open(f"silver/index/{canonical_entity(kind)}")
        if table is None:
            return self.spark.createDataFrame([], "id string")
        return lookup.index_search(table.read(), query, limit, raw)

    # -- requests

    def status(self) -> dict:
        nodes, edges, vectors = self.views()
        return {
            "db_stats": graph.graph_counts(nodes, edges, vectors).first().asDict(), "entity_count": len(self.sync.known_entities()),
            "registered_fetchers": self.sync.registered(),
        }

    def overview(self, limit: int = 30) -> tuple[DataFrame, DataFrame]:
        nodes, edges, _ = self.views()
        picked, among = lookup.overview(nodes, edges, limit)
        return lookup.node_view(picked), lookup.edge_view(among)

    def types(self) -> list[dict]:
        return type_styles()

    def visual(self, k: int | None = None, node_prop: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(id, label, title; id, label, source, target): the first ``k`` nodes by id (all without it), titled by a property, and the edges among them."""
        store = self.graph()
        picked, among = lookup.first_nodes(store.nodes, store.edges, k)
        title = lookup.json_field(F.col("properties"), node_prop) if node_prop else F.lit(None).cast("string")
        return picked.select("id", "label", title.alias("title")), lookup.edge_view(among)

    def graph_search(self, query: str, limit: int = 20, types: str | None = None) -> DataFrame:
        names = lookup.parse_list(types)
        if not query.strip() and not names:
            return self.overview(limit)[0]
        specs = [self.registry.entity(n) for n in names] if names else self.registry.entities(Category.NODE)
        tables = {s.entity_type: t.read() for s in specs if s is not None and (t := self.lake.open(s.index_table)) is not None}
        hits = lookup.graph_search(tables, query, within(limit, 1, 100)) if tables else None
        nodes = self.views()[0]
        return lookup.node_view(nodes.limit(0) if hits is None else nodes.join(F.broadcast(hits.select("id")), "id", "left_semi"))

    def node(self, node_id: str) -> dict:
        """A node or a vector. Only the bucket of its id is read."""
        row = lookup.node_by_id(self.graph().nodes_of([node_id]), None, node_id).first()
        if row is None:
            raise NotFound(node_id)
        return row.asDict()

    def node_by_keys(self, kind: str, keys: dict[str, object]) -> dict | None:
        spec = self.registry.entity(kind)
        if spec is None:
            raise InvalidArgument(f"unknown type: {kind}")
        table = self.lake.open(spec.table)
        wanted = node_id_of(spec.entity_type, **{k: lookup.text_of(v) for k, v in keys.items()})
        row = lookup.node_by_keys(self.graph().nodes_of([wanted]), table.read() if table else None, spec, keys).first()
        return row and row.asDict()

    def neighbours(self, node: str, types: str | None = None, direction: str = "both", limit: int = 20) -> DataFrame:
        return graph.neighbours_in(self.graph(), node, lookup.parse_edge_types(types), direction, limit)

    def subgraph(self, node: str, types: str | None = None, depth: int = 1, nodes_limit: int = 150, edges_limit: int = 200) -> graph.Subgraph:
        found = graph.bfs(self.graph(), node, lookup.parse_edge_types(types), depth, nodes_limit, edges_limit)
        if not found.nodes.head(1):
            raise NotFound(node)
        return found

    def shortest_path(self, source: str, target: str, label: str | None = None) -> dict:
        """Over nodes; vectors are not on any path."""
        store = self.graph().hiding([s.entity_type for s in self.registry.entities(Category.VECTOR)])
        path = graph.path_between(store, source, target, label)
        return {"found": path is not None, **(path or {"length": 0, "nodes": [], "edges": []})}

    def hybrid_types(self) -> list[str]:
        return sorted(s.entity_type for s in self.registry.entities() if s.category is not Category.EDGE)

    def hybrid_all(self, query: str, types: str | None = None, alpha: float = 0.5, limit: int = 20) -> DataFrame:
        names = [canonical_entity(t) for t in lookup.parse_list(types)] or self.hybrid_types()
        unknown = [n for n in names if self.registry.entity(n) is None]
        if unknown:
            raise InvalidArgument(f"unknown types: {', '.join(unknown)}")
        if not query.strip():
            return self.spark.createDataFrame([], "id string, label string, score double, summary string")
        specs, vector, limit = [self.registry.entity(n) for n in dict.fromkeys(names)], self.embed_query(query), within(limit, 1, 200)
        near, vectors = nearest(self.lake, [s for s in specs if s.category is Category.VECTOR], vector, OVERFETCH * limit)
        texts = any(s.category is Category.NODE for s in specs)  # of vectors the index has none
        with self.texts(query) if texts else nullcontext() as index:
            hits, _ = settle(search.hybrid_multi(index, near, names, query, vector, within(alpha * 1000, 0, 1000) / 1000, limit, OVERFETCH))
        return search.with_summaries(hits, graph_views(self.lake, self.registry, names)[0], vectors)

    def bm25(self, kind: str, query: str, limit: int = 20) -> DataFrame:
        with self.texts(query) as index:
            return settle(search.bm25(index, query, limit, canonical_entity(kind)))[0]

    def vectors_by_text(self, kind: str, text: str, limit: int = 20) -> DataFrame:
        vectors = self.views()[2]
        return search.knn(vectors, self.embed_query(text) if text.strip() else [], limit, canonical_entity(kind))

    def edge_statistics(self) -> DataFrame:
        """Rows and table version by edge type."""
        versions = [(f"edge_{n}", self.lake.table(f"silver/edges/{n}").version()) for n in self.lake.types_below("silver/edges")]
        frame = self.spark.createDataFrame(versions, "label string, version int")
        return graph.edge_statistics(self.views()[1], frame)

    def readiness(self, uris: list[tuple[str, str | None]]) -> list[dict]:
        return [{"entity_uri": uri, "is_fresh": self.sync.is_fresh(uri, fetcher)} for uri, fetcher in uris]

    def trigger_sync(self, fetcher: str, params: dict, uri: str, kind: str, ttl: int = 3600) -> dict:
        self.sync.sync(fetcher, params, uri, kind, ttl)
        return {"ok": True}
