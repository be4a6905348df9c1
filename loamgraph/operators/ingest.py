"""Ingestion: entity batches to tables, node indexes, vectors with stable ids, rule edges, freshness and replay."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Container
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.ids import edge_id, node_id, vector_uuid
from loamgraph.operators.graph import InvalidArgument
from loamgraph.operators.search import similarity
from loamgraph.operators.segments import SegmentedIndex
from loamgraph.schema import REGISTRY, Category, EntitySpec, Registry, VectorRule
from loamgraph.session import SMALL, discard, keep, settle, swept
from loamgraph.sources.catalog import Catalog
from loamgraph.sources.graph_store import GraphStore
from loamgraph.sources.store import Lake, VersionedTable, last_wins

UUID_PATTERN = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
DEFAULT_TTL = 3600
#: Ids are hexadecimal text, which this codec brings near its sixteen bytes.
CODEC = "zstd"


@dataclass
class GraphData:
    """Batches in order. A batch is None if there are no rows."""

    batches: list[tuple[EntitySpec, DataFrame]] = field(default_factory=list)

    def add(self, spec: EntitySpec, rows: DataFrame | None) -> GraphData:
        if rows is not None:
            self.batches.append((spec, rows))
        return self


@dataclass
class Progress:
    """How far a lake has got with some batches."""

    written: dict[tuple[int, str], int] = field(default_factory=dict)  # by batch and table, the version that has it
    before: dict[int, int] = field(default_factory=dict)  # of the index that a batch of vectors is resolved with


@dataclass
class PanelData:
    table: str
    rows: DataFrame


class Fetcher(Protocol):
    """A source of facts."""

    name: str

    def capability(self) -> dict: ...

    def probe(self, uri: str) -> dict | None:
        """{fresh, anchor_key, anchor} as far as they are known."""

    def fetch(self, spark: SparkSession, params: dict) -> GraphData | PanelData: ...


def records(spark: SparkSession, spec: EntitySpec, rows: list[dict]) -> DataFrame | None:
    """Typed rows; fields that are left out are null. No rows: None."""
    return spark.createDataFrame([tuple(r.get(n) for n in spec.schema.names) for r in rows], spec.schema) if rows else None


def conform(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """The declared columns in order and type."""
    has = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in spec.schema.fields])


def node_index(rows: DataFrame, spec: EntitySpec, now: Column | None = None) -> DataFrame:
    """id, keys as text, updated_at. A given id counts if it is a UUID; rows with a null key or a bad id are left out."""
    keys = [F.col(k).cast("string") for k in spec.keys]
    hashed = node_id(spec.entity_type, [(k, F.col(k)) for k in spec.keys])
    own = F.when(F.col("id").isNull(), hashed).when(F.col("id").rlike(UUID_PATTERN), F.lower("id")) if "id" in rows.columns else hashed
    listed = rows.select(
        own.alias("id"), *[k.alias(n) for k, n in zip(keys, spec.keys, strict=True)], (F.current_timestamp() if now is None else now).alias("updated_at"),
    )
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in ("id", *spec.keys)])
    return listed.filter(whole)


def as_nodes(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """The rows as nodes: id, label, properties (JSON). A missing key counts as empty text in the hash."""
    hashed = node_id(spec.entity_type, [(k, F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in spec.keys])
    own = F.coalesce(F.col("id"), hashed) if "id" in rows.columns else hashed
    return rows.select(own.alias("id"), F.lit(spec.entity_type).alias("label"), F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("properties"))


def as_edges(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """The rows as edges; rows without two valid ends are left out."""
    ends = F.col("from_node_id").rlike(UUID_PATTERN) & F.col("to_node_id").rlike(UUID_PATTERN)
    own = F.coalesce(F.col("id"), edge_id(spec.entity_type, F.col("from_node_id"), F.col("to_node_id")))
    return rows.filter(ends).select(own.alias("id"), F.lit(spec.entity_type).alias("label"), "from_node_id", "to_node_id", "from_node_type", "to_node_type")


def resolve_vectors(rows: DataFrame, spec: EntitySpec, index: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows with their ids, new index rows).

    An embedding id that is known keeps its vector's id; of rows that share one, all get the same. Rows without an embedding
    whose id isn't known are kept (their given id, or none) but get no vector: column ``has_vector`` is false.
    """
    known = index.select("embedding_id", F.col("vector_uuid").alias("_known")) if index is not None else None
    joined = rows.join(known, "embedding_id", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("string"))
    usable = F.coalesce(F.size("embedding"), F.lit(0)) > 0
    fresh = F.when(usable & F.col("embedding_id").isNotNull(), vector_uuid(spec.entity_type, F.col("embedding_id")))
    made = joined.withColumn("vector_uuid", F.coalesce("_known", fresh))
    out = made.withColumn("id", F.coalesce("id", "vector_uuid")).withColumn("has_vector", F.col("vector_uuid").isNotNull())
    new = made.filter(F.col("_known").isNull() & F.col("vector_uuid").isNotNull()).select("embedding_id").distinct()
    new = new.withColumn("vector_uuid", vector_uuid(spec.entity_type, F.col("embedding_id")))
    return out.select(*rows.columns, "vector_uuid", "has_vector"), new


def rule_edges(vectors: DataFrame, spec: EntitySpec, rules: list[VectorRule], now: Column | None = None, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """Edges by type from nodes to the vectors (``resolve_vectors`` rows); a rule whose columns are missing or null gives none."""
    out: dict[str, DataFrame] = {}
    at = F.current_timestamp() if now is None else now
    for rule in rules:
        needed = [c for _, c in rule.mapping] + ([rule.id_column, rule.type_column] if rule.id_column else [])
        if any(c not in vectors.columns for c in needed):
            continue
        if rule.id_column:
            source, kind = F.col(rule.id_column), F.element_at(F.split(F.col(rule.type_column), "::"), 1)
        else:
            source, kind = node_id(rule.node_type, [(k, F.col(c)) for k, c in rule.mapping]), F.lit(rule.node_type)
        identity = F.coalesce("id", "vector_uuid")
        edges = (
            vectors.filter("has_vector")
            .withColumns({"_from": source, "_type": kind})
            .filter(F.col("_from").isNotNull())
            .select(
                edge_id(rule.edge_type, F.col("_from"), identity).alias("id"),
                F.col("_from").alias("from_node_id"),
                F.col("vector_uuid").alias("to_node_id"),
                F.col("_type").alias("from_node_type"),
                F.lit(spec.entity_type).alias("to_node_type"),
                at.alias("created_at"),
                at.alias("updated_at"),
            )
            .dropDuplicates(["id"])
        )
        out[rule.edge_type] = out[rule.edge_type].unionByName(edges) if rule.edge_type in out else edges
    return out


def freshness(requests: DataFrame, readiness: DataFrame, anchors: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    """entity_uri, fetcher, is_fresh for each request (entity_uri, fetcher).

    Fresh: the record's time to live has not passed, and the anchor holds: the remote one equals ours; with none remote, what the probe says, else
    yes. No record, a failed probe or an unknown fetcher: stale. No fetcher asked for: the anchor holds.
    ``probes``: entity_uri, fetcher, known, failed, fresh, remote_anchor.
    """
    local = anchors.select("entity_uri", "fetcher", F.col("anchor_value").alias("local_anchor"))
    joined = requests.join(
        readiness.select("entity_uri", "last_synced_at", "ttl_seconds"), "entity_uri", "left",
    ).join(local, ["entity_uri", "fetcher"], "left").join(probes, ["entity_uri", "fetcher"], "left")
    alive = (F.lit(now) - F.col("last_synced_at")) < F.coalesce("ttl_seconds", F.lit(DEFAULT_TTL))
    anchored = (
        F.when(F.col("fetcher").isNull(), True)
        .when(~F.coalesce("known", F.lit(False)) | F.coalesce("failed", F.lit(False)), False)
        .when(F.col("remote_anchor").isNotNull(), F.coalesce(F.col("remote_anchor") == F.col("local_anchor"), F.lit(False)))
        .otherwise(F.coalesce("fresh", F.lit(True)))
    )
    return joined.select("entity_uri", "fetcher", F.coalesce(alive & anchored, F.lit(False)).alias("is_fresh"))


class Synchronizer:
    def __init__(self, spark: SparkSession, lake: Lake, catalog: Catalog, registry: Registry = REGISTRY, buckets: int = 1):
        self.spark, self.lake, self.catalog, self.registry, self.buckets = spark, lake, catalog, registry, buckets
        self.fetchers: dict[str, Fetcher] = {}

    def register(self, fetcher: Fetcher) -> None:
        """By name; the same name again replaces."""
        self.fetchers[fetcher.name] = fetcher

    def registered(self) -> list[str]:
        return sorted(self.fetchers)

    def known_entities(self) -> list[dict]:
        return self.catalog.rows("ingestion_offsets")

    def table(self, spec: EntitySpec):
        return self.lake.table(spec.table, list(spec.keys), self.buckets, codec=CODEC)

    def process(self, graph: GraphData, tables: Container[str] | None = None, progress: Progress | None = None) -> None:
        """Each batch in order: table, offset, index; vectors also rule edges. ``tables``: only what these get; a later call with the same ``progress`` writes what is left. A source
        is asked once: its rows are written to their table first, and what else is made of them is made of what that commit wrote."""
        progress = Progress() if progress is None else progress
        for n, (spec, rows) in enumerate(graph.batches):
            if spec.category is Category.VECTOR:
                self._vectors(progress, n, spec, rows, tables)
                continue
            due = self._due(progress, n, [spec.table, spec.index_table] if spec.category is Category.NODE else [spec.table], tables)
            if due:
                held = self._rows(progress, n, spec, conform(rows, spec))
            if spec.category is Category.NODE and spec.index_table in due:
                index = last_wins(node_index(held, spec), ["id"], [F.col("updated_at")])
                progress.written[n, spec.index_table] = self.lake.table(spec.index_table, ["id"], self.buckets, codec=CODEC).write(index, dealt=False)
                self.catalog.ensure_offset(spec.index_table, spec.entity_type, spec.category.value, ["id"])

    @staticmethod
    def _due(progress: Progress, n: int, own: list[str], tables: Container[str] | None) -> list[str]:
        return [t for t in own if (n, t) not in progress.written and (tables is None or t in tables)]

    def _rows(self, progress: Progress, n: int, spec: EntitySpec, rows: DataFrame) -> DataFrame:
        """A batch as its table has got it; written now if it hasn't."""
        table = self.table(spec)
        if (n, spec.table) not in progress.written:
            progress.written[n, spec.table] = table.write(rows, dealt=False)
            self.catalog.ensure_offset(spec.table, spec.entity_type, spec.category.value, list(spec.keys))
        return table.added(progress.written[n, spec.table])

    def _vectors(self, progress: Progress, n: int, spec: EntitySpec, rows: DataFrame, tables: Container[str] | None) -> None:
        if self.registry.entity(spec.entity_type) is None:
            raise InvalidArgument(f"unknown vector type: {spec.entity_type}")
        rules = self.registry.vector_rules(spec.entity_type)
        due = self._due(progress, n, [spec.table, *dict.fromkeys(self.registry.edge(r.edge_type).table for r in rules), spec.index_table], tables)
        if not due:
            return
        index_table, at = self.lake.table(spec.index_table, ["embedding_id"], self.buckets, codec=CODEC), None
        known = index_table.read(before) if (before := progress.before.setdefault(n, index_table.version())) >= 0 else None
        held = self._rows(progress, n, spec, resolve_vectors(conform(rows, spec), spec, known)[0].select(*spec.schema.names))
        resolved, new = resolve_vectors(held, spec, known)  # once more, and with the same ids
        if known is not None and len(due) > 1:
            resolved, at = keep(resolved)
        for edge_type, edges in rule_edges(resolved, spec, rules, registry=self.registry).items():
            edge = self.registry.edge(edge_type)
            if edge.table in due:
                progress.written[n, edge.table] = self.table(edge).write(conform(edges, edge), dealt=False)
                self.catalog.ensure_offset(edge.table, edge.entity_type, edge.category.value, ["id"])
        if spec.index_table in due:
            progress.written[n, spec.index_table] = index_table.write(new.withColumn("updated_at", F.current_timestamp()), dealt=False)
        if at:
            discard(self.spark, at)

    def sync(self, name: str, params: dict, uri: str, entity_type: str, ttl: int = DEFAULT_TTL) -> None:
        """Fetch, write, mark fresh; the task's log ends in SUCCESS or FAILED."""
        if name not in self.fetchers:
            raise InvalidArgument(f"unknown fetcher: {name}")
        fetcher, task = self.fetchers[name], self.catalog.start_task(f"sync:{name}", uri)
        try:
            got = fetcher.fetch(self.spark, params)
            if isinstance(got, PanelData):
                self.lake.table(got.table).write(got.rows)
            else:
                self.process(got)
            self.catalog.set_readiness(uri, entity_type, ttl)
            seen = fetcher.probe(uri)
            if seen and seen.get("anchor") is not None:
                self.catalog.set_anchor(uri, name, seen.get("anchor_key", "anchor"), seen["anchor"])
        except Exception as e:
            self.catalog.end_task(task, "FAILED", str(e)[:500])
            raise
        self.catalog.end_task(task, "SUCCESS")

    def is_fresh(self, uri: str, fetcher: str | None = None, now: int | None = None) -> bool:
        """The same rule as ``freshness``, for one entity, with a probe of the source now."""
        record, at = self.catalog.readiness(uri), int(time.time()) if now is None else now
        if record is None or at - record["last_synced_at"] >= (DEFAULT_TTL if record["ttl_seconds"] is None else record["ttl_seconds"]):
            return False
        if fetcher is None:
            return True
        if fetcher not in self.fetchers:
            return False
        try:
            seen = self.fetchers[fetcher].probe(uri) or {}
        except Exception:  # noqa: BLE001  a source that can't be asked is stale, whatever the reason
            return False
        if seen.get("anchor") is not None:
            return self.catalog.anchor(uri, fetcher, seen.get("anchor_key", "anchor")) == seen["anchor"]
        return bool(seen.get("fresh", True))

    def replay(self, apply: Callable[[EntitySpec | None, str, int, DataFrame], None]) -> dict[str, int]:
        """Hand every change since a table's offset to ``apply``, version by version, and move the offset after each. Rows have ``_change``: insert, update or delete (the row as it
        was); a commit that changed nothing hands over no rows."""
        out = {}
        for row in self.known_entities():
            table = self.lake.table(row["table_path"], self._keys(row))
            at = row["last_version"]
            latest = table.version()
            for version in range(at + 1, latest + 1):
                apply(self.registry.specs.get(row["entity_type"]), row["table_path"], version, table.row_changes(version))
                self.catalog.set_offset(row["table_path"], version)
            out[row["table_path"]] = max(at, latest)
        return out

    @staticmethod
    def _keys(row: dict) -> list[str]:
        return json.loads(row["primary_keys"])


VECTORS = "id string, label string, text string, embedding array<float>, properties string"


def vector_rows(lake: Lake, rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """Vectors under the ids they are known by: id, label, text, embedding, properties, embedding_id."""
    props = F.to_json(F.struct(*[F.col(c) for c in spec.schema.names if c != "embedding"]))
    index, hashed = lake.open(spec.index_table), vector_uuid(spec.entity_type, F.col("embedding_id"))
    if index:  # an id that follows from its embedding id isn't moved with it
        own = index.read().select("embedding_id", F.when(F.col("vector_uuid") != hashed, F.col("vector_uuid")).alias("_own"))
        with_ids = rows.join(own, "embedding_id").withColumn("vector_uuid", F.coalesce("_own", hashed))
    else:
        with_ids = rows.withColumn("vector_uuid", F.col("id"))
    return with_ids.filter(F.size("embedding") > 0).select(
        F.col("vector_uuid").alias("id"), F.lit(spec.entity_type).alias("label"), "text", "embedding", props.alias("properties"), "embedding_id",
    )


def nearest(lake: Lake, specs: list[EntitySpec], vector: list[float], best: int, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """(id, label, similarity of the ``best`` vectors of each type, ties by id; the rows of these as ``vector_rows`` has them).

    Ids stand in the vectors' indexes. Only rows at least as near as the one in place ``best`` are looked up there; if too few of them are found in it, all rows are.
    """
    spark, near, rows_of = lake.spark, [], []
    for spec in specs:
        table = lake.open(spec.table)
        if table is None or not vector:
            continue
        every = conform(table.read(), spec).filter(F.size("embedding") == len(vector))
        score = similarity(F.col("embedding"), vector, metric)
        found = lambda rows, spec=spec, score=score: settle(
            vector_rows(lake, rows, spec).select("id", "label", score.alias("similarity"), "embedding_id").orderBy(F.desc("similarity"), "id").limit(best),
        )
        with swept(spark):
            top = every.select(score.alias("s")).orderBy(F.desc("s")).limit(best).agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n")).first()
            picked, n = found(every.filter(score >= F.lit(top["least"])) if top["n"] == best else every)
            if n < best == top["n"]:
                picked, n = found(every)
        near.append(picked)
        named = [r["embedding_id"] for r in picked.select("embedding_id").collect()] if n <= SMALL else None
        rows = every.filter(F.col("embedding_id").isin(named)) if named is not None else every.join(picked.select("embedding_id").distinct(), "embedding_id", "left_semi")
        rows_of.append(vector_rows(lake, rows, spec).drop("embedding_id"))
    merge = lambda parts, schema: reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], schema)
    return merge(near, "id string, label string, similarity double, embedding_id string").drop("embedding_id"), merge(rows_of, VECTORS)


def graph_views(lake: Lake, registry: Registry = REGISTRY, types: Container[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, vectors) over all tables that exist (of ``types``)."""
    nodes, edges, vectors = [], [], []
    for spec in registry.entities():
        table = lake.open(spec.table) if types is None or spec.entity_type in types else None
        if table is None:
            continue
        rows = conform(table.read(), spec)
        if spec.category is Category.NODE:
            nodes.append(as_nodes(rows, spec))
        elif spec.category is Category.EDGE:
            edges.append(as_edges(rows, spec))
        else:
            vectors.append(vector_rows(lake, rows, spec).drop("embedding_id"))
    spark = lake.spark
    merge = lambda parts, schema: reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], schema)
    return (
        merge(nodes, "id string, label string, properties string"),
        merge(edges, "id string, label string, from_node_id string, to_node_id string, from_node_type string, to_node_type string"),
        merge(vectors, VECTORS),
    )


def refresh_graph(sync: Synchronizer, root: str, buckets: int = 32) -> GraphStore:
    """The stored graph below ``root``, brought up to the tables' versions: only net changes since the versions it has seen are read and applied."""
    store, lake, registry = GraphStore(sync.spark, root, buckets), sync.lake, sync.registry
    seen_table = VersionedTable(sync.spark, f"{root}/seen")
    seen = {r["name"]: r["version"] for r in seen_table.read().collect()} if seen_table.exists() else {}
    now = {spec.table: sync.table(spec).version() for spec in registry.entities()}
    if seen == now and store.exists():
        return store
    if not store.exists():
        seen = {}
        none = "id string, label string, properties string", "id string, label string, from_node_id string, to_node_id string, from_node_type string, to_node_type string"
        store.upsert(*[sync.spark.createDataFrame([], schema) for schema in none])
    put_nodes, put_edges, gone_nodes, gone_edges = [], [], [], []
    for spec in registry.entities():
        before = seen.get(spec.table, -1)
        if now[spec.table] <= before:
            continue
        table = sync.table(spec)
        changed = table.net_changes(before) if before >= 0 else table.read().withColumn("_change", F.lit("insert"))
        kept, dropped = (conform(changed.filter(c), spec) for c in ("_change <> 'delete'", "_change = 'delete'"))
        if spec.category is Category.EDGE:
            put_edges.append(as_edges(kept, spec))
            if before >= 0:
                gone_edges += [as_edges(rows, spec).select("id") for rows in (dropped, conform(changed.filter("_change = 'update'"), spec))]
        else:
            rows_of = (lambda rows, spec=spec: as_nodes(rows, spec)) if spec.category is Category.NODE else (lambda rows, spec=spec: vector_rows(lake, rows, spec))
            put_nodes.append(rows_of(kept).select("id", "label", "properties"))
            if before >= 0:
                gone_nodes.append(rows_of(dropped).select("id"))
    merge = lambda parts: reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    store.delete(merge(gone_nodes), merge(gone_edges))
    store.upsert(merge(put_nodes), merge(put_edges))
    seen_table.replace(sync.spark.createDataFrame(list(now.items()), "name string, version long"))
    return store


def refresh_text(sync: Synchronizer, root: str, with_vectors: bool = False, buckets: int = 32) -> SegmentedIndex:
    """The text index below ``root`` over nodes' properties and labels (and vectors' texts), brought up to the tables' versions: only changed rows are cut into words."""
    index, lake, registry = SegmentedIndex(sync.spark, root, "string", buckets), sync.lake, sync.registry
    specs = [s for s in registry.entities() if s.category is Category.NODE or (with_vectors and s.category is Category.VECTOR)]
    seen, now = index.facts.get("tables", {}), {s.table: sync.table(s).version() for s in specs}
    if seen == now and index.exists():
        return index
    put, gone = [], []
    for spec in specs:
        before = seen.get(spec.table, -1)
        if now[spec.table] <= before:
            continue
        table = sync.table(spec)
        changed = table.net_changes(before) if before >= 0 else table.read().withColumn("_change", F.lit("insert"))
        kept, dropped = (conform(changed.filter(c), spec) for c in ("_change <> 'delete'", "_change = 'delete'"))
        if spec.category is Category.NODE:
            text_of = lambda rows, spec=spec: as_nodes(rows, spec).select("id", "label", F.concat_ws(" ", "properties", "label").alias("text"))
        else:
            text_of = lambda rows, spec=spec: vector_rows(lake, rows, spec).select("id", "label", "text")
        put.append(text_of(kept))
        if before >= 0:
            gone.append(text_of(dropped).select("id"))
    merge = lambda parts: reduce(lambda a, b: a.unionByName(b), parts) if parts else None
    index.update(merge(put), merge(gone), label_col="label", facts={"tables": now})
    return index
