"""Lookups and predicates: filtered scans, index search, nodes by id and by keys, display fields, small parsers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.functions.ids import is_uuid, node_id_of
from loamgraph.functions.text import first_text
from loamgraph.operators.graph import InvalidArgument
from loamgraph.schema import EntitySpec

# Where names and summaries are looked for, in order.
NAME_FIELDS = "display_name name title slug identifier path file_path repo repository value".split()
NODE_SUMMARY_FIELDS = "title name label signature path".split()
VECTOR_SUMMARY_FIELDS = "text body summary content preview".split()


def matches(column: Column, value: object) -> Column:
    """Equality of text; null matches null."""
    return column.cast("string").eqNullSafe(F.lit(None if value is None else text_of(value)))


def text_of(value: object) -> str:
    """A scalar as text, as JSON writes it."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def typed_equal(df: DataFrame, name: str, value: object) -> Column:
    """Equality that reaches the scan: the literal is cast to the column's type, never the column to text."""
    kind = df.schema[name].dataType
    if value is None:
        return F.col(name).isNull()
    literal = F.lit(value) if isinstance(kind, T.StringType) and isinstance(value, str) else F.lit(text_of(value)).try_cast(kind)
    return F.col(name) == literal


def filtered_scan(df: DataFrame, filters: list[tuple[str, object]], limit: int | None = None) -> DataFrame:
    """All conditions at once; a value that is no value of the column's type matches nothing."""
    out = reduce(lambda d, f: d.filter(typed_equal(d, *f)), filters, df)
    return out if limit is None else out.limit(limit)


def like_literal(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def index_search(df: DataFrame, query: str, limit: int, raw: bool = False, newest: str = "updated_at") -> DataFrame:
    """Rows in which a string column contains the query, case aside; newest first. ``raw``: ``%`` and ``_`` stay wildcards."""
    q = query.strip().lower()
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not q or limit <= 0 or not columns:
        return df.limit(0)
    pattern = f"%{q if raw else like_literal(q)}%"
    found = df.filter(reduce(lambda a, b: a | b, [F.lower(F.col(c)).like(pattern) for c in columns]))
    order = ([F.desc(newest)] if newest in df.columns else []) + [F.col(c) for c in df.columns if c != newest and c in ("id", *columns)]
    return found.orderBy(*order).limit(limit)


def by_ids(df: DataFrame, id_col: str, ids: list[str]) -> DataFrame:
    """Rows whose id is in the list; nulls are no ids."""
    wanted = [i for i in ids if i is not None]
    if not wanted:
        return df.limit(0)
    if len(wanted) <= 1000:
        return df.filter(F.col(id_col).isin(wanted))
    listed = df.sparkSession.createDataFrame([(i,) for i in set(wanted)], f"{id_col} string")
    return df.join(F.broadcast(listed) if len(wanted) <= 100_000 else listed, id_col, "left_semi")


def node_by_id(nodes: DataFrame, vectors: DataFrame | None, node_id: str) -> DataFrame:
    """The node, or the vector as a node with label ``VECTOR`` where it has none; at most one row of id, label, properties."""
    found = nodes.filter(F.col("id") == node_id).select("id", "label", "properties", F.lit(0).alias("_o"))
    if vectors is not None:
        label = F.coalesce(F.col("label"), F.lit("VECTOR")) if "label" in vectors.columns else F.lit("VECTOR")
        found = found.unionByName(vectors.filter(F.col("id") == node_id).select("id", label.alias("label"), "properties", F.lit(1).alias("_o")))
    return found.orderBy("_o").limit(1).drop("_o")


def node_by_keys(nodes: DataFrame, table: DataFrame | None, spec: EntitySpec, keys: dict[str, object]) -> DataFrame:
    """By the hash of the keys in the order given, else by the keys themselves."""
    if not keys:
        raise InvalidArgument("no keys")
    wanted = node_id_of(spec.entity_type, **{k: text_of(v) for k, v in keys.items()})
    found = nodes.filter(F.col("id") == wanted).select("id", "label", "properties", F.lit(0).alias("_o"))
    if table is not None:
        scanned = filtered_scan(table, list(keys.items()))
        props = F.to_json(F.struct(*[F.col(c) for c in table.columns]))
        found = found.unionByName(scanned.select(F.lit(wanted).alias("id"), F.lit(spec.entity_type).alias("label"), props.alias("properties"), F.lit(1).alias("_o")))
    return found.orderBy("_o").limit(1).drop("_o")


def lookup_via_index(index: DataFrame, entity: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """id -> keys -> entity row; the entity's side is filtered by the keys found."""
    picked = by_ids(index, "id", ids).select("id", *[F.col(k).alias(f"_k_{k}") for k in keys])
    on = reduce(lambda a, b: a & b, [entity[k].cast("string") == picked[f"_k_{k}"] for k in keys])
    return entity.join(F.broadcast(picked) if len(ids) <= 100_000 else picked, on).drop(*[f"_k_{k}" for k in keys])


def json_field(properties: Column, name: str) -> Column:
    return F.get_json_object(properties, f"$.{name}")


def display_name(df: DataFrame, properties: str = "properties", title: str | None = None, id_col: str = "id") -> Column:
    """The first name field that is not blank, then the title, then the id."""
    fields = [json_field(F.col(properties), f) for f in NAME_FIELDS]
    return first_text(*fields, *([F.col(title)] if title else []), F.col(id_col))


def summary(properties: Column, fields: list[str]) -> Column:
    return first_text(*[json_field(properties, f) for f in fields])


def node_view(nodes: DataFrame) -> DataFrame:
    """id, label (``Unknown`` if there is none), title, display_name, properties."""
    title = first_text(json_field(F.col("properties"), "title"), F.col("id"))
    return nodes.select(
        "id", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.lit("Unknown")).alias("label"), title.alias("title"),
        display_name(nodes).alias("display_name"), "properties",
    )


def edge_view(edges: DataFrame) -> DataFrame:
    """id, label (``EDGE`` if it is blank), source, target; other names of the columns are understood."""
    has = set(edges.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in has], F.lit(None).cast("string"))
    label = F.coalesce(F.nullif(F.trim(pick("label")), F.lit("")), F.lit("EDGE"))
    return edges.select(pick("id", "title").alias("id"), label.alias("label"), pick("from_node_id", "from").alias("source"), pick("to_node_id", "to").alias("target"))


def nodes_of_label(nodes: DataFrame, label: str, limit: int = 20) -> DataFrame:
    return nodes.filter(F.col("label") == label).orderBy("id").limit(limit)


def graph_search(tables: dict[str, DataFrame], query: str, limit: int, types: list[str] | None = None) -> DataFrame:
    """Index search over several types: types in order, each filled before the next; one row per id. id, label, place."""
    names = types or sorted(tables)
    parts = []
    for place, name in enumerate(names):
        if name in tables:
            found = index_search(tables[name], query, limit)
            parts.append(found.select(F.col("id"), F.lit(name).alias("label"), F.lit(place).alias("_t")))
    if not parts:
        raise InvalidArgument("no such types")
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy("id").agg(F.min(F.struct("_t", "label")).alias("m")).orderBy("m", "id").limit(limit).select("id", "m.label")


def entity_types(nodes: DataFrame) -> DataFrame:
    return nodes.select("label").distinct().orderBy("label")


def parse_edge_types(text: str | None) -> list[str]:
    """Names set off by commas, semicolons or white space; none: no filter."""
    return [p for p in re.split(r"[,;\s]+", text or "") if p]


def parse_list(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def parse_key_value(text: str) -> tuple[str, str]:
    key, sep, value = text.partition("=")
    if not sep or not key.strip():
        raise InvalidArgument(f"not key=value: {text}")
    return key.strip(), value


def first_nodes(nodes: DataFrame, edges: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``k`` nodes by id, all without it, and the edges among them."""
    picked = nodes if k is None else nodes.orderBy("id").limit(k)
    ids = picked.select("id") if k is None or k > 100_000 else F.broadcast(picked.select("id"))
    among = edges.join(
        ids.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi",
    ).join(ids.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi")
    return picked, among


def overview(nodes: DataFrame, edges: DataFrame, limit: int = 30) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id and the edges among them; the limit is kept within 1 and 300."""
    return first_nodes(nodes, edges, max(1, min(300, limit)))


def valid_uuid(text: str) -> str:
    if not is_uuid(text):
        raise InvalidArgument(f"not a UUID: {text}")
    return text
