"""Stable identifiers as Column expressions: name-based UUIDs (version 5), without any Python function at run time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of RFC 4122.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value written, and computed, once: a lambda's variable stands for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def uuid5(name: Column, namespace: str = NAMESPACE_OID) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    return let(digest, _dashed)  # an id of an id of an id has one digest in it for each, not one for each use


def _dashed(h: Column) -> Column:
    dash = F.lit("-")
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(h, 1, 8), dash, F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), dash, variant, F.substring(h, 18, 3), dash,
        F.substring(h, 21, 12),
    )


def node_name(entity_type: str, keys: list[tuple[str, Column]]) -> Column:
    """``type|k1=v1|k2=v2`` with keys in the order given; null if a key is null."""
    parts = [F.lit(entity_type)]
    for name, value in keys:
        parts += [F.lit(f"|{name}="), value.cast("string")]
    return F.concat(*parts)


def node_id(entity_type: str, keys: list[tuple[str, Column]]) -> Column:
    return uuid5(node_name(entity_type, keys))


def edge_id(label: Column | str, source: Column, target: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return uuid5(F.concat(label, F.lit("|"), source, F.lit("|"), target))


def readme_embedding_id(full_name: Column, sha: Column, start: Column, end: Column, index: Column) -> Column:
    return uuid5(
        F.concat(F.lit("readme|"), full_name, F.lit("|"), sha, F.lit("|"), start.cast("string"), F.lit("|"), end.cast("string"), F.lit("|"), index.cast("string")),
        NAMESPACE_URL,
    )


def code_embedding_id(full_name: Column, sha: Column, source_node_id: Column, order: Column) -> Column:
    return uuid5(F.concat(F.lit("code|"), full_name, F.lit("|"), sha, F.lit("|"), source_node_id, F.lit("|"), order.cast("string")), NAMESPACE_URL)


def code_chunk_id(source_node_id: Column, order: Column) -> Column:
    return node_id("codechunk", [("source_node_id", source_node_id), ("chunk_order", order)])


def source_node_key(entity_type: Column, sha: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("::", entity_type, sha, path, name)


def vector_uuid(entity_type: str, embedding_id: Column) -> Column:
    """The id of a stored vector: the same embedding id always gets the same one."""
    return uuid5(F.concat(F.lit(f"vector|{entity_type}|"), embedding_id))


def node_id_of(entity_type: str, **keys: object) -> str:
    """The same id for one row, on the driver."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, "|".join([entity_type, *(f"{k}={v}" for k, v in keys.items())])))


def edge_id_of(label: str, source: str, target: str) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_OID, f"{label}|{source}|{target}"))


def is_uuid(text: str) -> bool:
    try:
        uuid.UUID(text)
    except (ValueError, AttributeError, TypeError):
        return False
    return True


#: DuckDB text of the same formula, for oracles: name must be a VARCHAR expression.
def uuid5_sql(name: str, namespace: str = NAMESPACE_OID) -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({h},18,3) || '-' || substr({h},21,12))"
    )
