"""Declared entity types: nodes, vectors, edges and the rules that tie vectors to nodes.

Declarations are text, parsed once: one line per type, ``name: column type, ...``, keys marked with ``*`` in hash order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T


class Category(Enum):
    NODE = "node"
    EDGE = "edge"
    VECTOR = "vector"

    @staticmethod
    def parse(text: str) -> Category:
        for c in Category:
            if text in (c.value, c.value.capitalize()):
                return c
        raise ValueError(f"no such category: {text}")


# Declared types. text, i8..i64, u8..u64, f32, f64, bool, time, json and lists of them.
SPARK_TYPES = {
    "text": T.StringType(), "uuid": T.StringType(), "u128": T.StringType(), "json": T.StringType(),
    "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "time": T.TimestampType(),
}

# The node types and their columns.
NODES = """
project: url* text, name text, description text, language text, stars i64, forks i64
developer: platform* text, account_id* text, login* text, name text, company text, followers i64, following i64, location text, email text, created_at time, updated_at time
commit: sha* text, message text, committed_at time
version: sha* text, tag text, is_head bool, created_at time
issue: project_url* text, number* i64, title text, body text, state text, author_login text, author_id text, created_at time, updated_at time, closed_at time, comments_count i64, is_locked bool, milestone text, assignees text, labels text, reactions_plus_one i64, reactions_heart i64, reactions_hooray i64, reactions_eyes i64, reactions_rocket i64, reactions_confused i64, representative_comment_ids text, representative_digest_text text
pullrequest: project_url* text, number* i64, title text, body text, state text, draft bool, author_login text, author_id text, created_at time, updated_at time, closed_at time, merged bool, merged_at time, merged_by text, additions i64, deletions i64, changed_files i64, commits i64, base_ref text, head_ref text, base_sha text, head_sha text, is_cross_repo bool, review_comments_count i64, comments_count i64, representative_comment_ids text, representative_digest_text text, related_issues text
label: project_url* text, name* text, color text, description text
file: version_sha* text, path* text, language text
library: name* text, version text
class: version_sha* text, file_path* text, name* text, start_line i32, end_line i32
trait: version_sha* text, file_path* text, name* text, start_line i32, end_line i32
function: version_sha* text, file_path* text, name* text, signature text, start_line i32, end_line i32, is_component bool
datamodel: version_sha* text, file_path* text, name* text, construct text, start_line i32, end_line i32
variable: version_sha* text, file_path* text, name* text, data_type text
test: version_sha* text, file_path* text, name* text, test_kind text, start_line i32, end_line i32
endpoint: version_sha* text, file_path* text, path* text, http_method text
"""

# The vector types' own columns; every vector has the generated ones besides.
VECTORS = """
readmechunk: id* text, project_url text, revision_sha text, source_file text, start_line i32, end_line i32
codechunk: id* text, project_url text, revision_sha text, source_file text, source_node_key text, source_node_id text, language text
issuedoc: id* text, project_url text, issue_number i64, source_updated_at time
prdoc: id* text, project_url text, pr_number i64, source_updated_at time
"""
VECTOR_COLUMNS = "text text, embedding [f32], embedding_model text, embedding_id text, token_count i32, chunk_order i32, created_at time, updated_at time"
EDGE_COLUMNS = "id* text, from_node_id text, to_node_id text, from_node_type text, to_node_type text, created_at time, updated_at time"

# Edge names and their endpoints, ``from>to``.
EDGES = """
hasversion: project>version
iscommit: version>commit
contributesto: developer>project
authored: developer>commit
hasissue: project>issue
haspr: project>pullrequest
openedissue: developer>issue
openedpr: developer>pullrequest
relatesto: pullrequest>issue
implementspr: commit>pullrequest
haslabel: issue>label, pullrequest>label
assignedto: issue>developer, pullrequest>developer
reviewed: developer>pullrequest
mentions: issue>developer, pullrequest>developer
contains: version>file, file>class, file>function, file>datamodel, file>variable, file>test, file>endpoint
dependson: file>library
calls: function>function
uses: function>function
operand: class>function
handler: endpoint>function
parentof: class>class
implements: class>trait
nestedin: function>function
imports: file>file
containscontent: project>readmechunk, project>issuedoc, project>prdoc
documents: readmechunk>function, issue>issuedoc, pullrequest>prdoc
embeds: function>codechunk, class>codechunk
"""
#: Edge types that stored queries name though the schema does not; ours, optional.
EXTRA_EDGES = """
tests_function: test>function
tests_class: test>class
tests_endpoint: test>endpoint
"""


@dataclass(frozen=True)
class EntitySpec:
    entity_type: str
    category: Category
    table: str
    schema: T.StructType
    keys: tuple[str, ...]
    endpoints: tuple[tuple[str, str], ...] = ()

    @property
    def index_table(self) -> str:
        return f"silver/index_vector/{self.entity_type}" if self.category is Category.VECTOR else f"silver/index/{self.entity_type}"


@dataclass(frozen=True)
class VectorRule:
    """An edge from a node to every vector of a type.

    The node's id is either a hash of key columns (``node_type`` and ``mapping`` of its keys to vector columns)
    or a column as it is (``id_column``, the node's type before ``::`` in ``type_column``).
    """

    vector: str
    edge_type: str
    node_type: str | None = None
    mapping: tuple[tuple[str, str], ...] = ()
    id_column: str | None = None
    type_column: str | None = None


# The rules.
VECTOR_RULES = (
    VectorRule("readmechunk", "edge_containscontent", "project", (("url", "project_url"),)),
    VectorRule("codechunk", "edge_embeds", id_column="source_node_id", type_column="source_node_key"),
    VectorRule("issuedoc", "edge_containscontent", "project", (("url", "project_url"),)),
    VectorRule("issuedoc", "edge_documents", "issue", (("project_url", "project_url"), ("number", "issue_number"))),
    VectorRule("prdoc", "edge_containscontent", "project", (("url", "project_url"),)),
    VectorRule("prdoc", "edge_documents", "pullrequest", (("project_url", "project_url"), ("number", "pr_number"))),
)


def spark_type(text: str) -> T.DataType:
    text = text.strip()
    return T.ArrayType(spark_type(text[1:-1])) if text.startswith("[") else SPARK_TYPES[text]


def parse_columns(text: str, required: bool = False) -> tuple[T.StructType, tuple[str, ...]]:
    fields, keys = [], []
    for part in text.split(","):
        name, kind = part.split()
        if name.endswith("*"):
            keys.append(name := name[:-1])
        fields.append(T.StructField(name, spark_type(kind), not required))
    return T.StructType(fields), tuple(keys)


def parse_lines(text: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.split(":", 1)) for line in text.strip().splitlines()]


@dataclass
class Registry:
    specs: dict[str, EntitySpec] = field(default_factory=dict)
    rules: tuple[VectorRule, ...] = ()

    @staticmethod
    def declared(nodes: str = NODES, vectors: str = VECTORS, edges: str = EDGES, rules: tuple[VectorRule, ...] = VECTOR_RULES, extra_edges: bool = False) -> Registry:
        out = Registry(rules=rules)
        for name, columns in parse_lines(nodes):
            schema, keys = parse_columns(columns)
            out.add(EntitySpec(name, Category.NODE, f"silver/entities/{name}", schema, keys))
        for name, columns in parse_lines(vectors):
            schema, _ = parse_columns(f"{columns}, {VECTOR_COLUMNS}")
            out.add(EntitySpec(name, Category.VECTOR, f"silver/vectors/{name}", schema, ("id",)))
        for name, pairs in parse_lines(edges + (EXTRA_EDGES.lstrip("\n") if extra_edges else "")):
            schema, _ = parse_columns(EDGE_COLUMNS)
            ends = tuple(tuple(p.strip().split(">")) for p in pairs.split(","))
            out.add(EntitySpec(f"edge_{name}", Category.EDGE, f"silver/edges/{name}", schema, ("id",), ends))
        return out

    def add(self, spec: EntitySpec) -> None:
        self.specs[spec.entity_type] = spec

    def entity(self, name: str) -> EntitySpec | None:
        return self.specs.get(canonical_entity(name))

    def edge(self, name: str) -> EntitySpec | None:
        return self.specs.get(canonical_edge(name))

    def entities(self, category: Category | None = None) -> list[EntitySpec]:
        return [s for s in self.specs.values() if category is None or s.category is category]

    def vector_rules(self, vector: str) -> list[VectorRule]:
        return [r for r in self.rules if r.vector == vector]

    def vector_index(self, vector: str) -> str | None:
        spec = self.entity(vector)
        return spec.index_table if spec and spec.category is Category.VECTOR else None


def canonical_entity(name: str) -> str:
    """``PULL_REQUEST`` and ``PullRequest`` are ``pullrequest``; edges keep their prefix."""
    lower = name.lower()
    return lower if lower.startswith("edge_") else lower.replace("_", "")


def canonical_edge(name: str) -> str:
    """``edge_x``, ``x`` and ``X`` name one edge type."""
    lower = name.lower()
    return lower if lower.startswith("edge_") else "edge_" + (lower if lower.startswith("tests_") else lower.replace("_", ""))


REGISTRY = Registry.declared()
