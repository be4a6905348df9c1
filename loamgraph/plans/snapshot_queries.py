"""Repository snapshots made of the generated tables, written by the engine and read back by its requests.

Nations are repositories, customers are developers, orders with even keys are issues and the others pull requests, documents are READMEs.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph import cli
from loamgraph.functions import embedding, text
from loamgraph.functions.ids import node_id_of, uuid5_sql
from loamgraph.operators import lookup, snapshot
from loamgraph.operators.ingest import GraphData, PanelData, Progress, records
from loamgraph.plans.registry import query
from loamgraph.plans.text_queries import comments
from loamgraph.schema import REGISTRY, Category
from loamgraph.service import Engine
from loamgraph.session import scratch, table
from loamgraph.sources import rest

STAMP = "2024-01-01 00:00:00"


def no_text() -> Column:
    return F.lit(None).cast("string")


def embed(t: Column) -> Column:
    """Numbers of a text's length: an embedding that SQL can make too. No two that differ point the same way."""
    n = F.length(t)
    return F.when(
        t != "", F.array((n % 7 + 1).cast("float"), (n % 5).cast("float"), (n % 3).cast("float"), F.lit(1.0).cast("float")),
    ).otherwise(F.array().cast("array<float>"))


def frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    k, host = F.col("n_nationkey").cast("string"), F.lit("https://host/")
    at = F.lit(STAMP).cast("timestamp")
    repos = table(spark, sf, "nation").select(
        F.concat(host, k).alias("project_url"), F.concat(F.lit("own/r"), k).alias("full_name"), F.col("n_name").alias("name"), no_text().alias("description"),
        F.concat(
            F.lit("L"), F.col("n_regionkey").cast("string"),
        ).alias("language"), (F.col("n_nationkey") * 10).cast("long").alias("stars"), F.col("n_nationkey").cast("long").alias("forks"),
        F.concat(
            F.lit("sha"), k,
        ).alias("sha"), no_text().alias("tag"), (F.col("n_nationkey") % 2 == 0).alias("is_head"), F.col("n_name").alias("message"), at.alias("authored_at"),
    )
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c"), "c_custkey")
    person = lambda platform, login: c.select(F.lit(platform).alias("platform"), F.col("c").alias("account_id"), login.alias("login"))
    blank = F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.concat(F.lit("User"), F.col("c")))
    people = person("GitHub", blank).unionByName(person("github", F.concat(F.lit("user"), F.col("c"))))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n, login = F.col("o_orderkey"), F.concat(F.lit("USER"), F.col("o_custkey").cast("string"))
    label = lambda name: F.struct(name.alias("name"), no_text().alias("color"), no_text().alias("description"))
    link = lambda number, cross: F.struct(
        F.lit("own").alias("owner"), F.lit("r").alias("repo"), number.alias("number"), F.lit("closes").alias("link_type"), F.lit(3).alias("strength"),
        F.lit("body").alias("origin"), F.lit(cross).alias("cross_repo"),
    )
    base = o.select(
        F.concat(
            host, F.col("c_nationkey").cast("string"),
        ).alias("project_url"), n.alias("number"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("total "), F.col("o_orderstatus")).alias("body"),
        F.col("o_orderstatus").alias("state"), F.when(
            n % 11 == 0, "nobody",
        ).otherwise(login).alias("author_login"), F.when(n % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("author_id"),
        at.alias("created_at"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.array(
            label(F.when(n % 3 == 0, "Bug").otherwise("bug")), label(F.col("o_orderpriority")),
        ).alias("label_list"),
        F.array(
            link(n - 1, False), link(n + 1, True), link(n - 3, False),
        ).alias("links"), no_text().alias("representative_digest_text"), (n % 3 == 1).alias("draft"), n.alias("additions"), F.lit(None).cast("long").alias("deletions"), F.lit(2).cast("long").alias("changed_files"),
    )
    d = table(spark, sf, "documents").filter("text is not null")
    readmes = d.select(
        F.concat(host, (F.col("doc_id") % 25).cast("string")).alias("project_url"), "text",
        F.concat(F.lit("README"), F.col("doc_id").cast("string")).alias("source_file"),
    )
    return {"repos": repos, "people": people, "issues": base.filter(n_of(0)), "pulls": base.filter(n_of(1)), "readmes": readmes}


def n_of(rest_: int) -> Column:
    return F.col("number") % 2 == rest_


class Repositories:
    """A fetcher of the repositories alone."""

    name = "repositories"

    def __init__(self, sf: str):
        self.sf, self.anchor = sf, "sha-1"

    def capability(self) -> dict:
        return {"name": self.name}

    def probe(self, uri: str) -> dict:
        return {"anchor": self.anchor, "anchor_key": "sha"}

    def fetch(self, spark: SparkSession, params: dict) -> GraphData | PanelData:
        repos = frames(spark, self.sf)["repos"]
        if params.get("panel"):
            return PanelData("silver/panel/repositories", repos.select("full_name"))
        return GraphData().add(REGISTRY.entity("project"), repos.select(F.col("project_url").alias("url"), "name", "language", "stars"))


_ENGINES: dict[tuple[str, str], tuple[Engine, GraphData, Progress]] = {}


def engine(spark: SparkSession, sf: str, *kinds: str) -> Engine:
    """The snapshot, written once for the queries of a session. ``kinds``: all that a request looks into; other tables are written when a query first needs them."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENGINES:
        f = frames(spark, sf)
        graph = snapshot.snapshot_graph(f["repos"], f["people"], f["issues"], f["pulls"], None, snapshot.Options(embed=embed))
        _ENGINES[key] = Engine(spark, scratch(spark, "lake"), embed=embed, buckets=4), graph, Progress()
    e, graph, progress = _ENGINES[key]
    specs = [REGISTRY.entity(k) for k in kinds]
    e.sync.process(graph, {t for s in specs for t in (s.table, *[s.index_table] * (s.category is Category.VECTOR))} if kinds else None, progress)
    return e


def entity(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return engine(spark, sf).show(REGISTRY.specs[kind].table, 0)


PROJECT = uuid5_sql("'project|url=' || project_url")
LABEL = uuid5_sql("'label|project_url=' || project_url || '|name=' || name")
DEVELOPER = uuid5_sql("'developer|platform=' || platform || '|account_id=' || account_id || '|login=' || login")
ITEM = uuid5_sql("kind || '|project_url=' || project_url || '|number=' || number")
VECTOR = uuid5_sql("'vector|' || doc || '|' || embedding_id")


def edge_sql(label: str) -> str:
    return uuid5_sql(f"'edge_{label}|' || from_node_id || '|' || to_node_id")


#: The frames above as DuckDB tables, and what follows from them.
SNAPSHOT = f"""
WITH repos AS (SELECT 'https://host/' || n_nationkey AS project_url, 'own/r' || n_nationkey AS full_name, n_name AS name, 'L' || n_regionkey AS language, n_nationkey * 10 AS stars, 'sha' || n_nationkey AS sha FROM nation),
raw_people AS (SELECT 'GitHub' AS platform, c_custkey::VARCHAR AS account_id, CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'User' || c_custkey END AS login FROM customer UNION ALL SELECT 'github', c_custkey::VARCHAR, 'user' || c_custkey FROM customer),
people AS (SELECT * FROM raw_people WHERE trim(login) <> '' QUALIFY row_number() OVER (PARTITION BY lower(platform), account_id, lower(login) ORDER BY platform, login) = 1),
devs AS (SELECT *, {DEVELOPER} AS dev FROM people),
items AS (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'issue' ELSE 'pullrequest' END AS kind, CASE o_orderkey % 2 WHEN 0 THEN 'issuedoc' ELSE 'prdoc' END AS doc, 'https://host/' || c_nationkey AS project_url, 'own/r' || c_nationkey AS full_name,
  o_orderkey AS number, o_orderpriority AS title, 'total ' || o_orderstatus AS body, o_orderstatus AS state, CASE WHEN o_orderkey % 11 = 0 THEN 'nobody' ELSE 'USER' || o_custkey END AS author_login,
  CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS author_id FROM orders JOIN customer ON o_custkey = c_custkey),
nodes_ AS (SELECT *, {ITEM} AS node, {PROJECT} AS project FROM items),
named AS (SELECT *, CASE WHEN number % 3 = 0 THEN 'Bug' ELSE 'bug' END AS name, 0 AS place FROM nodes_ UNION ALL SELECT *, title, 1 FROM nodes_),
labels_ AS (SELECT project_url, name FROM named QUALIFY row_number() OVER (PARTITION BY project_url, lower(name) ORDER BY kind, number, place, name) = 1),
label_ids AS (SELECT *, {LABEL} AS label_id FROM labels_),
docs_ AS (SELECT *, CASE kind WHEN 'issue' THEN 'Issue #' ELSE 'Pull Request #' END || number || ' in ' || full_name || chr(10) || chr(10) || 'State: ' || state || CASE WHEN kind = 'pullrequest' AND number % 3 = 1 THEN ' (draft)' ELSE '' END
  || chr(10) || chr(10) || 'Author: ' || author_login || chr(10) || chr(10) || 'Title:' || chr(10) || title || chr(10) || chr(10) || 'Body:' || chr(10) || body
  || CASE kind WHEN 'issue' THEN '' ELSE chr(10) || chr(10) || 'Additions: ' || number || chr(10) || chr(10) || 'Changed Files: 2' END AS text,
  CASE kind WHEN 'issue' THEN 'issue-doc://' ELSE 'pr-doc://' END || full_name || '/' || number || '#doc#0' AS embedding_id FROM nodes_),
vectors_ AS (SELECT *, {VECTOR} AS vid, [length(text) % 7 + 1, length(text) % 5, length(text) % 3, 1]::DOUBLE[] AS e FROM docs_)
"""


# -- what ingestion wrote


@query("snapshot_projects", SNAPSHOT + "SELECT project_url AS url, name, language, stars::BIGINT AS stars FROM repos")
def snapshot_projects(spark: SparkSession, sf: str) -> DataFrame:
    return entity(spark, sf, "project").select("url", "name", "language", "stars")


@query("snapshot_developers", SNAPSHOT + "SELECT platform, account_id, login FROM people")
def snapshot_developers(spark: SparkSession, sf: str) -> DataFrame:
    """Developers without repeats in another case, blank ones left out."""
    return entity(spark, sf, "developer").select("platform", "account_id", "login")


@query("snapshot_items", SNAPSHOT + "SELECT kind, project_url, number, title, body, state, author_login FROM items")
def snapshot_items(spark: SparkSession, sf: str) -> DataFrame:
    parts = [entity(spark, sf, k).select(F.lit(k).alias("kind"), "project_url", "number", "title", "body", "state", "author_login") for k in ("issue", "pullrequest")]
    return parts[0].unionByName(parts[1])


@query("snapshot_labels", SNAPSHOT + "SELECT project_url, name FROM labels_")
def snapshot_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One label for each project and name in lower case, in the casing met first."""
    return entity(spark, sf, "label").select("project_url", "name")


def edges_between(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    parts = [entity(spark, sf, f"edge_{k}").select("id", "from_node_id", "to_node_id", "from_node_type", "to_node_type") for k in kinds]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


@query(
    "snapshot_label_edges",
    SNAPSHOT + f""", e AS (SELECT DISTINCT node AS from_node_id, label_id AS to_node_id, kind AS from_node_type, 'label' AS to_node_type
    FROM named JOIN label_ids l ON l.project_url = named.project_url AND lower(l.name) = lower(named.name)) SELECT {edge_sql("haslabel")} AS id, * FROM e""",
)
def snapshot_label_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges_between(spark, sf, "haslabel")


@query(
    "snapshot_authors",
    SNAPSHOT + f""", a AS (SELECT n.*, coalesce(min(x.dev), min(l.dev)) AS dev FROM nodes_ n LEFT JOIN devs x ON lower(x.platform) = 'github' AND x.account_id = n.author_id AND lower(x.login) = lower(n.author_login)
    LEFT JOIN devs l ON lower(l.login) = lower(n.author_login) GROUP BY ALL),
    e AS (SELECT dev AS from_node_id, node AS to_node_id, 'developer' AS from_node_type, kind AS to_node_type FROM a WHERE dev IS NOT NULL)
    SELECT CASE to_node_type WHEN 'issue' THEN {edge_sql("openedissue")} ELSE {edge_sql("openedpr")} END AS id, * FROM e""",
)
def snapshot_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Authors by account and login, else by login in any case."""
    return edges_between(spark, sf, "openedissue", "openedpr")


@query(
    "snapshot_relates",
    SNAPSHOT + f""", e AS (SELECT DISTINCT p.node AS from_node_id, i.node AS to_node_id, 'pullrequest' AS from_node_type, 'issue' AS to_node_type FROM nodes_ p JOIN nodes_ i
    ON i.kind = 'issue' AND i.project_url = p.project_url AND i.number IN (p.number - 1, p.number - 3) WHERE p.kind = 'pullrequest') SELECT {edge_sql("relatesto")} AS id, * FROM e""",
)
def snapshot_relates(spark: SparkSession, sf: str) -> DataFrame:
    """Pull requests to the issues of their own repository that they name."""
    return edges_between(spark, sf, "relatesto")


@query(
    "snapshot_documents",
    SNAPSHOT + r"SELECT vid AS id, project_url, number, text, embedding_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS token_count, e AS embedding FROM vectors_",
)
def snapshot_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Composed documents of issues and pull requests, as stored vectors."""
    parts = [entity(spark, sf, f"{k}doc").select(
        "id", "project_url", F.col(f"{k if k == 'issue' else 'pr'}_number").alias("number"), "text", "embedding_id", "token_count",
        F.col("embedding").cast("array<double>").alias("embedding"),
    ) for k in ("issue", "pr")]
    return parts[0].unionByName(parts[1])


@query(
    "snapshot_vector_edges",
    SNAPSHOT + f""", e AS (SELECT 'c' AS t, project AS from_node_id, vid AS to_node_id, 'project' AS from_node_type, doc AS to_node_type FROM vectors_ UNION ALL SELECT 'd', node, vid, kind, doc FROM vectors_)
    SELECT CASE t WHEN 'c' THEN {edge_sql("containscontent")} ELSE {edge_sql("documents")} END AS id, * EXCLUDE t FROM e""",
)
def snapshot_vector_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges by the vector rules, of issues' and pull requests' documents."""
    return edges_between(spark, sf, "containscontent", "documents")


LINES = r"string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n\z', ''), chr(10))"
README = f"""
WITH d AS (SELECT doc_id, doc_id % 25 AS k, {LINES} AS x FROM documents WHERE text <> ''),
c AS (SELECT *, unnest(range(0, (len(x) - 1) // 120 + 1)) AS i FROM d),
t AS (SELECT doc_id, k, i, i * 120 + 1 AS a, least(i * 120 + 120, len(x)) AS b, array_to_string(x[i * 120 + 1 : i * 120 + 120], chr(10)) AS text FROM c)
"""


@query(
    "snapshot_readme_chunks",
    README + rf"""SELECT 'https://host/' || k AS project_url, 'sha' || k AS revision_sha, 'README' || doc_id AS source_file, a::INT AS start_line, b::INT AS end_line, i::INT AS chunk_order, text,
    {uuid5_sql("'readme|own/r' || k || '|sha' || k || '|' || a || '|' || b || '|' || i", "6ba7b8119dad11d180b400c04fd430c8")} AS embedding_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS token_count FROM t""",
)
def snapshot_readme_chunks(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    chunks = snapshot.readme_chunks(f["readmes"], f["repos"], snapshot.Options(embed=embed))
    return chunks.select("project_url", "revision_sha", "source_file", "start_line", "end_line", "chunk_order", "text", "embedding_id", "token_count")


@query(
    "readme_rule_edges",
    README + f""", v AS (SELECT DISTINCT {uuid5_sql("'project|url=https://host/' || k")} AS from_node_id,
    {uuid5_sql("'vector|readmechunk|' || " + uuid5_sql("'readme|own/r' || k || '|sha' || k || '|' || a || '|' || b || '|' || i", "6ba7b8119dad11d180b400c04fd430c8"))} AS to_node_id FROM t WHERE text <> '')
    SELECT {edge_sql("containscontent")} AS id, from_node_id, to_node_id, 'project' AS from_node_type, 'readmechunk' AS to_node_type FROM v""",
)
def readme_rule_edges(spark: SparkSession, sf: str) -> DataFrame:
    """READMEs through ingestion: chunks that share an embedding id share a vector and its edge."""
    e, f = Engine(spark, scratch(spark, "readmes")), frames(spark, sf)
    e.sync.process(GraphData().add(REGISTRY.entity("readmechunk"), snapshot.readme_chunks(f["readmes"], f["repos"], snapshot.Options(embed=embed))))
    return e.show("silver/edges/containscontent", 0).select("id", "from_node_id", "to_node_id", "from_node_type", "to_node_type")


# -- tables and the catalog

COUNTS = """SELECT 'silver/entities/project' AS name, count(*) AS n FROM repos UNION ALL SELECT 'silver/entities/developer', count(*) FROM people UNION ALL SELECT 'silver/entities/label', count(*) FROM labels_
    UNION ALL SELECT 'silver/entities/' || kind, count(*) FROM items GROUP BY kind UNION ALL SELECT 'silver/vectors/' || doc, count(*) FROM items GROUP BY doc UNION ALL SELECT 'silver/index_vector/' || doc, count(*) FROM items GROUP BY doc
    UNION ALL SELECT 'silver/index/' || kind, count(*) FROM items GROUP BY kind"""


@query("engine_row_counts", SNAPSHOT + COUNTS)
def engine_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    names = [f"silver/entities/{k}" for k in ("project", "developer", "label", "issue", "pullrequest")]
    names += [f"silver/{a}/{b}" for a, b in (
        ("vectors", "issuedoc"), ("vectors", "prdoc"), ("index_vector", "issuedoc"), ("index_vector", "prdoc"), ("index", "issue"), ("index", "pullrequest"),
    )]
    return spark.createDataFrame([(n, e.row_count(n)) for n in names], "name string, n long")


def listed_sql(names: str, prefix: str) -> str:
    return " UNION ALL ".join(f"SELECT '{prefix}{n}' AS name" for n in names.split())


@query("engine_tables", listed_sql("commit developer issue label project pullrequest version", "silver/entities/"))
def engine_tables(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(name,) for name, _ in engine(spark, sf).tables("silver/entities")], "name string")


@query("engine_edge_types", listed_sql("containscontent documents hasissue haslabel haspr hasversion iscommit openedissue openedpr relatesto", ""))
def engine_edge_types(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in engine(spark, sf).lake.types_below("silver/edges")], "name string")


@query("engine_index_types", listed_sql("commit developer issue label project pullrequest version", ""))
def engine_index_types(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in engine(spark, sf).lake.types_below("silver/index")], "name string")


@query(
    "engine_schema",
    "SELECT * FROM (VALUES ('sha', 'string', true), ('tag', 'string', true), ('is_head', 'boolean', true), ('created_at', 'timestamp', true)) AS t(name, type, nullable)",
)
def engine_schema(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(engine(spark, sf).schema("silver/entities/version"), "name string, type string, nullable boolean")


@query("engine_show_limit", "SELECT 20::BIGINT AS some, (SELECT count(*) FROM nation) AS every")
def engine_show_limit(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    return spark.createDataFrame([(e.show("silver/entities/project").count(), e.show("silver/entities/project", 0).count())], "some long, every long")


@query("optional_table", "SELECT 'project' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'trait', 0")
def optional_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table that was never written reads as no rows of its declared columns."""
    lake = engine(spark, sf).lake
    parts = [lake.table(REGISTRY.entity(k).table).read(schema=REGISTRY.entity(k).schema).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(k).alias("name"), "n",
    ) for k in ("project", "trait")]
    return parts[0].unionByName(parts[1])


@query(
    "known_entities",
    SNAPSHOT + "SELECT 'silver/entities/project' AS table_path, 'project' AS entity_type, 'node' AS category, '[\"url\"]' AS primary_keys, -1::BIGINT AS last_version UNION ALL SELECT 'silver/index/project', 'project', 'node', '[\"id\"]', -1",
)
def known_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog's offsets as a frame."""
    return engine(spark, sf).catalog.frame(spark, "ingestion_offsets").filter("entity_type = 'project'")


@query(
    "edge_table_statistics",
    SNAPSHOT + ", e AS (SELECT 'edge_has' || CASE kind WHEN 'issue' THEN kind ELSE 'pr' END AS label FROM items UNION ALL SELECT 'edge_hasversion' FROM repos) SELECT label, count(*) AS row_count, 0 AS version FROM e GROUP BY label",
)
def edge_table_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).edge_statistics().filter(F.col("label").isin("edge_hasissue", "edge_haspr", "edge_hasversion"))


# -- synchronisation


@query(
    "sync_and_replay",
    """SELECT * FROM (VALUES ('fetchers', 'repositories'), ('fresh before', 'false'), ('fresh after', 'true'), ('fresh with another anchor', 'false'), ('fresh with an unknown fetcher', 'false'), ('tasks', 'SUCCESS,SUCCESS,SUCCESS'),
    ('offset before', '-1'), ('offset after', '1'), ('readiness', 'project 3600')) AS t(what, value)
    UNION ALL SELECT 'rows of version 0', count(*)::VARCHAR FROM nation UNION ALL SELECT 'rows of version 1', '0' UNION ALL SELECT 'panel', (2 * count(*))::VARCHAR FROM nation""",
)
def sync_and_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Two syncs of a graph, one of a panel after another; the second of the graph changes nothing, so its replay hands on nothing."""
    e, source, out = Engine(spark, scratch(spark, "sync")), Repositories(sf), []
    e.sync.register(source)
    say = lambda what, value: out.append((what, str(value).lower() if isinstance(value, bool) else str(value)))
    say("fetchers", ",".join(e.sync.registered()))
    say("fresh before", e.sync.is_fresh("u", "repositories"))
    e.trigger_sync("repositories", {}, "u", "project")
    say("fresh after", e.readiness([("u", "repositories")])[0]["is_fresh"])
    source.anchor = "sha-2"
    say("fresh with another anchor", e.sync.is_fresh("u", "repositories"))
    say("fresh with an unknown fetcher", e.sync.is_fresh("u", "nobody"))
    e.trigger_sync("repositories", {}, "u", "project")
    e.sync.fetchers["repositories"].fetch(spark, {})
    e.trigger_sync("repositories", {"panel": True}, "p", "panel")
    e.lake.table("silver/panel/repositories").write(source.fetch(spark, {"panel": True}).rows)
    say("panel", e.row_count("silver/panel/repositories"))
    say("tasks", ",".join(r["status"] for r in e.catalog.rows("task_logs")))
    say("readiness", "{entity_type} {ttl_seconds}".format(**e.catalog.readiness("u")))
    say("offset before", e.catalog.offset("silver/entities/project"))
    e.sync.replay(lambda spec, path, version, rows: say(f"rows of version {version}", rows.count()) if path == "silver/entities/project" else None)
    say("offset after", e.catalog.offset("silver/entities/project"))
    return spark.createDataFrame(out, "what string, value string")


@query("nothing_is_written", "SELECT -1 AS before, -1 AS after_nothing, 0 AS after_rows, (SELECT count(*) FROM region) AS n")
def nothing_is_written(spark: SparkSession, sf: str) -> DataFrame:
    """No batches, no version."""
    e = Engine(spark, scratch(spark, "nothing"))
    t, spec = e.lake.table("silver/entities/project", ["url"]), REGISTRY.entity("project")
    before = t.version()
    e.sync.process(GraphData().add(spec, records(spark, spec, [])))
    nothing = t.write(table(spark, sf, "region"), nothing=True)
    after = t.write(table(spark, sf, "region").select(F.col("r_name").alias("url")))
    return spark.createDataFrame([(before, nothing, after, t.read().count())], "before int, after_nothing int, after_rows int, n long")


# -- requests

ALL_NODES = f"""
, every AS (SELECT {PROJECT} AS id, 'project' AS label, name AS title, name AS shown FROM repos UNION ALL SELECT {uuid5_sql("'version|sha=' || sha")}, 'version', NULL, NULL FROM repos UNION ALL SELECT {uuid5_sql("'commit|sha=' || sha")}, 'commit', NULL, NULL FROM repos
  UNION ALL SELECT dev, 'developer', NULL, NULL FROM devs UNION ALL SELECT node, kind, title, title FROM nodes_ UNION ALL SELECT label_id, 'label', name, name FROM label_ids UNION ALL SELECT vid, doc, NULL, NULL FROM vectors_)"""
NEARBY = SNAPSHOT + ALL_NODES + """
, links_ AS (SELECT project AS s, node AS t FROM nodes_ UNION ALL SELECT p.project, v.vid FROM nodes_ p JOIN vectors_ v USING (kind, project_url, number))"""
ONE = node_id_of("project", url="https://host/3")


@query(
    "api_status",
    SNAPSHOT + ALL_NODES + ", v AS (SELECT count(*) AS n FROM vectors_) SELECT (SELECT count(*) FROM every) - v.n AS num_nodes, v.n AS num_vectors, 'repositories' AS fetchers FROM v",
)
def api_status(spark: SparkSession, sf: str) -> DataFrame:
    e = engine(spark, sf)
    e.sync.register(Repositories(sf))
    s = e.status()
    return spark.createDataFrame(
        [(s["db_stats"]["num_nodes"], s["db_stats"]["num_vectors"], ",".join(s["registered_fetchers"]))], "num_nodes long, num_vectors long, fetchers string",
    )


@query("api_node", SNAPSHOT + ALL_NODES + f" SELECT id, label FROM every WHERE id = '{ONE}'")
def api_node(spark: SparkSession, sf: str) -> DataFrame:
    row = engine(spark, sf).node(ONE)
    return spark.createDataFrame([(row["id"], row["label"])], "id string, label string")


@query("api_overview", SNAPSHOT + ALL_NODES + " SELECT id, label FROM every WHERE id NOT IN (SELECT vid FROM vectors_) ORDER BY id LIMIT 30")
def api_overview(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).overview()[0].select("id", "label")


@query(
    "api_visual",
    SNAPSHOT + ALL_NODES + " SELECT id, label, CASE label WHEN 'project' THEN shown WHEN 'label' THEN shown END AS title FROM every ORDER BY id LIMIT 200",
)
def api_visual(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).visual(200, "name")[0]


@query("api_types", "SELECT 19::BIGINT AS types, 'Project' AS first, 'Default' AS last, '#38bdf8' AS highlight, 'README_CHUNK,README' AS aliases")
def api_types(spark: SparkSession, sf: str) -> DataFrame:
    styles = engine(spark, sf).types()
    aliases = ",".join(next(s["aliases"] for s in styles if s["entity_type"] == "ReadmeChunk"))
    row = (len(styles), styles[0]["entity_type"], styles[-1]["entity_type"], styles[0]["color"]["highlight_background"], aliases)
    return spark.createDataFrame([row], "types long, first string, last string, highlight string, aliases string")


@query("api_search", SNAPSHOT + f" SELECT {PROJECT} AS id, 'project' AS label, name AS display_name FROM repos WHERE project_url LIKE '%host/1%' ORDER BY id LIMIT 20")
def api_search(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).graph_search(" HOST/1 ", 20, "project").select("id", "label", "display_name")


@query(
    "api_subgraph",
    NEARBY + f" SELECT id, label, CASE WHEN id = '{ONE}' THEN 0 ELSE 1 END AS level FROM every WHERE id = '{ONE}' OR id = {uuid5_sql(chr(39) + 'version|sha=sha3' + chr(39))} OR id IN (SELECT t FROM links_ WHERE s = '{ONE}')",
)
def api_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).subgraph(ONE, None, 1, 0, 0).nodes.select("id", "label", "level")


@query("api_neighbours", NEARBY + f" SELECT t AS node_id, 'outgoing' AS orientation FROM links_ JOIN nodes_ ON node = t AND kind = 'issue' WHERE s = '{ONE}'")
def api_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).neighbours(ONE, "HAS_ISSUE", "both", 0).select("node_id", "orientation")


@query("api_path", NEARBY + f" SELECT true AS found, 2 AS length, '{ONE}' AS first, 3::BIGINT AS nodes UNION ALL SELECT false, 0, NULL, 0")
def api_path(spark: SparkSession, sf: str) -> DataFrame:
    """From a project to one of its labels, and back, where no path leads."""
    e = engine(spark, sf)
    label = entity(spark, sf, "label").filter("project_url = 'https://host/3'").orderBy("name").first()
    to = node_id_of("label", project_url=label["project_url"], name=label["name"])
    found = [e.shortest_path(*ends) for ends in ((ONE, to), (to, ONE))]
    return spark.createDataFrame(
        [(p["found"], p["length"], p["nodes"][0] if p["nodes"] else None, len(p["nodes"])) for p in found],
        "found boolean, length int, first string, nodes long",
    )


@query(
    "api_hybrid_types",
    listed_sql(
        " ".join(sorted("project developer commit version issue pullrequest label file library class trait function datamodel variable test endpoint readmechunk codechunk issuedoc prdoc".split())),
        "",
    ),
)
def api_hybrid_types(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in engine(spark, sf).hybrid_types()], "name string")


ASKED = "where is the total"
DISTANCE = f"""
, q AS (SELECT [length('{ASKED}') % 7 + 1, length('{ASKED}') % 5, length('{ASKED}') % 3, 1]::DOUBLE[] AS q), near AS (SELECT vid AS id, doc AS label, text, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS distance FROM vectors_, q)"""


@query(
    "api_vectors_by_text",
    SNAPSHOT + DISTANCE + " SELECT id, label, round(distance, 6) AS distance FROM near WHERE label = 'issuedoc' ORDER BY round(near.distance, 9), id LIMIT 20",
)
def api_vectors_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return engine(spark, sf).vectors_by_text("issuedoc", ASKED, 20).select("id", "label", F.round("distance", 6).alias("distance"))


@query(
    "api_hybrid",
    SNAPSHOT + DISTANCE + " SELECT id, label, round(1 / (1 + distance), 6) AS score, text AS summary FROM near ORDER BY round(near.distance, 9), id LIMIT 10",
)
def api_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """By vectors alone (alpha 0), over both kinds of documents; and nothing for blank text."""
    e = engine(spark, sf, "issuedoc", "prdoc")
    return e.hybrid_all(ASKED, "issuedoc,prdoc", 0.0, 10).select("id", "label", F.round("score", 6).alias("score"), "summary").unionByName(e.hybrid_all("  "))


@query("api_bm25", SNAPSHOT + f" SELECT {PROJECT} AS id, 'project' AS label FROM repos WHERE project_url = 'https://host/7'")
def api_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The best project for its own name."""
    name = table(spark, sf, "nation").filter("n_nationkey = 7").first()["n_name"]
    nodes = [s.entity_type for s in REGISTRY.entities(Category.NODE)]
    return engine(spark, sf, *nodes).bm25("project", f"{name} 7", 1).select("id", "label")


@query("cli_counts", SNAPSHOT + "SELECT 'silver/entities/' || kind AS name, count(*) AS rows FROM items GROUP BY kind")
def cli_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The command line's answers."""
    e, names = engine(spark, sf), ("silver/entities/issue", "silver/entities/pullrequest")
    return spark.createDataFrame([(n, cli.run(cli.parser().parse_args(["root", "cold", "count", n]), e)[0]["rows"]) for n in names], "name string, rows long")


@query("embedding_provider", "SELECT doc_id, [length(coalesce(text, '')), length(coalesce(text, '')) % 7]::DOUBLE[] AS embedding FROM documents")
def embedding_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A local model, loaded once in each Python worker and called with batches; it knows a text's length only."""
    provider = embedding.local_embedding("lengths", lambda _: lambda texts: [[float(len(t)), float(len(t) % 7)] for t in texts])
    return table(spark, sf, "documents").select("doc_id", provider(F.col("text")).cast("array<double>").alias("embedding"))


@query("fetcher_capability", "SELECT 'repositories' AS name, 'sha' AS anchor_key, 'sha-1' AS anchor, (SELECT count(*) FROM nation) AS rows")
def fetcher_capability(spark: SparkSession, sf: str) -> DataFrame:
    """What a fetcher says of itself, of its source, and what it brings."""
    f = Repositories(sf)
    seen, rows = f.probe("u"), f.fetch(spark, {}).batches[0][1].count()
    return spark.createDataFrame([(f.capability()["name"], seen["anchor_key"], seen["anchor"], rows)], "name string, anchor_key string, anchor string, rows long")


# -- parsers, panels, captures, recorded services


@query(
    "parse_edge_types",
    "SELECT n_nationkey, unnest(list_filter(regexp_split_to_array(n_name || ', ;HAS ' || n_regionkey || chr(10), '[,;\\s]+'), lambda x: x <> '')) AS part FROM nation",
)
def parse_edge_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").collect()  # requests, not data
    return spark.createDataFrame(
        [(r["n_nationkey"], p) for r in rows for p in lookup.parse_edge_types(f"{r['n_name']}, ;HAS {r['n_regionkey']}\n")], "n_nationkey int, part string",
    )


@query(
    "parse_lists",
    "SELECT n_nationkey, unnest([n_name, n_regionkey::VARCHAR, 'a=b']) AS part, 'k' || n_nationkey AS key, 'v=' || n_name AS value, lower((n_nationkey % 2 = 0)::VARCHAR) AS scalar FROM nation",
)
def parse_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows, out = table(spark, sf, "nation").collect(), []
    for r in rows:
        key, value = lookup.parse_key_value(f" k{r['n_nationkey']} =v={r['n_name']}")
        out += [(r["n_nationkey"], p, key, value, lookup.text_of(r["n_nationkey"] % 2 == 0)) for p in lookup.parse_list(f"{r['n_name']} , ,{r['n_regionkey']},a=b,")]
    return spark.createDataFrame(out, "n_nationkey int, part string, key string, value string, scalar string")


@query("search_panel", "SELECT c_name AS full_name, 'h' || c_custkey AS html_url, c_custkey AS stargazers FROM customer ORDER BY c_custkey LIMIT 12")
def search_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A search as it is sent, answered from the customers, and its panel; rows without a name or an address are left out."""

    class Service:
        def get(self, path: str, params: dict) -> dict:
            assert (path, params) == ("search/repositories", {"q": "x language:rust stars:>=5", "per_page": 12})
            rows = table(spark, sf, "customer").orderBy("c_custkey").limit(100).collect()
            return {"items": [{"full_name": None}, *({"full_name": r["c_name"], "html_url": f"h{r['c_custkey']}", "stargazers_count": r["c_custkey"]} for r in rows)]}

    return rest.search_repositories(spark, Service(), "x", "rust", 5, 12).select("full_name", "html_url", "stargazers")


@query("recorded_issues", "SELECT 'own/r' AS repo, c_custkey AS number, c_name AS title FROM customer WHERE c_custkey % 10 <> 3")
def recorded_issues(spark: SparkSession, sf: str) -> DataFrame:
    """The repository source over recorded pages of customers; every tenth is a pull request and is not an issue."""
    folder = tempfile.mkdtemp()  # the recording: a fixture on the driver
    rows = [{
        "number": r["c_custkey"], "title": r["c_name"],
    } | ({"pull_request": {}} if r["c_custkey"] % 10 == 3 else {}) for r in table(spark, sf, "customer").orderBy("c_custkey").collect()]
    for page in range(0, len(rows) // rest.PAGE + 1):
        with open(f"{folder}/repos__own__r__issues{f'__page={page + 1}' if page else ''}.json", "w", encoding="utf-8") as f:
            json.dump(rows[page * rest.PAGE : (page + 1) * rest.PAGE], f)
    spark.dataSource.register(rest.RepositorySource)
    got = spark.read.format("repository").option("recorded", folder).option("repos", "own/r").load()
    r = F.from_json("payload", "number long, title string")
    return got.select("repo", r["number"].alias("number"), r["title"].alias("title"))


class Indicators:
    """Answers of an indicator service, made of the nations."""

    def __init__(self, rows: list):
        self.rows = rows

    def get(self, path: str, params: dict | None = None) -> list:
        if path == "country":
            return [
                {"page": 1},
                [{
                    "id": f"N{r['n_nationkey']}", "iso2Code": r["n_name"][:2], "name": r["n_name"],
                    "longitude": "" if r["n_nationkey"] % 2 else str(r["n_nationkey"] / 2),
                } for r in self.rows],
            ]
        return [{"page": 1}, [{"id": f"I.{r['n_nationkey']}", "name": r["n_name"], "sourceNote": f"region {r['n_regionkey']}"} for r in self.rows]]


@query("indicator_lists", "SELECT 'N' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 2 END AS longitude FROM nation")
def indicator_lists(spark: SparkSession, sf: str) -> DataFrame:
    return rest.listed(spark, Indicators(table(spark, sf, "nation").collect()), "country").select("id", "name", "longitude")


@query(
    "indicator_search",
    "SELECT 'country' AS kind, 'N' || n_nationkey AS id FROM nation WHERE lower(n_name) LIKE '%an%' OR lower('N' || n_nationkey) LIKE '%an%' OR lower(left(n_name, 2)) LIKE '%an%' UNION ALL SELECT 'indicator', 'I.' || n_nationkey FROM nation WHERE n_regionkey = 1",
)
def indicator_search(spark: SparkSession, sf: str) -> DataFrame:
    service = Indicators(table(spark, sf, "nation").collect())
    found = rest.search_countries(rest.listed(spark, service, "country"), "AN").select(F.lit("country").alias("kind"), "id")
    return found.unionByName(rest.search_indicators(rest.listed(spark, service, "indicator"), "Region 1").select(F.lit("indicator").alias("kind"), "id"))


@query(
    "indicator_series",
    "SELECT 'N' || n_nationkey AS country, m AS measure, CASE WHEN m = 'b' AND n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey + CASE m WHEN 'a' THEN 0 ELSE 0.5 END END AS value FROM nation, (VALUES ('a'), ('b')) AS t(m)",
)
def indicator_series(spark: SparkSession, sf: str) -> DataFrame:
    """A cube of nations and two measures, laid out with its dimensions' codes."""
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    index = {f"N{r['n_nationkey']}": k for k, r in enumerate(rows)}
    value = [x for r in rows for x in (float(r["n_regionkey"]), None if r["n_nationkey"] % 3 == 0 else r["n_regionkey"] + 0.5)]
    dimension = {"id": ["country", "measure"], "size": [len(rows), 2], "country": {"category": {"index": index}}, "measure": {"category": {"index": ["a", "b"]}}}
    return rest.series(spark, {"dimension": dimension, "value": value}).select("country", "measure", "value")


@query(
    "captured_batches",
    "SELECT 'regions' AS name, r_regionkey AS k, r_name AS v FROM region UNION ALL SELECT 'regions', r_regionkey, r_name FROM region UNION ALL SELECT 'nations', n_nationkey, n_name FROM nation",
)
def captured_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches grouped by category and name, written as a capture and read again."""
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    folder = tempfile.mkdtemp()  # captures are test fixtures on the driver's disk
    rest.write_capture([("node", "regions", region), ("node", "nations", nation), ("node", "regions", region)], folder)
    parts = [df.select(F.lit(name).alias("name"), "k", "v") for name, df in sorted(rest.read_capture(spark, folder).items())]
    return parts[0].unionByName(parts[1])


@query(
    "comment_cut",
    "SELECT conv_id, conv_id * 100 + turn AS id FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 100 + turn) <= 4",
)
def comment_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Of each thread the first four times as many comments as may represent it."""
    return text.first_comments(comments(spark, sf), ["conv_id"], 1).select("conv_id", "id")
