"""A repository snapshot, or an abstract syntax graph, mapped to entity batches by DataFrame transforms.

Snapshot frames (any number of repositories at once, joined by ``project_url``):
  repositories: project_url, full_name, name, description, language, stars, forks, sha, tag, is_head, message, authored_at
  developers: columns of the developer type
  issues, pulls: columns of their types, ``label_list`` array of struct(name, color, description), for pulls also ``links`` array of
    struct(owner, repo, number, link_type, strength, origin, cross_repo)
  readmes: project_url, text, source_file
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.functions import ids, text
from loamgraph.functions.embedding import Provider, null_embedding
from loamgraph.operators.ingest import GraphData
from loamgraph.schema import REGISTRY, Registry
from loamgraph.session import pin

# What a file contains, and how AST edges are called here.
CONTAINED_IN_FILE = ("class", "function", "datamodel", "variable", "test", "endpoint")
AST_EDGES = ("contains", "calls", "uses", "operand", "handler", "parentof", "implements", "nestedin", "imports")
CHUNKED = ("function", "class")


def edges_of(
    kind: str, rows: DataFrame, source: Column, target: Column, source_type: Column | str, target_type: Column | str, created: Column, updated: Column,
) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    made = rows.select(
        source.alias("from_node_id"), target.alias("to_node_id"), lit(source_type).alias("from_node_type"), lit(target_type).alias("to_node_type"),
        created.alias("created_at"), updated.alias("updated_at"),
    )
    return made.filter("from_node_id is not null and to_node_id is not null").select(
        ids.edge_id(f"edge_{kind}", F.col("from_node_id"), F.col("to_node_id")).alias("id"), "*",
    )


@dataclass
class Options:
    developers: bool = True
    issues: bool = True
    pulls: bool = True
    readme: bool = True
    embed: Provider = null_embedding
    model: str | None = None


def project_id(url: Column) -> Column:
    return ids.node_id("project", [("url", url)])


def numbered_id(kind: str, url: Column, number: Column) -> Column:
    return ids.node_id(kind, [("project_url", url), ("number", number)])


def unique_developers(developers: DataFrame) -> DataFrame:
    """One row per platform, account and login, case of platform and login aside; rows without any of them are left out."""
    filled = reduce(lambda a, b: a & b, [text.strip(F.coalesce(F.col(c), F.lit(""))) != "" for c in ("platform", "account_id", "login")])
    w = Window.partitionBy(F.lower("platform"), "account_id", F.lower("login")).orderBy("platform", "login")
    return developers.filter(filled).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def author_ids(rows: DataFrame, developers: DataFrame) -> DataFrame:
    """``rows`` with developer_id: the developer of this account and login, else the one of this login; null if there is neither."""
    dev = developers.select(
        ids.node_id("developer", [(k, F.col(k)) for k in ("platform", "account_id", "login")]).alias("_dev"), "account_id", F.lower("login").alias("_login"),
        F.lower("platform").alias("_platform"),
    )
    exact = dev.filter("_platform = 'github'").select(F.col("_dev").alias("_exact"), F.col("account_id").alias("_account"), F.col("_login").alias("_l1"))
    loose = dev.groupBy(F.col("_login").alias("_l2")).agg(F.min("_dev").alias("_loose"))
    joined = rows.join(
        exact, (F.col("author_id") == F.col("_account")) & (F.lower("author_login") == F.col("_l1")), "left",
    ).join(loose, F.lower("author_login") == F.col("_l2"), "left")
    return joined.withColumn("developer_id", F.coalesce("_exact", "_loose")).drop("_exact", "_account", "_l1", "_l2", "_loose")


def unique_labels(rows: DataFrame) -> DataFrame:
    """Labels of issues and pulls by project and lower-cased name; the casing met first stays. ``rows``: project_url, place, name, color, description."""
    w = Window.partitionBy("project_url", F.lower("name")).orderBy("place", "name")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def snapshot_graph(
    repositories: DataFrame, developers: DataFrame | None = None, issues: DataFrame | None = None, pulls: DataFrame | None = None,
    readmes: DataFrame | None = None, options: Options | None = None, registry: Registry = REGISTRY,
) -> GraphData:
    o, graph, spec = options or Options(), GraphData(), registry.specs
    at = F.col("authored_at")
    graph.add(spec["project"], repositories.select(F.col("project_url").alias("url"), "name", "description", "language", "stars", "forks"))
    graph.add(spec["version"], repositories.select("sha", "tag", "is_head", at.alias("created_at")))
    graph.add(spec["commit"], repositories.select("sha", "message", at.alias("committed_at")))
    version, commit = (ids.node_id(k, [("sha", F.col("sha"))]) for k in ("version", "commit"))
    graph.add(spec["edge_hasversion"], edges_of("hasversion", repositories, project_id(F.col("project_url")), version, "project", "version", at, at))
    graph.add(spec["edge_iscommit"], edges_of("iscommit", repositories, version, commit, "version", "commit", at, at))
    people = unique_developers(developers) if developers is not None and o.developers else None
    graph.add(spec["developer"], people)
    names = repositories.select("project_url", "full_name")
    labelled = []
    for rank, (kind, rows, wanted) in enumerate((("issue", issues, o.issues), ("pullrequest", pulls, o.pulls))):
        if rows is None or not wanted:
            continue
        short = "issue" if kind == "issue" else "pr"
        node = numbered_id(kind, F.col("project_url"), F.col("number"))
        created, updated = F.col("created_at"), F.col("updated_at")
        graph.add(spec[kind], rows)
        graph.add(spec[f"edge_has{short}"], edges_of(f"has{short}", rows, project_id(F.col("project_url")), node, "project", kind, created, updated))
        if people is not None:
            opened = author_ids(rows, people)
            graph.add(spec[f"edge_opened{short}"], edges_of(f"opened{short}", opened, F.col("developer_id"), node, "developer", kind, created, updated))
        labelled.append(rows.select(
            "project_url", node.alias("node"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), "number", created, updated,
            F.posexplode("label_list").alias("place", "label"),
        ))
        document = (text.issue_document if kind == "issue" else text.pull_request_document)(F.col("full_name"))
        docs = rows.join(names, "project_url").withColumn("text", document)
        scheme = "issue-doc" if kind == "issue" else "pr-doc"
        embedding = o.embed(F.col("text"))
        graph.add(
            spec[f"{short}doc"],
            docs.select(
                F.lit(None).cast("string").alias("id"), "project_url", F.col("number").alias(f"{short}_number"), F.coalesce(
                    "updated_at", "created_at",
                ).alias("source_updated_at"), "text", embedding.alias("embedding"),
                F.lit(o.model).alias("embedding_model"), F.concat(
                    F.lit(f"{scheme}://"), F.col("full_name"), F.lit("/"), F.col("number").cast("string"), F.lit("#doc#0"),
                ).alias("embedding_id"),
                text.token_count(F.col("text")).alias("token_count"), F.lit(0).alias("chunk_order"), "created_at", "updated_at",
            ),
        )
        if kind == "pullrequest" and issues is not None and o.issues:
            linked = rows.select("project_url", node.alias("node"), created, updated, F.explode("links").alias("l")).filter("not l.cross_repo")
            known = issues.select("project_url", F.col("number").alias("_number"))
            hit = linked.join(known, (linked["project_url"] == known["project_url"]) & (F.col("l.number") == F.col("_number"))).drop(known["project_url"])
            graph.add(
                spec["edge_relatesto"],
                edges_of(
                    "relatesto", hit, F.col("node"), numbered_id("issue", F.col("project_url"), F.col("_number")), "pullrequest", "issue",
                    F.coalesce("updated_at", "created_at"), updated,
                ).dropDuplicates(["id"]),
            )
    if labelled:
        every = reduce(lambda a, b: a.unionByName(b), labelled)
        order = F.struct("rank", "number", "place")
        flat = every.select("project_url", "node", "kind", "created_at", "updated_at", order.alias("place"), "label.name", "label.color", "label.description")
        labels = unique_labels(flat.select("project_url", "place", "name", "color", "description"))
        graph.add(spec["label"], labels.select("project_url", "name", "color", "description"))
        chosen = labels.select(F.col("project_url").alias("_u"), F.lower("name").alias("_l"), F.col("name").alias("_name"))
        hit = flat.join(chosen, (F.col("project_url") == F.col("_u")) & (F.lower("name") == F.col("_l")))
        label_id = ids.node_id("label", [("project_url", F.col("project_url")), ("name", F.col("_name"))])
        graph.add(
            spec["edge_haslabel"],
            edges_of("haslabel", hit, F.col("node"), label_id, F.col("kind"), "label", F.col("created_at"), F.col("updated_at")).dropDuplicates(["id"]),
        )
    if readmes is not None and o.readme:
        graph.add(spec["readmechunk"], readme_chunks(readmes, repositories, o))
    return graph


def readme_chunks(readmes: DataFrame, repositories: DataFrame, o: Options) -> DataFrame:
    rows = text.line_chunks(readmes.join(repositories.select("project_url", "full_name", "sha", "authored_at"), "project_url"))
    ident = ids.readme_embedding_id(F.col("full_name"), F.col("sha"), F.col("start_line"), F.col("end_line"), F.col("chunk_order"))
    return rows.select(
        F.lit(None).cast("string").alias("id"), "project_url", F.col("sha").alias("revision_sha"), "source_file", "start_line", "end_line", F.col("chunk_text").alias("text"), o.embed(F.col("chunk_text")).alias("embedding"),
        F.lit(o.model).alias("embedding_model"), ident.alias("embedding_id"), text.token_count(F.col("chunk_text")).alias("token_count"), "chunk_order", F.col("authored_at").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
    )


# -- abstract syntax graphs ----------------------------------------------------------------------------


def ast_nodes(nodes: DataFrame, sha: str, root: str = "") -> DataFrame:
    """``nodes`` (key, kind, name, file, body, start, end, meta map) with entity type, path relative to ``root``, lines from 1 and node_id.

    Nodes without what their key needs are left out.
    """
    meta = lambda k: F.element_at("meta", k)
    blank = lambda c: F.nullif(c, F.lit(""))
    prefix = root.rstrip("/") + "/" if root else ""
    relative = lambda c: F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(c) if prefix else c
    kind = F.regexp_replace(F.lower("kind"), "_", "")
    raw = F.when(kind == "file", F.coalesce(blank(F.col("file")), blank(F.col("name")))).otherwise(F.coalesce(blank(F.col("file")), meta("file_path"), meta("file")))
    base = nodes.withColumns({
        "entity": kind, "path": relative(raw), "title": blank(F.col("name")), "start_line": (F.col("start") + 1).cast("int"),
        "end_line": (F.col("end") + 1).cast("int"),
    })
    version = F.lit(sha)
    keyed = lambda t: ids.node_id(t, [("version_sha", version), ("file_path", F.col("path")), ("name", F.col("title"))])
    own = F.when(F.col("entity") == "file", ids.node_id("file", [("version_sha", version), ("path", F.col("path"))]))
    own = own.when(F.col("entity") == "library", ids.node_id("library", [("name", F.col("title"))]))
    own = own.when(F.col("entity") == "endpoint", ids.node_id("endpoint", [("version_sha", version), ("file_path", F.col("path")), ("path", F.col("title"))]))
    for t in ("class", "trait", "function", "datamodel", "variable", "test"):
        own = own.when(F.col("entity") == t, keyed(t))
    return base.withColumns({"version_sha": version, "node_id": own}).filter("node_id is not null")


def ast_graph(
    nodes: DataFrame, edges: DataFrame, sha: str, created: Column, project_url: str, full_name: str, root: str = "", options: Options | None = None,
    registry: Registry = REGISTRY,
) -> GraphData:
    """Nodes of nine kinds; containment of files and what files may contain; libraries become dependencies; code chunks of functions and classes."""
    o, graph, spec = options or Options(), GraphData(), registry.specs
    mapped = pin(ast_nodes(nodes, sha, root))  # twenty batches are made of it
    meta = lambda k: F.element_at("meta", k)
    lines = ["start_line", "end_line"]
    common = ["version_sha", F.col("path").alias("file_path"), F.col("title").alias("name")]
    true = F.lower(meta("component")).isin("1", "true", "yes", "y")
    columns = {
        "file": ["version_sha", "path", meta("language").alias("language")],
        "library": [F.col("title").alias("name"), meta("version").alias("version")],
        "class": [*common, *lines],
        "trait": [*common, *lines],
        "function": [*common, F.coalesce(meta("signature"), meta("interface")).alias("signature"), *lines, true.alias("is_component")],
        "datamodel": [*common, F.coalesce(meta("construct"), meta("type")).alias("construct"), *lines],
        "variable": [*common, meta("data_type").alias("data_type")],
        "test": [*common, meta("test_kind").alias("test_kind"), *lines],
        "endpoint": ["version_sha", F.col("path").alias("file_path"), F.col("title").alias("path"), meta("http_method").alias("http_method")],
    }
    for kind, picked in columns.items():
        graph.add(spec[kind], mapped.filter(F.col("entity") == kind).select(*picked).distinct())
    ends = mapped.select("key", F.col("node_id").alias("id"), "entity")
    version = ids.node_id("version", [("sha", F.lit(sha))])
    none = F.lit(None).cast("timestamp")
    files = edges_of("contains", ends.filter("entity = 'file'"), version, F.col("id"), "version", "file", created, none)
    both = (
        edges.select("source", "target", F.regexp_replace(F.lower("kind"), "_", "").alias("kind"))
        .join(ends.select(F.col("key").alias("source"), F.col("id").alias("s"), F.col("entity").alias("st")), "source")
        .join(ends.select(F.col("key").alias("target"), F.col("id").alias("t"), F.col("entity").alias("tt")), "target")
    )
    for kind in AST_EDGES:
        own = both.filter(F.col("kind") == kind)
        if kind == "contains":
            own = own.filter((F.col("st") == "file") & F.col("tt").isin(*CONTAINED_IN_FILE))
        made = edges_of(kind, own, F.col("s"), F.col("t"), F.col("st"), F.col("tt"), created, none)
        graph.add(spec[f"edge_{kind}"], (made.unionByName(files) if kind == "contains" else made).dropDuplicates(["id"]))
    needs = both.filter("kind = 'contains' and st = 'file' and tt = 'library'")
    graph.add(spec["edge_dependson"], edges_of("dependson", needs, F.col("s"), F.col("t"), "file", "library", created, none).dropDuplicates(["id"]))
    body = text.strip(F.col("body"))
    chunks = mapped.filter(F.col("entity").isin(*CHUNKED) & (body != "") & (F.coalesce("path", F.lit("")) != "")).withColumn("text", body)
    graph.add(
        spec["codechunk"],
        chunks.select(
            ids.code_chunk_id(
                F.col("node_id"), F.lit(0),
            ).alias("id"), F.lit(project_url).alias("project_url"), F.lit(sha).alias("revision_sha"), F.col("path").alias("source_file"),
            ids.source_node_key(
                F.col("entity"), F.lit(sha), F.col("path"), F.col("title"),
            ).alias("source_node_key"), F.col("node_id").alias("source_node_id"), meta("language").alias("language"), "text", o.embed(F.col("text")).alias("embedding"),
            F.lit(o.model).alias("embedding_model"), ids.code_embedding_id(
                F.lit(full_name), F.lit(sha), F.col("node_id"), F.lit(0),
            ).alias("embedding_id"), text.token_count(F.col("text")).alias("token_count"), F.lit(0).alias("chunk_order"),
            created.alias("created_at"), none.alias("updated_at"),
        ),
    )
    return graph
