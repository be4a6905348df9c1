"""Syntax graphs made of the generated tables, and the stored queries over what the engine wrote of them.

Suppliers are files, parts are functions of them, brands are libraries, nations are classes and endpoints, regions are tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.ids import node_id_of, uuid5_sql
from loamgraph.operators import snapshot, stored
from loamgraph.operators.ingest import GraphData
from loamgraph.plans.registry import query
from loamgraph.plans.snapshot_queries import STAMP, edge_sql, embed, listed_sql, no_text
from loamgraph.schema import Registry
from loamgraph.service import Engine
from loamgraph.session import scratch, table
from loamgraph.sources.graph_store import Frames

SHA, URL = "sha0", "https://host/code"
REGISTRY = Registry.declared(extra_edges=True)


def syntax(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a parser would give them; some edges lead nowhere."""
    kind = "key string, kind string, name string, file string, body string, start long, end long, meta map<string,string>"
    meta = lambda *pairs: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in pairs])
    none = F.create_map().cast("map<string,string>")
    zero = F.lit(0).cast("long")

    def node(rows: DataFrame, key, name: str, title, file, body=no_text(), start=zero, end=zero, about=none) -> DataFrame:
        made = rows.select(
            key.alias("key"), F.lit(name).alias("kind"), title.alias("name"), file.alias("file"), body.alias("body"), start.alias("start"), end.alias("end"),
            about.alias("meta"),
        )
        return made.select(*[F.col(x.split()[0]) for x in kind.split(", ")])

    suppliers = table(spark, sf, "supplier")
    count = suppliers.count()
    s, p, n, r = F.col("s_suppkey").cast("string"), F.col("p_partkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("r_regionkey").cast("string")
    at = lambda k: F.concat(F.lit("/r/f"), k.cast("string"), F.lit(".py"))
    home = F.col("p_partkey") % count
    parts, nations = table(spark, sf, "part"), table(spark, sf, "nation")
    about = meta("component", F.when(F.col("p_partkey") % 2 == 0, "Yes").otherwise("no"), "interface", F.col("p_type"))
    size = F.col("p_size").cast("long")
    nodes = [
        node(suppliers, F.concat(F.lit("s"), s), "FILE", no_text(), at(F.col("s_suppkey")), about=meta("language", "python")),
        node(
            parts, F.concat(F.lit("p"), p), "Function", F.concat(F.lit("fn"), p), at(home),
            F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit("\n"))), size, size + 2, about,
        ),
        node(parts.select("p_brand").distinct(), F.col("p_brand"), "Library", F.col("p_brand"), F.lit("")),
        node(nations, F.concat(F.lit("c"), n), "Class", F.concat(F.lit("C"), n), at(F.lit(0)), F.concat(F.lit("class "), F.col("n_name"))),
        node(nations, F.concat(F.lit("e"), n), "Endpoint", F.concat(F.lit("/api/"), n), at(F.lit(0)), about=meta("http_method", "GET")),
        node(table(spark, sf, "region"), F.concat(F.lit("t"), r), "Test", F.concat(F.lit("test"), r), at(F.lit(0))),
    ]
    edge = lambda rows, a, b, name: rows.select(a.alias("source"), b.alias("target"), F.lit(name).alias("kind"))
    fn = lambda k: F.concat(F.lit("p"), k.cast("string"))
    edges = [
        edge(
            parts, F.concat(F.lit("s"), home.cast("string")), fn(F.col("p_partkey")), "Contains",
        ), edge(parts, F.concat(F.lit("s"), home.cast("string")), F.col("p_brand"), "contains"),
        edge(parts, fn(F.col("p_partkey")), fn(F.col("p_partkey") + 1), "Calls"), edge(parts, fn(F.col("p_partkey")), F.lit("gone"), "Uses"), edge(
            nations, F.concat(F.lit("c"), n), fn(F.col("n_nationkey")), "Operand",
        ),
        edge(nations, F.lit("s0"), F.concat(F.lit("c"), n), "Contains"), edge(nations, F.concat(F.lit("e"), n), fn(F.col("n_nationkey")), "Handler"), edge(
            nations, F.concat(F.lit("c"), n), F.concat(F.lit("c"), (F.col("n_nationkey") + 1).cast("string")), "ParentOf",
        ),
    ]
    merge = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(merge(frames[1:]))
    return merge(nodes), merge(edges)


_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf: str) -> Engine:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENGINES:
        e = Engine(spark, scratch(spark, "code"), embed=embed, registry=REGISTRY, buckets=4)
        nodes, edges = syntax(spark, sf)
        e.sync.process(snapshot.ast_graph(nodes, edges, SHA, F.lit(STAMP).cast("timestamp"), URL, "own/code", "/r", snapshot.Options(embed=embed), REGISTRY))
        stored.create_nodes(e.sync, "version", [{"sha": SHA}])
        tests = table(spark, sf, "region").collect()
        test = lambda r: node_id_of("test", version_sha=SHA, file_path="f0.py", name=f"test{r['r_regionkey']}")
        stored.create_edges(e.sync, "tests_function", [(test(r), function_id(r["r_regionkey"], 0)) for r in tests if r["r_regionkey"] == 0], "test", "function")
        _ENGINES[key] = e
    return _ENGINES[key]


def rows(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return engine(spark, sf).show(REGISTRY.specs[kind].table, 0)


def function_id(k: int, file: int) -> str:
    return node_id_of("function", version_sha=SHA, file_path=f"f{file}.py", name=f"fn{k}")


FN, FL = uuid5_sql("'function|version_sha=sha0|file_path=' || path || '|name=' || fn"), uuid5_sql("'file|version_sha=sha0|path=' || path")
CHUNK = uuid5_sql("'codechunk|source_node_id=' || id || '|chunk_order=0'")
EMBEDDING = uuid5_sql("'code|own/code|sha0|' || id || '|0'", "6ba7b8119dad11d180b400c04fd430c8")
CODE = f"""
WITH m AS (SELECT count(*) AS m FROM supplier), files AS (SELECT 'f' || s_suppkey || '.py' AS path FROM supplier), file_ids AS (SELECT path, {FL} AS id FROM files),
fns AS (SELECT p_partkey AS k, 'fn' || p_partkey AS fn, 'f' || (p_partkey % m) || '.py' AS path, p_type, p_size, p_brand, p_name FROM part, m),
functions AS (SELECT *, {FN} AS id FROM fns), classes AS (SELECT n_nationkey AS k, {uuid5_sql("'class|version_sha=sha0|file_path=f0.py|name=C' || n_nationkey")} AS id, n_name FROM nation),
endpoints AS (SELECT n_nationkey AS k, {uuid5_sql("'endpoint|version_sha=sha0|file_path=f0.py|path=/api/' || n_nationkey")} AS id FROM nation),
bodies AS (SELECT id, 'function' AS kind, path, fn AS name, p_name AS text FROM functions WHERE k % 5 <> 0 UNION ALL SELECT id, 'class', 'f0.py', 'C' || k, 'class ' || n_name FROM classes),
chunks AS (SELECT *, {CHUNK} AS chunk_id, {EMBEDDING} AS embedding_id, [length(text) % 7 + 1, length(text) % 5, length(text) % 3, 1]::DOUBLE[] AS e FROM bodies),
vecs AS (SELECT *, {uuid5_sql("'vector|codechunk|' || embedding_id")} AS vid FROM chunks)
"""


# -- the syntax graph


@query(
    "ast_functions",
    CODE + "SELECT path AS file_path, fn AS name, p_type AS signature, (p_size + 1)::INT AS start_line, (p_size + 3)::INT AS end_line, k % 2 = 0 AS is_component FROM functions",
)
def ast_functions(spark: SparkSession, sf: str) -> DataFrame:
    return rows(spark, sf, "function").select("file_path", "name", "signature", "start_line", "end_line", "is_component")


@query(
    "ast_other_nodes",
    CODE + "SELECT 'file' AS kind, path AS name FROM files UNION ALL SELECT DISTINCT 'library', p_brand FROM part UNION ALL SELECT 'class', 'C' || n_nationkey FROM nation UNION ALL SELECT 'endpoint', '/api/' || n_nationkey FROM nation UNION ALL SELECT 'test', 'test' || r_regionkey FROM region",
)
def ast_other_nodes(spark: SparkSession, sf: str) -> DataFrame:
    names = {"file": "path", "library": "name", "class": "name", "endpoint": "path", "test": "name"}
    parts = [rows(spark, sf, k).select(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges_of(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return rows(spark, sf, f"edge_{kind}").select("id", "from_node_id", "to_node_id", "from_node_type", "to_node_type")


@query(
    "ast_contains",
    CODE + f""", e AS (SELECT {uuid5_sql("'version|sha=sha0'")} AS from_node_id, id AS to_node_id, 'version' AS from_node_type, 'file' AS to_node_type FROM file_ids
    UNION ALL SELECT f.id, g.id, 'file', 'function' FROM functions g JOIN file_ids f USING (path) UNION ALL SELECT f.id, c.id, 'file', 'class' FROM classes c, file_ids f WHERE f.path = 'f0.py') SELECT {edge_sql("contains")} AS id, * FROM e""",
)
def ast_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the version and what files may contain; libraries are dependencies instead."""
    return edges_of(spark, sf, "contains")


@query(
    "ast_depends",
    CODE + f""", e AS (SELECT DISTINCT f.id AS from_node_id, {uuid5_sql("'library|name=' || p_brand")} AS to_node_id, 'file' AS from_node_type, 'library' AS to_node_type FROM functions JOIN file_ids f USING (path)) SELECT {edge_sql("dependson")} AS id, * FROM e""",
)
def ast_depends(spark: SparkSession, sf: str) -> DataFrame:
    return edges_of(spark, sf, "dependson")


@query(
    "ast_calls",
    CODE + f""", e AS (SELECT a.id AS from_node_id, b.id AS to_node_id, 'function' AS from_node_type, 'function' AS to_node_type FROM functions a JOIN functions b ON b.k = a.k + 1) SELECT {edge_sql("calls")} AS id, * FROM e""",
)
def ast_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to unknown ends are left out: the last function's call, every use of what is gone."""
    return edges_of(spark, sf, "calls").unionByName(edges_of(spark, sf, "uses"))


@query(
    "ast_handlers",
    CODE + f""", e AS (SELECT 'h' AS t, e.id AS from_node_id, f.id AS to_node_id, 'endpoint' AS from_node_type, 'function' AS to_node_type FROM endpoints e JOIN functions f USING (k) UNION ALL SELECT 'o', c.id, f.id, 'class', 'function' FROM classes c JOIN functions f USING (k)
    UNION ALL SELECT 'p', a.id, b.id, 'class', 'class' FROM classes a JOIN classes b ON b.k = a.k + 1) SELECT CASE t WHEN 'h' THEN {edge_sql("handler")} WHEN 'o' THEN {edge_sql("operand")} ELSE {edge_sql("parentof")} END AS id, * EXCLUDE t FROM e""",
)
def ast_handlers(spark: SparkSession, sf: str) -> DataFrame:
    return edges_of(spark, sf, "handler").unionByName(edges_of(spark, sf, "operand")).unionByName(edges_of(spark, sf, "parentof"))


@query(
    "code_chunks",
    CODE + "SELECT chunk_id AS id, kind || '::sha0::' || path || '::' || name AS source_node_key, id AS source_node_id, text, embedding_id, length(text) - length(replace(text, ' ', '')) + 1 AS token_count FROM chunks",
)
def code_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Trimmed bodies that are not blank."""
    return rows(spark, sf, "codechunk").select("id", "source_node_key", "source_node_id", "text", "embedding_id", F.col("token_count").cast("long").alias("token_count"))


@query(
    "code_embeds",
    CODE + f""", x AS (SELECT id AS from_node_id, chunk_id AS to_node_id, vid, kind FROM vecs) SELECT {edge_sql("embeds")} AS id, from_node_id, vid AS to_node_id, kind AS from_node_type, 'codechunk' AS to_node_type FROM x""",
)
def code_embeds(spark: SparkSession, sf: str) -> DataFrame:
    """An edge's id is made of the chunk's own id, its end is the vector's."""
    return edges_of(spark, sf, "embeds")


# -- stored queries


def graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges as the engine keeps them, and the vectors."""
    e = engine(spark, sf)
    store = e.graph()
    return store.nodes, store.edges, e.views()[2]


@query("function_details", CODE + "SELECT id FROM functions WHERE fn = 'fn11' AND path = 'f' || (11 % (SELECT m FROM m)) || '.py'")
def function_details(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.find_function_details(nodes, edges, "fn11", f"f{11 % table(spark, sf, 'supplier').count()}.py", SHA).select("id")


@query("function_callees", CODE + "SELECT b.id, b.path FROM functions a JOIN functions b ON b.k = a.k + 1 WHERE a.fn = 'fn0'")
def function_callees(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.function_callees(Frames(nodes, edges), function_id(0, 0)).select("id", "path")


@query("function_callers", CODE + "SELECT a.id, a.path FROM functions a JOIN functions b ON b.k = a.k + 1 WHERE b.k = (SELECT m FROM m)")
def function_callers(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.function_callers(Frames(nodes, edges), function_id(table(spark, sf, "supplier").count(), 0)).select("id", "path")


@query("tests_for_function", f"SELECT {uuid5_sql(chr(39) + 'test|version_sha=sha0|file_path=f0.py|name=test0' + chr(39))} AS id, 'test' AS label")
def tests_for_function(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.tests_for_function(nodes, edges, function_id(0, 0)).select("id", "label")


@query("endpoint_handler", CODE + "SELECT id, 'function' AS label FROM functions WHERE k = 5")
def endpoint_handler(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.endpoint_handler(nodes, edges, "/api/5", "GET").select("id", "label")


@query("files_in_version", CODE + "SELECT id, 'file' AS label FROM file_ids")
def files_in_version(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = graph(spark, sf)
    return stored.files_in_version(nodes, edges, node_id_of("version", sha=SHA)).select("id", "label")


ASKED = [3.0, 4.0, 1.0, 1.0]
NEAR = CODE + f", q AS (SELECT {ASKED}::DOUBLE[] AS q), near AS (SELECT *, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS distance FROM vecs, q), top AS (SELECT * FROM near ORDER BY round(distance, 9), vid LIMIT 40)"


@query("similar_function_chunks", NEAR + " SELECT DISTINCT id, 'function' AS label FROM top WHERE kind = 'function'")
def similar_function_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return stored.similar_chunks(*graph(spark, sf), ASKED, 40).select("id", "label")


@query("similar_class_chunks", CODE + "SELECT DISTINCT id, 'class' AS label FROM vecs WHERE kind = 'class'")
def similar_class_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks are near enough here; those of classes count."""
    return stored.similar_chunks(*graph(spark, sf), ASKED, 1 << 30, "class").select("id", "label")


@query("relevant_docs", NEAR + " SELECT vid AS id, round(1 / (1 + distance), 6) AS similarity FROM top")
def relevant_docs(spark: SparkSession, sf: str) -> DataFrame:
    return stored.relevant_docs(graph(spark, sf)[2], ASKED, 40, "codechunk").select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "relevant_callees",
    CODE + ", top AS (SELECT id FROM vecs WHERE kind = 'function') SELECT b.id FROM functions a JOIN functions b ON b.k = a.k + 1 WHERE a.fn = 'fn0' AND b.id IN (SELECT id FROM top)",
)
def relevant_callees(spark: SparkSession, sf: str) -> DataFrame:
    """Callees that are among the functions with the nearest chunks; here all chunks are near enough."""
    return stored.relevant_callees(*graph(spark, sf), function_id(0, 0), ASKED, 1 << 30).select("id")


# -- stored writes


def written(spark: SparkSession, sf: str) -> tuple[Engine, list, list]:
    """Everything that stored queries write, from the nations and regions."""
    e = Engine(spark, scratch(spark, "stored"), embed=embed, registry=REGISTRY)
    nations, regions = table(spark, sf, "nation").orderBy("n_nationkey").collect(), table(spark, sf, "region").orderBy("r_regionkey").collect()
    version, file = node_id_of("version", sha=SHA), node_id_of("file", version_sha=SHA, path="r0.py")
    stored.create_nodes(e.sync, "project", [{"url": f"https://host/{r['r_regionkey']}", "name": r["r_name"]} for r in regions])
    stored.create_version(e.sync, "https://host/0", {"sha": SHA}, {"sha": "c0", "message": "m"})
    stored.create_contained(e.sync, "file", [{"version_sha": SHA, "path": f"r{r['r_regionkey']}.py"} for r in regions], version, "version")
    own = lambda kind, rows_: stored.create_contained(e.sync, kind, [{"version_sha": SHA, "file_path": "r0.py", **r} for r in rows_], file, "file")
    own("function", [{"name": r["n_name"]} for r in nations])
    own("class", [{"name": r["r_name"]} for r in regions])
    own("datamodel", [{"name": r["r_name"], "construct": "struct"} for r in regions])
    own("test", [{"name": r["n_name"]} for r in nations])
    own("endpoint", [{"path": f"/{r['r_name']}", "http_method": "GET"} for r in regions])
    of = lambda kind, name: node_id_of(kind, version_sha=SHA, file_path="r0.py", name=name)
    fns, tests = ([of(k, r["n_name"]) for r in nations] for k in ("function", "test"))
    classes, ends = [of("class", r["r_name"]) for r in regions], [node_id_of("endpoint", version_sha=SHA, file_path="r0.py", path=f"/{r['r_name']}") for r in regions]
    stored.create_edges(e.sync, "calls", list(zip(fns, fns[1:], strict=False)), "function", "function")
    stored.create_edges(e.sync, "tests_function", list(zip(tests, fns, strict=True)), "test", "function")
    stored.create_edges(e.sync, "tests_class", list(zip(tests, classes, strict=False)), "test", "class")
    stored.create_edges(e.sync, "tests_endpoint", list(zip(tests, ends, strict=False)), "test", "endpoint")
    stored.create_edges(e.sync, "handler", list(zip(ends, fns, strict=False)), "endpoint", "function")
    chunk = lambda kind, node, name: {
        "id": f"k-{name}", "source_node_id": node, "source_node_key": f"{kind}::{SHA}::r0.py::{name}", "text": name, "embedding": [1.0, 2.0],
        "embedding_id": f"e-{kind}-{name}",
    }
    stored.embed_chunks(e.sync, [chunk("function", f, r["n_name"]) for f, r in zip(fns, nations, strict=True)])
    stored.embed_chunks(e.sync, [chunk("class", c, r["r_name"]) for c, r in zip(classes, regions, strict=True)])
    return e, nations, regions


TABLES = "entities/project entities/version entities/commit entities/file entities/function entities/class entities/datamodel entities/test entities/endpoint vectors/codechunk edges/hasversion edges/iscommit edges/contains edges/calls edges/tests_function edges/tests_class edges/tests_endpoint edges/handler edges/embeds"
WRITTEN = "r AS (SELECT count(*) AS r FROM region), n AS (SELECT count(*) AS n FROM nation)"
SIZES = dict(zip(TABLES.split(), "r 1 1 r n r r n r n+r 1 1 4*r+2*n n-1 n r r r n+r".split(), strict=True))


@query(
    "stored_writes",
    f"WITH {WRITTEN} " + " UNION ALL ".join(f"SELECT '{t}' AS name, ({n})::BIGINT AS rows FROM r, n" for t, n in SIZES.items()) + " UNION ALL SELECT 'https://host/1', 1",
)
def stored_writes(spark: SparkSession, sf: str) -> DataFrame:
    e, _, _ = written(spark, sf)
    found = stored.find_project_by_url(e.views()[0], "https://host/1").count()
    return spark.createDataFrame([*((t, e.row_count(f"silver/{t}")) for t in SIZES), ("https://host/1", found)], "name string, rows long")


@query("stored_call_edges", f"""WITH f AS (SELECT n_nationkey AS k, {uuid5_sql("'function|version_sha=sha0|file_path=r0.py|name=' || n_name")} AS id, {uuid5_sql("'test|version_sha=sha0|file_path=r0.py|name=' || n_name")} AS t FROM nation),
    e AS (SELECT 'c' AS x, a.id AS from_node_id, b.id AS to_node_id FROM f a JOIN f b ON b.k = a.k + 1 UNION ALL SELECT 't', t, id FROM f) SELECT CASE x WHEN 'c' THEN {edge_sql("calls")} ELSE {edge_sql("tests_function")} END AS id, from_node_id, to_node_id FROM e""")
def stored_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    e, _, _ = written(spark, sf)
    parts = [e.show(f"silver/edges/{t}", 0).select("id", "from_node_id", "to_node_id") for t in ("calls", "tests_function")]
    return parts[0].unionByName(parts[1])


@query(
    "stored_delete_version",
    f"WITH {WRITTEN} SELECT 'entities/project' AS name, r::BIGINT AS rows FROM r UNION ALL SELECT 'entities/commit', 1 UNION ALL " + " UNION ALL ".join(f"SELECT '{t}', 0" for t in SIZES if t not in (
        "entities/project", "entities/commit", "vectors/codechunk",
    )),
)
def stored_delete_version(spark: SparkSession, sf: str) -> DataFrame:
    """A version goes with what was found in it and the edges at either end of that; its project and commit stay."""
    e, _, _ = written(spark, sf)
    stored.delete_version(e.sync, SHA)
    return spark.createDataFrame([(t, e.row_count(f"silver/{t}")) for t in SIZES if t != "vectors/codechunk"], "name string, rows long")


@query("graph_after_changes", listed_sql("f1 f2", "") + " UNION ALL SELECT 'project'")
def graph_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The kept graph follows the tables: rows added, changed and deleted between two requests."""
    e = Engine(spark, scratch(spark, "changes"), registry=REGISTRY, buckets=4)
    stored.create_nodes(e.sync, "project", [{"url": URL}])
    stored.create_version(e.sync, URL, {"sha": SHA}, {"sha": "c"})
    stored.create_contained(e.sync, "file", [{"version_sha": SHA, "path": p} for p in ("f1", "f2", "f3")], node_id_of("version", sha=SHA), "version")
    before = e.subgraph(node_id_of("version", sha=SHA), "contains", 1, 0, 0).nodes.count()
    assert before == 4
    e.sync.table(REGISTRY.entity("file")).delete(F.col("path") == "f3")
    e.sync.process(GraphData().add(REGISTRY.entity("project"), spark.createDataFrame([(URL, "project")], "url string, name string")))
    found = e.subgraph(node_id_of("version", sha=SHA), "contains", 1, 0, 0).nodes.select("id").collect()
    store = e.graph()
    names = store.nodes_of([r["id"] for r in found] + [node_id_of("project", url=URL)]).filter("label in ('file', 'project')")
    field = F.when(F.col("label") == "file", F.get_json_object("properties", "$.path")).otherwise(F.get_json_object("properties", "$.name"))
    return names.select(field.alias("name"))
