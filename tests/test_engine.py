"""Ingestion, search, snapshots, sources and the service, end to end on literal fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loamgraph import cli
from loamgraph.functions import embedding
from loamgraph.functions.ids import edge_id_of, node_id_of
from loamgraph.operators import search, snapshot, sqlapi, stored
from loamgraph.operators.graph import InvalidArgument
from loamgraph.operators.ingest import GraphData, PanelData, as_edges, freshness, node_index, records
from loamgraph.schema import REGISTRY
from loamgraph.service import Engine, NotFound, status_of
from loamgraph.sources import rest
from loamgraph.sources.graph_store import Frames

NOW = dt.datetime(2024, 5, 1, 12, tzinfo=dt.timezone.utc)
URL, SHA = "https://host/own/repo", "f" * 40


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "lake"), embed=embedding.hashing_embedding(16))


def chunk(**more):
    return {"project_url": URL, "text": "hello world", "embedding": [0.5, 0.25], "embedding_id": "e1", "token_count": 2, "chunk_order": 0, **more}


def test_vectors_are_idempotent(engine, spark):
    spec = REGISTRY.entity("readmechunk")
    for text in ("old text", "new text"):
        engine.sync.process(GraphData().add(spec, records(spark, spec, [chunk(text=text), chunk(text=text, embedding_id="e2", embedding=[])])))
    rows = {r["embedding_id"]: r for r in engine.lake.table(spec.table).read().collect()}
    index = engine.lake.table(spec.index_table).read().collect()
    assert rows["e1"]["text"] == "new text" and len(index) == 1 and rows["e1"]["id"] == index[0]["vector_uuid"]
    edges = engine.lake.table("silver/edges/containscontent").read().collect()
    assert [(r["from_node_id"], r["to_node_id"]) for r in edges] == [(node_id_of("project", url=URL), index[0]["vector_uuid"])]


def test_shared_embedding_id_in_one_batch(engine, spark):
    spec = REGISTRY.entity("issuedoc")
    rows = [chunk(issue_number=1, embedding_id="same"), chunk(issue_number=2, embedding_id="same")]
    engine.sync.process(GraphData().add(spec, records(spark, spec, rows)))
    assert engine.lake.table(spec.index_table).read().count() == 1
    assert len({r["id"] for r in engine.lake.table(spec.table).read().collect()}) == 1
    assert engine.lake.table("silver/edges/documents").read().count() == 2


def test_code_chunks_give_one_edge(engine, spark):
    spec, source = REGISTRY.entity("codechunk"), node_id_of("function", name="f")
    for v in ([1.0], [2.0]):
        row = {"id": "c1", "source_node_id": source, "source_node_key": f"function::{SHA}::a.py::f", "embedding": v, "embedding_id": "x"}
        engine.sync.process(GraphData().add(spec, records(spark, spec, [row])))
    edges = engine.lake.table("silver/edges/embeds").read().collect()
    assert len(edges) == 1 and edges[0]["from_node_type"] == "function" and edges[0]["from_node_id"] == source
    with pytest.raises(InvalidArgument):
        from dataclasses import replace

        engine.sync.process(GraphData().add(replace(spec, entity_type="nothing"), records(spark, spec, [chunk()])))


def test_node_index_and_edges_skip_bad_rows(spark):
    spec = REGISTRY.entity("file")
    rows = spark.createDataFrame([("s", "p", None), (None, "p", None), ("s", "q", "no uuid")], "version_sha string, path string, id string")
    assert [r["path"] for r in node_index(rows, spec).collect()] == ["p"]
    e = spark.createDataFrame(
        [(None, "no", node_id_of("a")), (None, node_id_of("a"), node_id_of("b"))], "id string, from_node_id string, to_node_id string",
    ).withColumns({c: F.lit("t") for c in ("from_node_type", "to_node_type")})
    assert [r["id"] for r in as_edges(e, REGISTRY.edge("calls")).collect()] == [edge_id_of("edge_calls", node_id_of("a"), node_id_of("b"))]


class Fake:
    name = "fake"

    def __init__(self, what):
        self.what, self.anchor, self.fails = what, "sha-1", False

    def capability(self):
        return {"name": self.name}

    def probe(self, uri):
        if self.fails:
            raise OSError("no network")
        return {"anchor": self.anchor, "anchor_key": "sha"}

    def fetch(self, spark, params):
        if params.get("bad"):
            raise ValueError("bad")
        return self.what(spark)


def test_sync_freshness_and_replay(engine, spark):
    spec = REGISTRY.entity("project")
    fake = Fake(lambda s: GraphData().add(spec, records(s, spec, [{"url": URL, "name": "repo", "stars": 5}])))
    engine.sync.register(fake)
    assert engine.sync.registered() == ["fake"] and not engine.sync.is_fresh(URL, "fake")
    engine.trigger_sync("fake", {}, URL, "project")
    assert engine.sync.is_fresh(URL, "fake") and engine.sync.is_fresh(URL)
    fake.anchor = "sha-2"
    assert not engine.sync.is_fresh(URL, "fake") and not engine.sync.is_fresh(URL, "unknown")
    fake.anchor, fake.fails = None, True
    assert not engine.sync.is_fresh(URL, "fake")
    fake.fails = False
    assert engine.sync.is_fresh(URL, "fake") and not engine.sync.is_fresh(URL, "fake", now=1 << 40)
    with pytest.raises(ValueError):
        engine.trigger_sync("fake", {"bad": 1}, URL, "project")
    assert sorted(r["status"] for r in engine.catalog.rows("task_logs")) == ["FAILED", "SUCCESS"]
    seen = []
    take = lambda spec, path, version, rows: seen.append((path, version, rows.count()))
    assert engine.catalog.offset(spec.table) == -1
    engine.sync.replay(take)
    assert (spec.table, 0, 1) in seen and engine.catalog.offset(spec.table) == 0
    engine.trigger_sync("fake", {}, URL, "project")
    seen.clear()
    engine.sync.replay(take)
    assert (spec.table, 1, 0) in seen and engine.catalog.offset(spec.table) == 1  # the same row again changes nothing
    with pytest.raises(InvalidArgument):
        engine.trigger_sync("nobody", {}, URL, "project")


def test_panels_append(engine):
    fake = Fake(lambda s: PanelData("silver/panel/x", s.createDataFrame([("a",)], "full_name string")))
    engine.sync.register(fake)
    for _ in range(2):
        engine.trigger_sync("fake", {}, "p", "panel")
    assert engine.row_count("silver/panel/x") == 2


def test_freshness_rule(spark):
    requests = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", None), ("d", "f")], "entity_uri string, fetcher string")
    ready = spark.createDataFrame([("a", 100, 50), ("b", 100, 50), ("c", 10, 50)], "entity_uri string, last_synced_at long, ttl_seconds long")
    anchors = spark.createDataFrame([("a", "f", "x")], "entity_uri string, fetcher string, anchor_value string")
    probes = spark.createDataFrame(
        [("a", "f", True, False, None, "x"), ("b", "f", True, False, None, "y")],
        "entity_uri string, fetcher string, known boolean, failed boolean, fresh boolean, remote_anchor string",
    )
    got = {r["entity_uri"]: r["is_fresh"] for r in freshness(requests, ready, anchors, probes, 120).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}


# -- snapshots


def snapshot_frames(spark):
    repos = spark.createDataFrame(
        [(URL, "own/repo", "repo", None, "Rust", 3, 1, SHA, None, True, "msg", NOW)],
        "project_url string, full_name string, name string, description string, language string, stars long, forks long, sha string, tag string, is_head boolean, message string, authored_at timestamp",
    )
    spec = REGISTRY.entity("developer")
    people = records(
        spark, spec,
        [
            {"platform": "GitHub", "account_id": "1", "login": "Ann"}, {"platform": "github", "account_id": "1", "login": "ann"},
            {"platform": " ", "account_id": "2", "login": "x"},
        ],
    )
    extra = "label_list array<struct<name:string,color:string,description:string>>, links array<struct<owner:string,repo:string,number:long,link_type:string,strength:int,origin:string,cross_repo:boolean>>"

    def numbered(kind, rows):
        s = REGISTRY.entity(kind).schema
        names = [*s.names, "label_list", "links"]
        schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in s.fields] + [extra])
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    issue = {
        "project_url": URL, "number": 1, "title": "Bug", "state": "open", "author_login": "ANN", "author_id": "9", "created_at": NOW,
        "label_list": [("Bug", None, None), ("docs", None, None)],
    }
    pull = {
        "project_url": URL, "number": 42, "title": "Fix", "state": "closed", "draft": True, "author_login": "nobody", "created_at": NOW, "updated_at": NOW,
        "label_list": [("bug", None, None)],
        "links": [("own", "repo", 1, "closes", 3, "body", False), ("x", "y", 1, "closes", 3, "body", True), ("own", "repo", 99, "closes", 3, "body", False)],
    }
    readme = spark.createDataFrame([(URL, "# Title\ntext", "README.md")], "project_url string, text string, source_file string")
    return repos, people, numbered("issue", [issue]), numbered("pullrequest", [pull]), readme


def test_snapshot_graph_through_the_engine(engine, spark):
    repos, people, issues, pulls, readme = snapshot_frames(spark)
    graph = snapshot.snapshot_graph(repos, people, issues, pulls, readme, snapshot.Options(embed=embedding.hashing_embedding(16)))
    engine.sync.process(graph)
    count = engine.row_count
    assert [count(f"silver/entities/{t}") for t in ("developer", "label")] == [1, 2]
    assert [count(f"silver/edges/{t}") for t in ("openedissue", "openedpr", "haslabel", "relatesto", "containscontent", "documents")] == [1, 0, 3, 1, 3, 2]
    project = node_id_of("project", url=URL)
    assert engine.node(project)["label"] == "project"
    assert engine.subgraph(project, depth=1).edges.count() == 6
    hits = engine.hybrid_all("bug issue", "issue,issuedoc,readmechunk", 0.5, 10).collect()
    assert {"issue", "issuedoc"} <= {r["label"] for r in hits} and all(r["score"] >= 0 for r in hits) and hits[0]["summary"]
    assert engine.search_index("project", "host/own", 5).count() == 1 and engine.search_index("file", "x", 5).count() == 0
    with pytest.raises(NotFound):
        engine.node(node_id_of("nothing"))
    assert status_of(NotFound("x")) == 404 and status_of(InvalidArgument("x")) == 400 and status_of(OSError()) == 500
    assert cli.run(cli.parser().parse_args(["root", "cold", "count", "silver/entities/issue"]), engine) == [{"rows": 1}]


def test_ast_graph(engine, spark):
    nodes = [("f", "File", "", "/r/a.py", "", 0, 9, {"language": "python"}), ("c", "Class", "C", "/r/a.py", "class C: pass", 1, 2, {}), ("g", "Function", "g", "/r/a.py", " def g() ", 3, 4, {"component": "Yes", "interface": "g()"}), ("d", "DataModel", "D", "/r/a.py", "", 5, 6, {"type": "struct"}), ("l", "Library", "os", "", "", 0, 0, {}), ("e", "Endpoint", "/x", "/r/a.py", "", 0, 0, {"http_method": "GET"}), ("t", "Test", "", "/r/a.py", "", 0, 0, {})]
    edges = [
        ("f", "c", "Contains"), ("f", "d", "Contains"), ("f", "l", "Contains"), ("g", "d", "Contains"), ("c", "g", "Operand"), ("e", "g", "Handler"),
        ("g", "g", "Calls"), ("g", "gone", "Calls"),
    ]
    n = spark.createDataFrame(nodes, "key string, kind string, name string, file string, body string, start long, end long, meta map<string,string>")
    e = spark.createDataFrame(edges, "source string, target string, kind string")
    graph = snapshot.ast_graph(n, e, SHA, F.lit(NOW).cast("timestamp"), URL, "own/repo", "/r", snapshot.Options(embed=embedding.hashing_embedding(16)))
    engine.sync.process(graph)
    pairs = {(r["from_node_type"], r["to_node_type"]) for r in engine.show("silver/edges/contains", 0).collect()}
    assert pairs == {("version", "file"), ("file", "class"), ("file", "datamodel")}
    f = engine.show("silver/entities/function", 0).first()
    assert (f["file_path"], f["start_line"], f["end_line"], f["signature"], f["is_component"]) == ("a.py", 4, 5, "g()", True)
    assert engine.row_count("silver/edges/dependson") == 1 and engine.row_count("silver/vectors/codechunk") == 2 and engine.row_count("silver/edges/embeds") == 2
    assert engine.row_count("silver/entities/test") == 0


def test_stored_writes(engine):
    stored.create_nodes(engine.sync, "project", [{"url": URL, "name": "repo"}])
    stored.create_version(engine.sync, URL, {"sha": SHA}, {"sha": SHA, "message": "m"})
    version = node_id_of("version", sha=SHA)
    stored.create_contained(engine.sync, "file", [{"version_sha": SHA, "path": "a.py"}], version, "version")
    file = node_id_of("file", version_sha=SHA, path="a.py")
    stored.create_contained(engine.sync, "function", [{"version_sha": SHA, "file_path": "a.py", "name": n} for n in "fg"], file, "file")
    f, g = (node_id_of("function", version_sha=SHA, file_path="a.py", name=n) for n in "fg")
    stored.create_edges(engine.sync, "CALLS", [(f, g)], "function", "function")
    nodes, edges, _ = engine.views()
    assert [r["path"] for r in stored.function_callees(Frames(nodes, edges), f).collect()] == ["a.py"]
    assert [r["id"] for r in stored.function_callers(Frames(nodes, edges), g).collect()] == [f]
    assert [r["id"] for r in stored.files_in_version(nodes, edges, version).collect()] == [file]
    assert [r["id"] for r in stored.find_function_details(nodes, edges, "g", "a.py", SHA).collect()] == [g]
    assert stored.find_project_by_url(nodes, URL).first()["id"] == node_id_of("project", url=URL)
    stored.delete_version(engine.sync, SHA)
    assert engine.row_count("silver/entities/version") == 0 and engine.row_count("silver/edges/hasversion") == 0 and engine.row_count("silver/entities/project") == 1


# -- search


def test_bm25_and_vectors(spark):
    docs = spark.createDataFrame(
        [
            ("1", "function", "fn search_engine()"), ("2", "function", "function::search"), ("3", "class", "hybrid search search"), ("4", "class", ""),
            ("5", "class", None),
        ],
        "id string, label string, text string",
    )
    index = search.text_index(docs, label_col="label")
    assert index.documents == 5 and {r["id"] for r in search.bm25(index, "search engine", 10).collect()} == {"1", "2", "3"}
    assert search.bm25(index, "search", 1, "function", post_filter=True).count() == 0 and search.bm25(index, "search", 1, "function").count() == 1
    assert search.bm25(index, "  ", 5).count() == 0 and search.bm25(index, "search", 0).count() == 1
    vecs = spark.createDataFrame(
        [("a", "x", [1.0, 0.0]), ("b", "x", [0.0, 1.0]), ("c", "y", [0.0, 0.0]), ("d", "x", None), ("e", "x", [])],
        "id string, label string, embedding array<float>",
    )
    got = search.knn(vecs, [1.0, 0.0], 5).collect()
    assert [r["id"] for r in got][:1] in (["a"], ["c"]) and all(0 <= r["similarity"] <= 1 for r in got) and len(got) == 3
    assert search.knn(vecs, [], 5).count() == 0 and search.knn(vecs, [1.0, 0.0], 1, label="x").first()["id"] == "a"
    text_only = search.hybrid(index, vecs, "search", [1.0, 0.0], 7.0, 5).collect()
    assert [r["score"] for r in text_only] == sorted((r["score"] for r in text_only), reverse=True)


def test_clusters_find_neighbours(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    clustered, centres = search.cluster_vectors(v, 8)
    queries = [r["embedding"] for r in v.limit(10).collect()]
    hit = sum(len({r["id"] for r in search.knn(v, q, 5).collect()} & {r["id"] for r in search.knn_in_cells(
        clustered, centres, q, 5, probes=5,
    ).collect()}) for q in queries)
    assert hit >= 45 * 0.9


def test_embedding_providers(spark, monkeypatch):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    rows = [r[0] for r in df.select(embedding.hashing_embedding(8)(F.col("t"))).collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-5 and set(rows[1]) == {0.0} and len(rows[2]) == 8
    assert [r[0] for r in df.select(embedding.null_embedding(F.col("t"))).collect()] == [[], [], []]
    assert [list(r[0]) for r in df.select(embedding.batch_embedding(lambda x: [[float(len(t))] for t in x])(F.col("t"))).collect()] == [[5.0], [0.0], [0.0]]
    monkeypatch.delenv("EMBEDDING_API_KEY", raising=False)
    assert embedding.provider_from_environment(lambda: 1) is embedding.null_embedding
    monkeypatch.setenv("EMBEDDING_API_KEY", "x")
    assert embedding.provider_from_environment(lambda: 1) == 1


def test_table_sql(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert sqlapi.table_sql(df, "silver/x-1", "SELECT max(n) AS m FROM {{table}}").first()["m"] == 2
    assert sqlapi.alias_of("silver/x-1") == "silver_x_1" and sqlapi.alias_of("1x") == "t_1x"
    assert sqlapi.columns_of(df) == [("n", "int", True), ("s", "string", True)]


# -- sources


def test_repository_source(spark, tmp_path):
    def put(name, value):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))

    put("repos__o__r__issues", [{"number": 1}, {"number": 2, "pull_request": {}}])
    put("repos__o__r__branches", [{"name": "main", "commit": {"sha": "b1"}}])
    put("repos__o__r__tags", [{"name": "v1", "commit": {"sha": "t1"}}])
    put("repos__o__r__commits__abc", {"sha": "abc"})
    spark.dataSource.register(rest.RepositorySource)
    rows = spark.read.format("repository").option("recorded", str(tmp_path)).option("repos", "o/r").load().collect()
    assert [json.loads(r["payload"])["number"] for r in rows] == [1]
    client = rest.FolderClient(str(tmp_path))
    assert rest.resolve_revision(client, "o/r", "main", None) == {"sha": "b1", "reference": "main", "is_head": True}
    assert rest.resolve_revision(client, "o/r", "main", "v1")["sha"] == "t1" and rest.resolve_revision(client, "o/r", "main", "abc") == {
        "sha": "abc", "reference": "abc", "is_head": False,
    }
    assert rest.search_query("q", "rust", 5, 500) == {"q": "q language:rust stars:>=5", "per_page": 100}
    panel = rest.search_panel(spark.createDataFrame([('{"full_name":"a/b","html_url":"h","stargazers_count":3}',), ("{}",)], "payload string"))
    assert panel.count() == 1 and panel.first()["stargazers"] == 3


def test_indicators(spark, tmp_path):
    (tmp_path / "country.json").write_text(json.dumps([{"page": 1}, [{"id": "DEU", "iso2Code": "DE", "name": "Germany", "longitude": "13.4", "latitude": ""}]]))
    (tmp_path / "topic.json").write_text(json.dumps([{"message": [{"value": "broken"}]}]))
    client = rest.FolderClient(str(tmp_path))
    countries = rest.listed(spark, client, "country")
    assert (countries.first()["longitude"], countries.first()["latitude"]) == (13.4, None)
    assert rest.search_countries(countries, "germ").count() == 1 and rest.search_countries(countries, "xx").count() == 0
    with pytest.raises(rest.SourceError, match="broken"):
        rest.listed(spark, client, "topic")
    cells = rest.series_cells(spark.createDataFrame([([1.0, None, 3.0, 4.0, 5.0, 6.0], [2, 3])], "value array<double>, size array<int>")).orderBy("position").collect()
    assert [r["coordinates"] for r in cells] == [[0, 0], [0, 1], [0, 2], [1, 0], [1, 1], [1, 2]] and cells[1]["value"] is None
    assert rest.series_request("X", "DE", mrv=3, language="fr") == ("fr/country/DE/indicator/X", {"format": "jsonstat", "mrv": "3"})
    assert rest.dimension_codes({"t": {"category": {"index": {"b": 1, "a": 0}}}}, ["t"]) == [["a", "b"]]


def test_captures(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    meta = rest.write_capture([("node", "x", df), ("node", "x", df)], str(tmp_path / "c"))
    assert meta["datasets"][0]["rows"] == 2 and rest.read_capture(spark, str(tmp_path / "c"))["x"].count() == 2
    (tmp_path / "c" / "x.arrow").unlink()
    assert rest.read_capture(spark, str(tmp_path / "c"))["x"].count() == 2
    with pytest.raises(ValueError):
        rest.write_capture([("node", "x", df), ("node", "x", df.select("n"))], str(tmp_path / "d"))


def test_keyed_state_stream(spark, tmp_path):
    from loamgraph.streaming import replay

    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0)], "k long, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v double").parquet(str(tmp_path / "in"))
    run = replay.running_totals(stream, "k", "v").writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r["k"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM totals").collect()} == {(1, 2, 5.0), (2, 1, 1.0)}
