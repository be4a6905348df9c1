"""What is kept on disk: buckets, log states, graphs and text indexes; searches over them as over frames; services by an injected opener."""

import io
import json
import random
import urllib.error

import pytest
from pyspark.sql import functions as F

from loamgraph import session
from loamgraph.functions import embedding, text
from loamgraph.functions.ids import node_id_of
from loamgraph.operators import graph, joins, search
from loamgraph.sources import rest, store
from loamgraph.sources.graph_store import Frames, GraphStore
from loamgraph.sources.store import VersionedTable


def test_bucket_numbers_agree(spark):
    values = ["", "a", "é", "x" * 300, node_id_of("a", k=1)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.pmod(F.xxhash64("v"), F.lit(7)).alias("b")).collect()
    assert all(store.bucket_number(r["v"], 7) == r["b"] for r in rows)


def test_log_states_and_marks(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], 3)
    for n in range(20):
        t.write(spark.createDataFrame([(n % 7, n)], "k long, v long"), f"stream#{n}")
    assert (tmp_path / "t" / "_log" / f"{16:020}.state.json").exists() and t.version() == 19
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {(n % 7, n) for n in range(13, 20)}
    assert {(r["k"], r["v"]) for r in t.read(10).collect()} == {(n % 7, n) for n in range(4, 11)}
    assert t.done("stream#19") and t.done("stream#3") and not t.done("stream#20") and not t.done("other#0")
    seen, entry = [], t.entry
    t.entry = lambda v: seen.append(v) or entry(v)
    t.live()
    assert min(seen) > 16 and t.changes(18).count() == len(entry(19)["add"]) * 1 + t.changes(18).count() - len(entry(19)["add"])


def test_reading_and_deleting_by_value(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["id"], 8, by=["a"])
    t.write(spark.range(100).selectExpr("cast(id as string) id", "cast(id % 10 as string) a"))
    files = lambda df: set(df.inputFiles())
    assert t.read_of(["3"]).count() == 10 and len(files(t.read_of(["3"]))) < len(files(t.read()))
    assert t.read_of(["3", "4", "none"]).count() == 20 and t.read_of([]).count() == 0
    assert t.read_of([str(k) for k in range(2000)]).count() == 100
    before = t.version()
    assert len(t.entry(before)["add"]) > 2
    assert t.delete_matching(spark.createDataFrame([("none",)], "x string"), ["id", "a"]) == before
    t.delete_matching(spark.createDataFrame([("5",), ("77",), ("77",)], "x string"), ["id", "a"])
    assert len(t.entry(t.version())["remove"]) < len(t.live(before)[0])
    assert {r["id"] for r in t.read().collect()} == {str(k) for k in range(100) if k % 10 != 5 and k not in (5, 77)}
    t.replace(spark.createDataFrame([("z", "1")], "id string, a string"))
    assert t.read().count() == 1 and t.read(before).count() == 100


def test_last_wins_leaves_null_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 2)], "k long, v long")
    assert sorted(map(str, ((r["k"], r["v"]) for r in store.last_wins(df, ["k"], [F.col("v")]).collect()))) == ["(1, 2)", "(None, 1)", "(None, 2)"]


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:1"

        class _jsc:  # noqa: N801
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))

        getConf = staticmethod(lambda: {})  # noqa: N815

    class Session:
        sparkContext, conf = Context, type("C", (), {"get": staticmethod(lambda k, d: d)})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_dir(Session)


def name(k):
    return node_id_of("n", k=k)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """A random graph with a hub, loops, parallel edges and targets that don't exist, and a line of 80 steps."""
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(66)) for _ in range(150)] + [(0, k) for k in range(1, 40)] + [(5, 5)] + [(k, k + 1) for k in range(100, 180)]
    nodes = [(name(k), "n" if k % 3 else "m", "{}") for k in [*range(60), *range(100, 181)]]
    edges = [(node_id_of("e", k=k), f"edge_{'ab'[k % 2]}", name(a), name(b), "n", "n") for k, (a, b) in enumerate(pairs)]
    n = spark.createDataFrame(nodes, "id string, label string, properties string")
    e = spark.createDataFrame(edges, "id string, label string, from_node_id string, to_node_id string, from_node_type string, to_node_type string")
    kept = GraphStore(spark, str(tmp_path_factory.mktemp("graph")), 4)
    kept.upsert(n, e)
    return Frames(n, e), kept, edges, {x[0] for x in nodes}


def rows_of(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("options", [{"depth": 2}, {"depth": 3, "types": ["a"]}, {"depth": 2, "edge_limit": 7}, {"depth": 3, "node_limit": 20, "edge_limit": 25}])
def test_stored_searches_are_those_of_frames(both, options, monkeypatch):
    frames, kept, _, _ = both
    found = [graph.bfs(g, name(0), **options) for g in (frames, kept)]
    want = [(rows_of(f.nodes, "id", "label", "level"), rows_of(f.edges, "id", "level")) for f in found]
    assert want[0] == want[1] and len(want[0][0]) > 3
    monkeypatch.setattr(session, "SMALL", 2)
    monkeypatch.setattr(graph, "SMALL", 2)
    monkeypatch.setattr("loamgraph.sources.graph_store.SMALL", 2)
    large = graph.bfs(kept, name(0), **options)
    assert (rows_of(large.nodes, "id", "label", "level"), rows_of(large.edges, "id", "level")) == want[0]
    for side in ("out", "in", "both"):
        assert len({str(rows_of(graph.neighbours_in(g, name(5), None, side, 0), "*")) for g in (frames, kept)}) == 1


def plain_length(edges, known, a, b):
    seen, front, n = {a}, {a}, 0
    while front:
        if b in front:
            return n
        front = {e[3] for e in edges if e[2] in front and e[3] in known} - seen
        seen |= front
        n += 1
    return None


def test_paths_of_any_length(both):
    frames, kept, edges, known = both
    for a, b in ((0, 30), (30, 0), (7, 59), (100, 170), (170, 100), (5, 5), (0, 120)):
        want = plain_length(edges, known, name(a), name(b))
        for g in (kept,) if (a, b) == (100, 170) else (frames, kept):
            path = graph.path_between(g, name(a), name(b))
            assert (path and path["length"]) == want
            if path:
                by_id = {e[0]: e for e in edges}
                assert [(by_id[x][2], by_id[x][3]) for x in path["edges"]] == list(zip(path["nodes"], path["nodes"][1:], strict=False))
    assert graph.path_between(kept.hiding(["m"]), name(100), name(170)) is None


def test_a_kept_index_scores_like_one_in_memory(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta".split()
    rng = random.Random(2)
    docs = [(str(k), rng.choice("xy"), " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for k in range(80)]
    frame = spark.createDataFrame(docs, "id string, label string, text string")
    memory, kept = search.text_index(frame, label_col="label"), search.keep_index(frame, str(tmp_path), label_col="label", buckets=4, stamp="1")
    assert (memory.documents, round(memory.average, 9)) == (kept.documents, round(kept.average, 9))
    for q in ("alpha", "beta zeta nothing", "none"):
        a, b = ([(r["id"], round(r["score"], 9)) for r in search.bm25(i, q, 12).collect()] for i in (memory, kept))
        assert a == b
    again = search.open_index(spark, str(tmp_path), 4)
    assert again.stamp == "1" and again.documents == 80 and search.open_index(spark, str(tmp_path / "no"), 4) is None
    kept.table.append(kept.table.read())
    assert search.open_index(spark, str(tmp_path), 4) is None  # postings that the statistics don't know


@pytest.mark.parametrize("width", [0.5, 3.0, 100.0])
def test_sliced_asof_is_the_plain_one(spark, width):
    rng = random.Random(3)
    left = spark.createDataFrame([(k, rng.choice("ab"), rng.uniform(0, 20)) for k in range(120)], "id long, k string, t double")
    right = spark.createDataFrame([(rng.choice("abc"), rng.uniform(-5, 18), float(k)) for k in range(40)], "k string, t double, v double")
    got = [rows_of(joins.asof_join(left, right, ["k"], "t", "t", ["v"], width=w), "id", "v") for w in (None, width)]
    assert got[0] == got[1]


def test_first_comments(spark):
    df = spark.createDataFrame([(1, k, 100 - k) for k in range(20)] + [(2, 50, 1)], "t long, id long, created_at long")
    got = [(r["t"], r["id"]) for r in text.first_comments(df, ["t"], 2).collect()]
    assert sorted(got) == [(1, k) for k in range(12, 20)] + [(2, 50)]


def test_byte_windows_and_many_references(spark):
    far = "fixes " + "é" * 20 + " #1"  # 47 bytes before the sign: the word is out of reach, though not by characters
    near = "fixes " + "é" * 16 + " #1"
    long = " ".join(f"#{k}" for k in range(1, 3001))
    df = spark.createDataFrame([(far,), (near,), (long,)], "t string")
    got = text.issue_links(df, F.col("t"), F.lit("o"), F.lit("r"), F.lit("body")).select("t", "position", "number", "link_type").collect()
    kinds = {r["t"]: r["link_type"] for r in got if r["t"] != long}
    assert kinds == {far: "mentions", near: "closes"}
    assert sorted((r["position"], r["number"]) for r in got if r["t"] == long) == [(long.index(f"#{k}"), k) if k == 1 else (long.index(f" #{k}") + 1, k) for k in range(1, 3001)]


def test_url_client():
    asked, answers = [], [urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "0"}, io.BytesIO(b"")), urllib.error.URLError("gone"), io.BytesIO(b'{"a": 1}')]

    def opener(request, timeout):
        asked.append((request.full_url, request.headers.get("Authorization")))
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    client = rest.UrlClient("https://host/api/", "key", opener, pause=0)
    assert client.get("/x/y", {"q": "a b", "none": None}) == {"a": 1} and asked == [("https://host/api/x/y?q=a+b", "Bearer key")] * 3
    answers += [urllib.error.HTTPError("u", 404, "no", {}, io.BytesIO(b"nothing here"))]
    with pytest.raises(rest.SourceError, match="404: nothing here"):
        client.get("z")
    assert isinstance(rest.client_of({"base_url": "http://h"}), rest.UrlClient) and isinstance(rest.client_of({"recorded": "/x"}), rest.FolderClient)
    assert rest.client_of({"client": "collections:OrderedDict", "a": "b"})["a"] == "b"
    with pytest.raises(rest.SourceError):
        rest.client_of({})


def test_series_of_three_dimensions(spark):
    dimension = {"id": ["c", "s", "y"], "size": [2, 1, 2], "c": {"category": {"index": {"B": 1, "A": 0}}}, "s": {"category": {"index": ["X"]}}, "y": {"category": {"index": ["1", "2"]}}}
    got = rest.series(spark, {"dimension": dimension, "value": [1.0, None, 3.0, 4.0], "status": ["", "e", "", ""]}).orderBy("c", "y").collect()
    assert [(r["c"], r["s"], r["y"], r["value"], r["status"]) for r in got] == [("A", "X", "1", 1.0, ""), ("A", "X", "2", None, "e"), ("B", "X", "1", 3.0, ""), ("B", "X", "2", 4.0, "")]


def test_remote_and_local_embeddings(spark):
    def answer_lengths(request, timeout):
        texts = json.loads(request.data)["input"]
        data = [{"index": k, "embedding": [float(len(t))]} for k, t in reversed(list(enumerate(texts)))]
        return io.BytesIO(json.dumps({"data": data}).encode())

    df = spark.createDataFrame([("a",), ("bbb",), (None,)], "t string")
    remote = embedding.remote_embedding("m", "k", "https://host/v1", answer_lengths, batch=2)
    local = embedding.local_embedding("n", lambda _: lambda texts: [[float(len(t))] for t in texts])
    for provider in (remote, local):
        assert [list(r[0]) for r in df.select(provider(F.col("t"))).collect()] == [[1.0], [3.0], [0.0]]
