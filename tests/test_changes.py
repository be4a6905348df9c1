"""Deletion vectors, exact differences, replay with deletes, change streams, file statistics and Bloom filters."""

import datetime
import os
from collections import Counter
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.plans import feed_queries
from loamgraph.sources import deletion, file_stats
from loamgraph.sources.changes import difference
from loamgraph.sources.store import Conflict, VersionedTable
from loamgraph.streaming.change_source import Log, change_stream, follow, pieces


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def rows_of(df):
    return Counter(map(str, map(tuple, df.collect())))


def test_marks_instead_of_old_rows(spark, data, tmp_path):
    """An upsert and a delete of a hundredth write a small part of what the table has."""
    o = spark.read.parquet(f"{data}/orders.parquet")
    t = VersionedTable(spark, str(tmp_path / "t"), ["o_orderkey"])
    t.write(o.unionByName(o.withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000)))
    whole = size(tmp_path / "t" / "data")
    t.write(o.filter("o_orderkey % 100 = 1"))
    t.delete(F.col("o_orderkey") % 100 == 2)
    changed = o.filter("o_orderkey % 100 = 1").count()
    assert sum(r["rows"] for f, r in t.state()["info"].items() if f in t.entry(1)["add"]) == changed and t.entry(2)["add"] == [] == t.entry(2)["remove"]
    assert size(tmp_path / "t" / "data") - whole < whole / 10 and size(tmp_path / "t" / "deletes") < whole / 10
    assert t.read().count() == 2 * o.count() - 2 * o.filter("o_orderkey % 100 = 2").count()
    assert t.read(0).count() == 2 * o.count()


def test_files_without_rows_go_and_marks_add_up(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], 2)
    t.write(spark.range(100_000).select(F.col("id").alias("k"), F.lit("a").alias("v")))  # more rows than a bitmap holds
    for r in (0, 1, 2):
        t.delete(F.col("k") % 4 == r)
    assert t.read().count() == 25_000 and sum(v["gone"] for v in t.state()["vectors"].values()) == 75_000
    assert [r[0] for r in t.read().select((F.col("k") % 4).alias("m")).distinct().collect()] == [3]
    assert {r["_change"]: r["n"] for r in t.row_changes(2).groupBy("_change").agg(F.count("*").alias("n")).collect()} == {"delete": 25_000}
    assert t.net_changes(1).count() == 50_000
    before = len(t.state()["files"])
    t.compact()
    assert not t.state()["vectors"] and t.read().count() == 25_000 and t.row_changes(t.version()).count() == 0
    t.delete(F.lit(True))
    assert t.state()["files"] == [] and before and t.read().count() == 0 and t.delete(F.lit(True)) == t.version()
    t.write(spark.createDataFrame([(1, "b")], "k long, v string"))
    assert rows_of(t.net_changes(t.version() - 1)) == Counter({"(1, 'b', 'insert')": 1})


KEYS = st.one_of(st.none(), st.integers(0, 3))
STATES = st.lists(st.tuples(KEYS, st.sampled_from("abc")), max_size=7)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(STATES, STATES)
def test_differences_are_exact(spark, old, new):
    """Applied to the old multiset, the changes give the new one; updates are of keys that one row left and one took."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    frame = lambda rows: spark.createDataFrame([(k, v, {v: 1}) for k, v in rows], schema)
    got = [(r["k"], r["v"], r["_change"]) for r in difference(frame(old), frame(new), ["k"], schema).collect()]
    went, came = Counter(old) - Counter(new), Counter(new) - Counter(old)
    of = lambda kind: Counter((k, v) for k, v, c in got if c == kind)
    assert of("insert") + of("update") == came
    for k, _ in of("update"):
        assert k is not None and sum(n for (x, _), n in went.items() if x == k) == 1 == sum(n for (x, _), n in came.items() if x == k)
        went = Counter({r: n for r, n in went.items() if r[0] != k})
    assert of("delete") == went


def test_null_keys_in_net_changes(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    t.write(spark.createDataFrame([(None, "a"), (None, "b"), (1, "x")], "k long, v string"))
    t.write(spark.createDataFrame([(None, "c"), (1, "y")], "k long, v string"))
    assert rows_of(t.net_changes(0)) == Counter({"(None, 'c', 'insert')": 1, "(1, 'y', 'update')": 1})
    assert VersionedTable(spark, str(tmp_path / "none"), ["k"]).net_changes(-1).collect() == []


def test_a_lost_race_leaves_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], bloom=["k"])
    t.write(spark.range(10).withColumnRenamed("id", "k"))
    held = sorted(p for p in os.listdir(tmp_path / "t" / "data"))
    add = t._write_files(spark.range(5).withColumnRenamed("id", "k"))
    with pytest.raises(Conflict):
        t._commit(0, add, [], t.live()[1])
    assert sorted(os.listdir(tmp_path / "t" / "data")) == held and len(os.listdir(tmp_path / "t" / "blooms")) == 1
    assert [n for n in os.listdir(tmp_path / "t" / "_log") if not n.startswith(".")] == [f"{0:020}.json"]


def test_replay_hands_over_deletes(spark, tmp_path):
    from loamgraph.operators.ingest import Synchronizer
    from loamgraph.sources.catalog import Catalog
    from loamgraph.sources.store import Lake

    lake, catalog = Lake(spark, str(tmp_path)), Catalog()
    sync = Synchronizer(spark, lake, catalog)
    table = lake.table("silver/entities/project", ["url"])
    catalog.ensure_offset("silver/entities/project", "project", "node", ["url"])
    frame = lambda *rows: spark.createDataFrame(rows, "url string, v string")
    table.write(frame(("u1", "a"), ("u2", "b"), ("u3", "c")))
    table.write(frame(("u1", "z"), ("u2", "b")))
    table.delete(F.col("url") == "u3")
    seen = []
    sync.replay(lambda spec, path, version, rows: seen.append((version, sorted((r["url"], r["_change"]) for r in rows.collect()))))
    assert seen == [(0, [("u1", "insert"), ("u2", "insert"), ("u3", "insert")]), (1, [("u1", "update")]), (2, [("u3", "delete")])]


# -- streams


def test_a_stream_of_changes_is_the_feed(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], 4)
    t.write(spark.range(50_000).select(F.col("id").alias("k"), F.lit("a").alias("v")))
    t.write(spark.range(10, 20).select(F.col("id").alias("k"), F.lit("b").alias("v")))
    t.delete(F.col("k") > 40_000)
    t.compact()
    t.delete(F.col("k") < 15)
    run = change_stream(spark, t).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = Counter(map(tuple, spark.table("seen").collect()))
    want = Counter()
    for r in t.feed(-1).collect():
        if r["_change"] == "update":
            want[(r["k"], "a", "delete", r["_version"])] += 1
        want[(r["k"], r["v"], "delete" if r["_change"] == "delete" else "insert", r["_version"])] += 1
    assert got == want
    assert {p.version for p in pieces(Log(t.root), 2, t.version())} == {4}  # the compaction has nothing to say
    assert len({p.file for p in pieces(Log(t.root), -1, 0)}) == len(t.entry(0)["add"]) > 1


def test_following_across_restarts(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / n), ["k"], 2) for n in "ab")
    same = lambda: rows_of(a.read()) == rows_of(b.read())
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v string, t timestamp")
    at = datetime.datetime(2020, 1, 1)
    a.write(frame((1, "a", at), (2, "b", None), (3, None, at)))
    follow(a, b, str(tmp_path / "cp"))
    assert same() and b.version() == 0
    for k in range(18):  # past a state of the log
        a.write(frame((k % 4, f"v{k}", at)))
    a.delete(F.col("k") == 2)
    follow(a, b, str(tmp_path / "cp"))
    assert same() and b.version() == 1
    follow(a, b, str(tmp_path / "cp"))
    assert b.version() == 1
    assert b.done(f"{tmp_path / 'cp'}#1")
    with pytest.raises(ValueError, match="keys"):
        follow(a, VersionedTable(spark, str(tmp_path / "c")), str(tmp_path / "cp2"))


# -- statistics


def test_few_files_are_opened(spark, data):
    t = feed_queries.dated_orders(spark, data)
    n = len(t.state()["files"])
    assert n == 16 and len(t.files_for([("o_orderdate", ">=", feed_queries.FROM), ("o_orderdate", "<", feed_queries.TO)])) <= 2
    one = t.read().first()["o_orderkey"]
    assert 1 <= len(t.files_for([("o_orderkey", "=", one)])) <= 2 and t.files_for([("o_orderkey", "=", -5)]) == []
    plan = t.scan([("o_orderkey", "=", one)])
    assert len(plan.inputFiles()) <= 2 and [r["o_orderkey"] for r in plan.collect()] == [one]
    assert t.scan([("o_orderdate", "null", None)]).count() == 0 and t.scan([("o_orderdate", ">", datetime.date(2050, 1, 1))]).count() == 0


VALUES = {
    "long": (st.integers(-5, 5), "k long"), "string": (st.text("abé\U0001f600", max_size=3), "k string"), "date": (st.dates(datetime.date(2000, 1, 1), datetime.date(2000, 1, 9)), "k date"),
    "double": (st.floats(-3, 3) | st.just(float("nan")), "k double"), "decimal": (st.decimals(-5, 5, places=2), "k decimal(9,2)"), "boolean": (st.booleans(), "k boolean"),
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_pruning_loses_no_row(spark, tmp_path_factory, kind):
    values, schema = VALUES[kind]

    @settings(max_examples=2, deadline=None)
    @given(st.lists(st.none() | values, min_size=1, max_size=12), values)
    def check(held, sought):
        t = VersionedTable(spark, str(tmp_path_factory.mktemp("s")), stats=["k"], bloom=["k"])
        for k in range(0, len(held), 4):
            t.write(spark.createDataFrame([(v,) for v in held[k : k + 4]], schema).coalesce(1))
        whole = t.read()
        lit = F.lit(sought).cast(schema.split()[1])
        for op, c in {"=": F.col("k") == lit, "<": F.col("k") < lit, ">=": F.col("k") >= lit, "in": F.col("k").isin([lit]), "null": F.col("k").isNull()}.items():
            got = t.scan([("k", op, [sought] if op == "in" else sought)])
            assert rows_of(got) == rows_of(whole.filter(c)), op

    check()


def test_bounds():
    info = {"rows": 5, "columns": {"k": [3, 9, 1], "all_null": [None, None, 5], "d": ["1.50", "2.50", 0]}}
    may = lambda c, op, v, kind=None: file_stats.may_hold(info, c, op, v, kind or T.LongType())
    assert [may("k", "=", v) for v in (2, 3, 9, 10)] == [False, True, True, False] and may("k", "null", None) and not may("all_null", "=", 1) and may("all_null", "null", None)
    assert not may("k", "<", 3) and may("k", "<=", 3) and not may("k", ">", 9) and may("unknown", "=", 1) and may("k", "=", "text")
    assert may("d", "=", Decimal("2.00"), T.DecimalType(9, 2)) and not may("d", ">", Decimal("2.50"), T.DecimalType(9, 2)) and may("k", "in", [1, 4]) and not may("k", "in", [1, 2])


def test_bloom_filters_say_no_to_most(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), stats=[], bloom=["k"])
    t.write(spark.range(0, 40_000, 2).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("k")).repartition(4))
    assert all(len(t.files_for([("k", "=", f"u{2 * i}")])) >= 1 for i in range(0, 5))
    wrong = sum(len(t.files_for([("k", "=", f"u{2 * i + 1}")])) for i in range(12))
    assert wrong <= 3 and len(t.files_for([("k", "in", [f"u{2 * i}" for i in range(200)])])) == 4


def test_bits(spark):
    places = spark.createDataFrame([("f", 0), ("f", 7), ("f", 32767), ("f", 32768), ("g", 9)], "_file string, _row long")
    bits = deletion.bitmaps(places)
    all_ = spark.range(0, 65536).select(F.lit("f").alias("_file"), F.col("id").alias("_row"))
    assert sorted(r["_row"] for r in deletion.flagged(all_, bits, "x", True).filter("x").collect()) == [0, 7, 32767, 32768]
