"""The segmented text index: equal to one built anew after any edits, results without the skipped blocks, and groups of tables."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import search, segments
from loamgraph.operators.segments import SegmentedIndex
from loamgraph.sources.group import Group
from loamgraph.sources.store import VersionedTable

SCHEMA = "id string, label string, text string"


def frame(spark, docs):
    return spark.createDataFrame([(i, la, t) for i, (la, t) in docs.items()], SCHEMA)


def postings_of(df):
    return sorted(map(str, map(tuple, df.select("term", "id", "label", "tf", "dl").collect())))


def ranked(df):
    return [(r["id"], r["label"], round(r["score"], 9)) for r in df.collect()]


def test_edits_and_rebuilding_agree(spark, tmp_path):
    rng = random.Random(1)
    words = ["the", "of", "rare", "é", "x1", "data", "lake"]
    text = lambda: " ".join(rng.choices(words, [9, 5, 1, 1, 2, 3, 2], k=rng.randint(0, 12))) if rng.random() > 0.1 else None
    index, held = SegmentedIndex(spark, str(tmp_path), buckets=2, fan=2), {}
    for step in range(4):
        new = {f"d{rng.randint(0, 15)}": (rng.choice(["a", "b", None]), text()) for _ in range(6)}
        gone = [f"d{rng.randint(0, 15)}" for _ in range(2)] if step else []
        index.update(frame(spark, new), spark.createDataFrame([(g,) for g in gone], "id string") if gone else None, label_col="label")
        held = {i: d for i, d in held.items() if i not in gone} | new
    plain = search.text_index(frame(spark, held), label_col="label")
    assert postings_of(index.postings) == postings_of(plain.postings)
    assert index.documents == plain.documents == len(held) and abs(index.average - plain.average) < 1e-9
    assert 1 <= len(index.facts["segments"]) < 5
    for query in ("the rare", "nothing"):
        for limit, label in ((3, None), (50, "a")):
            assert ranked(index.search(query, limit, label)) == ranked(search.bm25(plain, query, limit, label))
    assert ranked(index.search("the", 4, "a", post_filter=True)) == ranked(search.bm25(plain, "the", 4, "a", post_filter=True))


def test_common_terms_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    docs = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("label"),
        F.concat(F.repeat(F.lit("common "), (F.col("id") % 7 + 1).cast("int")), F.repeat(F.lit("other "), (F.col("id") % 31).cast("int")), F.when(F.col("id") % 500 == 3, "rare").otherwise("")).alias("text"),
    )
    index = SegmentedIndex(spark, str(tmp_path), buckets=2)
    index.upsert(docs)
    plain = search.text_index(docs)
    for query in ("common", "common rare"):
        kept, blocks = index.plan(query, 10)
        assert (kept.count() < blocks / 2 or query != "common") and blocks >= 3000 // 16
        assert ranked(index.search(query, 10)) == ranked(search.bm25(plain, query, 10))


def test_only_new_documents_are_cut_into_words(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    index = SegmentedIndex(spark, str(tmp_path), fan=2)
    many = {f"d{k}": ("a", f"word{k} text") for k in range(40)}
    index.upsert(frame(spark, many), label_col="label")

    def counted(text):
        add = F.udf(lambda t: seen.add(1) or t, "string")
        return search.tokens(add(text))

    monkeypatch.setattr(segments, "tokens", counted)
    index.upsert(frame(spark, {"d1": ("b", "new text"), "d99": ("b", None)}), label_col="label")
    index.delete(spark.createDataFrame([("d2",), ("unknown",)], "id string"))
    assert seen.value == 2 and index.documents == 40 and "d2" not in {r["id"] for r in index.postings.collect()}


def test_repeated_and_missing_ids(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path))
    assert not index.exists() and index.search("a", 3).collect() == [] and index.postings.collect() == []
    index.upsert(spark.createDataFrame([("1", "x", "b b"), ("1", "x", "a"), (None, "x", "c")], SCHEMA), label_col="label")
    assert [(r["id"], r["term"], r["tf"]) for r in index.postings.collect()] == [("1", "b", 2)] and index.documents == 1
    index.upsert(spark.createDataFrame([], SCHEMA))
    index.delete(spark.createDataFrame([("1",)], "id string"))
    assert index.documents == 0 and index.search("b", 3).collect() == []


# -- groups


def test_nothing_of_a_failed_group_is_seen(spark, tmp_path):
    a, b = (VersionedTable(spark, f"{tmp_path}/{n}", ["k"]) for n in "ab")
    group = Group(spark, str(tmp_path), {"a": a, "b": b})
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    schema = rows(1).schema
    with group.commit():
        a.write(rows(1, 2))
        b.write(rows(1))
    with pytest.raises(RuntimeError, match="between"), group.commit():
        a.write(rows(3))
        a.delete(F.col("k") == 1)
        raise RuntimeError("between two tables")
    keys = lambda n: sorted(r["k"] for r in group.read(n, schema).collect())
    assert (keys("a"), keys("b")) == ([1, 2], [1]) and a.read().count() == 2
    with group.commit() as facts:  # the retry
        assert sorted(r["k"] for r in a.read().collect()) == [1, 2]
        a.write(rows(3))
        b.write(rows(2))
        facts["n"] = 1
    assert (keys("a"), keys("b")) == ([1, 2, 3], [1, 2]) and group.record()["facts"] == {"n": 1}


def test_a_first_group_that_fails(spark, tmp_path):
    a = VersionedTable(spark, f"{tmp_path}/a", ["k"])
    group = Group(spark, str(tmp_path), {"a": a})
    rows = spark.createDataFrame([(1,)], "k long")
    with pytest.raises(RuntimeError), group.commit():
        a.write(rows)
        raise RuntimeError
    assert group.read("a", rows.schema).count() == 0
    with group.commit():
        assert a.read().count() == 0
        a.write(rows)
    assert group.read("a").count() == 1


def test_restoring(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"])
    t.write(spark.range(10).withColumnRenamed("id", "k"))
    t.delete(F.col("k") < 3)
    t.write(spark.range(2, 12).withColumnRenamed("id", "k"))
    t.delete(F.col("k") == 5)
    keys = lambda v=None: sorted(r["k"] for r in t.read(v).collect())
    for v in (1, 0, 3, 2):
        want = keys(v)
        t.restore(v)
        assert keys() == want
    assert t.restore(2) == t.version()
