"""Substring search by trigrams gives the rows of a scan, from few files."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.operators.ngrams import NgramIndex, grams, grams_of
from loamgraph.session import table


def test_grams(spark):
    texts = ["", "ab", "abc", "aAaA", "Żółć!", "a\U0001f600b c"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(grams(F.col("t")).alias("g")).collect()
    assert [sorted(r["g"]) for r in got] == [grams_of(t) for t in texts]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abÄ%_ ", max_size=12), min_size=1, max_size=8), st.text("abÄ%_ ", min_size=1, max_size=5))
def test_patterns_are_found_as_by_a_scan(spark, tmp_path_factory, texts, pattern):
    index = NgramIndex(spark, str(tmp_path_factory.mktemp("n")), buckets=2)
    index.upsert(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string"))
    want = sorted((str(i), t) for i, t in enumerate(texts) if pattern.lower() in t.lower())
    assert sorted(map(tuple, index.contains(pattern).collect())) == want


def test_edits_and_files(spark, data, tmp_path):
    docs = table(spark, data, "documents").select("doc_id", "text")
    index = NgramIndex(spark, str(tmp_path))
    assert index.contains("abc").collect() == []
    index.upsert(docs, id_col="doc_id")
    index.upsert(spark.createDataFrame([(1, "wholly quizzical zebra"), (99_999, "another QUIZZICAL one"), (2, None), (None, "quizzical")], "doc_id long, text string"), id_col="doc_id")
    assert {r["id"] for r in index.contains("quizzical").collect()} == {"1", "99999"}
    index.delete(spark.createDataFrame([(99_999,)], "id long"))
    assert {r["id"] for r in index.contains("Quizzical").collect()} == {"1"}
    opened = index.postings.read_of(grams_of("quizzical"), index.postings.version()).inputFiles(), index.texts.read_of(["1"]).inputFiles()
    assert len(opened[0]) < len(index.postings.state()["files"]) and len(opened[1]) < len(index.texts.state()["files"]) / 4
    assert "2" not in {r["id"] for r in index.contains("a").collect()}  # its text is null now
    old = docs.filter("doc_id = 1").first()["text"]
    assert "1" not in {r["id"] for r in index.contains(old[:40]).collect()}
