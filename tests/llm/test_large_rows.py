"""Rows that are very deep, long or repetitive, and clashing columns in every stage of the pipeline."""

import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import decontamination, html_text, language_id, toxicity
from loamgraph.llm.words import hash_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
NAMES = ("_key", "_id", "_KEY", "key", "id", "text_key", "node", "root", "n", "row", "norm", "bucket", "first", "_key_")


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_extra_columns_of_any_name(spark, data, stage):
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, near), (2, near + " x"), (2, near + " x"), (3, "alone and quite other"), (3, "alone and quite other"), (None, None), (4, "")]
    plain = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    held = [n for n in NAMES if n.lower() not in {m.lower() for m in NAMES[: NAMES.index(n)]}]
    wide = plain.withColumns({n: F.lit(k) for k, n in enumerate(held)})
    run = corpus_pipeline.STAGES[stage][1]
    got, want = run(spark, wide, data), run(spark, plain, data)
    assert got.columns == wide.columns
    assert sorted(map(str, map(tuple, got.select(*plain.columns).collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert got.select(*held).distinct().collect() in ([], [tuple(range(len(held)))])


@pytest.mark.parametrize("html", ["<div>", "<div><p>", "<p><table><td><div>", "<ul><li>", "<b>"])
def test_depth_costs_no_square_time(html):
    began = time.perf_counter()
    assert "end" in html_text.html_to_text(html * 100_000 + "end") and time.perf_counter() - began < 30


def test_equal_words_are_searched_in_bounded_pieces(monkeypatch):
    index = decontamination.Index.build([7], ["a " * 200], **decontamination.DEFAULTS)
    most = []
    stack = np.stack
    monkeypatch.setattr(np, "stack", lambda arrays, axis=0: most.append(len(arrays[0])) or stack(arrays, axis=axis))
    w = hash_words(["a " * 30_000, "b " * 50, "x " + "a " * 150 + "y"])
    assert [h[:2] for h in index.search(w.hashes, w.offsets)] == [(0, 0)]
    assert max(most) <= decontamination.PAIRS_AT_ONCE + 200
    monkeypatch.undo()
    monkeypatch.setattr(decontamination, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(decontamination, "CELLS_AT_ONCE", 1000)
    assert [h[:2] for h in index.search(w.hashes, w.offsets)] == [(0, 0)]


def test_places_in_periodic_texts_are_found():
    rng = np.random.default_rng(4)
    words = [f"v{k}" for k in rng.integers(0, 4, 120)]
    index = decontamination.Index.build([1, 2], [" ".join(words), "p q " * 20], **decontamination.DEFAULTS)
    w = hash_words(["z " * 99 + " ".join(words) + " z" * 50, "p q " * 300, " ".join(words[:60]), "q p " * 20 + "r"])
    assert [h[:2] for h in index.search(w.hashes, w.offsets)] == [(0, 0), (1, 1), (3, 1)]


def test_the_net_learns_from_bounded_texts(spark):
    """One labelled text is larger than the bound: it is passed over, and scored like the others."""
    rows = [(k, ("vile awful words " if k % 2 else "kind gentle words ") * 4, "en") for k in range(200)] + [(1000, "vile awful words " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1 if k % 2 or k == 1000 else 0) for k, _, _ in rows], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    try:
        toxicity.train = lambda texts, y, **k: seen.append(sum(len(t) for t in texts)) or train(texts, y, **k)
        net, scored = toxicity.fit_and_score(docs, labels, F.lit(True), max_bytes=10_000)
    finally:
        toxicity.train = train
    assert 0 < seen[0] <= 10_000
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(got) == 201 and got[1000] > 0.3 and all((got[k] > 0.3) == bool(k % 2) for k in range(200))


def test_languages_with_little_text_are_not_taken_for_one_with_much(spark):
    """Sixty documents of English, 400 characters of each other language: of the other documents 99 in 100 of every language are told."""
    held = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null and lang is not null").orderBy("doc_id").select("lang", "text").collect():
        held.setdefault(r["lang"], []).append(r["text"])
    sample = {k: v[:60] if k == "en" else ["".join(v[:60])[:400]] for k, v in held.items()}
    model = language_id.Model.fit(sample, 24_000)
    assert model.costs[model.languages.index("en")] > 1.5 * min(model.costs)
    for lang, texts in held.items():
        found, _ = model.predict(texts[60:])
        assert found.count(lang) >= 0.99 * len(found)
