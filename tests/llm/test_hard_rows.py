"""Null, repeated and very large ids, colliding keys, several scripts, long words: nothing is lost or made up."""

import hashlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm import chat, decontamination, exact_dedup, language_id, near_copies, packing, simhash
from loamgraph.llm.words import hash_words

BIG = 2**53
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)


def test_packing_returns_the_ids_it_was_given(spark):
    ids = [BIG + 1, BIG + 3, None, None, -BIG - 1, 7, 7]
    out = packing.best_fit(docs_of(spark, [(i, "a b c") for i in ids]).withColumn("shard", F.lit("x")), 16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted((i is None, i) for i in ids)


def test_a_repeated_id_fills_no_shard(spark):
    same = docs_of(spark, [(5, "one two three four")] * 4000)
    out = packing.best_fit(same, 8, source_col=None, cluster=F.lit(None), shard_tokens=1000)
    assert out.select(F.split("bin_id", "-")[0]).distinct().count() == 16 and out.count() == 4000


def test_chat_keeps_conversations_apart(spark):
    turns = [(c, k, r, f"{c}") for c in (BIG, BIG + 1, None) for k, r in enumerate(("user", "assistant"))]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {BIG, BIG + 1, None} and all(r["n_turns"] == 2 for r in got.values())
    assert all(r["loss_sha256"] == hashlib.sha256(str(c).encode()).hexdigest() for c, r in got.items())


ROWS = [
    (1, "same"), (2, "same"), (2, "other"), (None, "same"), (None, "lonely"), (None, "lonely"), (3, "ot her"), (3, "ot  her"), (BIG + 1, "x y"),
    (BIG + 2, "x\ty"), (9, None), (8, ""),
]


def plain(t):
    return " ".join((t or "").split())


@pytest.mark.parametrize("hot", [1024, 1])
@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long") % 3])
def test_exact_dedup_through_owner_tasks(spark, hot, key):
    """Also with keys that nearly all collide, and with every repeated key folded first."""
    frame = docs_of(spark, ROWS * 2)
    first = {}
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        first.setdefault(plain(t), i)
    kept = exact_dedup.keep_first(frame, hot_rows=hot, capacity=2, key=key)
    assert kept.columns == frame.columns
    assert sorted(map(str, ((plain(r["text"]), r["doc_id"]) for r in kept.collect()))) == sorted(map(str, first.items()))
    got = exact_dedup.exact_dedup(frame, hot_rows=hot, capacity=2, key=key).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in first}
    assert sorted(map(str, ((r["doc_id"], sha[r["text_sha256"]]) for r in got))) == sorted(map(str, ((i, plain(t)) for i, t in ROWS * 2)))
    for r in got:
        t = sha[r["text_sha256"]]
        assert r["keep_id"] == first[t] and r["group_size"] == 2 * sum(plain(x) == t for _, x in ROWS) and r["kept"] == (r["doc_id"] == r["keep_id"])
    places = {(r["text_sha256"], r["chain_no"]) for r in got}
    assert len(places) == len(first) and (key is F.xxhash64 or max(c for _, c in places) > 1)


def test_stages_keep_one_row_per_group(spark, data):
    words = [f"w{k}" for k in range(60)]
    near = " ".join(words)
    rows = [*ROWS, (20, near), (21, near + " tail"), (21, near + " tail"), (None, near + " end"), (22, "quite other words here"), (22, "and again some others")]
    kept = sorted(map(str, ((r["doc_id"], plain(r["text"])) for r in corpus_pipeline.drop_copies(spark, docs_of(spark, rows), data).collect())))
    want = [(1, "same"), (2, "other"), (None, "lonely"), (3, "ot her"), (BIG + 1, "x y"), (8, ""), (20, near), (21, near + " tail"), (None, near + " end"), *rows[-2:]]
    assert kept == sorted(map(str, want))
    out = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), data)
    assert out.columns == docs_of(spark, rows).columns
    want = [(1, "same"), (2, "other"), (None, "lonely"), (3, "ot her"), (BIG + 1, "x y"), (8, ""), (20, near), *rows[-2:]]
    assert sorted(map(str, ((r["doc_id"], plain(r["text"])) for r in out.collect()))) == sorted(map(str, want))


def test_near_copies_dropped_by_join_as_by_broadcast(spark, monkeypatch):
    near = " ".join(f"w{k}" for k in range(60))
    frame = docs_of(spark, [(1, near), (2, near + " x"), (2, near + " x"), (3, "alone"), (3, "alone"), (None, "alone")])
    want = [(1, near), (3, "alone")]
    for most in (near_copies.BROADCAST_ROWS, 0):
        monkeypatch.setattr(near_copies, "BROADCAST_ROWS", most)
        assert sorted((r["doc_id"], r["text"]) for r in near_copies.keep_one(frame).collect()) == want


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_an_empty_table(spark, data, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, docs_of(spark, []), data).count() == 0


def test_classes_are_fingerprints_not_hashes_of_them(spark):
    docs = docs_of(spark, [(1, "a b c d"), (2, "a b c d"), (3, "e f g h i"), (4, None)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs, n_fingerprints=2).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_a_star_of_many_is_one_component(spark):
    edges = spark.range(1, 3000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.lit(5001)).alias("src"), F.col("id").alias("dst"),
    ).union(spark.range(1).selectExpr("0", "5001"))
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


SCRIPTS = {
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах", "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में स्वतन्त्रता", "en": "All human beings are born free and equal in dignity and rights",
}


def test_language_id_tells_scripts_apart(monkeypatch):
    for width in (64, 2):
        monkeypatch.setattr(language_id, "ALPHABET", width)
        model = language_id.Model.fit({k: [v] for k, v in SCRIPTS.items()}, 1000)
        assert len(model.rare) > 0
        langs, scores = model.predict([*SCRIPTS.values(), *(v[5:25] for v in SCRIPTS.values())])
        assert langs == [*SCRIPTS, *SCRIPTS] and min(scores) > 0.9
        if width == 64:
            whole = model.phrases(list(SCRIPTS.values()))[0]
    assert (model.phrases(list(SCRIPTS.values()))[0] == whole).all()


def test_words_of_any_length_and_script():
    w = hash_words(["a" * 300 + "bc", "a" * 300 + "cb", "“hello” Hello", "Ä ä", "漢字かな", "don't été"])
    h, n = w.hashes, np.diff(w.offsets).tolist()
    assert h[0] != h[1] and h[2] == h[3] and h[4] == h[5] and n == [1, 1, 2, 2, 4, 3] and len(set(h[6:10].tolist())) == 4


def test_a_chinese_passage_is_found_in_longer_text(spark):
    rng = np.random.default_rng(3)
    item, others = ("".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 40)) for _ in range(2))
    frame = docs_of(spark, [(1, others + item + others), (2, others * 2), (3, others + item[:20] + "错" + item[21:] + others)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r["doc_id"], r["edits"]) for r in decontamination.find_items(frame, bench).collect()) == [(1, 0), (3, 1)]
