"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamgraph.llm import chat, decontamination, exact_dedup, html_text, language_id, packing, quality, simhash, toxicity, url_filter
from loamgraph.llm import queries as registered
from loamgraph.llm.words import hash_words

BASE = "The quick brown fox jumps over the lazy dog while seven wizards quietly box with five dozen liquor jugs near an old stone bridge "
LONG = " ".join(f"word{i}" for i in range(20_000))
TEXTS = [
    (1, "a b  c"), (2, "a b c"), (3, "a\tb\nc"), (4, None), (5, ""), (6, BASE * 3), (7, BASE * 3 + "end"), (8, LONG), (9, LONG + " more"), (10, "é ü"),
    (11, "!!! 123"), (12, "A B C"), (6, BASE * 3),
]
SCHEMA = "doc_id long, text string, key long, kept string, node string, lang string, source string, bucket int, k int, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "en", "s" if i and i % 2 else None, 5, 6, 7) for i, t in TEXTS], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- exact dedup


def test_exact_dedup(docs, none):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in TEXTS}
    for capacity in (100_000, 1):
        got = exact_dedup.exact_dedup(docs, capacity=capacity).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            own = norm[r["doc_id"]]
            assert r["text_sha256"] == hashlib.sha256(own.encode()).hexdigest()
            assert r["keep_id"] == min(i for i, t in norm.items() if t == own)
            assert r["group_size"] == sum(norm[i] == own for i, _ in TEXTS)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(none).count() == 0


@given(st.dictionaries(st.integers(0, 15), st.integers(1, 9), max_size=16), st.integers(1, 12))
def test_directory_splits_what_is_overfull(counts, capacity):
    buckets = exact_dedup.grow_directory(counts, 4, capacity)
    depth, slots = exact_dedup.directory_slots(buckets)
    assert len(slots) == 1 << depth and sorted(set(slots)) == list(range(len(buckets)))
    for d, lead in buckets:
        held = sum(n for p, n in counts.items() if p >> (4 - d) == lead)
        assert held <= capacity or d == 4


def test_colliding_keys_chain(spark):
    keyed = spark.createDataFrame([(1, "x", 5), (2, "y", 5), (3, "x", 5)], "id long, norm string, key long")
    index, _, _ = exact_dedup.build_index(keyed, 10)
    assert sorted((r["keep_id"], r["group_size"], r["chain_no"]) for r in index.collect()) in ([(1, 2, 1), (2, 1, 2)], [(1, 2, 2), (2, 1, 1)])


# -- html


HTML = [
    (None, ""), ("", ""), ("plain   text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<div>a<div>b</div>c</div>", "a\nb\nc"), (
        "x<script>y</script><style>z</style>w", "xw",
    ),
    ("<head><title>t</title></head>body", "body"), ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"), (
        "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d",
    ), ("<pre>\n a\n  b</pre>", " a\n  b"),
    ("<p hidden>x</p>y", "y"), ("<span style='display: none'>x</span>y", "y"), ("<style>.h{display:none}</style><b class='q h'>x</b>y", "y"), (
        "<i style='visibility:hidden'>x<b style='visibility:visible'>y</b></i>", "y",
    ),
    ("&lt;&amp;&eacute;&#65;", "<&éA"), ("<!-- x -->y<!-- z", "y"), (
        "<details><summary>s</summary>x</details>", "s",
    ), ("1 < 2 <3", "1 < 2 <3"), ("<a href='>'>x</a>", "x"), ("<textarea><b>x</textarea>y", "<b>xy"), ("</p>x</b></table>", "x"),
    ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>t<dd>d</dl>", "t\n    d"), ("<script>never closed", ""),
]


@pytest.mark.parametrize(("html", "want"), HTML)
def test_html(html, want):
    assert html_text.html_to_text(html) == want


def test_html_extremes(spark):
    assert html_text.html_to_text("<div>" * 30_000 + "x") == "x"
    assert "y" in html_text.html_to_text("<table><tr><td>" * 200 + "y")
    assert html_text.html_to_text("<p>" + LONG) == LONG
    pages = spark.createDataFrame([(1, "<b>x"), (1, "<b>x"), (2, None)], "page_id long, html string").withColumn("text", F.lit(1))
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(pages).collect()) == [(1, "x"), (1, "x"), (2, "")]
    assert html_text.extract(pages.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(
    st.sampled_from([
        "<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "<b>", "</b>", "<pre>", "<select>", "<", ">", "&", '"', "<!--", "zq1",
    ]),
    max_size=25,
))
def test_html_keeps_visible_text(parts):
    parts = [p for p in parts if p not in ("<!--", '"', "<", ">")]
    assert html_text.html_to_text(" ".join(parts)).count("zq1") == parts.count("zq1")


# -- classifiers


def held_out_auc(y, s):
    order = np.argsort(np.argsort(s))
    n = int(y.sum())
    return (order[y].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def labelled(spark):
    d = "/root/testdata/sf0.01"
    return d, spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()


def test_quality(spark, labelled, docs, none):
    d, frame = labelled
    got = registered.op3_quality(spark, d).toPandas()
    assert len(got) == len(frame) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    m = got[got.held_out].merge(frame[frame.quality.notna()], on="doc_id")
    assert held_out_auc((m.quality == 1).to_numpy(), m.score.to_numpy()) > 0.9
    assert quality.fit(np.zeros((0, quality.STATS)), np.zeros((0, quality.STATS))) is None
    assert quality.score(docs, None).count() == len(TEXTS) and quality.score(none, None).count() == 0
    assert np.isfinite(quality.features([t for _, t in TEXTS])).all()


def test_nonnegative_risk_separates():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (1500, 4)), rng.normal(-1.5, 1, (1000, 4))
    unl = np.concatenate([rng.normal(1.5, 1, (1000, 4)), neg])
    net = quality.fit(pos, unl)
    assert abs(net.prior - 0.5) < 0.12
    assert (net.score(neg) < 0.5).mean() > 0.9 and (net.score(pos) >= 0.5).mean() > 0.9


def test_toxicity(spark, labelled, docs, none):
    d, frame = labelled
    got = registered.op4_toxicity(spark, d).toPandas()
    assert len(got) == len(frame) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    m = got[got.held_out].merge(frame[frame.toxic.notna()], on="doc_id")
    assert held_out_auc((m.toxic == 1).to_numpy(), m.score.to_numpy()) > 0.7
    assert toxicity.fit([], np.array([]), []) is None and toxicity.fit(["a", "b"], np.array([1, 1]), ["x", None]) is None
    assert toxicity.score(docs, None).count() == len(TEXTS) and toxicity.score(none, None).count() == 0


def test_toxicity_learns_words():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(600):
        t = rng.choice(words, 40).tolist()
        y.append(i % 4 == 0)
        if y[-1]:
            t[int(rng.integers(0, 40))] = f"nasty{rng.choice(list('abcdef'))}"
        texts.append(" ".join(t))
    net = toxicity.fit(texts, np.array(y, int), ["xx"] * 600)
    test = ["w1 w2 nastyz w3 " + " ".join(words[:30]), " ".join(words[:40]), "", None]
    s = net.score(test)
    assert s[0] >= 0.3 and (s[1:] < 0.3).all()


def test_toxicity_windows_and_pooling():
    net = toxicity.train(["a b c", "d e", "f", "g h i j"], np.array([1, 0, 1, 0]), epochs=1)
    whole = net.margins(hash_words(["a b", "c", "", "d e f"]))
    alone = np.concatenate([net.margins(hash_words([t])) for t in ("a b", "c", "", "d e f")])
    assert np.allclose(whole, alone, atol=1e-5)


# -- language


def twin_phrases(sample: str, text: str) -> int:
    n, at = 0, 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += max(1, k)
        n += 1
    return n


@settings(max_examples=40, deadline=None)
@given(st.text("abc ", min_size=1, max_size=60), st.text("abcd ", min_size=1, max_size=80))
def test_phrases_match_the_definition(sample, text):
    model = language_id.Model.fit({"x": [sample]}, 1000)
    squeeze = lambda t: re.sub(r"\s+", " ", t)
    counts, sizes, lettered = model.phrases([text, None])
    assert counts[0, 0] == twin_phrases(squeeze(sample), squeeze(text)) and sizes[0] == len(squeeze(text))
    assert lettered.tolist() == [any(c.isalpha() for c in text), False] and counts[1, 0] == 0


def test_language_id(spark, labelled, docs, none):
    d, frame = labelled
    got = registered.op5_language_id(spark, d).toPandas()
    m = got[got.held_out].merge(frame, on="doc_id")
    assert len(got) == len(frame) and (m.lang_pred == m.lang).mean() > 0.95 and got.score.between(0, 1).all()
    model = language_id.Model.fit({"en": [BASE], "xx": ["zzz qqq zzz"]}, 1000)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert out[6] == out[7] == "en" and out[4] == out[5] == out[11] == "und"
    assert {r["doc_id"] for r in language_id.keep_identified(docs, model, 0.0).collect()} == {i for i, t in TEXTS if i not in (4, 5, 11)}
    empty = language_id.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"} and language_id.identify(none, model).count() == 0


# -- packing


def check_bins(frame: pd.DataFrame, capacity: int):
    assert frame.groupby("bin_id").n_tokens.sum().max() <= capacity
    for c in ("source", "cluster"):
        known = frame[frame[c].notna()]
        assert not known.duplicated(["bin_id", c]).any()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, 3, None])), max_size=40))
def test_best_fit_is_the_tightest_compatible(items):
    items = sorted(items, key=lambda x: -x[0])
    bins = packing.pack(items, 20)
    brute: list[list] = []
    for it in items:
        fits = [(
            20 - sum(x[0] for x in b) - it[0], k,
        ) for k, b in enumerate(brute) if sum(x[0] for x in b) + it[0] <= 20 and not any((it[1] is not None and x[1] == it[1]) or (it[2] is not None and x[2] == it[2]) for x in b)]
        if fits:
            brute[min(fits)[1]].append(it)
        else:
            brute.append([it])
    assert bins == brute


def test_packing(docs, none):
    out = packing.best_fit(docs, 64, shard_tokens=5000).toPandas()
    frame = docs.select("doc_id", "source", exact_dedup.normalised(F.col("text")).alias("cluster")).toPandas().drop_duplicates("doc_id")
    check_bins(out.merge(frame, on="doc_id"), 64)
    want = pd.Series([max(1, len((t or "").split())) for _, t in TEXTS], [i for i, _ in TEXTS]).groupby(level=0).sum()
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == want.to_dict()
    assert packing.best_fit(none, 64).count() == 0
    assert len(list(packing.bin_iterator(packing.best_fit(docs, 64)))) > 0


# -- urls


def test_url_filter(spark):
    urls = ["http://A.example.net/en/x?q#f", "http://example.net/de/", "https://net/", "http://notnet/x", "http://x.com://y", "no scheme", None, "", "http://example.com/de/1", "http://example.com/DE/1", "ftp://org/fr/", "http://a.org", "http://a.org?x", "http://b.net:80/x", "x://net/" + "p" * 5000, "http://net/", "http://net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.url_filter(pages, registered.URL_RULES).collect()}
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, a) for h, p, a in registered.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == (max(fits)[1:] if fits else (None, "allow"))
    assert url_filter.url_filter(pages.limit(0), registered.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, []).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed, others = keys.filter(F.crc32("key") % 7 == 0), keys.filter(F.crc32("key") % 7 != 0)
    for bits in (1 << 20, 20_000):
        has = url_filter.sharded(listed, others, bits, 1)
        assert keys.filter(has(F.col("key")) != (F.crc32("key") % 7 == 0)).count() == 0


# -- simhash


def twin_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), 42).intdigest() for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, bits):
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return [min(ids[k] for k in range(len(ids)) if root[k] == root[i]) for i in range(len(ids))]


def test_simhash(docs, none):
    got = simhash.near_dedup(docs).collect()
    text = dict(TEXTS)
    ids, fps = [r["doc_id"] for r in got], [twin_fingerprint(text[r["doc_id"]]) for r in got]
    assert len(got) == len(TEXTS) and [r["fingerprint"] for r in got] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in got] == brute_components(ids, fps, 3)
    assert simhash.near_dedup(none).count() == 0
    several = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs, n_fingerprints=3).collect()}
    assert several[9] == 8 and several[2] == 1


def test_hot_keys_are_tiled(spark):
    rng = np.random.default_rng(4)
    centre = [int(x) for x in rng.integers(0, 1 << 62, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 4)), replace=False)) for c in centre for _ in range(60)})
    frame = spark.createDataFrame([(f,) for f in fps], "node long")
    linked = simhash.components(simhash.links(frame, ["node"], 3, 2, 5, 16))
    root = {r["node"]: r["root"] for r in linked.collect()}
    assert [root.get(f, f) for f in fps] == brute_components(fps, fps, 3)


# -- chat


def test_chat(spark):
    turns = [
        (2, 1, "user", "x<|im_end|>"), (2, 0, "system", None), (1, 0, "us\ner%0A", "<\\|"), (1, 1, "assistant", "<|im_start|><"), (1, 2, "assistant", ""),
        (None, 0, None, "n"), (3, 0, "user", "t"), (3, 0, "user", "t"),
    ]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(rows)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1], t[2] or "", t[3] or "") for t in turns if t[0] == c))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(rows.limit(0)).count() == 0


@given(st.text("<|\\>im_end%\nA", max_size=30))
def test_escapes_go_back(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_rewritten_history_is_found():
    cut = lambda turns: "".join(f"[{r}:{t}]" for r, t in turns[-2:])
    assert chat.format_conversation([("u", "1"), ("a", "2"), ("u", "3")], cut)[1:] == (None, 2)
    out, spans, rewritten = chat.format_conversation([("u", "1"), ("a", "2")], cut)
    assert rewritten is None and [out[s["text_start"] : s["text_end"]] for s in spans] == ["1", "2"]


# -- decontamination


def twin_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    rng = np.random.default_rng(2)
    vocab = [f"v{i}" for i in range(400)]
    items = [rng.choice(vocab, n).tolist() for n in (40, 30, 12, 6, 3, 1)]
    items[-1] = ["unique"]
    texts = []
    for k in range(120):
        own = list(items[k % 6])
        edits = int(0.2 * len(own)) if k % 3 == 0 else 0
        for _ in range(edits):
            own[int(rng.integers(0, len(own)))] = "zz"
        body = rng.choice(vocab, 60).tolist()
        texts.append(body[:30] + (own if k % 2 == 0 else []) + body[30:])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(items)), (7, None), (8, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_items(frame, bench).collect()}
    want = {(i, j): twin_edits(it, t) for i, t in enumerate(texts) for j, it in enumerate(items) if twin_edits(it, t) <= int(0.2 * len(it) + 1e-9)}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k]["edits"] == want[k] for k in got)
    exact = {k for k, v in want.items() if v == 0}
    assert exact <= set(got)
    for (i, j), r in got.items():
        assert twin_edits(items[j], texts[i][r["start_word"] : r["end_word"]]) == r["edits"]
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(frame, bench).collect()}
    assert kept == (set(range(120)) | {900, 901}) - {i for i, _ in got}
    blocks = {(r["doc_id"], r["item_id"]) for r in decontamination.find_items(frame, bench, block_chars=60).collect()}
    assert exact <= blocks
    assert decontamination.find_items(docs, bench.limit(0)).count() == 0 and decontamination.find_items(none, bench).count() == 0
    assert decontamination.drop_contaminated(docs, bench).columns == docs.columns
