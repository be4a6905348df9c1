"""Centroid clustering, source mixing and the Merkle manifest against brute force, and on nulls, ties, repeated rows, odd widths and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connection, rows
from pyspark.sql import functions as F

from loamgraph.llm import clustering, merkle, mixing
from loamgraph.llm import queries as registered

CLASHES = ("key", "tree", "pos", "hash", "size", "rows", "target", "id", "vector", "cluster", "h", "n", "block", "left", "_at", "above")


def clashing(frame):
    """Extra columns that have the operators' own names."""
    return frame.withColumns({c: F.lit("x") for c in CLASHES})


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_source_mix", "op13_merkle_manifest"])
def test_against_sql(spark, data, name):
    got, want = registered.QUERIES[name](spark, data).toPandas(), connection(data).sql(registered.ORACLES[name]).to_df()
    assert rows(got) == rows(want)


# -- clustering


def plain_clusters(points, ids, k, rounds):
    order = sorted(range(len(points)), key=lambda i: (ids[i] is None, hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest() if ids[i] is not None else "", points[i]))
    centroids = [list(points[i]) for i in order[:k]]
    nearest = lambda p: min(range(len(centroids)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, centroids[c], strict=True)), c))
    for _ in range(rounds):
        held = defaultdict(list)
        for p in points:
            held[nearest(p)].append(p)
        for c, own in held.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(nearest(p), sum((a - b) ** 2 for a, b in zip(p, centroids[nearest(p)], strict=True))) for p in points], centroids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.integers(-4, 4)] * 3), min_size=1, max_size=90), st.integers(1, 7), st.integers(1, 6), st.sampled_from([1, 1 << 22]))
def test_filtering_is_comparing_all(points, k, leaf, scale):
    """Small grids are full of ties and copies; large components go by integers."""
    p = np.array(points, np.int64) * scale
    c = p[:: max(1, len(p) // k)][:k]
    tree = clustering.grow(p, leaf)
    order = tree.pop("order")
    assert sorted(order.tolist()) == list(range(len(p)))
    tree["points"] = p[order]
    f = clustering.Filter(c, int(np.abs(p).max()))
    want = ((p[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (clustering.assign(f, tree) == want[order]).all()
    counts, sums = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    clustering.add_up(f, tree, counts, sums)
    assert (counts == np.bincount(want, minlength=len(c))).all() and all((sums[j] == p[want == j].sum(axis=0)).all() for j in range(len(c)))


def test_copies_are_one_leaf_and_far_nodes_are_assigned_whole():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.integers(0, 9, (500, 4)), rng.integers(1000, 1009, (500, 4)), np.full((3000, 4), 5000)])
    tree = clustering.grow(p)
    sizes = (tree["last"] - tree["first"])[tree["left"] == 0]
    assert sizes.max() == 3000 and np.sort(sizes)[-2] <= clustering.LEAF_ROWS
    tree["points"] = p[tree.pop("order")]
    whole, open_leaves = clustering.Filter(np.array([[4] * 4, [1004] * 4, [5000] * 4]), 5000).split(tree)
    assert not open_leaves and len(whole) == 3


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    good += [(7, [0.5] * 4)] * 150 + [(None, [1e9, -1e9, 0.0, 1.0]), (7, [0.25] * 4)]
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0, 3.0]), (4, [1.0, float("nan"), 2.0, 3.0]), (5, [float("inf"), 0.0, 0.0, 0.0]), (6, [1.0] * 5)]
    frame = clashing(spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")).repartition(3)
    got = clustering.cluster(frame, k=6, rounds=3, width=4, tree_rows=50)
    points = [tuple(clustering.quantise(np.array(v), 256).tolist()) for _, v in good]
    labels, centroids = plain_clusters(points, [i for i, _ in good], 6, 3)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    inertia = Counter()
    for c, d in labels:
        inertia[c] += d
    want = [(i, c, d, min(inertia[c], clustering.LONG), min(sum(inertia.values()), clustering.LONG), digests[c]) for (i, _), (c, d) in zip(good, labels, strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert clustering.cluster(frame.filter("vec_id is not null and vec_id < 3"), k=6, width=4).select("distance").distinct().collect() == [(0,)]
    assert clustering.cluster(frame.limit(0), k=6, width=4).collect() == []


# -- mixing


def shares(sizes, weights, most):
    """By halving the level until every source's cap is decided."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, low, high = sum(sizes.values()), 0.0, 1e18
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(level * weight[s], most * sizes[s]) for s in names) < total else (low, level)
    return {s: min(high * weight[s], most * sizes[s]) for s in names}


def documents(seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(600):
        source = [None, "", "b", "hot", "hot", "hot", "z", "é", "\U0001f600", "ﬀ"][int(rng.integers(10))]
        out.append((int(rng.integers(200)) if i % 5 else None, " ".join(["w"] * int(rng.integers(40))) + "\n", "en", source, 1))
    out += [(5, "same words here", "en", "hot", 1)] * 400  # nothing tells these apart
    return [*out, (1, None, None, "nothing", None), (2, " \t\n", None, "nothing", None), (3, "x" * 50_000 + " long " * 900, "en", "long", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed, monkeypatch):
    docs = documents(seed)
    frame = clashing(spark.createDataFrame(docs, SCHEMA)).repartition(5)
    if seed == 2:
        monkeypatch.setattr(mixing, "LARGE_SHARE", 4)  # most sources by join
    got = mixing.mix(frame).collect()
    count = lambda t: len((t or "").split())
    assert sorted(map(str, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(str, ((i, s, count(t)) for i, t, _, s, _ in docs)))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert 0 <= r["times"] <= 3 and r["taken"] == r["times"] * r["size"]
    want = shares(sizes, (1, 2, 3), 3)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(frame.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_smaller_mixes_are_inside_larger_ones(spark):
    frame = spark.createDataFrame([(i, "a b " * (i % 7), "en", f"s{i % 3}", 1) for i in range(300)], SCHEMA)
    times = [{r["doc_id"]: r["times"] for r in mixing.mix(frame, share=s).collect()} for s in (0.2, 0.5, 1.0, 3.0)]
    assert all(a[i] <= b[i] for a, b in zip(times, times[1:], strict=False) for i in a)
    assert set(times[3].values()) == {3}


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", None)], SCHEMA)).collect()
    assert {(r["doc_id"], r["source_size"], r["target"], r["taken"]) for r in empty} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


# -- manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i, fold):
    """(siblings, refolded root)."""
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out += [x for k, x in enumerate(run) if k != i % 3]
        fold, i = h(*[fold if k == i % 3 else x for k, x in enumerate(run)]), i // 3
    return out, fold


def plain_manifest(docs):
    """Rows: doc_id, text, lang, source, n_chars."""
    by_source = defaultdict(list)
    for i, t, lang, s, n in docs:
        now = t.replace("\n", "") if t is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by_source[s].append((i, h(*map(field, (i, s, lang, n, t))), h(*map(field, (i, s, lang, n, now)))))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree_levels([r[1] for r in by_source[s]])
    over = tree_levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (doc, leaf, found) in enumerate(by_source[s]):
            low, fold = path(trees[s], i, found)
            high, fold = path(over, k, fold)
            yield doc, leaf, trees[s][-1][0], over[-1][0], h(*low, *high), fold, fold == over[-1][0]


def manifest_of(frame):
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    found = merkle.manifest(frame, {"text": F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("small", [10_000, 0])
def test_manifest(spark, small, monkeypatch):
    """A source of 900 leaves has seven levels, two layers of blocks; with ``small`` 0 everything is joined instead of broadcast."""
    monkeypatch.setattr(merkle, "SMALL", small)
    rng = np.random.default_rng(3)
    docs = [(int(rng.integers(2000)), "line\nline\n" * int(rng.integers(3)), "en", "hot", 5) for _ in range(800)] + [(77, "same\n", "en", "hot", 5)] * 100
    docs += [(None, None, None, None, None), (None, "x\n", None, None, 1), (4, "é\n\U0001f600", "en", None, 2), (1, "a\n", "en", "", 2), (9, "long\n" * 30_000, "de", "one", 1)]
    docs += [(k, "t\n", "en", f"s{k % 300}", 1) for k in range(320)]  # more sources than a block holds
    got = manifest_of(clashing(spark.createDataFrame(docs, SCHEMA)).repartition(4)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(docs)))
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 243, 244])
def test_small_manifests(spark, n):
    docs = [(k, "a\nb", "en", "s", 1) for k in range(n)]
    got = manifest_of(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(docs))) if n else got == []
