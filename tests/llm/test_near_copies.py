"""Near copies against all pairs of texts."""

import numpy as np
import pytest

from loamgraph.llm import near_copies


def shingle_set(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, least):
    """The smallest id of each id's component of pairs at Jaccard ``least`` or more; ids without any such partner."""
    sets, root, alone = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}, set(texts)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= least * (len(sets[a]) + len(sets[b]) - both):
                alone -= {a, b}
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    return root, alone


def corpus():
    """Texts and copies with words replaced, at similarities on both sides of 0.8."""
    rng, texts = np.random.default_rng(5), {}
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 400)))]
        for share in (0, 0.01, 0.02, 0.025, 0.04):
            own = list(words)
            for at in rng.choice(len(own), int(share * len(own)), replace=False):
                own[at] = f"x{rng.integers(0, 1 << 40)}"
            texts[len(texts)] = " ".join(own)
    return texts | {200: None, 201: "", 202: " \n", 203: "one two", 204: "One  TWO", 205: "one two three"}


@pytest.mark.parametrize("tile", [2048, 2])
def test_links_are_those_of_all_pairs(spark, tile):
    texts = corpus()
    frame = spark.createDataFrame([*texts.items(), (203, "one two")], "doc_id long, text string")
    got = near_copies.near_copies(frame, tile=tile).collect()
    root, _ = brute(texts, 0.8)
    assert len(got) == len(texts) + 1 and {r["doc_id"]: r["component_id"] for r in got} == root
    assert 60 < sum(i != r for i, r in root.items()) < 160
    assert near_copies.near_copies(frame.limit(0)).count() == 0


def test_forest_links_what_a_walk_reaches():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(1, 40)), dtype=np.uint64)) for _ in range(120)]
    for least in (0.3, 0.5, 0.7):
        src, dst = near_copies.forest(sets, least)
        pairs = [(a, b) for a in range(120) for b in range(a) if len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-9]

        def parts(edges):
            root = list(range(120))
            for a, b in edges:
                root = [root[a] if r == root[b] else r for r in root]
            return {frozenset(k for k in range(120) if root[k] == r) for r in root}

        assert parts(zip(src, dst, strict=True)) == parts(pairs) and len(src) == 120 - len(parts(pairs))


def test_simhash_blocks_meet_at_the_least_similarity():
    """A bit is the majority of the shingles' bits; of pairs at Jaccard 0.8, short and long, none misses all blocks and the limit of bits; unlike sets do not meet."""
    lanes, most = near_copies.plan(0.8, 0.00005)
    rng = np.random.default_rng(2)
    one = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    assert (near_copies.fingerprints(np.repeat(one, 9), 4) == near_copies.fingerprints(one, 4)).all() and not near_copies.fingerprints(one[:0], 4).any()

    def meets(a, b):
        shares = (a[:, None] ^ b[:, None]) >> np.arange(0, 64, 16, dtype=np.uint64) & np.uint64(0xFFFF) == 0
        bits = np.bitwise_count(a ^ b).astype(int)
        return bool((shares.any(axis=1) & (bits + np.roll(bits, -1) <= most)).any())

    missed = 0
    for small, both, large in ((4, 4, 5), (9, 8, 9), (18, 16, 18), (40, 40, 50), (360, 320, 360)):
        for _ in range(200):
            made = rng.integers(0, 1 << 63, small + large - both, dtype=np.uint64)
            a, b = (near_copies.fingerprints(x, lanes) for x in (made[:small], made[small - both :]))
            missed += not meets(a, b)
            c = near_copies.fingerprints(rng.integers(0, 1 << 63, 100, dtype=np.uint64), lanes)
            assert not meets(a, c) or small < 9
    assert missed <= 1


@pytest.mark.parametrize("pairwise", [1, 256])
def test_clusters_are_those_of_all_pairs_of_a_block(monkeypatch, pairwise):
    monkeypatch.setattr(near_copies, "PAIRWISE", pairwise)
    rng = np.random.default_rng(4)
    place, base = np.sort(rng.integers(0, 6, 90)), rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64)
    prints = base[rng.integers(0, 12, 90)] ^ (np.uint64(1) << rng.integers(0, 60, (90, 2)).astype(np.uint64))
    key, node = near_copies.clusters(place, np.arange(90), prints, 4)
    root = list(range(90))
    for a in range(90):
        for b in range(a):
            if place[a] == place[b] and np.bitwise_count(prints[a] ^ prints[b]).sum() <= 4:
                root = [root[a] if r == root[b] else r for r in root]
    due = {frozenset(i for i in range(90) if root[i] == r) for r in set(root) if root.count(r) > 1}
    assert len(due) > 5 and {frozenset(node[key == k].tolist()) for k in np.unique(key)} == due


def test_texts_far_below_the_least_similarity_have_no_sets_made(spark, monkeypatch):
    """A crowd of texts at Jaccard 0.5 to 0.6 meets in blocks; only the texts that are alike hold keys, and their links are those of all pairs."""
    rng, held, join = np.random.default_rng(9), [], near_copies.links
    base, texts = [f"w{x}" for x in range(300)], {}
    for i in range(80):
        own = list(base)
        for at in rng.choice(300, 11, replace=False):
            own[at] = f"x{i}_{at}"
        texts[i] = " ".join(own)
    texts |= {100: texts[7] + " more", 101: texts[9] + " words at the end"}
    monkeypatch.setattr(near_copies, "links", lambda of, *rest: held.append({r["node"] for r in of.collect()}) or join(of, *rest))
    got = near_copies.near_copies(spark.createDataFrame([*texts.items()], "doc_id long, text string"))
    root, alone = brute(texts, 0.8)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root
    linked = len(texts) - len(alone)
    assert linked == 4 and len(held[0]) <= 10


def roots_of(nodes, pairs):
    """The smallest node of each one's component."""
    root = {i: i for i in nodes}
    for a, b in pairs:
        if root[a] != root[b]:
            lo, hi = sorted((root[a], root[b]))
            root = {i: lo if r == hi else r for i, r in root.items()}
    return root


def test_a_crowd_in_many_keys_is_dealt_about_once(spark, monkeypatch):
    """400 sets alike and 12 less so, in 30 keys that hold most of them: what is shuffled grows with the nodes, not with keys or tiles, and the links connect what all pairs do."""
    rng, seen = np.random.default_rng(11), []
    base, sets = np.arange(1, 101, dtype=np.uint64), {}
    for i in range(412):
        swapped = rng.integers(1, 5) if i < 400 else 13
        own = base.copy()
        own[rng.choice(100, swapped, replace=False)] = rng.integers(1 << 20, 1 << 60, swapped, dtype=np.uint64)
        sets[i] = np.unique(own)
    held = [(k, int(i), 100) for k in range(30) for i in rng.choice(412, 330, replace=False)] + [(50, 3, 100), (50, 405, 100)]
    frame = spark.createDataFrame(held, "key long, node long, n int")
    made = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, shingles binary")
    kind = type(frame)
    sort = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *by: ("lo" in by and seen.append(self.count())) or sort(self, *by))
    got = near_copies.links(getattr(near_copies, "merged", lambda x: x)(frame), made, 0.8, 2048).collect()

    def alike(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    due = [(a, b) for a in sets for b in range(a) if alike(a, b)]
    assert roots_of(sets, [(r["src"], r["dst"]) for r in got]) == roots_of(sets, due)
    assert all(alike(r["src"], r["dst"]) for r in got) and sum(seen) < 5 * len(sets)


def test_merged_keys_keep_every_meeting(spark):
    """Overlapping keys, chains and stars: nodes that share a key share one still, in no more rows and pairs."""
    rng = np.random.default_rng(12)
    held = [(int(k), int(i)) for k in range(-20, 20) for i in rng.choice(80, rng.integers(2, 50), replace=False)]
    held += [(1000 + i, 100 + i + j) for i in range(60) for j in (0, 1)] + [(2000 + i, j) for i in range(20) for j in (300, 301 + i)] + [(3000, 400)]
    frame = spark.createDataFrame([(k, i, 7) for k, i in held], "key long, node long, n int")

    def keys_of(rows):
        keys = {}
        for k, i in rows:
            keys.setdefault(k, set()).add(i)
        return list(keys.values())

    got = [(r["key"], r["node"]) for r in near_copies.merged(frame).collect()]
    before, after = keys_of(held), keys_of(got)
    assert len(set(got)) == len(got) < len(held) / 2
    assert all(any({a, b} <= k for k in after) for own in before for a in own for b in own if a < b)
    assert sum(len(k) ** 2 for k in after) <= sum(len(k) ** 2 for k in before)


def test_only_what_is_not_connected_meets_again(spark):
    """Of a key, nodes of different roots meet in a group; its largest root is not dealt to more groups than the others need, and a key with one root has no rows."""
    size, apart = 700, (3, 90)
    for n in apart:
        held = spark.createDataFrame([(1, i, 10) for i in range(size + n)] + [(2, i, 10) for i in range(9)], "key long, node long, n int")
        roots = spark.createDataFrame([(i, 0) for i in range(size)] + [(size + 1, size)], "node long, root long")
        root = {i: 0 if i < size else size if i == size + 1 else i for i in range(size + n)}
        groups = {}
        for r in near_copies.opposed(held, roots, 2048).collect():
            assert r["key"] == 1
            groups.setdefault((r["lo"], r["hi"]), set()).add(r["node"])
        met = {(a, b) for own in groups.values() for a in own for b in own if a < b}
        assert all((a, b) in met for b in range(size, size + n) for a in range(b) if root[a] != root[b])
        rows = sum(map(len, groups.values()))
        assert rows <= (size + 10 * n if n <= 64 else 2 * size + 10 * n)
