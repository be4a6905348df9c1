"""Near copies by SimHash: blocks of fingerprints find candidates, every link is verified exactly by Jaccard similarity of word shingles.

Words are as in ``simhash.py``: ASCII letters lower-cased, cut at ASCII white space. A text is the set of its shingles' 64-bit hashes; equal sets are one
node. A node has several fingerprints of 64 bits, each cut into four blocks. Nodes that agree on a block are compared over that fingerprint and the next, and those at few differing bits
meet. At similarity s a bit differs with probability acos(2s / (1 + s)) / pi; the number of fingerprints follows from ``least``, so that a pair at that similarity agrees on none of the blocks
with probability ``missed`` at most. No two texts meet by a block alone, so texts that have nothing in common hardly ever have their sets compared. What has met is compared over all fingerprints, so
that only texts near that similarity go on.

Only nodes that meet another have their sets made again and shuffled: a bitmap of bounded size, built on the executors, says which
texts. Keys are what met together; those with the same members are compared once, and those that overlap are merged where that makes no more pairs. A key held by many nodes, or by nodes of long
texts, is cut into tiles. Each meets the first one; what that leaves unconnected meets the rest of its key then, in groups of two tiles. Within a group the intersections are counted exactly; a group
emits a spanning forest of its links, never all pairs.

Defined results: null text is empty text; texts without words are equal; fewer words than a shingle give one shingle; rows that repeat an id share
one component; a null id takes its component's smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgraph.llm import simhash
from loamgraph.llm.simhash import SEED, components
from loamgraph.llm.words import mix
from loamgraph.operators.graph import stars
from loamgraph.session import SMALL, discard, keep, pin, settle

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the bitmap of wanted texts, as a power of two; with more texts than it can tell apart, more sets are made than needed, none is missed.
LEAST_BITS, MOST_BITS = 15, 27
#: Bytes of sets in a tile; nodes that need no second tile.
TILE_BYTES, SPLIT = 16_000_000, 64
#: Rounds in which keys are merged; rows beyond which a key's own row is broadcast.
MERGES, CROWD = 2, 256


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted different hashes of ``width`` words in a row."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w, SEED) for w in words], dtype=np.uint64)
    n = max(1, len(own) - width + 1)
    made = np.full(n, min(width, len(own)), dtype=np.uint64)
    for k in range(min(width, len(own))):
        made = mix(made * GOLDEN ^ own[k : k + n])
    return np.unique(made)


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


#: Blocks of a fingerprint, their bits, and the bits that are compared where a block agrees: two fingerprints less that block.
BLOCKS, BLOCK_BITS = 4, 16
COMPARED = 128 - BLOCK_BITS
#: Nodes of one block that are compared pair by pair; of more, each node reached is compared with those not yet reached.
PAIRWISE = 256


def most_bits(least: float, bits: int) -> int:
    """Differing ones of ``bits`` bits at most for pairs at Jaccard ``least``, with room for five standard deviations."""
    differs = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(bits * differs + 5 * math.sqrt(bits * differs * (1 - differs)))


def plan(least: float, missed: float) -> tuple[int, int]:
    """(fingerprints, differing bits of two fingerprints at most) for pairs at Jaccard ``least``."""
    differs = math.acos(2 * least / (1 + least)) / math.pi
    keys = 1 if differs == 0 else math.log(missed) / math.log1p(-((1 - differs) ** BLOCK_BITS))
    return max(2, math.ceil(keys / BLOCKS)), most_bits(least, COMPARED)


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` SimHash fingerprints: a bit is 1 if set in over half the hashes. A shingle counts twice, by hashes of its own, so that few bits of short texts are ties."""
    count, by = np.zeros(64 * n, dtype=np.int32), mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * GOLDEN)
    for at in range(0, len(hashes), 127):
        made = mix(hashes[at : at + 127, None] ^ by)
        count += np.unpackbits(made.view(np.uint8).reshape(-1, 8 * n), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(count > len(hashes), bitorder="little").view(np.uint64)


def alike(both, a, b, least: float):
    """Whether ``both`` common members make sets of sizes a and b similar enough."""
    return both >= least * (a + b - both) - 1e-9


def forest(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Index pairs of a spanning forest of the links among ``sets``. Each set reached is compared with those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        a, b = sizes
        fits = alike(min(a, b), a, b, least) and alike(len(np.intersect1d(*sets, assume_unique=True)), a, b, least)
        return ([0], [1]) if fits else ([], [])
    ends = np.cumsum(sizes)
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    holders, first = np.repeat(np.arange(len(sets)), sizes)[order], np.append(0, np.cumsum(np.bincount(member)))
    left, src, dst, queue = np.ones(len(sets), dtype=bool), [], [], []
    while left.any():
        if not queue:
            queue.append(int(left.argmax()))
            left[queue[0]] = False
            continue
        i = queue.pop()
        own = member[ends[i] - sizes[i] : ends[i]]
        many = first[own + 1] - first[own]
        at = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        hit = np.flatnonzero(left & alike(np.bincount(holders[at], minlength=len(sets)), sizes[i], sizes, least)).tolist()
        src += [i] * len(hit)
        dst += hit
        queue += hit
        left[hit] = False
    return src, dst


def with_fingerprints(texts: DataFrame, width: int, lanes: int) -> DataFrame:
    """``texts``: doc_id, text, text_key. doc_id, text_key, node, n (shingles), prints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32), np.zeros((b.num_rows, lanes), np.uint64)
            for i, t in enumerate(b.column(1)):
                own = shingles(t.as_py(), width)
                nodes[i], sizes[i], prints[i] = node_of(own), len(own), fingerprints(own, lanes)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * lanes, pa.int32()), pa.array(prints.view(np.int64).ravel()))
            made = [b.column(0), b.column(2), pa.array(nodes.view(np.int64)), pa.array(sizes), listed]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text_key", "node", "n", "prints"])

    return texts.mapInArrow(run, "doc_id long, text_key long, node long, n int, prints array<long>")


def clusters(place: np.ndarray, node: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of what meets, rows sorted by ``place``: a key is a place's nodes that are linked, also through others, at ``most`` differing bits."""
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    ends = np.append(starts[1:], len(place))
    large, src, dst, d = ends - starts > PAIRWISE, [], [], 0
    at = np.flatnonzero(~np.repeat(large, ends - starts))
    end = np.repeat(ends, ends - starts)[at]
    while len(at):
        d += 1
        inside = at + d < end
        at, end = at[inside], end[inside]
        near = np.bitwise_count(prints[at] ^ prints[at + d]).sum(axis=1) <= most
        src.append(at[near])
        dst.append(at[near] + d)
    for a, b in zip(starts[large], ends[large], strict=True):
        i, j = simhash.forest(prints[a:b], most)
        src.append(i + a)
        dst.append(j + a)
    rows, first = stars(np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2
    heads = np.unique(first)
    rows, first = np.append(rows, heads).astype(np.int64), np.append(first, heads).astype(np.int64)
    return mix(place[first].view(np.uint64) * GOLDEN ^ node[first].view(np.uint64)).view(np.int64), node[rows]


def meetings(nodes: DataFrame, lanes: int, most: int, tile: int) -> DataFrame:
    """``nodes``: node, prints, each node once. (key, node): nodes that agree on a block and, directly or through others of that block, differ in ``most`` bits of two fingerprints at most."""
    spark, lane = nodes.sparkSession, f"int(k / {BLOCKS})"
    keyed = nodes.select("node", "prints", F.explode(F.sequence(F.lit(0), F.lit(lanes * BLOCKS - 1))).alias("k")).selectExpr(
        "node", f"get(prints, {lane}) AS a", f"get(prints, ({lane} + 1) % {lanes}) AS b", "k",
    ).selectExpr(f"k * {1 << BLOCK_BITS} + int(shiftrightunsigned(a, k % {BLOCKS} * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}) AS at", "node", "a", "b")
    hot, n = settle(keyed.groupBy("at").count().filter(F.col("count") > tile).select("at", F.ceil(F.col("count") / tile).alias("tiles")))
    dealt = keyed.select((F.col("at").cast("long") * (1 << 32)).alias("place"), "node", "a", "b")
    if n:  # fewer than all rows over ``tile``
        own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("long")
        tiled = keyed.join(F.broadcast(hot), "at").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        place = F.col("at").cast("long") * (1 << 32) + F.least("own", "other") * (1 << 16) + F.greatest("own", "other")
        dealt = keyed.join(F.broadcast(hot), "at", "left_anti").select((F.col("at").cast("long") * (1 << 32)).alias("place"), "node", "a", "b")
        dealt = dealt.unionByName(tiled.select(place.alias("place"), "node", "a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, node, a, b in whole_places([c.to_numpy() for c in b.columns] for b in batches):
            made = clusters(place, node, np.stack([a, b], axis=1).view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["key", "node"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(run, "key long, node long")


def whole_places(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The same rows, sorted by their first column, cut so that rows alike in it are together."""
    rest: list[np.ndarray] | None = None
    for cols in parts:
        rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        whole = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last place may go on
        if whole:
            yield [x[:whole] for x in rest]
            rest = [x[whole:] for x in rest]
    if rest is not None and len(rest[0]):
        yield rest


def sharpened(held: DataFrame, lanes: int, most: int) -> DataFrame:
    """``held``: key, node, n, prints. key, node, n of the nodes of a key that, directly or through others of it, differ in ``most`` bits of all fingerprints at most. What is linked stays
    together; texts that have met by their two fingerprints only go before anything is made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = ([*(c.to_numpy() for c in b.columns[:3]), b.column(3).flatten().to_numpy().reshape(-1, lanes)] for b in batches)
        for place, node, n, prints in whole_places(cols):
            key, left = clusters(place, node, prints.view(np.uint64), most)
            names, first = np.unique(node, return_index=True)
            made = [pa.array(key), pa.array(left), pa.array(n[first[np.searchsorted(names, left)]])]
            yield pa.RecordBatch.from_arrays(made, names=["key", "node", "n"])

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.select("key", "node", "n", "prints").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "key long, node long, n int")


def sets_of(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and shingles (bytes) of the texts whose ``text_key`` is in ``wanted``, and of a few more."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * wanted.count()).bit_length()))
    place = F.pmod("text_key", F.lit(1 << bits)) + 1
    parts = wanted.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).collect()
    held = np.zeros(1 << bits >> 3, dtype=np.uint8)
    for r in parts:
        held[(r["part"] - 1) << 12 : r["part"] << 12] = np.frombuffer(bytes(r["held"]), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy() & ((1 << bits) - 1)
            picked = np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for k in range(0, len(picked), 512):
                made = [shingles(t, width) for t in b.column(0).take(pa.array(picked[k : k + 512])).to_pylist()]
                nodes = np.array([node_of(s) for s in made], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "shingles"])

    return texts.select("text", "text_key").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def told(rows: DataFrame, of: DataFrame, by: str) -> DataFrame:
    """``rows`` with the columns of ``of`` (one row per ``by``; ``rows``: how many of them it has) but that. What has more than ``CROWD`` rows is broadcast, so that no task reads all of one key's;
    up to ``SMALL`` rows of ``of`` are all broadcast."""
    if of.count() <= SMALL:
        return rows.join(F.broadcast(of.drop("rows")), by)
    hot = F.broadcast(of.filter(F.col("rows") > CROWD).drop("rows"))
    rest = rows.join(hot.select(by), by, "left_anti").join(of.filter(F.col("rows") <= CROWD).drop("rows"), by)
    return rows.join(hot, by).unionByName(rest)


def merged(held: DataFrame) -> DataFrame:
    """``held``: key, node, n, each key once for each of its nodes. The same columns in fewer rows: nodes that share a key share one still.

    Texts that are alike meet in many keys with much the same members. A key goes to the smallest key that any of its nodes holds, and keys that go to the same one become one, if its nodes have
    no more pairs than theirs had; others stay. Neither rows nor pairs ever become more.
    """
    members = (F.count(F.lit(1)), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))))
    same = Window.partitionBy("key")  # a key's nodes were together in one task: two tiles at most
    held = held.select(*(m.over(same).alias(c) for c, m in zip(("size", "a", "b"), members, strict=True)), "node", "n").filter("size > 1")
    held = pin(held.select(F.xxhash64("size", "a", "b").alias("key"), "node", "n").distinct())  # of those with the same members, one
    for k in range(MERGES):
        low = held.withColumn("low", F.min("key").over(Window.partitionBy("node")))
        if k == 0:
            rows = pin(low.select("key", "node", "n", F.count(F.lit(1)).over(same).alias("size"), F.min("low").over(same).alias("to")))
        else:  # merged keys have any number of nodes
            keys = low.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("low").alias("to"))
            rows = pin(told(held, pin(keys.withColumn("size", F.col("rows"))), "key"))
        each = pin(rows.groupBy("to", "node").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.sum("size").alias("pairs")))
        sums = each.groupBy("to").agg(F.count(F.lit(1)).alias("size"), F.sum("keys").alias("keys"), F.sum("pairs").alias("pairs"))
        sums = pin(sums.withColumn("fits", F.col("size") * F.col("size") <= F.col("pairs")))
        one = told(each.select("to", "node", "n"), sums.filter("fits").select("to", F.col("size").alias("rows")), "to")
        other = told(rows.select("to", "key", "node", "n"), sums.filter("not fits").select("to", F.col("keys").alias("rows")), "to")
        # merged keys are the negative ones, so that the next round's keys go to them first
        one = one.select(F.col("to").bitwiseOR(F.lit(-1 << 63)).alias("key"), "node", "n")
        held = pin(one.unionByName(other.select(F.xxhash64("key").bitwiseAND(F.lit((1 << 63) - 1)).alias("key"), "node", "n")))
    return held


def tiles(size: str, total: str, most: int):
    """Tiles of up to ``most`` nodes and ``TILE_BYTES`` of sets each."""
    return F.greatest(F.ceil(F.col(size) / F.lit(most)), F.ceil(F.col(total) * 8 / F.lit(TILE_BYTES)), F.lit(1)).cast("int")


def opposed(held: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """``held``: key, node, n; ``roots``: node, root of nodes that are linked already. node, key, lo, hi: the task groups in which nodes of one key and different roots meet.

    The root with most nodes of a key is not compared within itself: each of its tiles meets those of the other nodes only. A key with one root has no rows, one with few other nodes about
    as many rows as nodes.
    """
    named = pin(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    each = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
    first = F.max(F.struct("size", "root", "total"))
    keys = each.groupBy("key").agg(first.alias("most"), F.sum("size").alias("rows"), F.sum("total").alias("total")).selectExpr(
        "key", "rows", "most.root AS most", "most.size AS size_a", "most.total AS total_a", "rows - most.size AS size_b", "total - most.total AS total_b",
    ).filter("size_b > 0")

    def cut(of: str):
        """Up to ``tile`` nodes each, and fewer where they are not so many: as many tiles as a tile has nodes over SPLIT."""
        return F.greatest(tiles(f"size_{of}", f"total_{of}", tile), F.ceil(F.sqrt(F.col(f"size_{of}") / F.lit(float(SPLIT))))).cast("int")

    keys = pin(keys.select("key", "rows", "most", cut("a").alias("a"), cut("b").alias("b")))
    apart = F.col("root") != F.col("most")
    own = F.when(apart, F.col("a") + F.pmod(F.xxhash64("node", F.lit(7)), F.col("b"))).otherwise(F.pmod(F.xxhash64("node", F.lit(7)), F.col("a"))).cast("int")
    others = F.sequence(F.when(apart, F.lit(0)).otherwise(F.col("a")), F.col("a") + F.col("b") - 1)
    met = told(named, keys, "key").select("node", "key", own.alias("own"), F.explode(others).alias("other"))
    return met.select("node", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def links(held: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """``held``: key, node, n, each key once for each of its nodes. Links src, dst (nodes) that connect whatever links among nodes of one key connect.

    First each node of a key is in one of its tiles, and each tile is compared with itself and the key's first tile: two rows a node, however large the key. That joins most of what is alike; of
    keys with several tiles, only nodes that are not connected yet are compared then, see ``opposed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []

        def emit() -> pa.RecordBatch:
            src, dst = forest(sets, least) if len(sets) > 1 else ([], [])
            own = np.array(nodes, dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(own[src], pa.int64()), pa.array(own[dst], pa.int64())] if src else [pa.array([], pa.int64())] * 2, names=["src", "dst"],
            )

        for b in batches:
            places = zip(*(b.column(c).to_pylist() for c in ("key", "lo", "hi")), strict=True)
            for place, node, own in zip(places, b.column("node").to_pylist(), b.column("shingles"), strict=True):
                if place != now:
                    if len(sets) > 1:
                        yield emit()
                    now, nodes, sets = place, [], []
                nodes.append(node)
                sets.append(np.frombuffer(own.as_buffer(), np.uint64))
        if len(sets) > 1:
            yield emit()

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compared(groups: DataFrame) -> DataFrame:
        dealt = groups.join(sets, "node").select("key", "lo", "hi", "node", "shingles").repartition(parts, "key", "lo", "hi")
        return pin(dealt.sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "src long, dst long").distinct())

    sized = held.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total")).filter("rows > 1")
    whole = min(SPLIT, tile)  # nodes of a group
    one = (F.col("rows") <= whole) & (F.col("total") * 8 <= TILE_BYTES)
    sized = pin(sized.select("key", "rows", F.when(one, F.lit(1)).otherwise(tiles("rows", "total", max(1, whole // 2))).alias("tiles")))
    several = sized.filter("tiles > 1").drop("tiles")
    again = not several.isEmpty()
    if again:
        sets, path = keep(sets, "zstd")
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("tiles")).cast("int")
    others = F.when(F.col("lo") == 0, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("lo"))
    found = compared(told(held, sized, "key").withColumn("lo", own).select("node", "key", F.explode(others).alias("lo")).withColumn("hi", F.col("lo")))
    if again:
        found = found.unionByName(compared(opposed(told(held, several, "key"), components(found), tile)))
        discard(held.sparkSession, path)
    return found


#: Rows to drop that are sent to every executor; beyond it the documents are shuffled.
BROADCAST_ROWS = 1 << 20


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def linked_rows(docs: DataFrame, id_col: str, text_col: str, least: float, width: int, missed: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node of every row; node, rows, low, root of every node). low is its first row by id, nulls last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    lanes, most = plan(least, missed)
    made = pin(with_fingerprints(texts, width, lanes))
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    nodes = pin(made.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), low.alias("low"), F.min("n").alias("n"), F.first("prints").alias("prints")))
    met = meetings(nodes.select("node", "prints"), lanes, most, tile).join(nodes.select("node", "n", "prints"), "node")
    held = merged(pin(sharpened(met, lanes, most_bits(least, 64 * lanes))))
    wanted = pin(nodes.join(held.select("node").distinct(), "node", "left_semi").select("low.text_key"))
    roots = components(links(held, sets_of(texts, wanted, width), least, tile))
    of = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return made.select("doc_id", "text_key", "node"), of.select("node", "rows", "low", F.coalesce("root", "node").alias("root"))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, missed: float = 0.00005, tile: int = 2048
) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest id that is linked, directly or through others, at Jaccard similarity ``least`` or more)."""
    made, of = linked_rows(docs, id_col, text_col, least, width, missed, tile)
    smallest = of.groupBy("root").agg(F.min("low").alias("first"))
    linked = pin(of.join(smallest, "root").select("node", F.col("first.doc_id").alias("component_id")))
    return made.select("doc_id", "node").join(linked, "node").select("doc_id", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, missed: float = 0.00005, tile: int = 2048
) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that with the smallest id (null ids last), of repeated rows one.

    The rows to drop, by id and text, are broadcast while there are at most ``BROADCAST_ROWS``; more of them are joined.
    """
    made, of = linked_rows(docs, id_col, text_col, least, width, missed, tile)
    crowds = of.groupBy("root").agg(F.min("low").alias("first"), F.sum("rows").alias("all")).filter("all > 1")
    crowded = made.join(of.join(crowds, "root").select("node", "first"), "node").groupBy("doc_id", "text_key").agg(
        F.min("first").alias("first"), F.count(F.lit(1)).alias("n"),
    )
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    id_, key_ = unused(docs, "_id"), unused(docs, "_key")
    judged = pin(crowded.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), "n", stays.alias("stays")))
    found = judged.groupBy((F.col("stays") & (F.col("n") > 1)).alias("again"), "stays").agg(F.count(F.lit(1)).alias("n")).collect()
    gone, again = judged.filter("not stays").select(id_, key_), judged.filter("stays and n > 1").select(id_, key_)
    n_gone, n_again = sum(r["n"] for r in found if not r["stays"]), sum(r["n"] for r in found if r["again"])
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def same(of: DataFrame):
        return F.col(id_col).cast("long").eqNullSafe(of[id_]) & (key == of[key_])

    def sent(of: DataFrame, n: int) -> DataFrame:
        return F.broadcast(of) if n <= BROADCAST_ROWS else of

    kept = docs.join(sent(gone, n_gone), same(gone), "left_anti") if n_gone else docs
    if not n_again:
        return kept
    several = kept.join(sent(again, n_again), same(again), "left_semi").withColumn(key_, key).dropDuplicates([id_col, key_]).drop(key_)
    return kept.join(sent(again, n_again), same(again), "left_anti").unionByName(several)
