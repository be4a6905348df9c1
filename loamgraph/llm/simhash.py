"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified links, components.

Fingerprints are made where the rows are. Equal fingerprints fold into one row first (map-side), so copies never meet
again. Two fingerprints at ``max_bits`` or fewer differing bits agree on at least ``n_blocks - max_bits`` of ``n_blocks``
blocks; every choice of that many blocks is one key, and fingerprints that share a key are compared. Keys held by one
fingerprint are dropped. A key held by more than ``tile`` fingerprints is cut into tiles, and each pair of tiles is a task
group of its own, so no group is larger than two tiles and every pair is still compared. A group emits a spanning forest
of its verified links, never all pairs. Forests are joined into components by repeated minimum-label contraction with reliable
checkpoints.

Defined results: null text is empty text; texts without words have fingerprint zero and link like any other; fewer words than a
shingle give one shingle; rows that repeat an id share one component; a null id keeps its fingerprint and takes its
component's smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.llm.words import mix
from loamgraph.operators.graph import contract
from loamgraph.session import pin

SEED = 42


def fingerprints(text: str | None, width: int = 3, n: int = 1) -> list[int]:
    """``n`` fingerprints of 64 bits; bit i is set if over half the shingles' hashes have it.

    The first uses the shingles' XXH64; the others use the same hashes mixed with a number each.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return [0] * n
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    out = []
    for k in range(n):
        own = hashes if k == 0 else mix(hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), 1 << 16):
            bits = np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > len(own), bitorder="little").view("<u8")[0]))
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, n: int) -> DataFrame:
    """doc_id and the fingerprints as signed longs fp0, fp1, ..."""
    names = [f"fp{k}" for k in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprints(t, width, n) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(made[:, k], pa.int64()) for k in range(n))], names=["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{c} long" for c in names)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def block_masks(n_blocks: int, agree: int) -> list[int]:
    edges = [round(64 * i / n_blocks) for i in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links among these rows of fingerprints. Each row reached is compared with the rows not yet reached only."""
    left, src, dst, queue = np.arange(len(prints)), [], [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, prints_left = left[1:], prints[left[1:]]
            continue
        i = queue.pop()
        near = np.bitwise_count(prints_left ^ prints[i]).sum(axis=1) <= limit
        if near.any():
            hit = left[near]
            src.append(np.full(len(hit), i))
            dst.append(hit)
            queue += hit.tolist()
            left, prints_left = left[~near], prints_left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *src]), np.concatenate([none, *dst])


def links(classes: DataFrame, lanes: list[str], limit: int, agree: int, n_blocks: int, tile: int) -> DataFrame:
    """``classes``: one row per node with its fingerprints in the columns ``lanes``. Nodes that agree on ``agree`` of ``n_blocks`` blocks of one
    lane are compared; those at ``limit`` or fewer differing bits over all lanes are linked. Links src, dst (nodes) that connect whatever links
    connect."""
    masks = block_masks(n_blocks, agree)
    keys = [F.xxhash64(F.lit(k), F.lit(i), F.col(c).bitwiseAND(F.lit(signed(m)))) for k, c in enumerate(lanes) for i, m in enumerate(masks)]
    keyed = classes.select("node", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = keyed.join(sizes, "key")
    carried = [c for c in lanes if c != "node"]
    if carried:  # fingerprints join only the keys that are shared
        held = held.join(classes.select("node", *carried), "node")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    dealt = (
        held.withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", *carried)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def emit(t: pa.Table, last: bool) -> tuple[pa.Table | None, pa.RecordBatch]:
            cols = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            node = t.column("node").to_numpy()
            prints = np.stack([t.column(c).to_numpy() for c in lanes], axis=1).view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
            ends = np.append(new[1:], len(node))
            if not last:
                new, ends, left = new[:-1], ends[:-1], t.slice(int(new[-1]))
            else:
                left = None
            src, dst = [], []
            small = ends - new == 2  # most groups
            a = new[small]
            near = np.bitwise_count(prints[a] ^ prints[a + 1]).sum(axis=1) <= limit
            src.append(node[a][near])
            dst.append(node[a + 1][near])
            for s, e in zip(new[~small], ends[~small], strict=True):
                i, j = forest(prints[s:e], limit)
                src.append(node[s:e][i])
                dst.append(node[s:e][j])
            made = [pa.array(np.concatenate(x), pa.int64()) for x in (src, dst)]
            return left, pa.RecordBatch.from_arrays(made, names=["src", "dst"])

        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
                rest, out = emit(rest, False)
                yield out
        if rest is not None and rest.num_rows:
            yield emit(rest, True)[1]

    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); root is the component's smallest node."""
    return contract(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    max_bits: int = 3,
    n_blocks: int = 5,
    tile: int = 2048,
    n_fingerprints: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits, the first), component_id.

    With several fingerprints a text has ``64 * n_fingerprints`` bits; texts that agree on the blocks of any one fingerprint are compared over all bits
    and linked at ``limit`` or fewer differing ones (default ``max_bits`` times ``n_fingerprints``). All pairs with ``max_bits`` or fewer in any
    one fingerprint are compared for certain, others the likelier the nearer they are.
    """
    made = pin(with_fingerprints(docs, id_col, text_col, width, n_fingerprints))
    names = [f"fp{k}" for k in range(n_fingerprints)]
    single = n_fingerprints == 1
    lanes = ["node"] if single else names
    # a class is all rows with the same fingerprints, never a hash of them
    classes = pin(made.groupBy(*names).agg(F.min("doc_id").alias("low")))
    classes = classes.withColumnRenamed("fp0", "node") if single else pin(classes.withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(classes, lanes, max_bits * n_fingerprints if limit is None else limit, n_blocks - max_bits, n_blocks, tile))
    keys = ["node"] if single else names
    of = classes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*keys, "low", F.coalesce("root", "node").alias("root"))
    smallest = of.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = pin(of.join(smallest, "root").select(*keys, "component_id"))
    out = made.withColumn("node", F.col("fp0")).join(linked, keys) if single else made.join(linked, keys)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
