"""Centroid clustering in exact integers by kd-tree filtering.

Vectors are turned into integers once. Each task builds kd-trees over its own rows, of at most ``tree_rows`` vectors each, and writes them to the shared folder: the vectors in leaf
order and, for every node, its count, integer sums and bounding box. A round sends the centroids (``k`` vectors) to all tasks. In every tree, level by level, a node keeps those of its parent's centroids
that no other strictly dominates: for the one nearest to the middle of the box, another is farther at every point of the box if it is so at the box's corner that favours it most. A node with one
centroid left is assigned whole, by its count and sums; so is a box of a single point, however many copies it holds. Vectors of other leaves are compared with the centroids left to them.

A task adds up its trees and sends ``k`` rows of sums, so a round shuffles no vectors. All is done in integers (in doubles where every intermediate value is below 2^53, so they are exact
too), ties go to the smaller number, and a dominated centroid is farther, never equal; results are those of comparing every vector with every centroid.

Defined results: vectors of another width, null ones, and those with a null or non-finite component are left out; rows that repeat an id are clustered each, and of
them the start takes those with the smallest components; with fewer vectors than centroids every vector starts one; rows without an id start no centroid unless there are too few others;
components are held at +-2^26 after scaling, so that squared distances fit a long; sums beyond a long are held at its end; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.session import scratch

#: Largest component; 64 squared differences of such fit a long.
LIMIT = 1 << 26
LONG = (1 << 63) - 1
#: Components below this leave every intermediate value below 2^53.
EXACT_IN_DOUBLES = 1 << 21
LEAF_ROWS = 32


def quantise(values: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(values.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def usable(vector: Column, width: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


# -- trees


def grow(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """A kd-tree: ``order`` of the points, and by node (children after parents) ``first``, ``last`` (points), ``left`` (0: a leaf; its sibling follows), ``low``, ``high``, ``sums``.

    A node is cut at the median of its widest side; equal values stay together, so points that are all equal are a leaf, however many.
    """
    order = np.arange(len(points))
    first, last, left, low, high = [0], [len(points)], [0], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        own = points[order[a:b]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        low.append(lo)
        high.append(hi)
        side = int((hi - lo).argmax())
        if hi[side] > lo[side] and b - a > leaf_rows:
            along = own[:, side]
            below = along <= np.partition(along, (b - a - 1) // 2)[(b - a - 1) // 2]
            if below.all():
                below = along < hi[side]
            order[a:b] = np.concatenate([order[a:b][below], order[a:b][~below]])
            middle = a + int(below.sum())
            left[at] = len(first)
            first += [a, middle]
            last += [middle, b]
            left += [0, 0]
        at += 1
    first, last = np.array(first), np.array(last)
    upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[order], axis=0)])
    return {"order": order, "first": first, "last": last, "left": np.array(left), "low": np.array(low), "high": np.array(high), "sums": upto[last] - upto[first]}


class Filter:
    """Centroids, and what is needed to tell which of them a box can do without."""

    def __init__(self, centroids: np.ndarray, bound: int):
        kind = np.float64 if max(bound, int(np.abs(centroids).max(initial=0))) < EXACT_IN_DOUBLES else np.int64
        self.centroids = c = centroids.astype(kind)
        self.squares = (c * c).sum(axis=1)
        self.apart = np.abs(c[:, None, :] - c[None, :, :])  # star, other, component

    def split(self, tree: dict[str, np.ndarray]) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """([(node assigned whole, its centroid)], [(leaf, mask of the centroids left)])."""
        whole, open_leaves = [], []
        nodes, masks = np.array([0]), np.ones((1, len(self.centroids)), bool)
        while len(nodes):
            lo, hi = tree["low"][nodes].astype(self.squares.dtype), tree["high"][nodes].astype(self.squares.dtype)
            # twice the distance to the middle, less what all have; then, with the nearest, how much farther each other is where the box favours it most
            middle = (lo + hi) @ self.centroids.T
            far = self.squares - middle
            star = np.where(masks, far, np.inf if far.dtype.kind == "f" else LONG).argmin(axis=1)
            rows = np.arange(len(nodes))
            reach = np.matmul(self.apart[star], (hi - lo)[:, :, None])[:, :, 0]
            least = (self.squares - self.squares[star][:, None]) - (middle - middle[rows, star][:, None]) - reach
            masks = masks & (least <= 0)
            alone = masks.sum(axis=1) == 1
            point = (lo == hi).all(axis=1)
            nearest = masks.argmax(axis=1)  # of a single point all centroids left are equally near
            done = alone | point
            whole += zip(nodes[done].tolist(), nearest[done].tolist(), strict=True)
            is_leaf = tree["left"][nodes] == 0
            for k in np.flatnonzero(~done & is_leaf):
                open_leaves.append((int(nodes[k]), masks[k]))
            inner = ~done & ~is_leaf
            children = tree["left"][nodes[inner]]
            nodes, masks = np.concatenate([children, children + 1]), np.concatenate([masks[inner], masks[inner]])
        return whole, open_leaves

    def nearest(self, points: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Per point the nearest of its centroids, the smaller number on ties."""
        far = self.squares - 2 * (points.astype(self.squares.dtype) @ self.centroids.T)
        return np.where(masks, far, np.inf if far.dtype.kind == "f" else LONG).argmin(axis=1)


def leaf_rows_of(tree: dict[str, np.ndarray], open_leaves: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(places of the points of these leaves, the mask of each)."""
    sizes = [tree["last"][n] - tree["first"][n] for n, _ in open_leaves]
    at = np.concatenate([np.arange(tree["first"][n], tree["last"][n]) for n, _ in open_leaves])
    return at, np.repeat(np.array([m for _, m in open_leaves]), sizes, axis=0)


def add_up(f: Filter, tree: dict[str, np.ndarray], counts: np.ndarray, sums: np.ndarray) -> None:
    whole, open_leaves = f.split(tree)
    for node, c in whole:
        counts[c] += tree["last"][node] - tree["first"][node]
        sums[c] += tree["sums"][node]
    if open_leaves:
        at, masks = leaf_rows_of(tree, open_leaves)
        found = f.nearest(tree["points"][at], masks)
        counts += np.bincount(found, minlength=len(counts))
        np.add.at(sums, found, tree["points"][at])


def assign(f: Filter, tree: dict[str, np.ndarray]) -> np.ndarray:
    """The centroid of each point, in leaf order."""
    whole, open_leaves = f.split(tree)
    out = np.empty(len(tree["points"]), np.int64)
    for node, c in whole:
        out[tree["first"][node] : tree["last"][node]] = c
    if open_leaves:
        at, masks = leaf_rows_of(tree, open_leaves)
        out[at] = f.nearest(tree["points"][at], masks)
    return out


# -- trees as rows

PARTS = ("points", "first", "last", "left", "low", "high", "sums")
TREE_SCHEMA = "ids array<long>, bound long, " + ", ".join(f"{p} binary" for p in PARTS)
TREE_ARROW = pa.schema([("ids", pa.list_(pa.int64())), ("bound", pa.int64()), *[(p, pa.binary()) for p in PARTS]])
STORED = {"points": np.int32, "first": np.int32, "last": np.int32, "left": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64}
WIDE = ("points", "low", "high", "sums")


def planter(width: int, scale: int, tree_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, tree_rows):
                part = batch.slice(a, tree_rows)
                vectors = part.column("vector")
                points = quantise(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale)
                tree = grow(points)
                order = tree.pop("order")
                row = {"ids": [part.column("id").take(pa.array(order)).to_pylist()], "bound": [int(np.abs(points).max())]}
                row |= {p: [(points[order] if p == "points" else tree[p]).astype(STORED[p]).tobytes()] for p in PARTS}
                yield pa.RecordBatch.from_pydict(row, schema=TREE_ARROW)

    return plant


def trees_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, int, dict[str, np.ndarray]]]:
    """(ids, largest component, tree) of each row."""
    for k in range(batch.num_rows):
        tree = {p: np.frombuffer(batch.column(p)[k].as_buffer(), STORED[p]).reshape((-1, width) if p in WIDE else -1) for p in PARTS}
        yield batch.column("ids")[k].values, batch.column("bound")[k].as_py(), tree


def plant_trees(vectors: DataFrame, width: int, scale: int, tree_rows: int) -> DataFrame:
    """``vectors``: id, vector. The trees, written by the tasks that hold the rows, and read again a file or less at a time."""
    path = f"{scratch(vectors.sparkSession, 'kd-trees')}/trees"
    vectors.mapInArrow(planter(width, scale, tree_rows), TREE_SCHEMA).write.option("maxRecordsPerFile", TREES_PER_FILE).parquet(path)
    return vectors.sparkSession.read.parquet(path)


#: A tree of 4,096 vectors is some 1.5 MB; what a Python worker is handed at a time is a file at most.
TREES_PER_FILE = 32


def adder(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, bound, tree in trees_of(batch, width):
                add_up(Filter(centroids, bound), tree, counts, sums)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def labeller(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bound, tree in trees_of(batch, centroids.shape[1]):
                found = assign(Filter(centroids, bound), tree)
                apart = tree["points"].astype(np.int64) - centroids[found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array((apart * apart).sum(axis=1))], ["id", "cluster", "distance"])

    return run


# -- rounds


def starts(vectors: DataFrame, k: int, width: int, scale: int, order: Column) -> np.ndarray:
    first = vectors.orderBy(order.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return quantise(np.array([r["vector"] for r in first], np.float64).reshape(-1, width), scale)


def step(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid becomes the floor of its vectors' mean; one without vectors stays."""
    k, width = centroids.shape
    parts = trees.mapInArrow(adder(centroids), "cluster long, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(width)]
    return out


def cluster(
    table: DataFrame,
    k: int = 40,
    rounds: int = 5,
    width: int = 64,
    scale: int = 256,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tree_rows: int = 4096,
) -> DataFrame:
    """One row per vector that is kept: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors whose id's digest (sha256 of ``seed:id``) is smallest.
    """
    kept = table.filter(usable(F.col(vector_col), width)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    centroids = starts(kept, k, width, scale, order)
    schema = "id long, cluster long, distance long"
    if not len(centroids):
        rows = table.sparkSession.createDataFrame([], schema)
    else:
        trees = plant_trees(kept, width, scale, tree_rows)
        for _ in range(rounds):
            after = step(trees, centroids)
            if (after == centroids).all():
                break  # nothing changes any more
            centroids = after
        path = f"{scratch(table.sparkSession, 'kd-trees')}/labels"
        trees.mapInArrow(labeller(centroids), schema).write.parquet(path)
        rows = table.sparkSession.read.parquet(path)
    held = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()  # k rows at most
    inertia, total = {r["cluster"]: min(int(r["n"]), LONG) for r in held}, min(sum(int(r["n"]) for r in held), LONG)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = table.sparkSession.createDataFrame([(c, inertia[c], digests[c]) for c in sorted(inertia)], "cluster long, cluster_inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256"
    )
