"""A kept vector index: cells, residual codes, exact re-ranking; and an exact search that leaves out cells by the triangle inequality.

``build`` fits centres and codebooks on a bounded sample and then indexes every row. Vectors are scaled to length one. Each goes to the ``copies`` cells whose centres are nearest, as a code: the rest
after the centre is taken off, cut into ``PARTS`` pieces, each replaced by the number of the nearest of 256 codewords. Codes and vectors are two Parquet tables partitioned by cell
(vectors by their first), so a search opens the folders of its cells only.

A batch of queries of any size is taken in blocks of ``BLOCK`` (a bounded broadcast). ``search`` reads the codes in each query's nearest cells; the distance of a code is a sum of numbers looked
up in the query's table. Each task keeps its best candidates per query; the best of all are compared exactly. ``search_exact`` first searches each query's nearest cell, which bounds
its k-th distance, then reads the cells that may hold something nearer: those whose centre is no farther than that bound and the cell's radius together.

Distances are cosine distances, ties go to the smaller id. Vectors without a direction (zeros) have distance 0 to all, as in ``search.knn``: they are in a cell of their own that every query
reads. Vectors that are null or of another size are not indexed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators.search import dot
from loamgraph.session import pin
from loamgraph.sources.store import Files

#: Pieces of a code; queries sent to all tasks at a time; numbers of one distance matrix.
PARTS, BLOCK, ROOM = 16, 1024, 1 << 22
NOWHERE = -1  # the cell of zeros
CODES = "id {id}, cell int, home int, codes binary"


def units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class VectorIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        model = json.loads(Files(spark, root).read(f"{self.root}/model.json"))
        self.centres, self.words = np.array(model["centres"]), np.array(model["words"])  # cells x width; parts x codewords x piece
        self.width, self.id_type = self.centres.shape[1], model["id_type"]

    @property
    def cells(self) -> int:
        return len(self.centres)

    def table(self, name: str) -> DataFrame:
        schema = CODES if name == "codes" else "id {id}, home int, vector array<double>"
        return self.spark.read.schema(schema.format(id=self.id_type)).parquet(f"{self.root}/{name}")

    # -- building

    @staticmethod
    def build(vectors: DataFrame, root: str, cells: int = 64, copies: int = 3, sample: int = 20_000, rounds: int = 10, id_col: str = "id", vector_col: str = "embedding", seed: int = 3) -> VectorIndex:
        spark, root = vectors.sparkSession, root.rstrip("/")
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.size("vector") > 0)
        first = rows.first()
        width = len(first["vector"]) if first else PARTS
        rows = rows.filter((F.size("vector") == width) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        picked = rows.orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(sample).select("vector").collect()
        x = units(np.array([r["vector"] for r in picked], np.float64).reshape(-1, width))
        x = x[np.abs(x).sum(axis=1) > 0]
        x = x if len(x) else np.eye(1, width)
        rng = np.random.default_rng(seed)
        centres = k_means(x, min(cells, len(x)), rounds, rng)
        rest, piece = x - centres[nearest(x, centres)], -(-width // PARTS)
        rest = np.pad(rest, ((0, 0), (0, piece * PARTS - width)))
        words = np.stack([k_means(rest[:, p * piece : (p + 1) * piece], min(256, len(rest)), rounds, rng) for p in range(PARTS)])
        id_type = rows.schema["id"].dataType.simpleString()
        model = {"centres": centres.tolist(), "words": words.tolist(), "id_type": id_type}
        coded = rows.mapInArrow(coder(centres, words, copies), CODES.format(id=id_type) + ", vector array<double>")
        homes = f"{root}/vectors"
        coded.filter("cell = home").select("id", "vector", "home").write.mode("overwrite").partitionBy("home").parquet(homes)
        coded.drop("vector").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/codes")
        Files(spark, root).put(f"{root}/model.json", json.dumps(model))
        return VectorIndex(spark, root)

    # -- searching

    def _blocks(self, queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        """(ids, vectors) of the queries, ``BLOCK`` at a time."""
        held = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).filter(F.size("vector") == self.width)
        ids, rows = [], []
        for r in held.toLocalIterator():
            ids.append(r["qid"])
            rows.append(r["vector"])
            if len(ids) == BLOCK:
                yield ids, units(np.array(rows))
                ids, rows = [], []
        if ids:
            yield ids, units(np.array(rows))

    def _candidates(self, name: str, ids: list, q: np.ndarray, wanted: np.ndarray, keep: int) -> DataFrame:
        """qid, id, home of the best ``keep`` per query and task; ``wanted``: queries x cells."""
        spark, cell = self.spark, "cell" if name == "codes" else "home"
        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        own = self.table(name).filter(F.col(cell).isin([NOWHERE, *cells]))
        shared = spark.sparkContext.broadcast((q, wanted, self.centres, self.words if name == "codes" else None))
        found = own.select("id", F.col(cell).alias("cell"), "home", "codes" if name == "codes" else "vector").mapInArrow(scanner(shared, keep), f"q int, id {self.id_type}, home int, far double")
        best = Window.partitionBy("q").orderBy("far", "id")
        top = found.groupBy("q", "id").agg(F.min("home").alias("home"), F.min("far").alias("far")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= keep)
        named = spark.createDataFrame([(k, i, v.tolist()) for k, (i, v) in enumerate(zip(ids, q, strict=True))], f"q int, qid {self.id_type}, qv array<double>")
        return top.join(F.broadcast(named), "q").select("qid", "qv", "id", "home")

    def _ranked(self, candidates: DataFrame, k: int) -> DataFrame:
        """Compared exactly: qid, id, distance. Only the folders that the candidates come from are opened."""
        homes = [r["home"] for r in candidates.select("home").distinct().collect()]  # cells
        vectors = self.table("vectors").filter(F.col("home").isin(homes)) if homes else self.table("vectors").limit(0)
        v, q = F.col("vector"), F.col("qv")
        far = F.coalesce(1 - F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))), F.lit(0.0))
        exact = candidates.join(vectors, ["home", "id"]).select("qid", "id", far.alias("distance"))
        return exact.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, refine: int = 10) -> DataFrame:
        """``queries``: qid, vector. Approximate: qid, id, distance, rank; a quarter of the cells is read for each query unless ``probes`` says otherwise."""
        probes, out = max(1, self.cells // 4) if probes is None else probes, None
        for ids, q in self._blocks(queries):
            near = np.argsort(((self.centres**2).sum(axis=1) - 2 * q @ self.centres.T), axis=1)[:, :probes]
            wanted = np.zeros((len(q), self.cells), bool)
            np.put_along_axis(wanted, near, True, axis=1)
            part = self._ranked(pin(self._candidates("codes", ids, q, wanted, refine * k)), k)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self._none()

    def search_exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The same, exactly."""
        radii, out = self._radii(), None
        for ids, q in self._blocks(queries):
            apart = np.sqrt(np.maximum(((q[:, None, :] - self.centres[None]) ** 2).sum(axis=2), 0))
            first = np.zeros(apart.shape, bool)
            np.put_along_axis(first, np.argsort(apart, axis=1)[:, : max(1, self.cells // 8)], True, axis=1)
            reached = {r["qid"]: (r["n"], r["far"]) for r in self._ranked(pin(self._candidates("vectors", ids, q, first, k)), k).groupBy("qid").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
            # of unit vectors the squared distance is twice the cosine distance
            bound = np.array([np.sqrt(2 * max(0.0, reached[i][1])) if i in reached and reached[i][0] >= k else np.inf for i in ids])
            part = self._ranked(pin(self._candidates("vectors", ids, q, apart - radii[None] <= bound[:, None] + 1e-9, 2 * k)), k)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self._none()

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"qid {self.id_type}, id {self.id_type}, distance double, rank int")

    def _radii(self) -> np.ndarray:
        """Of each cell the distance of its farthest vector from the centre."""
        centres, out = self.centres, np.full(self.cells, -np.inf)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, cell = units(matrix(b.column("vector"), centres.shape[1])), b.column("home").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(np.sqrt(((x - centres[cell]) ** 2).sum(axis=1)))], ["home", "r"])

        far = self.table("vectors").filter(F.col("home") != NOWHERE).select("vector", "home").mapInArrow(run, "home int, r double")
        for r in far.groupBy("home").agg(F.max("r").alias("r")).collect():
            out[r["home"]] = r["r"]
        return out


def coder(centres: np.ndarray, words: np.ndarray, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, piece = centres.shape[1], words.shape[2]
        for b in batches:
            raw = matrix(b.column("vector"), width)
            x, some = units(raw), np.abs(raw).sum(axis=1) > 0
            near = np.argsort((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1, kind="stable")[:, :copies].astype(np.int32)
            home = np.where(some, near[:, 0], NOWHERE).astype(np.int32)
            for c in range(near.shape[1]):
                at = np.flatnonzero(some | (c == 0))  # zeros are in their one cell
                cell = np.where(some[at], near[at, c], NOWHERE).astype(np.int32)
                rest = np.pad(x[at] - centres[cell], ((0, 0), (0, piece * PARTS - width)))
                codes = np.stack([nearest(rest[:, p * piece : (p + 1) * piece], words[p]) for p in range(PARTS)], axis=1).astype(np.uint8)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pick), pa.array(cell), pa.array(home[at]), pa.array([r.tobytes() for r in codes], pa.binary()), b.column("vector").take(pick)],
                    ["id", "cell", "home", "codes", "vector"],
                )

    return run


def scanner(shared, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, wanted, centres, words = shared.value
        best: list[list] = [[] for _ in q]  # by query, arrays of (far, id, home), cut to ``keep`` now and then
        held = np.zeros(len(q), np.int64)

        def cut(k: int) -> None:
            far, ids, home = (np.concatenate(x) for x in zip(*best[k], strict=True))
            order = np.lexsort((ids, far))[:keep]
            best[k], held[k] = [(far[order], ids[order], home[order])], len(order)

        if words is not None:
            pieces = np.pad(q, ((0, 0), (0, words.shape[2] * PARTS - q.shape[1]))).reshape(len(q), PARTS, -1)
            looked_up = np.einsum("qpd,pwd->pqw", pieces, words)
        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            cell, ids, home = b.column("cell").to_numpy(), b.column("id").to_numpy(zero_copy_only=False), b.column("home").to_numpy()
            for c in np.unique(cell):
                mine = np.flatnonzero(wanted[:, c] if c != NOWHERE else np.ones(len(q), bool))
                rows_of = np.flatnonzero(cell == c)
                for a in range(0, len(rows_of), max(1, ROOM // max(1, len(mine)))):
                    at = rows_of[a : a + max(1, ROOM // max(1, len(mine)))]
                    if c == NOWHERE:
                        far = np.zeros((len(mine), len(at)))
                    elif words is None:
                        far = 1 - q[mine] @ units(matrix(b.column("vector").take(pa.array(at)), q.shape[1])).T
                    else:
                        codes = np.frombuffer(b"".join(b.column("codes").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), PARTS)
                        far = 1 - (q[mine] @ centres[c])[:, None] - sum(looked_up[p][mine][:, codes[:, p]] for p in range(PARTS))
                    for k, row in zip(mine, far, strict=True):
                        few = np.flatnonzero(row <= np.partition(row, keep - 1)[keep - 1]) if len(row) > keep else np.arange(len(row))
                        best[k].append((row[few], ids[at[few]], home[at[few]]))
                        held[k] += len(few)
                        if held[k] > 4 * keep:
                            cut(k)
        for k in range(len(q)):
            if best[k]:
                cut(k)
                far, ids, home = best[k][0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), k, np.int32)), pa.array(ids, kind), pa.array(home, pa.int32()), pa.array(far)], ["q", "id", "home", "far"])

    return run
