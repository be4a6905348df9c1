"""BM25, vector and hybrid search.

A postings table (term, id, label, tf, dl) is built once and kept, cut into buckets by term, with its statistics beside it (``keep_index``); a query reads the
files of its terms alone. ``text_index`` is the same without a folder, for frames at hand; ``scan`` finds the postings of one query and keeps nothing. Scores are summed with a
map-side partial aggregation and end in a top-k that keeps k rows per task. Vector search is exact: distances are computed in the scan, top-k as before; ``cells`` limits the
scan to the nearest clusters of a clustered table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators.lookup import NODE_SUMMARY_FIELDS, VECTOR_SUMMARY_FIELDS, summary
from loamgraph.session import SMALL, discard, keep, settle, swept
from loamgraph.sources.store import VersionedTable

#: Usual BM25 constants.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    word, out = "", []
    for c in text.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            out.append(word)
            word = ""
    return sorted(set(out))


@dataclass
class TextIndex:
    postings: DataFrame  # term, id, label, tf, dl
    documents: int
    average: float

    def hits(self, terms: list[str]) -> DataFrame:
        return self.postings.filter(F.col("term").isin(terms))


@dataclass
class KeptIndex:
    table: VersionedTable
    documents: int
    average: float
    stamp: str | None  # of what it was built from

    @property
    def postings(self) -> DataFrame:
        return self.table.read()

    def hits(self, terms: list[str]) -> DataFrame:
        return self.table.read_of(terms)


def build_postings(docs: DataFrame, text_col: str = "text", id_col: str = "id", label_col: str | None = None) -> DataFrame:
    """Documents without words have no postings. One shuffle, by (id, term) with partial sums; the length rides along."""
    label = F.col(label_col) if label_col else F.lit(None).cast("string")
    split = docs.select(F.col(id_col).alias("id"), label.alias("label"), tokens(F.col(text_col)).alias("words"))
    words = split.select("id", "label", F.size("words").alias("dl"), F.explode("words").alias("term"))
    return words.groupBy("term", "id", "label", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "id", "label", "tf", "dl")


def text_index(docs: DataFrame, text_col: str = "text", id_col: str = "id", label_col: str | None = None) -> TextIndex:
    """The number and mean length of all documents come from one narrow pass."""
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("a")).first()
    return TextIndex(build_postings(docs, text_col, id_col, label_col), stats["n"], stats["a"] or 0.0)


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """h (a hash of the id), dl, and of documents with one of the ``terms`` id, label and tf (by term)."""
    cut, times = docs.select("id", "label", tokens(F.col("text")).alias("_words")), lambda t: F.size(F.filter("_words", lambda w: w == t))
    each = cut.select("id", "label", F.size("_words").alias("dl"), F.array(*map(times, terms)).alias("tf"))
    hit = F.exists("tf", lambda n: n > 0)
    return each.select(F.xxhash64("id").alias("h"), "dl", *[F.when(hit, F.col(c)).alias(c) for c in ("id", "label", "tf")])


@contextmanager
def scan(docs: DataFrame, query: str) -> Iterator[TextIndex]:
    """An index of the query's terms alone, by a pass over the documents (id, label, text), for as long as the block lasts. As in a segmented index, of rows that share an id the one
    with the largest text counts and rows without an id are left out; only texts whose ids' hashes meet are brought together for that."""
    spark, terms = docs.sparkSession, query_terms(query)
    if not terms:
        yield TextIndex(spark.createDataFrame([], "term string, id string, label string, tf long, dl int"), 0, 0.0)
        return
    docs = docs.filter("id is not null").select("id", F.col("label").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    rows, at = keep(counted(docs, terms))
    folders = [at]
    try:
        with swept(spark):
            again, n = settle(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"))
        if n:
            again = F.broadcast(again) if n <= SMALL else again
            one = docs.withColumn("h", F.xxhash64("id")).join(again, "h", "left_semi").groupBy("id").agg(F.max(F.struct("text", "label")).alias("d"))
            more, at = keep(counted(one.select("id", "d.*"), terms))
            folders.append(at)
            rows = rows.join(again, "h", "left_anti").unionByName(more)
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
        named = F.map_from_arrays(F.array(*map(F.lit, terms)), F.col("tf"))
        hits = rows.filter("id is not null").select("id", "label", "dl", F.explode(named).alias("term", "tf")).filter("tf > 0")
        yield TextIndex(hits.select("term", "id", "label", F.col("tf").cast("long").alias("tf"), "dl"), sums["n"], (sums["words"] or 0) / sums["n"] if sums["n"] else 0.0)
    finally:
        for folder in folders:
            discard(spark, folder)


def keep_index(
    docs: DataFrame, root: str, text_col: str = "text", id_col: str = "id", label_col: str | None = None, buckets: int = 32, stamp: str | None = None,
) -> KeptIndex:
    """Write the index below ``root``, or write it anew. Texts are cut into words once: the mean length follows from the postings."""
    spark = docs.sparkSession
    table = VersionedTable(spark, f"{root}/postings", ["term", "id"], buckets, by=["term"])
    table.replace(build_postings(docs, text_col, id_col, label_col))
    n, words = docs.count(), table.read().agg(F.sum("tf")).first()[0] or 0
    stats = [(n, words / n if n else 0.0, table.version(), stamp)]
    VersionedTable(spark, f"{root}/statistics").replace(spark.createDataFrame(stats, "documents long, average double, version long, stamp string"))
    return open_index(spark, root, buckets)


def open_index(spark: SparkSession, root: str, buckets: int = 32) -> KeptIndex | None:
    """The index below ``root``; none if it was never finished or its postings have changed since."""
    stats = VersionedTable(spark, f"{root}/statistics")
    table = VersionedTable(spark, f"{root}/postings", ["term", "id"], buckets, by=["term"])
    row = stats.read().first() if stats.exists() else None
    if row is None or row["version"] != table.version():
        return None
    return KeptIndex(table, row["documents"], row["average"], row["stamp"])


def bm25_scores(index: TextIndex | KeptIndex, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """id, label, score of every document with a query term."""
    terms = query_terms(query)
    hits = index.hits(terms)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.average or 1.0))
    scored = hits.join(F.broadcast(df), "term").select("id", "label", (idf * F.col("tf") * (k1 + 1) / norm).alias("s"))  # df has one row per query term
    return scored.groupBy("id", "label").agg(F.sum("s").alias("score"))


def bm25(index: TextIndex | KeptIndex, query: str, limit: int, label: str | None = None, post_filter: bool = False) -> DataFrame:
    """The best ``limit`` documents: id, label, score; ties by id. ``post_filter``: the label is looked at after the cut. A segmented index skips blocks."""
    if hasattr(index, "search"):
        return index.search(query, limit, label, post_filter)
    scores = bm25_scores(index, query)
    if not query_terms(query):
        return scores.limit(0)
    if label and not post_filter:
        scores = scores.filter(F.col("label") == label)
    top = scores.orderBy(F.desc("score"), "id").limit(max(1, limit))
    return top.filter(F.col("label") == label) if label and post_filter else top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def distance(column: Column, query: list[float], metric: str = "cosine") -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        length = sum(float(x) ** 2 for x in query) ** 0.5
        return 1 - F.try_divide(dot(column, q), F.sqrt(dot(column, column)) * F.lit(length))  # a zero vector has no distance
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(column, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x))
    raise ValueError(f"no such metric: {metric}")


def similarity(column: Column, query: list[float], metric: str = "cosine") -> Column:
    """1 / (1 + distance); a vector without a distance is as near as one can be."""
    return 1 / (1 + F.coalesce(distance(column, query, metric), F.lit(0.0)))


def knn(
    vectors: DataFrame, query: list[float], limit: int, label: str | None = None, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding",
) -> DataFrame:
    """The nearest vectors: id, label, distance, similarity = 1 / (1 + distance); ties by id. Vectors that are null or empty, or of another size, are no candidates."""
    has_label = "label" in vectors.columns
    base = vectors.filter(F.size(vector_col) == len(query)) if query else vectors.limit(0)
    if label and has_label:
        base = base.filter(F.col("label") == label)
    d = F.coalesce(distance(F.col(vector_col), query, metric), F.lit(0.0)) if query else F.lit(0.0)
    out = base.select(F.col(id_col).alias("id"), (F.col("label") if has_label else F.lit(None)).cast("string").alias("label"), d.alias("distance"))
    return out.orderBy("distance", "id").limit(max(1, limit)).withColumn("similarity", 1 / (1 + F.col("distance")))


def cluster_vectors(
    vectors: DataFrame, cells: int, vector_col: str = "embedding", sample: int = 10_000, rounds: int = 8, seed: int = 3,
) -> tuple[DataFrame, list[list[float]]]:
    """(vectors with column cell, centres). Centres are fitted on ``sample`` rows at most; every row gets its nearest centre."""
    import numpy as np

    n = vectors.count()
    picked = vectors.select(vector_col).sample(False, min(1.0, 1.2 * sample / max(1, n)), seed).limit(sample).collect()
    x = np.array([r[0] for r in picked if r[0]], dtype=np.float64)
    if not len(x):
        return vectors.withColumn("cell", F.lit(0)), []
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            if (own == k).any():
                c = x[own == k].mean(axis=0)
                centres[k] = c / max(np.linalg.norm(c), 1e-12)
    listed = [c.tolist() for c in centres]
    near = F.array(*[F.struct(distance(F.col(vector_col), c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(listed)])
    return vectors.withColumn("cell", F.array_min(near)["k"]), listed


def knn_in_cells(clustered: DataFrame, centres: list[list[float]], query: list[float], limit: int, probes: int = 4, **options) -> DataFrame:
    """Approximate: only the ``probes`` cells nearest to the query are read (a table partitioned by cell reads nothing else)."""
    import numpy as np

    q = np.array(query) / max(np.linalg.norm(query), 1e-12)
    best = np.argsort(-(np.array(centres) @ q))[:probes].tolist()
    return knn(clustered.filter(F.col("cell").isin(best)), query, limit, **options)


def hybrid(
    index: TextIndex | KeptIndex, vectors: DataFrame, query: str, vector: list[float], alpha: float = 0.5, limit: int = 20, label: str | None = None,
    overfetch: int = 2, metric: str = "cosine",
) -> DataFrame:
    """id, label, score = alpha * bm25 + (1 - alpha) * similarity over the two best lists of ``overfetch * limit``; ties by id."""
    a = min(1.0, max(0.0, alpha))
    text = bm25(index, query, overfetch * max(1, limit), label).groupBy("id", "label").agg(F.max("score").alias("bm25")).select(
        "id", "label", "bm25", F.lit(None).cast("double").alias("similarity"),
    )
    near = knn(vectors, vector, overfetch * max(1, limit), label, metric).select("id", "label", F.lit(None).cast("double").alias("bm25"), "similarity")
    label_of = F.coalesce(F.max(F.when(F.col("bm25").isNotNull(), F.col("label"))), F.max("label"))
    both = text.unionByName(near).groupBy("id").agg(label_of.alias("label"), F.max("bm25").alias("bm25"), F.max("similarity").alias("similarity"))
    score = a * F.coalesce("bm25", F.lit(0.0)) + (1 - a) * F.coalesce("similarity", F.lit(0.0))
    return both.withColumn("score", score).orderBy(F.desc("score"), "id").limit(max(1, limit)).select("id", "label", "score")


def hybrid_multi(
    index: TextIndex | KeptIndex | None, vectors: DataFrame, types: list[str], query: str, vector: list[float], alpha: float = 0.5, limit: int = 20,
    overfetch: int = 2, metric: str = "cosine",
) -> DataFrame:
    """``hybrid`` for each type at once (best lists by a window per type), then the best over all types. No ``index``: by vectors alone. ``vectors`` may have their similarity
    instead of their embedding."""
    a, n = min(1.0, max(0.0, alpha)), max(1, limit)

    def best(df: DataFrame, score: str) -> DataFrame:
        w = Window.partitionBy("label").orderBy(F.desc(score), "id")  # Spark keeps the first rows per task before the shuffle
        return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= overfetch * n).drop("_n")

    typed = vectors.filter(F.col("label").isin(types))
    if "similarity" not in typed.columns:
        typed = typed.filter(F.size("embedding") == len(vector)).withColumn("similarity", similarity(F.col("embedding"), vector, metric))
    near = best(typed.select("id", "label", "similarity"), "similarity").select("id", "label", F.lit(None).cast("double").alias("bm25"), "similarity")
    if index is not None:
        text = best(bm25_scores(index, query).filter(F.col("label").isin(types)), "score")
        near = near.unionByName(text.select("id", "label", F.col("score").alias("bm25"), F.lit(None).cast("double").alias("similarity")))
    both = near.groupBy("label", "id").agg(F.max("bm25").alias("bm25"), F.max("similarity").alias("similarity"))
    scored = both.withColumn("score", a * F.coalesce("bm25", F.lit(0.0)) + (1 - a) * F.coalesce("similarity", F.lit(0.0)))
    per_type = Window.partitionBy("label").orderBy(F.desc("score"), "id")
    cut = scored.withColumn("_n", F.row_number().over(per_type)).filter(F.col("_n") <= n)
    return cut.orderBy(F.desc("score"), "id").limit(n).select("id", "label", "score")


def with_summaries(hits: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Hits with a summary of their node or vector (properties as JSON text); hits that have vanished are left out."""
    parts = [nodes.select("id", summary(F.col("properties"), NODE_SUMMARY_FIELDS).alias("summary"))]
    if vectors is not None:
        parts.append(vectors.select("id", summary(F.col("properties"), VECTOR_SUMMARY_FIELDS).alias("summary")))
    known = reduce(lambda a, b: a.unionByName(b), parts)
    return known.join(F.broadcast(hits), "id").orderBy(F.desc("score"), "id")  # hits are a top-k
