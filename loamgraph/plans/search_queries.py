"""Group D: BM25, vector and hybrid search over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.operators import search
from loamgraph.operators.ngrams import NgramIndex
from loamgraph.operators.segments import SegmentedIndex
from loamgraph.operators.vector_index import VectorIndex
from loamgraph.plans.registry import query
from loamgraph.session import scratch, table

TEXT_QUERY = "the licensed work"
QUERY = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
QUERY_SQL = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"

POSTINGS = r"""
WITH words AS (SELECT doc_id AS id, lang AS label, w AS term FROM documents, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS t(w) WHERE w <> ''),
lens AS (SELECT id, count(*) AS dl FROM words GROUP BY id),
post AS (SELECT term, id, label, count(*) AS tf FROM words GROUP BY ALL),
stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM lens) / (SELECT count(*) FROM documents) AS avgdl)"""
BM25 = POSTINGS + """,
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scores AS (SELECT id, label, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
           FROM post JOIN df USING (term) JOIN lens USING (id), stats WHERE term IN ('the', 'licensed', 'work') GROUP BY id, label)"""
NEAR = f""",
near AS (SELECT vec_id AS id, label::VARCHAR AS label, 1 - list_dot_product(embedding::DOUBLE[], {QUERY_SQL}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({QUERY_SQL}, {QUERY_SQL}))) AS distance FROM embeddings)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text")


_INDEXES: dict[tuple[str, str, str], search.KeptIndex] = {}


def kept_index(spark: SparkSession, sf: str, ids: str = "long") -> search.KeptIndex:
    """The documents' index, written once for all searches of the session; ``ids``: their type, which decides how ties are ordered."""
    key = (spark.sparkContext.applicationId, sf, ids)
    if key not in _INDEXES:
        docs = documents(spark, sf).withColumn("id", F.col("id").cast(ids))
        _INDEXES[key] = search.keep_index(docs, scratch(spark, "text-index"), label_col="label")
    return _INDEXES[key]


def edited_index(spark: SparkSession, sf: str) -> SegmentedIndex:
    """Built in three commits: other texts first, then the documents' own in parts, some deleted, some of those added again. Segments are merged on the way."""
    index, docs = SegmentedIndex(spark, scratch(spark, "segments"), "long", buckets=4, fan=2), documents(spark, sf)
    index.upsert(docs.filter("id % 4 <> 1").withColumn("text", F.concat(F.lit("the licensed draft "), F.coalesce("text", F.lit("")))), label_col="label")
    index.update(docs.filter("id % 2 = 1 or id % 4 = 0"), docs.filter("id % 10 = 3").select("id"), label_col="label")
    index.update(docs.filter("id % 4 = 2 or id % 20 = 3"), docs.filter("id % 10 in (3, 7)").select("id"), label_col="label")
    return index


LEFT = "id % 10 <> 7 AND (id % 10 <> 3 OR id % 20 = 3)"


@query(
    "segmented_postings",
    POSTINGS + f" SELECT term, id, label, tf, dl::INT AS dl FROM post JOIN lens USING (id) WHERE {LEFT}",
)
def segmented_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The postings after upserts and deletes are those of an index built anew."""
    return edited_index(spark, sf).postings.select("term", "id", "label", "tf", "dl")


@query(
    "blockmax_topk",
    BM25.replace("FROM documents,", f"FROM (SELECT * FROM documents WHERE {LEFT.replace('id %', 'doc_id %')}) AS documents,")
    .replace("(SELECT count(*) FROM documents)", f"(SELECT count(*) FROM documents WHERE {LEFT.replace('id %', 'doc_id %')})")
    + " SELECT id, label, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, id LIMIT 20",
)
def blockmax_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of an edited index, without the blocks that can't hold any."""
    return rounded(edited_index(spark, sf).search(TEXT_QUERY, 20), "score")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), "embedding")


@query("bm25_postings", POSTINGS + " SELECT term, id, label, tf, dl::INT AS dl FROM post JOIN lens USING (id)")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return search.build_postings(documents(spark, sf), label_col="label")


@query("bm25_topk", BM25 + " SELECT id, label, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, id LIMIT 20")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.bm25(kept_index(spark, sf), TEXT_QUERY, 20), "score")


@query("bm25_by_label", BM25 + " SELECT id, label, round(score, 6) AS score FROM scores WHERE label = 'de' ORDER BY scores.score DESC, id LIMIT 10")
def bm25_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.bm25(kept_index(spark, sf), TEXT_QUERY, 10, label="de"), "score")


@query("bm25_post_filter", BM25 + " SELECT * FROM (SELECT id, label, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, id LIMIT 50) WHERE label = 'en'")
def bm25_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.bm25(kept_index(spark, sf), TEXT_QUERY, 50, label="en", post_filter=True), "score")


@query(
    "knn_cosine",
    "WITH x AS (SELECT 1)" + NEAR + " SELECT id, label, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM near ORDER BY near.distance, id LIMIT 15",
)
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.knn(vectors(spark, sf), QUERY, 15), "distance", "similarity")


@query(
    "knn_l2",
    f"SELECT vec_id AS id, label::VARCHAR AS label, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM (SELECT *, list_distance(embedding::DOUBLE[], {QUERY_SQL}) AS d FROM embeddings) WHERE label = 3 ORDER BY d, id LIMIT 15",
)
def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.knn(vectors(spark, sf), QUERY, 15, label="3", metric="l2"), "distance", "similarity")


@query(
    "knn_then_source",
    "WITH x AS (SELECT 1)" + NEAR + ", top AS (SELECT * FROM near ORDER BY distance, id LIMIT 30) SELECT DISTINCT n_nationkey, n_name FROM top JOIN embeddings ON vec_id = id JOIN nation ON n_nationkey = embeddings.label",
)
def knn_then_source(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors, then what they belong to (label = nation key stands in for the edge)."""
    hits = search.knn(vectors(spark, sf), QUERY, 30)
    owners = hits.select(F.col("label").cast("int").alias("n_nationkey")).distinct()
    return table(spark, sf, "nation").select("n_nationkey", "n_name").join(F.broadcast(owners), "n_nationkey", "left_semi")


#: Vectors under the ids of documents, so that the two lists meet: of every fourth document of the same number.
MET = """, met AS (SELECT CASE WHEN id % 4 = 0 THEN id::VARCHAR ELSE 'v' || id END AS id, label, 1 / (1 + distance) AS similarity FROM near)"""


def meeting_vectors(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("id").cast("string")
    return vectors(spark, sf).withColumn("id", F.when(F.col("id") % 4 == 0, number).otherwise(F.concat(F.lit("v"), number)))


TEXT_IDS = BM25.replace("doc_id AS id", "doc_id::VARCHAR AS id")


@query(
    "hybrid_fusion",
    TEXT_IDS + NEAR + MET + """, t AS (SELECT id, label, score FROM scores ORDER BY score DESC, id LIMIT 600), v AS (SELECT * FROM met ORDER BY similarity DESC, id LIMIT 600)
    SELECT coalesce(t.id, v.id) AS id, coalesce(t.label, v.label) AS label, round(0.25 * coalesce(score, 0) + 0.75 * coalesce(similarity, 0), 6) AS score FROM t FULL JOIN v ON t.id = v.id
    ORDER BY 0.25 * coalesce(t.score, 0) + 0.75 * coalesce(v.similarity, 0) DESC, 1 LIMIT 300""",
)
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(search.hybrid(kept_index(spark, sf, "string"), meeting_vectors(spark, sf), TEXT_QUERY, QUERY, 0.25, 300), "score")


@query(
    "hybrid_multi",
    TEXT_IDS + NEAR + MET + """, named AS (SELECT id, CASE WHEN label IN ('1', '2', '3', '4', '5') THEN 'en' ELSE 'fr' END AS label, similarity FROM met),
    t AS (SELECT id, label, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM scores WHERE label IN ('en', 'fr')),
    v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS r FROM named),
    f AS (SELECT coalesce(t.id, v.id) AS id, coalesce(t.label, v.label) AS label, 0.5 * coalesce(score, 0) + 0.5 * coalesce(similarity, 0) AS score FROM (SELECT * FROM t WHERE r <= 400) t FULL JOIN (SELECT * FROM v WHERE r <= 400) v ON t.id = v.id AND t.label = v.label),
    c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM f)
    SELECT id, label, round(score, 6) AS score FROM c WHERE r <= 200 ORDER BY c.score DESC, id LIMIT 200""",
)
def hybrid_multi(spark: SparkSession, sf: str) -> DataFrame:
    vecs = meeting_vectors(spark, sf).withColumn("label", F.when(F.col("label").isin("1", "2", "3", "4", "5"), "en").otherwise("fr"))
    return rounded(search.hybrid_multi(kept_index(spark, sf, "string"), vecs, ["en", "fr"], TEXT_QUERY, QUERY, 0.5, 200), "score")


@query("knn_clustered", "SELECT true AS recall_reached, 15::BIGINT AS hits")
def knn_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Recall against the exact neighbours, over the vectors whose id is divisible by 100 as queries: 0.9 at least."""
    v = vectors(spark, sf)
    clustered, centres = search.cluster_vectors(v, 16)
    clustered = clustered.cache()
    asked = [r["embedding"] for r in v.filter("id % 100 = 0").orderBy("id").limit(20).collect()]
    hit = 0
    for q in asked:
        near, exact = search.knn_in_cells(clustered, centres, q, 15, probes=12), search.knn(v, q, 15)
        hit += near.join(exact.select("id"), "id", "left_semi").count()
    found = search.knn_in_cells(clustered, centres, QUERY, 15, probes=12).count()
    return spark.createDataFrame([(hit >= 0.9 * 15 * len(asked), found)], "recall_reached boolean, hits long")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100, as a batch of queries."""
    return vectors(spark, sf).filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))


@query("knn_quantised")
def knn_quantised(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of each query by codes in a quarter of the cells, compared exactly at the end."""
    index = VectorIndex.build(vectors(spark, sf), scratch(spark, "vector-index"))
    return rounded(index.search(asked(spark, sf), 10), "distance")


@query(
    "knn_triangle",
    """WITH d AS (SELECT q.vec_id AS qid, v.vec_id AS id, 1 - list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])
      / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS distance
      FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
    SELECT qid, id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d.distance, id) <= 10""",
)
def knn_triangle(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of each query, exactly, without the cells that are too far away to hold any."""
    index = VectorIndex.build(vectors(spark, sf), scratch(spark, "vector-index"), copies=1)
    return rounded(index.search_exact(asked(spark, sf), 10).drop("rank"), "distance")


PATTERNS = ("Copyright", "s w", "ü")


@query(
    "ngram_search",
    " UNION ALL ".join(f"SELECT '{p}' AS pattern, doc_id::VARCHAR AS id FROM documents WHERE contains(lower(text), lower('{p}'))" for p in PATTERNS),
)
def ngram_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a pattern, by their trigrams; the last pattern is too short to have any."""
    index = NgramIndex(spark, scratch(spark, "ngrams"))
    index.upsert(table(spark, sf, "documents"), id_col="doc_id")
    parts = [index.contains(p).select(F.lit(p).alias("pattern"), "id") for p in PATTERNS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
