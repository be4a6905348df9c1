"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loamgraph.llm import chat, clustering, decontamination, html_text, language_id, merkle, mixing, packing, quality, simhash, toxicity
from loamgraph.llm import exact_dedup as dedup
from loamgraph.llm import url_filter as urls
from loamgraph.session import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: Tokens in a training sequence.
SEQUENCE_TOKENS = 2048


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), SEQUENCE_TOKENS)


#: (host, path, action)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def remainder(n: int):
    """Of the id's checksum; a null id has -1, so it is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), learn_from=remainder(5) != 0)
    return judged(quality.score(docs, model), remainder(5) == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    _, scored = toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"), learn_from=remainder(4) != 2)
    return judged(scored, remainder(4) == 2)


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, learn_from=remainder(4) != 2)
    return language_id.identify(docs, model).withColumn("held_out", remainder(4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


#: A conversation whose texts are made of the template's own control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(tricky)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Centroids and rounds.
CENTROIDS, ROUNDS = 40, 5


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = {"text": F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OPERATORS = (
    op1_exact_dedup, op2_html_extraction, op3_quality, op4_toxicity, op5_language_id, op6_best_fit_packing, op7_url_filter, op8_simhash, op9_chat_format,
    op10_decontamination, op11_centroid_clustering, op12_source_mix, op13_merkle_manifest,
)

QUERIES = {f.__name__: f for f in OPERATORS}

def clusters_sql() -> str:
    """Every vector against every centroid, ``ROUNDS`` times and once more. Coordinates as rows."""
    parts = [
        f"""c{k} AS MATERIALIZED (
          SELECT c.cluster, c.j, CASE WHEN s.n IS NULL THEN c.x ELSE (s.x - ((s.x % s.n) + s.n) % s.n) // s.n END AS x
          FROM c{k - 1} c LEFT JOIN (SELECT cluster, j, sum(v.x)::HUGEINT AS x, count(*)::HUGEINT AS n FROM a{k - 1} a JOIN v USING (id) GROUP BY cluster, j) s
               ON s.cluster = c.cluster AND s.j = c.j)"""
        for k in range(1, ROUNDS + 1)
    ]
    found = [
        f"""a{k} AS MATERIALIZED (
          SELECT id, cluster, distance FROM (SELECT id, cluster, sum((v.x - c.x) * (v.x - c.x)) AS distance FROM v JOIN c{k} c USING (j) GROUP BY id, cluster)
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"""
        for k in range(ROUNDS + 1)
    ]
    steps = ", ".join(x for pair in zip(found, [*parts, ""], strict=True) for x in pair if x)
    return f"""
        WITH e AS MATERIALIZED (
          SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        v AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS j, floor(256 * unnest(embedding)::DOUBLE)::HUGEINT AS x FROM e),
        f AS (SELECT id, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS cluster FROM e),
        c0 AS MATERIALIZED (SELECT cluster, j, x FROM f JOIN v USING (id) WHERE cluster < {CENTROIDS}),
        {steps},
        h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
        SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{ROUNDS} JOIN e USING (id) JOIN h USING (cluster)"""


#: Rounds of sharing that the SQL has; each but the last caps a source.
SHARING = 24


def mix_sql() -> str:
    """Shares in ``SHARING`` rounds, then the rows of a source by hash, as long as the middle of a row is below what is left to take."""
    above = "l * w > 3 * size * width"
    levels = ["l0 AS MATERIALIZED (SELECT sum(size)::HUGEINT AS l, sum(w)::HUGEINT AS width FROM s)"] + [
        f"l{k} AS MATERIALIZED (SELECT (sum(size) - sum(CASE WHEN {above} THEN 3 * size ELSE 0 END))::HUGEINT AS l, sum(CASE WHEN {above} THEN 0 ELSE w END)::HUGEINT AS width"
        f" FROM s, l{k - 1})"
        for k in range(1, SHARING)
    ]
    return rf"""
        WITH d AS MATERIALIZED (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
          FROM documents),
        s AS MATERIALIZED (
          SELECT source, sum(size)::HUGEINT AS size, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::HUGEINT AS w FROM d GROUP BY source),
        {", ".join(levels)},
        t AS (SELECT source, size, CASE WHEN {above} THEN (3 * size)::DOUBLE ELSE (l * w)::DOUBLE / width::DOUBLE END AS target FROM s, l{SHARING - 1}),
        r AS (SELECT *, CASE WHEN size > 0 THEN floor(target / size::DOUBLE) ELSE 0 END AS rounds FROM t),
        p AS (
          SELECT doc_id, d.size, r.size::BIGINT AS source_size, target, rounds, target - rounds * r.size::DOUBLE AS rest,
                 sum(d.size) OVER (PARTITION BY d.source ORDER BY h) - d.size AS before
          FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN rest > 0 AND before + size / 2 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM p"""


def merkle_sql(levels: int = 12) -> str:
    """Trees of up to ``levels`` levels, one join of all nodes with their parents per level; DuckDB has no CRC, so its steps are folded over bytes and bits."""
    code = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(code.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(t: str) -> str:
        """From {t}0 (g, pos, h, n: nodes of the tree) the levels {t}1, ...; a level whose tree is done repeats its node."""
        return ", ".join(
            f"""{t}{k} AS MATERIALIZED (
              SELECT g, pos // 3 AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
                     (any_value(n) + 2) // 3 AS n, any_value(n) > 1 AS made
              FROM {t}{k - 1} GROUP BY g, pos // 3)"""
            for k in range(1, levels + 1)
        )

    def path(t: str, out: str, start: str, carried: str) -> str:
        """Level by level: proof so far and folded digest of every row of ``start`` (g, pos, proof, fold, ...)."""
        return ", ".join(
            f"""{out}{k} AS MATERIALIZED (
              SELECT {", ".join(f"any_value(a.{c}) AS {c}" for c in carried.split())}, a.id AS id, any_value(a.g) AS g, any_value(a.pos) // 3 AS pos,
                     any_value(a.proof) || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos <> a.pos), '') AS proof,
                     CASE WHEN any_value(p.made) THEN sha256(string_agg(CASE WHEN s.pos = a.pos THEN a.fold ELSE s.h END, '' ORDER BY s.pos)) ELSE any_value(a.fold) END AS fold
              FROM {start if k == 1 else f"{out}{k - 1}"} a JOIN {t}{k} p ON p.g = a.g AND p.pos = a.pos // 3 JOIN {t}{k - 1} s ON s.g = a.g AND s.pos // 3 = a.pos // 3
              GROUP BY a.id)"""
            for k in range(1, levels + 1)
        )

    return f"""
        WITH crc AS (
          SELECT doc_id AS crc_id, list_reduce(
                   list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END) AS state
          FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
        d AS MATERIALIZED (
          SELECT row_number() OVER () AS id, doc_id, coalesce('s' || source, 'n') AS g, {leaf("text")} AS h,
                 {leaf("(CASE WHEN xor(state, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS fold
          FROM documents LEFT JOIN crc ON doc_id = crc_id),
        e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, '' AS proof FROM d),
        a0 AS MATERIALIZED (SELECT g, pos, h, n FROM e),
        {tree("a")},
        b0 AS MATERIALIZED (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS n, g AS source FROM a{levels}),
        {tree("b")},
        {path("a", "p", "e", "doc_id h")},
        q0 AS MATERIALIZED (SELECT p{levels}.id, doc_id, p{levels}.h, b0.h AS subroot, 'all' AS g, b0.pos, proof, fold FROM p{levels} JOIN b0 ON p{levels}.g = b0.source),
        {path("b", "q", "q0", "doc_id h subroot")}
        SELECT doc_id, q.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.h AS verified
        FROM q{levels} q CROSS JOIN b{levels} r"""


ORACLES = {
    "op11_centroid_clustering": clusters_sql(),
    "op13_merkle_manifest": merkle_sql(),
    "op12_source_mix": mix_sql(),
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op7_url_filter": r"""
        WITH p AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
          FROM pages),
        r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        hits AS (
          SELECT page_id, rhost || rpath AS rule, action,
                 row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
          FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
        SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
        FROM p LEFT JOIN hits ON p.page_id = hits.page_id AND k = 1""",
    "op9_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        g AS (
          SELECT conv_id, count(*) AS n_turns,
                 string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                 coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
                 sum(length(role) + length(text) + 24
                     + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|')))::BIGINT AS formatted_chars
          FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
        FROM g""",
}
