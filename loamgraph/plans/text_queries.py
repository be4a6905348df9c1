"""Groups E and F: text analytics over documents and conversations, freshness over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions import text
from loamgraph.operators.ingest import freshness
from loamgraph.plans.registry import query
from loamgraph.session import table

LINES = r"string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n\z', ''), chr(10))"


@query(
    "line_chunks",
    f"""WITH l AS (SELECT doc_id, {LINES} AS x FROM documents WHERE text <> ''), c AS (SELECT doc_id, x, unnest(range(0, (len(x) - 1) // 3 + 1)) AS k FROM l)
    SELECT doc_id, k::INT AS chunk_order, (k * 3 + 1)::INT AS start_line, least(k * 3 + 3, len(x))::INT AS end_line, array_to_string(x[k * 3 + 1 : k * 3 + 3], chr(10)) AS chunk_text FROM c""",
)
def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = text.line_chunks(table(spark, sf, "documents").select("doc_id", "text"), size=3)
    return chunks.select("doc_id", "chunk_order", "start_line", "end_line", "chunk_text")


@query("token_counts", r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


NORMAL = r"lower(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(body_text, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '>')), ' '), '\s+', ' ', 'g')))"
#: Conversations as comment threads: turns are comments, roles decide associations and bots, numbers give reactions.
COMMENTS_SQL = """
comments AS (SELECT conv_id, conv_id * 100 + turn AS id, text AS body_text, CASE role WHEN 'assistant' THEN 'member' WHEN 'user' THEN 'CONTRIBUTOR' ELSE 'NONE' END AS assoc,
  turn AS created_at, (conv_id + turn) % 7 AS plus_one, turn % 3 AS confused, role = 'system' AS is_bot, CASE WHEN turn % 4 = 3 THEN 'review' ELSE 'issue' END AS kind FROM conversations)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    zero = F.lit(0)
    reactions = F.struct(
        ((F.col("conv_id") + F.col("turn")) % 7).alias("plus_one"), zero.alias("heart"), zero.alias("hooray"), zero.alias("eyes"), zero.alias("rocket"),
        (F.col("turn") % 3).alias("confused"),
    )
    association = F.when(F.col("role") == "assistant", "member").when(F.col("role") == "user", "CONTRIBUTOR").otherwise("NONE")
    return c.select(
        "conv_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("body_text"), association.alias("author_association"), F.col("turn").alias("created_at"), reactions.alias("reactions"),
        (F.col("role") == "system").alias("is_bot"), F.when(F.col("turn") % 4 == 3, "review").otherwise("issue").alias("kind"),
    )


SCORED_SQL = f"""WITH {COMMENTS_SQL},
kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, id) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS total FROM comments WHERE NOT is_bot AND trim(body_text) <> '' AND id <> 0),
norm AS (SELECT *, {NORMAL} AS n FROM kept),
uniq AS (SELECT * FROM norm WHERE n <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, n ORDER BY created_at, id) = 1),
scored AS (SELECT *, 0.45 * greatest(-1.0, least(1.0, ln(1 + plus_one) / ln(21.0) - 0.5 * ln(1 + confused) / ln(6.0)))
  + 0.2 * CASE upper(assoc) WHEN 'MEMBER' THEN 0.9 WHEN 'CONTRIBUTOR' THEN 0.7 WHEN 'NONE' THEN 0.5 ELSE 0.6 END
  + 0.15 * (CASE WHEN idx = 0 THEN 0.6 ELSE 0.3 END + CASE WHEN regexp_matches(lower(body_text), 'fix|fixed|resolve|resolved|workaround|duplicate') THEN 0.3 ELSE 0 END)
  + 0.1 * CASE WHEN total <= 1 THEN 1 ELSE idx / (total - 1) END
  + 0.1 * CASE WHEN strlen(n) <= 80 THEN strlen(n) / 80 WHEN strlen(n) >= 1200 THEN 1200 / strlen(n) ELSE 1 END AS score FROM uniq)"""


@query("comment_normalise", f"WITH {COMMENTS_SQL} SELECT id, {NORMAL} AS normalised FROM comments")
def comment_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return comments(spark, sf).select("id", text.normalise_comment(F.col("body_text")).alias("normalised"))


@query("comment_scores", SCORED_SQL + " SELECT conv_id, id, round(score, 6) AS score FROM scored")
def comment_scores(spark: SparkSession, sf: str) -> DataFrame:
    return text.score_comments(comments(spark, sf), ["conv_id"]).select("conv_id", "id", F.round("score", 6).alias("score"))


@query(
    "comment_selection",
    SCORED_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS r, sum((score >= 0.42)::INT) OVER (PARTITION BY conv_id) AS above FROM scored),
    chosen AS (SELECT *, r <= 4 AND (least(above, 4) < 3 OR score >= 0.42) AS c FROM ranked),
    rev AS (SELECT *, max((c AND kind = 'review')::INT) OVER (PARTITION BY conv_id) AS seen, min(CASE WHEN kind = 'review' THEN r END) OVER (PARTITION BY conv_id) AS best FROM chosen),
    sel AS (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS place FROM rev WHERE c OR (seen = 0 AND r = best))
    SELECT conv_id, id, place::INT AS place FROM sel WHERE place <= 4""",
)
def comment_selection(spark: SparkSession, sf: str) -> DataFrame:
    scored = text.score_comments(comments(spark, sf), ["conv_id"])
    return text.select_comments(scored, ["conv_id"], 4).select("conv_id", "id", "place")


SELECTED_SQL = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS r, sum((score >= 0.42)::INT) OVER (PARTITION BY conv_id) AS above FROM scored),
    chosen AS (SELECT *, r <= 8 AND (least(above, 8) < 3 OR score >= 0.42) AS c FROM ranked),
    rev AS (SELECT *, max((c AND kind = 'review')::INT) OVER (PARTITION BY conv_id) AS seen, min(CASE WHEN kind = 'review' THEN r END) OVER (PARTITION BY conv_id) AS best FROM chosen),
    sel AS (SELECT conv_id, id, body_text, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, id) AS place FROM rev WHERE c OR (seen = 0 AND r = best)),
    whole AS (SELECT conv_id, list(id ORDER BY place) AS comment_ids, list(body_text ORDER BY place) AS texts FROM sel WHERE place <= 8 GROUP BY conv_id)"""
#: One step of the digest: text x after what is done, within 4000 bytes.
DIGEST_STEP = """CASE WHEN strlen(done) >= 4000 THEN done WHEN strlen(x) > 4000 - strlen(done || CASE done WHEN '' THEN '' ELSE chr(10) || chr(10) END)
    THEN done || CASE done WHEN '' THEN '' ELSE chr(10) || chr(10) END || substr(x, 1, greatest(4000 - strlen(done || CASE done WHEN '' THEN '' ELSE chr(10) || chr(10) END), 0)) || '…'
    ELSE done || CASE done WHEN '' THEN '' ELSE chr(10) || chr(10) END || x END"""


@query(
    "comment_digests",
    SCORED_SQL + SELECTED_SQL + f" SELECT conv_id, comment_ids, nullif(list_reduce(list_prepend('', texts), lambda done, x: {DIGEST_STEP}), '') AS digest FROM whole",
)
def comment_digests(spark: SparkSession, sf: str) -> DataFrame:
    scored = text.score_comments(comments(spark, sf), ["conv_id"])
    return text.comment_digest(text.select_comments(scored, ["conv_id"]), ["conv_id"])


#: Documents hold no references; some are put in, around the whole text, and more than fifty after it.
REFERENCES = """'Fixes #' || (doc_id % 900 + 1) || ', see (#' || (doc_id % 17) || ') x#5 ' || text || ' related #12345678 and #' || (doc_id % 3) || '# ' || array_to_string(list_transform(range(0, 60), lambda i: '#' || (1000 + (i + doc_id * 3) % 70)), ' ')"""


def hexed(words: str) -> str:
    """A pattern of the words' bytes, as ``WINDOWS`` writes them."""
    return "|".join("".join(f"{b:02X} " for b in w.encode()) for w in words.split("|"))


#: Every ``#`` with digits, in what text it stands, and the 40 bytes before and after as pairs of hexadecimal digits.
WINDOWS = f"""b AS (SELECT doc_id, {REFERENCES} AS t FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, string_split(t, '#') AS x, unnest(range(2, len(string_split(t, '#')) + 1)) AS k FROM b),
    p AS (SELECT doc_id, array_to_string(x[1 : k - 1], '#') AS l, array_to_string(x[k :], '#') AS r, regexp_extract(x[k], '^[0-9]+') AS d FROM f),
    w AS (SELECT doc_id, length(l) AS position, d::BIGINT AS number, regexp_replace(right(hex(encode(lower(l))), 80), '(..)', '\\1 ', 'g') AS b, regexp_replace(substr(hex(encode(lower(r))), 2 * length(d) + 1, 80), '(..)', '\\1 ', 'g') AS a
      FROM p WHERE length(d) BETWEEN 1 AND 7 AND NOT regexp_matches(l, '[A-Za-z0-9/-]$')),
    c AS (SELECT *, CASE WHEN regexp_matches(a, '{hexed("close|fix|resolve")}') OR regexp_matches(b, '{hexed("close|fix|resolve")}') THEN 'closes' WHEN regexp_matches(a, '{hexed("duplicate")}') OR regexp_matches(b, '{hexed("duplicate")}') THEN 'duplicate'
      WHEN regexp_matches(a, '{hexed("ref|see|related")}') OR regexp_matches(b, '{hexed("ref|see|related")}') THEN 'references' ELSE 'mentions' END AS link_type FROM w),
    s AS (SELECT *, CASE link_type WHEN 'mentions' THEN 1 WHEN 'references' THEN 2 ELSE 3 END AS strength FROM c)"""


def with_references(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda i: F.concat(F.lit("#"), (1000 + (i + F.col("doc_id") * 3) % 70).cast("string"))
    body = F.concat(
        F.lit("Fixes #"), (F.col("doc_id") % 900 + 1).cast("string"), F.lit(", see (#"), (F.col("doc_id") % 17).cast("string"), F.lit(") x#5 "), F.col("text"),
        F.lit(" related #12345678 and #"), (F.col("doc_id") % 3).cast("string"), F.lit("# "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), number), " "),
    )
    return table(spark, sf, "documents").select("doc_id", body.alias("body"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return text.issue_links(with_references(spark, sf), F.col("body"), F.lit("own"), F.lit("repo"), F.lit("body"))


@query("issue_links", f"WITH {WINDOWS} SELECT doc_id, position, number FROM w")
def issue_links(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).select("doc_id", "position", "number")


@query("issue_link_classes", f"WITH {WINDOWS} SELECT doc_id, position, number, link_type FROM c")
def issue_link_classes(spark: SparkSession, sf: str) -> DataFrame:
    return links(spark, sf).select("doc_id", "position", "number", "link_type")


@query(
    "link_strength_dedup",
    f"""WITH {WINDOWS}, one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY strength DESC, position) = 1)
    SELECT doc_id, position, number, link_type, strength FROM one QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY strength DESC, position, number) <= 50""",
)
def link_strength_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest link of each number, the first on ties, and of each document the fifty strongest."""
    return text.strongest_links(links(spark, sf), ["doc_id"], ["title", "body"]).select("doc_id", "position", "number", "link_type", "strength")


@query(
    "cross_repository_links",
    "SELECT doc_id, doc_id AS number, CASE doc_id % 3 WHEN 0 THEN 'other' ELSE 'own' END AS ref_owner, CASE doc_id % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'repo' ELSE 'lib.x' END AS ref_repo, doc_id % 3 <> 1 AS cross_repo FROM documents WHERE text IS NOT NULL",
)
def cross_repository_links(spark: SparkSession, sf: str) -> DataFrame:
    """``owner/repo#n``, a plain ``#n`` and the own owner's other repository."""
    k = F.col("doc_id") % 3
    body = F.concat(
        F.lit("see ("), F.when(k == 0, "other/tool").when(k == 2, "own/lib.x").otherwise(""), F.lit("#"), F.col("doc_id").cast("string"), F.lit(") "),
        F.col("text"),
    )
    found = text.issue_links(
        table(spark, sf, "documents").select("doc_id", body.alias("body")), F.col("body"), F.lit("own"), F.lit("repo"), F.lit("body"), cross_repo=True,
    )
    return found.filter("position < 20").select("doc_id", "number", "ref_owner", "ref_repo", "cross_repo")


@query("bots", "SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS is_bot FROM customer")
def bots(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 3 == 0, "Bot").when(F.col("c_custkey") % 4 != 0, "User")
    login = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, "[BOT]").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", text.is_bot(kind, login).alias("is_bot"))


DOC = """'Issue #' || doc_id || ' in own/repo' || chr(10) || chr(10) || 'State: open' || chr(10) || chr(10) || 'Author: ' || source || CASE WHEN trim(text) <> '' THEN chr(10) || chr(10) || 'Body:' || chr(10) || text ELSE '' END"""


@query("doc_text_compose", f"SELECT doc_id, {DOC} AS document FROM documents")
def doc_text_compose(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").alias("number"), F.lit("open").alias("state"), F.col("source").alias("author_login"), none.alias("title"),
        F.col("text").alias("body"), none.alias("representative_digest_text"),
    )
    return d.select("doc_id", text.issue_document(F.lit("own/repo")).alias("document"))


@query(
    "optional_numbers",
    "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN NULL ELSE value END AS parsed FROM events",
)
def optional_numbers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 == 1, "null").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", text.optional_number(raw).alias("parsed"))


@query(
    "readiness_ttl_anchor",
    """WITH r AS (SELECT user_id, max(epoch(ts))::BIGINT AS last, CASE WHEN user_id % 2 = 0 THEN 86400 ELSE 3600 END AS ttl FROM events GROUP BY user_id),
    a AS (SELECT user_id, max(event_id) AS anchor FROM events GROUP BY user_id), m AS (SELECT max(epoch(ts))::BIGINT AS now FROM events)
    SELECT 'user/' || user_id AS entity_uri, CASE user_id % 5 WHEN 0 THEN NULL ELSE 'f' END AS fetcher,
      (now - last < ttl) AND CASE user_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN anchor % 2 = 0 WHEN 3 THEN user_id % 3 <> 0 ELSE true END AS is_fresh FROM r JOIN a USING (user_id), m""",
)
def readiness_ttl_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Users as entities: last event = last sync; remote anchors, probes and failures by the remainder of the user's number."""
    e = table(spark, sf, "events")
    by_user = e.groupBy("user_id").agg(F.max(F.unix_timestamp("ts")).alias("last_synced_at"), F.max("event_id").alias("anchor"))
    now = e.agg(F.max(F.unix_timestamp("ts")).alias("n")).first()["n"]
    kind, uri = F.col("user_id") % 5, F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    fetcher = F.when(kind != 0, "f")
    requests = by_user.select(uri.alias("entity_uri"), fetcher.alias("fetcher"))
    readiness = by_user.select(uri.alias("entity_uri"), "last_synced_at", F.when(F.col("user_id") % 2 == 0, 86400).otherwise(3600).alias("ttl_seconds"))
    anchors = by_user.select(uri.alias("entity_uri"), fetcher.alias("fetcher"), F.col("anchor").cast("string").alias("anchor_value"))
    remote = F.when(kind == 2, F.when(F.col("anchor") % 2 == 0, F.col("anchor")).otherwise(F.col("anchor") + 1).cast("string"))
    probes = by_user.select(
        uri.alias("entity_uri"), fetcher.alias("fetcher"), F.lit(True).alias("known"), (kind == 1).alias("failed"),
        F.when(kind == 3, F.col("user_id") % 3 != 0).alias("fresh"), remote.alias("remote_anchor"),
    )
    return freshness(requests, readiness, anchors, probes, now)
