"""Groups A and H: the versioned store, vectors and rules, change replay and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.ids import node_id, uuid5_sql
from loamgraph.operators.ingest import resolve_vectors, rule_edges
from loamgraph.plans.registry import query
from loamgraph.schema import EDGE_COLUMNS, REGISTRY, Category, EntitySpec, VectorRule, parse_columns
from loamgraph import session
from loamgraph.session import table
from loamgraph.sources.store import VersionedTable, last_wins
from loamgraph.streaming import replay


def scratch(spark: SparkSession, name: str, keys: list[str] | None = None, buckets: int = 4) -> VersionedTable:
    return VersionedTable(spark, session.scratch(spark, name), keys, buckets)


def changed_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Half the orders, then a third with another status; some are in both."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))


UPSERTED = """SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"""


@query("upsert_last_wins", UPSERTED)
def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    t = scratch(spark, "upsert", ["o_orderkey"])
    first, second = changed_orders(spark, sf)
    t.write(first)
    t.write(second)
    return t.read()


@query(
    "upsert_null_keys",
    "SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey END, 'new' FROM orders",
)
def upsert_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Null keys match nothing: old and new rows both stay."""
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k"), F.col("o_orderstatus").alias("v"))
    t = scratch(spark, "nullkeys", ["k"])
    t.write(o)
    t.write(o.withColumn("v", F.lit("new")))
    return t.read()


@query("upsert_in_batch_dups", "SELECT n_regionkey AS k, n_name AS v FROM nation")
def upsert_in_batch_dups(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of one batch that share a key all stay."""
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("v"))
    t = scratch(spark, "dups", ["k"])
    t.write(rows.withColumn("v", F.lit("old")).distinct())
    t.write(rows)
    return t.read()


@query("append_panel", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def append_panel(spark: SparkSession, sf: str) -> DataFrame:
    t = scratch(spark, "panel")
    rows = table(spark, sf, "region").select("r_regionkey", "r_name")
    t.write(rows)
    t.write(rows)
    return t.read()


@query("changes_since", f"SELECT 0 AS _version, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, * FROM ({UPSERTED})")
def changes_since(spark: SparkSession, sf: str) -> DataFrame:
    t = VersionedTable(spark, session.scratch(spark, "changes"), ["o_orderkey"], merge=False)
    for rows in changed_orders(spark, sf):
        t.write(rows)
    return t.changes(-1).withColumn("_version", F.col("_version").cast("int"))


@query(
    "net_changes",
    "SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'update' ELSE 'insert' END AS _change FROM orders WHERE o_orderkey % 3 = 0 AND NOT (o_orderkey % 2 = 0 AND o_orderstatus = 'X')",
)
def net_changes(spark: SparkSession, sf: str) -> DataFrame:
    t = scratch(spark, "net", ["o_orderkey"])
    for rows in changed_orders(spark, sf):
        t.write(rows)
    return t.net_changes(0)


@query("delete_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 AND o_totalprice <= 200000")
def delete_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = scratch(spark, "delete", ["o_orderkey"])
    t.write(changed_orders(spark, sf)[0])
    t.delete(F.col("o_totalprice") > 200000)
    return t.read()


@query("cdc_replay_state", "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def cdc_replay_state(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of events, each the last of its users, upserted in order."""
    e = table(spark, sf, "events")
    cuts = e.select(F.min(F.unix_timestamp("ts")).alias("a"), F.max(F.unix_timestamp("ts")).alias("b")).first()
    step = (cuts["b"] - cuts["a"]) // 3 + 1
    t = scratch(spark, "cdc", ["user_id"])
    for k in range(3):
        part = e.filter(F.unix_timestamp("ts").between(cuts["a"] + k * step, cuts["a"] + (k + 1) * step - 1))
        t.write(last_wins(part, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value", "event_id"))
    return t.read()


def vector_spec() -> EntitySpec:
    return REGISTRY.entity("issuedoc")


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as issue documents; every tenth id comes twice."""
    v = table(spark, sf, "embeddings")
    one = v.select(
        F.lit(None).cast("string").alias("id"), F.concat(
            F.lit("https://p/"), F.col("label").cast("string"),
        ).alias("project_url"), F.col("vec_id").alias("issue_number"), "embedding",
        F.concat(F.lit("doc://"), F.col("vec_id").cast("string")).alias("embedding_id"),
    )
    return one.unionByName(one.filter("issue_number % 10 = 0"))


VECTOR_ID = uuid5_sql("'vector|issuedoc|doc://' || vec_id")


@query("vector_dedup_index", f"SELECT 'doc://' || vec_id AS embedding_id, {VECTOR_ID} AS vector_uuid FROM embeddings WHERE vec_id % 2 = 1")
def vector_dedup_index(spark: SparkSession, sf: str) -> DataFrame:
    """New index rows when the even ids are known already."""
    rows = vector_rows(spark, sf)
    known = rows.filter("issue_number % 2 = 0").select("embedding_id", F.lit("known").alias("vector_uuid")).distinct()
    return resolve_vectors(rows, vector_spec(), known)[1]


@query(
    "vector_rule_edges",
    f"""WITH v AS (SELECT {VECTOR_ID} AS vid, {uuid5_sql("'project|url=https://p/' || label")} AS p, {uuid5_sql("'issue|project_url=https://p/' || label || '|number=' || vec_id")} AS i FROM embeddings)
    SELECT {uuid5_sql("'edge_containscontent|' || p || '|' || vid")} AS id, p AS from_node_id, vid AS to_node_id, 'project' AS from_node_type, 'issuedoc' AS to_node_type FROM v
    UNION ALL SELECT {uuid5_sql("'edge_documents|' || i || '|' || vid")}, i, vid, 'issue', 'issuedoc' FROM v""",
)
def vector_rule_edges(spark: SparkSession, sf: str) -> DataFrame:
    resolved, _ = resolve_vectors(vector_rows(spark, sf), vector_spec(), None)
    made = rule_edges(resolved, vector_spec(), REGISTRY.vector_rules("issuedoc"))
    return made["edge_containscontent"].unionByName(made["edge_documents"]).drop("created_at", "updated_at")


@query(
    "vector_source_edges",
    f"SELECT {uuid5_sql("'part|p_partkey=' || (vec_id + 1)")} AS from_node_id, {uuid5_sql("'vector|codechunk|c' || vec_id")} AS to_node_id, 'part' AS from_node_type FROM embeddings",
)
def vector_source_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Rule edges whose source id is a column and whose type is a key's prefix."""
    spec = REGISTRY.entity("codechunk")
    v = table(spark, sf, "embeddings").select(
        F.lit(None).cast("string").alias("id"), "embedding", F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("embedding_id"),
        node_id("part", [("p_partkey", F.col("vec_id") + 1)]).alias("source_node_id"), F.lit("part::x::y::z").alias("source_node_key"),
    )
    resolved, _ = resolve_vectors(v, spec, None)
    rules = [VectorRule("codechunk", "edge_embeds", id_column="source_node_id", type_column="source_node_key")]
    return rule_edges(resolved, spec, rules)["edge_embeds"].select("from_node_id", "to_node_id", "from_node_type")


@query("edge_upsert", "SELECT 'e' || n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN 'new' ELSE 'a' || n_regionkey END AS from_node_id FROM nation")
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same edge id with other ends replaces the edge."""
    schema, keys = parse_columns(EDGE_COLUMNS)
    spec = EntitySpec("edge_x", Category.EDGE, "silver/edges/x", schema, keys)
    n = table(spark, sf, "nation")
    now = F.current_timestamp()
    row = lambda source: [
        F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("id"), source.alias("from_node_id"), F.lit("t").alias("to_node_id"),
        F.lit("a").alias("from_node_type"), F.lit("b").alias("to_node_type"), now.alias("created_at"), now.alias("updated_at"),
    ]
    t = scratch(spark, "edges", list(spec.keys))
    t.write(n.select(*row(F.concat(F.lit("a"), F.col("n_regionkey").cast("string")))))
    t.write(n.filter("n_nationkey < 5").select(*row(F.lit("new"))))
    return t.read().select("id", "from_node_id")


# -- streams


@query("stream_upsert_replay", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a file stream, each batch reduced to its users' last event and upserted; the checkpoint is the offset."""
    target = scratch(spark, "stream", ["user_id"])
    source = replay.file_stream(spark, sf, "events").select("user_id", "event_id")
    reduce_batch = lambda df: df.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    replay.upsert_stream(source, target, session.scratch(spark, "stream-checkpoint"), reduce_batch)
    return target.read()


@query(
    "tumbling_event_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def tumbling_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = replay.windowed_counts(table(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "sliding_event_counts",
    """WITH e AS (SELECT ts::TIMESTAMP AS ts FROM events), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start FROM e, range(0, 4) AS r(k))
    SELECT window_start, count(*) AS n FROM w GROUP BY 1""",
)
def sliding_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = replay.windowed_counts(table(spark, sf, "events"), "ts", "24 hours", [], None, slide="6 hours")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "session_counts",
    """WITH e AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS t FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS k FROM b) SELECT user_id, min(t)::BIGINT AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = replay.session_counts(table(spark, sf, "events"), "ts", "2 hours", ["user_id"])
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), "n")


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows over a stream; complete output written batch by batch."""
    target = scratch(spark, "windows", ["window_start", "event_type"])
    source = replay.file_stream(spark, sf, "events")
    counts = replay.windowed_counts(source, "ts", "1 day", ["event_type"], None)
    replay.upsert_stream(counts, target, session.scratch(spark, "stream-checkpoint"), lambda df: df, mode="complete")
    return target.read().select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("keyed_stream_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def keyed_stream_state(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and sums kept per user while the events stream by; the last of each user's states."""
    target = scratch(spark, "states", ["user_id"])
    totals = replay.running_totals(replay.file_stream(spark, sf, "events"), "user_id", "value")
    replay.upsert_stream(totals, target, session.scratch(spark, "stream-checkpoint"), lambda df: df, mode="update")
    return target.read().select("user_id", "n", F.round("total", 4).alias("total"))
