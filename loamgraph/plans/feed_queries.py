"""Group H, continued: deletion vectors, change feeds, change streams, file statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph import session
from loamgraph.plans.registry import query
from loamgraph.session import table
from loamgraph.sources.store import VersionedTable
from loamgraph.streaming.change_source import follow


def kept(spark: SparkSession, name: str, keys: list[str], **options) -> VersionedTable:
    return VersionedTable(spark, session.scratch(spark, name), keys, **options)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def written_orders(spark: SparkSession, sf: str, **options) -> VersionedTable:
    """All orders; every hundredth with another status, some new; every hundredth deleted."""
    t = kept(spark, "marked-orders", ["o_orderkey"], **options)
    o = orders(spark, sf)
    t.write(o)
    other = o.filter("o_orderkey % 100 = 1").withColumn("o_orderstatus", F.lit("X"))
    t.write(other.unionByName(other.withColumn("o_orderkey", -F.col("o_orderkey"))))
    t.delete(F.col("o_orderkey") % 100 == 2)
    return t


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
CHANGED = "SELECT o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 100 = 1"
ADDED = "SELECT -o_orderkey, o_custkey, 'X', o_totalprice FROM orders WHERE o_orderkey % 100 = 1"


@query("deletion_vectors", f"SELECT {ORDER} FROM orders WHERE o_orderkey % 100 NOT IN (1, 2) UNION ALL {CHANGED} UNION ALL {ADDED}")
def deletion_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """An upsert and a delete that mark old rows and write none of them again."""
    return written_orders(spark, sf).read()


@query("compacted_rows", f"SELECT {ORDER} FROM orders WHERE o_orderkey % 100 NOT IN (1, 2) UNION ALL {CHANGED} UNION ALL {ADDED}")
def compacted_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = written_orders(spark, sf, buckets=4)
    t.compact()
    return t.read()


@query(
    "row_change_feed",
    f"""SELECT {ORDER}, 'insert' AS _change, 0 AS _version FROM orders
    UNION ALL SELECT *, 'update', 1 FROM ({CHANGED} AND o_orderstatus <> 'X') UNION ALL SELECT *, 'insert', 1 FROM ({ADDED})
    UNION ALL SELECT {ORDER}, 'delete', 2 FROM orders WHERE o_orderkey % 100 = 2""",
)
def row_change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """What each commit inserted, updated and deleted."""
    return written_orders(spark, sf).feed(-1).withColumn("_version", F.col("_version").cast("int"))


@query(
    "exact_net_changes",
    """WITH e AS (SELECT CASE WHEN event_id % 3 > 0 THEN user_id END AS k, event_type AS v FROM events WHERE event_id % 2 = 0),
    n AS (SELECT CASE WHEN event_id % 3 > 0 THEN user_id END AS k, event_type AS v FROM events WHERE event_id % 5 > 1),
    d AS (SELECT k, v, sum(s) AS s FROM (SELECT k, v, 1 AS s FROM n UNION ALL SELECT k, v, -1 FROM e) GROUP BY k, v HAVING sum(s) <> 0),
    p AS (SELECT k FROM d WHERE k IS NOT NULL GROUP BY k HAVING sum(CASE WHEN s > 0 THEN s ELSE 0 END) = 1 AND sum(CASE WHEN s < 0 THEN -s ELSE 0 END) = 1)
    SELECT d.k, v, CASE WHEN p.k IS NOT NULL THEN 'update' WHEN s > 0 THEN 'insert' ELSE 'delete' END AS _change, abs(s)::BIGINT AS times
    FROM d LEFT JOIN p ON d.k = p.k WHERE p.k IS NULL OR s > 0""",
)
def exact_net_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The difference of two states with null and repeated keys; changes that are alike are counted."""
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("k"), F.col("event_type").alias("v"), "event_id")
    t = kept(spark, "events", ["k"])
    t.write(e.filter("event_id % 2 = 0").drop("event_id"))
    t.replace(e.filter("event_id % 5 > 1").drop("event_id"))
    return t.net_changes(0).groupBy("k", "v", "_change").agg(F.count(F.lit(1)).alias("times"))


@query(
    "change_stream_mirror",
    """SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 AND event_id % 11 > 0 THEN 'seen' ELSE event_type END AS event_type, value FROM events WHERE event_id % 13 > 0 AND value <= 90
    UNION ALL SELECT event_id, user_id, 'late', value FROM events WHERE event_id % 13 = 0""",
)
def change_stream_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """A second table follows one of events through a stream of its changes: after the first load, and after updates, deletes, a compaction and rows that come again."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    first, second = kept(spark, "followed", ["event_id"], buckets=4), kept(spark, "follower", ["event_id"])
    checkpoint = session.scratch(spark, "follow-checkpoint")
    first.write(e)
    follow(first, second, checkpoint)
    first.write(e.filter("event_id % 7 = 0 and event_id % 11 > 0").withColumn("event_type", F.lit("seen")))
    first.delete((F.col("event_id") % 13 == 0) | (F.col("value") > 90))
    first.compact()
    first.write(e.filter("event_id % 13 = 0").withColumn("event_type", F.lit("late")))
    follow(first, second, checkpoint)  # another query, from the first one's checkpoint
    return second.read()


FROM, TO = datetime.date(1995, 3, 1), datetime.date(1995, 4, 1)
CUSTOMERS = list(range(7, 1500, 7))


@query("pruned_range", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01'")
def pruned_range(spark: SparkSession, sf: str) -> DataFrame:
    """Orders kept by date: the log's bounds tell which files to open."""
    return dated_orders(spark, sf).scan([("o_orderdate", ">=", FROM), ("o_orderdate", "<", TO)]).select("o_orderkey", "o_custkey", "o_totalprice")


@query("pruned_lookup", f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN ({', '.join(str(c) for c in CUSTOMERS[:40])})")
def pruned_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by key in a table cut by date: Bloom filters tell which files to open."""
    return dated_orders(spark, sf).scan([("o_orderkey", "in", CUSTOMERS[:40])]).select("o_orderkey", "o_custkey", "o_totalprice")


def dated_orders(spark: SparkSession, sf: str, files: int = 16) -> VersionedTable:
    t = kept(spark, "dated-orders", [], stats=["o_orderdate", "o_orderkey"], bloom=["o_orderkey"])
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    t.write(o.repartitionByRange(files, "o_orderdate"))
    return t
