"""Group G: what callers write in SQL over the tables, through the DataFrame API and ``table_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamgraph.operators import joins
from loamgraph.operators.sqlapi import table_sql
from loamgraph.plans.registry import query
from loamgraph.session import table


def same(name: str, tables: str, spark_sql: str, oracle: str | None = None) -> None:
    """A query whose text is the same for Spark and the oracle."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(spark_sql)

    run.__name__ = name
    query(name, oracle or spark_sql)(run)


# -- joins

same("join_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
same("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'")
same("join_right", "customer orders", "SELECT c_name, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000")
same(
    "join_full", "nation supplier",
    "SELECT n_name, s_name FROM (SELECT * FROM nation WHERE n_nationkey < 10) n FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) s ON n_nationkey = s_nationkey",
)
same("join_semi", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
same("join_anti", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
same("join_cross", "region", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
same("join_theta", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
same(
    "join_multi_key", "lineitem orders",
    "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 40",
)


@query(
    "join_asof",
    "SELECT e.event_id, e.user_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'",
)
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return joins.asof_join(clicks, bought, ["user_id"], "ts", "ts", ["last_purchase"], width=7 * 86400.0).select("event_id", "user_id", "last_purchase")


@query(
    "join_range",
    "SELECT p_partkey, k FROM part JOIN (SELECT range AS k, 900.0 + range * 40 AS lo, 960.0 + range * 40 AS hi FROM range(0, 20)) ON p_retailprice >= lo AND p_retailprice < hi",
)
def join_range(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.range(20).select(F.col("id").alias("k"), (900.0 + F.col("id") * 40).alias("lo"), (960.0 + F.col("id") * 40).alias("hi"))
    return joins.range_join(table(spark, sf, "part"), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "k")


@query(
    "join_interval",
    "SELECT a.event_id AS a, b.event_id AS b FROM (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'click') a JOIN (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.t < b.t + 600 AND b.t < a.t + 1800",
)
def join_interval(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("a"), "user_id", F.col("t").alias("a_lo"), (F.col("t") + 1800).alias("a_hi"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("b"), "user_id", F.col("t").alias("b_lo"), (F.col("t") + 600).alias("b_hi"))
    return joins.interval_join(a, b, "a_lo", "a_hi", "b_lo", "b_hi", 1800.0, ["user_id"]).select("a", "b")


@query("join_salted", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return joins.salted_join(lines, suppliers, ["l_suppkey"], 4).select("l_orderkey", "l_linenumber", "s_name")


# -- aggregates

same(
    "agg_group", "orders",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY o_orderstatus",
)
same("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
same("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
same(
    "agg_stats", "lineitem",
    "SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_linestatus",
)
same("agg_filter", "orders", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders")
same("agg_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
same("agg_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same(
    "agg_rollup", "customer nation",
    "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
)
same(
    "agg_quantile", "orders", "SELECT o_orderstatus, percentile(o_totalprice, 0.5) AS med FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY o_orderstatus",
)


@query("agg_approx_distinct", "SELECT true AS parts_within, quantile_disc(l_quantity, 0.9) AS q90 FROM lineitem")
def agg_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The estimate lies within four standard errors of the exact count; the quantile of so few values is exact."""
    found = table(spark, sf, "lineitem").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count_distinct("l_partkey").alias("n"), F.percentile_approx("l_quantity", 0.9).alias("q90"),
    )
    return found.select((F.abs(F.col("a") / F.col("n") - 1) <= 0.08).alias("parts_within"), "q90")


@query(
    "agg_pivot",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag",
)
def agg_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


# -- windows

same(
    "win_rank", "customer",
    "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
)
same(
    "win_lag_lead", "events",
    "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
same(
    "win_running", "orders",
    "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
same(
    "win_rows_frame", "events",
    "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS low FROM events",
)
same("win_range_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
same(
    "win_ntile", "supplier",
    "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS first FROM supplier",
)

# -- sets, sort, recursion

same("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
same("set_except", "customer orders", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
same("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
same("subquery_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
same("subquery_in", "part lineitem", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
same("predicates", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000 AND o_orderpriority IS NOT NULL AND NOT o_orderstatus = 'O'")
same(
    "recursive_cte", "nation",
    "WITH RECURSIVE r(k, n) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT k + 1, n + 1 FROM r WHERE n < 6) SELECT r.k, r.n, nation.n_name FROM r JOIN nation ON nation.n_nationkey = r.k",
)

# -- functions

@query(
    "fn_string",
    "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 5) AS s, length(p_type)::INT AS n, replace(p_brand, 'B', 'x') AS r, lpad(p_brand, 12, '*') AS l, starts_with(p_name, 'a') AS a, reverse(p_type) AS w FROM part",
)
def fn_string(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("u"), F.substring("p_name", 2, 5).alias("s"), F.length("p_type").alias("n"), F.replace(
            c("p_brand"), F.lit("B"), F.lit("x"),
        ).alias("r"), F.lpad("p_brand", 12, "*").alias("l"),
        c("p_name").startswith("a").alias("a"), F.reverse("p_type").alias("w"),
    )


@query(
    "fn_date",
    "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS rfc, epoch_us(o_orderdate) AS us, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days FROM orders",
)
def fn_date(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc"), F.unix_micros(d.cast("timestamp")).alias("us"), F.datediff(
            d, F.lit("1992-01-01").cast("date"),
        ).alias("days")
    )


@query(
    "fn_math",
    "SELECT event_id, round(ln(1 + abs(value)), 6) AS l, round(greatest(-1, least(1, value / 100)), 6) AS c, round(1 / (1 + abs(value)), 6) AS inv, floor(value)::BIGINT AS f, round(sqrt(abs(value)), 6) AS s FROM events",
)
def fn_math(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.log1p(F.abs(v)), 6).alias("l"), F.round(
            F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v / 100)), 6,
        ).alias("c"), F.round(1 / (1 + F.abs(v)), 6).alias("inv"), F.floor(v).alias("f"), F.round(F.sqrt(F.abs(v)), 6).alias("s")
    )


@query(
    "fn_array",
    "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, round(embedding[3]::DOUBLE, 6) AS third, len(list_filter(embedding, lambda x: x > 0))::INT AS positive FROM embeddings",
)
def fn_array(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.size(e).alias("n"), F.round(
            F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 5,
        ).alias("total"), F.round(F.element_at(e, 3).cast("double"), 6).alias("third"), F.size(F.filter(e, lambda x: x > 0)).alias("positive")
    )


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS ok FROM events")
def fn_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$").isNotNull().alias("ok"))


@query(
    "fn_regex",
    r"SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_matches(url, '^https') AS tls, regexp_replace(url, '[?#].*$', '') AS bare FROM pages",
)
def fn_regex(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.col("url").rlike("^https").alias("tls"),
        F.regexp_replace("url", "[?#].*$", "").alias("bare"),
    )


@query("fn_map", "SELECT n_regionkey, count(*) AS names, min(n_name) AS first FROM nation GROUP BY n_regionkey")
def fn_map(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return n.select("n_regionkey", F.size("m").cast("long").alias("names"), F.array_min(F.map_keys("m")).alias("first"))


# -- whole queries

same(
    "pricing_summary", "lineitem",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
same(
    "star_revenue", "customer orders lineitem supplier nation region",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = s_nationkey GROUP BY n_name""",
)
same(
    "star_top_customers", "customer orders lineitem",
    "SELECT c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20",
)


@query("table_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def table_sql_query(spark: SparkSession, sf: str) -> DataFrame:
    return table_sql(
        table(spark, sf, "orders"), "silver/entities/orders",
        "SELECT o_orderpriority, count(*) AS n FROM {{table}} WHERE o_totalprice > 100000 GROUP BY o_orderpriority",
    )
