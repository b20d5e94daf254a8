"""Picks of one row, orders, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import basic, snapshots
from ..functions.collections import first_present
from .registry import cte, query, table, view

ORD = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
_FINAL = "ORDER BY revision DESC, CASE source WHEN 'live' THEN 2 WHEN 'wayback' THEN 1 ELSE 0 END DESC, capture DESC, bytes DESC, l_orderkey, l_partkey, l_suppkey, l_extendedprice"


@query(f"WITH {cte('manifest')} SELECT * FROM manifest QUALIFY row_number() OVER (PARTITION BY season, week, slot {_FINAL}) = 1")
def w1_select_final(spark, sf_dir):
    return snapshots.select_final(view(spark, sf_dir, "manifest"), ["season", "week", "slot"], "revision", "source", "capture", "bytes", ORD)


@query("SELECT user_id, event_type, CAST(month(ts) AS INT) AS week, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY month(ts) DESC, event_id) = 1")
def w3_latest_per_key(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("user_id", "event_type", F.month("ts").alias("week"), "event_id")
    return snapshots.latest_per_key(df, "user_id", "week", ["event_id"])


_ATTEMPTS = "attempts AS (SELECT l_partkey AS page, l_suppkey AS priority, max(CASE WHEN l_quantity > 25 THEN l_linenumber ELSE 0 END) AS found FROM lineitem GROUP BY l_partkey, l_suppkey)"


@query(f"WITH {_ATTEMPTS} SELECT page, priority, found, CASE WHEN found > 0 THEN 'ok' ELSE 'failed' END AS status FROM attempts QUALIFY row_number() OVER (PARTITION BY page ORDER BY found > 0 DESC, priority) = 1")
def j2_first_good_source(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page"), F.col("l_suppkey").alias("priority")).agg(F.max(F.when(F.col("l_quantity") > 25, F.col("l_linenumber")).otherwise(0)).alias("found"))
    return snapshots.first_good_source(df, ["page"], "found", "priority")


@query(
    """WITH m AS (SELECT o_orderkey AS ord, CASE WHEN o_custkey % 3 = 0 THEN sha256('d' || o_custkey) ELSE '' END AS sha256, 'n' || (o_custkey % 700) AS local_name, 'n' || (o_custkey % 900) AS url_name FROM orders),
    l AS (SELECT 'p/' || c_custkey AS path, 'n' || (c_custkey % 1000) AS name, sha256('d' || c_custkey) AS digest FROM customer WHERE c_custkey % 2 = 0),
    hit AS (SELECT ord, 0 AS rule, path FROM m JOIN l ON sha256 = digest WHERE sha256 <> '' UNION ALL SELECT ord, 1, path FROM m JOIN l ON local_name = name UNION ALL SELECT ord, 2, path FROM m JOIN l ON url_name = name),
    best AS (SELECT ord, rule, path FROM hit QUALIFY row_number() OVER (PARTITION BY ord ORDER BY rule, path) = 1)
    SELECT m.ord, rule, path FROM m LEFT JOIN best ON m.ord = best.ord"""
)
def j3_resolve_files(spark, sf_dir):
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = F.col("o_custkey")
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.when(c % 3 == 0, F.sha2(s("d", c), 256)).otherwise("").alias("sha256"), s("n", c % 700).alias("local_name"), s("n", c % 900).alias("url_name"))
    k = F.col("c_custkey")
    files = table(spark, sf_dir, "customer").filter(k % 2 == 0).select(s("p/", k).alias("path"), s("n", k % 1000).alias("name"), F.sha2(s("d", k), 256).alias("digest"))
    return snapshots.resolve_files(m, files, ["ord"]).select("ord", "rule", "path")


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem QUALIFY rank <= 3")
def t5_top_k_per_group(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return basic.top_k_per_group(df, ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")], 3)


@query("SELECT l_returnflag, string_agg(DISTINCT CAST(year(l_shipdate) AS VARCHAR), ',' ORDER BY CAST(year(l_shipdate) AS VARCHAR)) AS seasons FROM lineitem GROUP BY l_returnflag")
def a23_distinct_sets(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("season", F.year("l_shipdate").cast("string"))
    return basic.distinct_sets(df, "l_returnflag", "season").select("l_returnflag", F.array_join("values", ",").alias("seasons"))


@query("SELECT v AS value, row_number() OVER (ORDER BY v) - 1 AS idx FROM (SELECT c_name AS v FROM customer UNION SELECT s_name FROM supplier)")
def u1_intern_values(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"))
    return basic.intern_values(a, b, "value")


@query(
    """WITH d AS (SELECT c_custkey AS k, CAST(c_custkey % 7 AS INT) AS v FROM customer WHERE c_custkey % 3 <> 0), l AS (SELECT c_custkey AS k, CAST(c_custkey % 5 AS INT) AS v FROM customer WHERE c_custkey % 3 <> 1)
    SELECT coalesce(l.k, d.k) AS k, coalesce(l.v, d.v) AS v, coalesce(d.v <> l.v, false) AS differs FROM d FULL JOIN l ON d.k = l.k"""
)
def u2_overlay(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    d, live = (c.filter(k % 3 != r).select(k.alias("k"), (k % m).cast("int").alias("v")) for r, m in ((0, 7), (1, 5)))
    return basic.overlay(d, live, "k", "v")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u3_append_batches(spark, sf_dir):
    return basic.append_batches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("WITH l AS (SELECT o_orderkey, [o_custkey % 5, o_custkey % 3, o_custkey % 7, 9, o_custkey % 5] AS p FROM orders) SELECT o_orderkey, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS players FROM l")
def u4_ordered_concat_except(spark, sf_dir):
    """Starters, then the players not among them; repeats on either side count once."""
    c = F.col("o_custkey")
    out = basic.ordered_concat_except(F.array(c % 5, c % 3), F.array(c % 7, F.lit(9), c % 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(out.cast("array<string>"), ",").alias("players"))


@query("SELECT l_partkey, l_suppkey FROM lineitem EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <> 3")
def u5_mismatches(spark, sf_dir):
    """Only parts whose digests differ are compared row by row."""
    li = table(spark, sf_dir, "lineitem")
    return basic.mismatches(li.select("l_partkey", "l_suppkey"), li.filter("l_linenumber <> 3").select("l_partkey", "l_suppkey"), by=["l_partkey"])


@query(
    """WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey % 3 > 0 OR l_tax > 0.01 GROUP BY ALL)
    SELECT DISTINCT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey WHERE a.n IS DISTINCT FROM b.n"""
)
def u5_differing_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    some = li.filter("l_suppkey % 3 > 0 or l_tax > 0.01")
    return basic.differing_keys(li.select("l_suppkey", "l_partkey"), some.select("l_partkey", "l_suppkey"), ["l_suppkey"])


@query("SELECT DISTINCT CAST(month(l_shipdate) AS INT) AS week FROM lineitem WHERE month(l_shipdate) NOT IN (SELECT month(o_orderdate) FROM orders WHERE month(o_orderdate) < 9)")
def s11_missing_batches(spark, sf_dir):
    asked = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("week"))
    got = table(spark, sf_dir, "orders").select(F.month("o_orderdate").alias("week")).filter("week < 9")
    return basic.missing_batches(asked, got)


@query("SELECT l_orderkey, n_name AS code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3")
def p3_map_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("code"))
    return basic.map_codes(li, "code", table(spark, sf_dir, "nation").filter("n_regionkey < 3"), "n_nationkey", "n_name")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN trim(c_mktsegment) END, CASE WHEN c_custkey % 5 = 0 THEN c_name END, 'none') AS label FROM customer")
def p4_first_present(spark, sf_dir):
    k = F.col("c_custkey")
    a, b = F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("  "), F.when(k % 5 == 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", first_present(a, b, default="none").alias("label"))


@query("SELECT c_custkey, c_acctbal AS lat FROM customer WHERE c_custkey % 4 <> 1")
def p16_finite_coordinates(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 1, F.when(k % 8 == 1, "NaN").otherwise("x")).otherwise(F.col("c_acctbal").cast("string"))
    df = table(spark, sf_dir, "customer").select("c_custkey", raw.alias("lat"), F.lit("1").alias("lon"))
    return basic.finite_coordinates(df, "lat", "lon").select("c_custkey", "lat")


@query("SELECT n_name, n_regionkey, n_nationkey FROM nation ORDER BY n_regionkey, n_name")
def t3_final_order(spark, sf_dir):
    return basic.final_order(table(spark, sf_dir, "nation").select("n_name", "n_regionkey", "n_nationkey"), ["n_regionkey", "n_name"])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders")
def t3_final_places(spark, sf_dir):
    """Every order's place in the final order, though a few priorities hold all of them."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return basic.final_places(df, ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_orderkey", "place")
