"""Compact maps, prefix tables and their round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import plausible_zip
from ..operators import basic, compaction
from .registry import cte, query, table, view
from .voting import CELLS, MAP, assignments

IDX = f"""{CELLS}, src AS (SELECT * FROM flagged WHERE game IS NOT NULL),
freq AS (SELECT season, week, slot, game, count(*) AS n, row_number() OVER (PARTITION BY season, week, slot ORDER BY count(*) DESC, min(ord), game) - 1 AS idx FROM src GROUP BY season, week, slot, game)"""


def _src(spark, sf_dir):
    return basic.resolved_only(assignments(spark, sf_dir))


@query(f"WITH {IDX} SELECT * FROM freq")
def w12_frequency_index(spark, sf_dir):
    return compaction.frequency_index(_src(spark, sf_dir), MAP, "game", "ord")


def _compact(spark, sf_dir):
    return compaction.compact_map(_src(spark, sf_dir), MAP, "market", "game", "ord", "confidence", "review")


@query(
    f"""WITH {IDX}, g AS (SELECT season, week, slot, string_agg(game, '|' ORDER BY idx) AS g FROM freq GROUP BY ALL),
    m AS (SELECT s.*, idx FROM src s JOIN freq USING (season, week, slot, game))
    SELECT season, week, slot, g.g, 0 AS d,
      coalesce(string_agg(CASE WHEN idx > 0 THEN market || ':' || idx END, ',' ORDER BY market::VARCHAR), '') AS e,
      coalesce(string_agg(CASE WHEN review THEN market || ':' || round(confidence, 2)::DECIMAL(5, 2) END, ',' ORDER BY market::VARCHAR), '') AS u
    FROM m JOIN g USING (season, week, slot) GROUP BY season, week, slot, g.g"""
)
def a16_compact_map(spark, sf_dir):
    text = lambda c, t: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws(":", x["key"], x["value"].cast(t).cast("string"))), ",")
    return _compact(spark, sf_dir).select(*MAP, F.array_join("g", "|").alias("g"), "d", text("e", "int").alias("e"), text("u", "decimal(5,2)").alias("u"))


@query(f"WITH {IDX} SELECT count(*) AS n_rows, 0::BIGINT AS n_mismatch FROM src")
def a17_verify_roundtrip(spark, sf_dir):
    return compaction.verify_roundtrip(_compact(spark, sf_dir), _src(spark, sf_dir), MAP, "market", "game")


@query(f"WITH {IDX} SELECT f.season, f.week, f.slot, f.market, coalesce(s.game, d.game) AS answer FROM flagged f LEFT JOIN src s USING (season, week, slot, market) LEFT JOIN (SELECT * FROM freq WHERE idx = 0) d ON d.season = f.season AND d.week = f.week AND d.slot = f.slot")
def j5_lookup_with_default(spark, sf_dir):
    asked = assignments(spark, sf_dir).select(*MAP, "market")
    return compaction.lookup_with_default(asked, _compact(spark, sf_dir), MAP, "market").select(*MAP, "market", "answer")


MAJOR = f"{cte('zips')}, major AS (SELECT substr(zip, 1, 3) AS prefix, zone AS value FROM zips GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY substr(zip, 1, 3) ORDER BY count(*) DESC, zone) = 1)"


@query(f"WITH {MAJOR} SELECT prefix AS code, value, 'prefix' AS kind FROM major UNION ALL SELECT zip, zone, 'exact' FROM zips JOIN major ON substr(zip, 1, 3) = prefix WHERE zone <> value")
def a2_prefix_majority(spark, sf_dir):
    major, exact = compaction.prefix_majority(view(spark, sf_dir, "zips"), "zip", "zone")
    return major.select(F.col("prefix").alias("code"), "value", F.lit("prefix").alias("kind")).unionByName(exact.withColumn("kind", F.lit("exact")))


@query(f"WITH {MAJOR} SELECT zip, zone, zone AS found FROM zips")
def j12_longest_prefix(spark, sf_dir):
    zips = view(spark, sf_dir, "zips")
    major, exact = compaction.prefix_majority(zips, "zip", "zone")
    return compaction.longest_prefix(zips, "zip", exact, major)


@query(f"WITH {cte('zips')} SELECT substr(zip, 1, 3) AS prefix, count(DISTINCT zone) AS n_values, count(DISTINCT zone) > 1 AS mixed FROM zips GROUP BY 1")
def a26_purity(spark, sf_dir):
    return compaction.purity(view(spark, sf_dir, "zips"), "zip", "zone")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') END AS zip FROM customer")
def p15_plausible_zip(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit(" "), (k % 100000).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", plausible_zip(raw).alias("zip"))
