"""Votes, status, legends, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic, voting
from .registry import cte, query, table, view

KEYS = ["season", "week", "slot", "market"]
MAP = ["season", "week", "slot"]

CELLS = (
    cte("samples")
    + """, per AS (
  SELECT season, week, slot, market, CASE WHEN colored THEN color END AS c, count(*) AS n FROM samples GROUP BY ALL
), rnk AS (
  SELECT *, row_number() OVER (PARTITION BY season, week, slot, market ORDER BY c IS NULL, n DESC, c) AS r FROM per
), cells AS (
  SELECT season, week, slot, market, max(CASE WHEN r = 1 THEN c END) AS color, coalesce(max(CASE WHEN r = 1 AND c IS NOT NULL THEN n END), 0) AS n_top,
         coalesce(sum(CASE WHEN c IS NOT NULL THEN n END), 0)::BIGINT AS valid, sum(n)::BIGINT AS total,
         coalesce(string_agg(CASE WHEN c IS NOT NULL THEN c || ':' || n END, ',' ORDER BY c), '') AS counts
  FROM rnk GROUP BY season, week, slot, market
), scored AS (
  SELECT *, CASE WHEN valid = 0 THEN 0.0 ELSE n_top::DOUBLE / valid END AS confidence, valid::DOUBLE / total AS valid_share FROM cells
), assignments AS (
  SELECT *, 'T' || color || ' @ T' || (8 + (color + week) % 7) AS game, market AS ord,
         CASE WHEN valid = 0 THEN 'no_color' WHEN valid < 3 THEN 'low_samples' WHEN confidence < 0.60 THEN 'mixed_boundary' WHEN valid_share < 0.20 THEN 'low_colored_share' ELSE 'ok' END AS status
  FROM scored
), flagged AS (
  SELECT *, status <> 'ok' OR (color IS NOT NULL AND game IS NULL) OR confidence < 0.70 AS review FROM assignments
)"""
)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.majority_vote(view(spark, sf_dir, "samples"), KEYS, "color", "colored")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cells(spark, sf_dir)
    game = F.concat(F.lit("T"), F.col("color").cast("string"), F.lit(" @ T"), (8 + (F.col("color") + F.col("week")) % 7).cast("string"))
    df = df.withColumn("game", game).withColumn("ord", F.col("market")).withColumn("status", voting.classification_status(F.col("valid"), F.col("total"), F.col("confidence"), min_valid=3))
    return df.withColumn("review", voting.review_flag(F.col("status"), F.col("color").cast("string"), F.col("game"), F.lit(False), F.col("confidence")))


@query(f"WITH {CELLS} SELECT season, week, slot, market, color, valid, total, round(confidence, 6) AS confidence, round(valid_share, 6) AS valid_share, counts FROM scored")
def a1_majority_vote(spark, sf_dir):
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return cells(spark, sf_dir).select(*KEYS, "color", "valid", "total", F.round("confidence", 6).alias("confidence"), F.round("valid_share", 6).alias("valid_share"), counts.alias("counts"))


@query(
    f"""WITH {CELLS} SELECT season, week, slot, market, status, review,
    CASE WHEN color = 3 THEN 'ambiguous' WHEN color <> 7 THEN 'resolved' WHEN color IS NULL THEN 'not_applicable' ELSE 'unresolved' END AS legend_status FROM flagged"""
)
def p12_p13_status_review(spark, sf_dir):
    """Colour 3 is ambiguous, colour 7 has no game."""
    game = F.when(F.col("color") != 7, F.col("game"))
    status = voting.legend_status(F.col("color").cast("string"), game, F.col("color") == 3)
    return assignments(spark, sf_dir).select(*KEYS, "status", "review", status.alias("legend_status"))


@query(f"WITH {CELLS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE game IS NOT NULL) AS resolved, count(*) FILTER (WHERE review) AS review FROM flagged")
def a13_run_summary(spark, sf_dir):
    return voting.run_summary(assignments(spark, sf_dir))


LEGEND = "auto AS (SELECT DISTINCT season, week, slot, color, game FROM flagged WHERE color <= 5), manual AS (SELECT DISTINCT season, week, slot, color, 'M' || color AS game FROM flagged WHERE color IN (2, 6))"


def _legends(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = [*MAP, "color"]
    auto = df.filter("color <= 5").select(*keys, "game").distinct()
    manual = df.filter("color in (2, 6)").select(*keys).distinct().withColumn("game", F.concat(F.lit("M"), F.col("color").cast("string")))
    return auto, manual


@query(f"WITH {CELLS}, {LEGEND} SELECT f.season, f.week, f.slot, f.market, f.color, coalesce(m.game, a.game) AS game FROM flagged f LEFT JOIN auto a USING (season, week, slot, color) LEFT JOIN manual m USING (season, week, slot, color)")
def j1_apply_legend(spark, sf_dir):
    df = assignments(spark, sf_dir)
    return voting.apply_legend(df.select(*KEYS, "color"), *_legends(df), [*MAP, "color"])


LEGENDED = f"{LEGEND}, named AS (SELECT f.* EXCLUDE (game), coalesce(m.game, a.game) AS game FROM flagged f LEFT JOIN auto a USING (season, week, slot, color) LEFT JOIN manual m USING (season, week, slot, color))"


def _named(spark, sf_dir):
    df = assignments(spark, sf_dir)
    return voting.apply_legend(df.drop("game"), *_legends(df), [*MAP, "color"])


@query(
    f"""WITH {CELLS}, {LEGENDED} SELECT season, week, slot, count(*) AS n_rows, count(*) FILTER (WHERE status = 'ok' AND game IS NOT NULL) AS ok_rows,
    count(*) FILTER (WHERE review) AS review_rows, count(DISTINCT color) AS n_colors,
    coalesce(string_agg(DISTINCT CASE WHEN game IS NULL THEN color::VARCHAR END, ',' ORDER BY CASE WHEN game IS NULL THEN color::VARCHAR END), '') AS unresolved,
    CASE WHEN count(game) = 0 THEN 'failed' WHEN count(CASE WHEN game IS NULL THEN color END) = 0 THEN 'resolved' ELSE 'partial' END AS map_status
    FROM named GROUP BY season, week, slot"""
)
def a14_map_diagnostics(spark, sf_dir):
    return voting.map_diagnostics(_named(spark, sf_dir), MAP)


@query(
    f"""WITH {CELLS}, {LEGENDED}, hued AS (SELECT *, CASE WHEN slot = 'A' THEN 'grey' ELSE 'c' || color END AS hue FROM named WHERE color IS NOT NULL AND game IS NULL)
    SELECT season, week, slot, hue, count(*) AS markets, CASE WHEN hue = 'grey' AND count(*) <= 2 THEN 'stray_grey' WHEN week % 3 = 0 THEN 'revision_mismatch' ELSE 'no_legend' END AS reason
    FROM hued GROUP BY season, week, slot, hue"""
)
def a15_legend_review_queue(spark, sf_dir):
    """Unnamed colours are grey in slot A; pages of every third week show another revision."""
    hue = F.when(F.col("slot") == "A", "grey").otherwise(F.concat(F.lit("c"), F.col("color").cast("string")))
    df = _named(spark, sf_dir).withColumn("hue", F.when(F.col("color").isNotNull(), hue)).withColumn("wrong", F.col("week") % 3 == 0)
    return voting.legend_review_queue(df, MAP, "hue", "wrong")


@query(
    f"""WITH {CELLS} SELECT season, slot, color, string_agg(DISTINCT game, ',' ORDER BY game) AS games, CASE WHEN count(DISTINCT game) = 1 THEN min(game) END AS game, count(DISTINCT game) > 1 AS ambiguous
    FROM flagged WHERE game IS NOT NULL GROUP BY season, slot, color"""
)
def a22_ambiguous_legend(spark, sf_dir):
    df = voting.ambiguous_legend(assignments(spark, sf_dir).filter("game is not null"), ["season", "slot", "color"])
    return df.withColumn("games", F.array_join("games", ","))


@query(f"WITH {CELLS} SELECT status, count(*) AS n FROM flagged GROUP BY status")
def a21_label_counts(spark, sf_dir):
    return basic.label_counts(assignments(spark, sf_dir), "status")


@query(f"WITH {CELLS} SELECT count(*) FILTER (WHERE game IS NULL) AS skipped, count(*) AS total FROM flagged")
def p2_resolved_only(spark, sf_dir):
    return basic.skipped_count(assignments(spark, sf_dir))


@query(
    f"""WITH {CELLS}, imgs AS (SELECT DISTINCT season, week, slot, 'v' || (valid % 3) AS name FROM flagged), maps AS (SELECT DISTINCT season, week, slot, 'v' || (week % 3) AS map_name FROM flagged)
    SELECT m.season, m.week, m.slot, m.map_name, coalesce((SELECT bool_and(i.name <> m.map_name) FROM imgs i WHERE i.season = m.season AND i.week = m.week AND i.slot = m.slot), false) AS revision_mismatch FROM maps m"""
)
def j4_revision_mismatch(spark, sf_dir):
    from ..operators.snapshots import missing_pages

    df = assignments(spark, sf_dir)
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))
    return missing_pages(df.select(*MAP, name("week").alias("map_name")).distinct(), df.select(*MAP, name("valid").alias("name")).distinct(), MAP)


@query("SELECT * FROM (SELECT event_type AS label, CAST(floor(value) AS BIGINT) % 10 AS v FROM events WHERE event_type IN ('click', 'view'))")
def p1_keep_status(spark, sf_dir):
    df = basic.keep_status(table(spark, sf_dir, "events"), "event_type", ("click", "view"))
    return df.select(F.col("event_type").alias("label"), (F.floor("value") % 10).alias("v"))


@query(f"WITH {CELLS} SELECT season, week, slot, market, game FROM flagged WHERE season = 1996 AND week = 3 AND market NOT IN (3, 4)")
def p5_p17_filters(spark, sf_dir):
    df = basic.exclude_markets(basic.season_week_filter(assignments(spark, sf_dir), 1996, 3), "market", [3, 4])
    return df.select(*KEYS, "game")
