"""Images, legends and manifests to market assignments (C1) and their compact form (C2, C8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_slot, revision_from_url, split_matchup, split_window_marker
from ..operators import basic, compaction, images, legends, snapshots, voting
from ..operators.cuts import written

KEYS = ["season", "week", "slot"]


def final_manifest(manifest: DataFrame) -> DataFrame:
    """Usable rows with slot and revision from their URL, the final one of each map."""
    df = basic.keep_status(manifest, "status")
    df = df.withColumn("slot", normalize_slot(F.col("image_url"), F.col("context"), F.col("slot"))).filter("slot <> 'UNKNOWN'").withColumn("revision", revision_from_url(F.col("image_url")))
    return snapshots.select_final(df, KEYS, "revision", "page_source", "capture_timestamp", "bytes", ["ord"])


def best_legend(attempts: DataFrame) -> DataFrame:
    """Legend of the first attempt of each season and week, by priority, that tells anything."""
    every = written(legends.extract_legend(attempts, ["season", "week", "priority"]))
    told = every.groupBy("season", "week", "priority").agg(F.count("*").alias("found"))
    tried = attempts.select("season", "week", "priority").distinct().join(told, ["season", "week", "priority"], "left")
    best = snapshots.first_good_source(tried, ["season", "week"], "found", "priority").filter("status = 'ok'").select("season", "week", "priority")
    return every.join(best, ["season", "week", "priority"]).drop("priority")


def build_assignments(manifest: DataFrame, listing: DataFrame, files: DataFrame, polygons: DataFrame, attempts: DataFrame, override: DataFrame, samples: int = images.SAMPLES, min_valid: int = voting.MIN_VALID) -> DataFrame:
    """One row per map and market: colour, game, confidence, status, review.

    A map's file is found in ``listing`` by its digest, else by the name of its ``local_path``,
    else by that of its URL; ``files`` are the decoded images, one of each content. Maps
    without a file, or with one that can't be decoded, have no row. Markets without a polygon, and
    off the map's frame, have status ``empty_polygon`` and ``outside_map``. ``attempts``:
    season, week, priority, html, of which the first that tells a legend counts. ``override``:
    season, week, slot, color, game.
    """
    name = lambda c: F.regexp_extract(c, r"([^/\\]+?)(?:[?#].*)?$", 1)
    final = final_manifest(manifest).select(*KEYS, "revision", "sha256", name("local_path").alias("local_name"), name("image_url").alias("url_name"))
    maps = written(final)  # the rules of files each read it
    maps = snapshots.resolve_files(maps, listing, KEYS).join(listing.select("path", "digest"), "path")
    maps = written(maps.select(*KEYS, "digest", "revision"))
    good = files.filter("width > 0")
    sizes = written(good.select("digest", "width", "height"))  # decoding once for these, once for the pixels
    shapes = written(images.polygon_frames(polygons, sizes))
    px = images.sample_polygons(good.join(maps.select("digest").distinct(), "digest", "left_semi"), shapes, "digest", samples, min_valid)
    sized = maps.join(sizes, "digest")
    every = sized.join(shapes.select("width", "height", F.col("poly").alias("market"), F.col("status").alias("frame")), ["width", "height"])
    votes = every.join(images.vote_polygons(px).withColumnRenamed("poly", "market"), ["digest", "market"], "left")
    votes = votes.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_top", "valid", "total")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("confidence", "valid_share")})
    legend = best_legend(attempts)
    auto = legend.filter("not ambiguous").select(*KEYS, "color", "game")
    rows = voting.apply_legend(votes, auto, override, [*KEYS, "color"])
    rows = rows.join(legend.filter("ambiguous").select(*KEYS, "color", "ambiguous"), [*KEYS, "color"], "left")
    rows = rows.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)) & F.col("game").isNull())
    marked = split_window_marker(F.col("game"))
    rows = rows.withColumn("effective_window", F.coalesce(F.nullif(marked["window"], F.lit("")), F.regexp_extract("slot", "_(.*)$", 1))).withColumn("game", marked["game"])
    sides = split_matchup(F.col("game"))
    status = F.when(F.col("frame") != "ok", F.col("frame")).otherwise(voting.classification_status(F.col("valid"), F.col("total"), F.col("confidence"), min_valid))
    rows = rows.withColumns({"away_team": sides["away"], "home_team": sides["home"], "status": status, "legend_status": voting.legend_status(F.col("color"), F.col("game"), F.col("ambiguous"))})
    return rows.withColumn("review", voting.review_flag(F.col("status"), F.col("color"), F.col("game"), F.col("ambiguous"), F.col("confidence")))


def build_compact_dataset(rows: DataFrame, keys: list[str], market: str, floor: float = voting.FLOOR) -> tuple[DataFrame, DataFrame]:
    """(compact maps, one row of verification counts); publish only if nothing differs."""
    src = basic.resolved_only(rows)
    compact = compaction.compact_map(src, keys, market, "game", market, "confidence", "review", floor)
    return compact, compaction.verify_roundtrip(compact, src, keys, market, "game")


def compact_prefix_table(zips: DataFrame, code: str, value: str, n: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prefix table, exceptions, codes that the two get wrong: none)."""
    major, exact = compaction.prefix_majority(zips, code, value, n)
    back = compaction.longest_prefix(zips, code, exact, major, n)
    return major, exact, back.filter(~F.col(value).eqNullSafe(F.col("found")))
