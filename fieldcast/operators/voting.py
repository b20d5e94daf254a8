"""Majority votes over samples, their status and review, legends, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least samples, confidence below which borders are mixed, least coloured
#: share, and the floor of confidence for review.
MIN_VALID, MIXED, MIN_SHARE, FLOOR = 12, 0.60, 0.20, 0.70


def majority_vote(samples: DataFrame, keys: list[str], label: str, valid: str | None = None, ord_col: str | None = None, weight: str | None = None) -> DataFrame:
    """Per key: winning label, ``n_top``, ``valid``, ``total``, ``confidence``, ``valid_share``, ``counts``.

    Rows where ``valid`` is false count in ``total`` only. Ties go to the label seen first
    by ``ord_col``, or else to the smallest. A row counts ``weight`` times, else once. A key without valid rows has a null label and
    confidence 0. Counting by (key, label) is combined before the shuffle; the second group
    has a row for each label only.
    """
    ok = F.col(valid) if valid else F.col(label).isNotNull()
    first = F.min(ord_col) if ord_col else F.min(label)
    per = samples.groupBy(*keys, F.when(ok, F.col(label)).alias("_label")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"), first.alias("_first"))
    real = F.col("_label").isNotNull()
    out = per.groupBy(*keys).agg(
        F.min_by(F.when(real, F.col("_label")), F.when(real, F.struct(-F.col("_n"), F.col("_first")))).alias(label),
        F.coalesce(F.max(F.when(real, F.col("_n"))), F.lit(0)).alias("n_top"),
        F.coalesce(F.sum(F.when(real, F.col("_n"))), F.lit(0)).alias("valid"),
        F.sum("_n").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(real, F.struct(F.col("_label").cast("string").alias("k"), F.col("_n").alias("v")))))).alias("counts"),
    )
    return out.withColumn("confidence", F.coalesce(F.col("n_top") / F.nullif("valid", F.lit(0)), F.lit(0.0))).withColumn("valid_share", F.col("valid") / F.col("total"))


def classification_status(valid: Column, total: Column, confidence: Column, min_valid: int = MIN_VALID) -> Column:
    return F.when(valid == 0, "no_color").when(valid < min_valid, "low_samples").when(confidence < MIXED, "mixed_boundary").when(valid / total < MIN_SHARE, "low_colored_share").otherwise("ok")


def legend_status(color: Column, game: Column, ambiguous: Column) -> Column:
    has_color, has_game = F.coalesce(color != "", F.lit(False)), F.coalesce(game != "", F.lit(False))
    return F.when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").when(has_game, "resolved").when(~has_color, "not_applicable").otherwise("unresolved")


def review_flag(status: Column, color: Column, game: Column, ambiguous: Column, confidence: Column, floor: float = FLOOR) -> Column:
    has_color, has_game = F.coalesce(color != "", F.lit(False)), F.coalesce(game != "", F.lit(False))
    return (status != "ok") | (has_color & ~has_game) | F.coalesce(ambiguous, F.lit(False)) | (confidence < floor)


def apply_legend(rows: DataFrame, auto: DataFrame, override: DataFrame, keys: list[str], value: str = "game") -> DataFrame:
    """Add ``value`` from two legends by ``keys``; the manual one beats the automatic one."""
    a = auto.select(*keys, F.col(value).alias("_auto"))
    m = override.select(*keys, F.col(value).alias("_manual"))
    return rows.join(a, keys, "left").join(m, keys, "left").withColumn(value, F.coalesce("_manual", "_auto")).drop("_auto", "_manual")


def ambiguous_legend(rows: DataFrame, keys: list[str], value: str = "game") -> DataFrame:
    """Per key: its sorted distinct values, the only one (else null), and ``ambiguous``."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("games"))
    return g.select(*keys, "games", F.when(F.size("games") == 1, F.get("games", 0)).alias(value), (F.size("games") > 1).alias("ambiguous"))


def run_summary(rows: DataFrame) -> DataFrame:
    """One row of counts: rows, resolved, review."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.col("game") != "", F.lit(False))).alias("resolved"), F.count_if("review").alias("review"))


def map_diagnostics(rows: DataFrame, keys: list[str], color: str = "color") -> DataFrame:
    """Per map: rows, good rows, review rows, colours, sorted colours without a game, status."""
    has_game = F.coalesce(F.col("game") != "", F.lit(False))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.col("status") == "ok") & has_game).alias("ok_rows"),
        F.count_if("review").alias("review_rows"),
        F.count_distinct(color).alias("n_colors"),
        F.array_join(F.sort_array(F.collect_set(F.when(~has_game, F.col(color).cast("string")))), ",").alias("unresolved"),
        F.count_if(has_game).alias("_resolved"),
    )
    return out.withColumn("map_status", F.when(F.col("_resolved") == 0, "failed").when(F.col("unresolved") == "", "resolved").otherwise("partial")).drop("_resolved")


def legend_review_queue(rows: DataFrame, keys: list[str], color: str = "color", mismatch: str | None = None) -> DataFrame:
    """Colours of a map that have no game: their market count and the likely reason."""
    bare = rows.filter(F.col(color).isNotNull() & ~F.coalesce(F.col("game") != "", F.lit(False)))
    wrong = F.bool_or(mismatch) if mismatch else F.lit(False)
    out = bare.groupBy(*keys, color).agg(F.count("*").alias("markets"), wrong.alias("_wrong"))
    reason = F.when((F.col(color).cast("string") == "grey") & (F.col("markets") <= 2), "stray_grey").when(F.col("_wrong"), "revision_mismatch").otherwise("no_legend")
    return out.withColumn("reason", reason).drop("_wrong")
