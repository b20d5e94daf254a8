"""Recency-weighted smoothed win rates, their softmax, calibration and honest validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import MAX_WEIGHT, PRIOR, PRIOR_WEIGHT, game_score, softmax, win_rate
from ..functions.text import game_teams
from .resolution import attach_rates, rates_of

#: Temperatures tried, and the floor of probabilities in the log loss.
GRID = [2, 4, 6, 8, 10, 12, 15, 20, 25, 30, 40]
LOSS_FLOOR = 1e-9


def season_counts(rows: DataFrame, map_keys: list[str], market: str, season: str = "season", game: str = "game") -> DataFrame:
    """Per (season, market, team): ``avail_n`` maps with the team, ``shown_n`` that aired it.

    A map's distinct games are found once, as an array of its teams with their games; each
    row joins its map and is one group's input for both counts.
    """
    maps = [*dict.fromkeys([season, *map_keys])]
    teams = rows.select(*maps, game).distinct().withColumn("team", F.explode(game_teams(F.col(game)))).groupBy(*maps, "team").agg(F.count("*").alias("games"))
    teams = teams.groupBy(*maps).agg(F.collect_list(F.struct("team", "games")).alias("_teams"))
    flat = rows.select(*maps, market, game_teams(F.col(game)).alias("_aired")).join(teams, maps).select(season, market, "_aired", F.inline("_teams"))
    times = F.size(F.filter("_aired", lambda x: x == F.col("team")))
    return flat.groupBy(season, market, "team").agg(F.sum("games").alias("avail_n"), F.sum(times).alias("shown_n"))


def expanding_folds(seasons: DataFrame, season: str = "season", min_train: int = 1) -> DataFrame:
    """(fold, season): fold ``t`` trains on every season before ``t``."""
    s = seasons.select(season).distinct()
    return s.select(F.col(season).alias("fold")).join(s, F.col(season) < F.col("fold"))


def recency_weight(folds: DataFrame, base: float = 2.0, season: str = "season") -> DataFrame:
    """Add ``weight``: base to the season's place in its fold."""
    place = F.dense_rank().over(Window.partitionBy("fold").orderBy(season)) - 1
    return folds.withColumn("weight", F.pow(F.lit(base), place))


def fold_rates(counts: DataFrame, weights: DataFrame, market: str, k: float = PRIOR_WEIGHT, prior: float = PRIOR, season: str = "season") -> DataFrame:
    """Rates of every fold from one table of season counts; smoothing comes after weighting."""
    w = counts.join(F.broadcast(weights), season)  # a fold and season have one row each
    g = w.groupBy("fold", market, "team").agg(F.sum(F.col("shown_n") * F.col("weight")).alias("shown"), F.sum(F.col("avail_n") * F.col("weight")).alias("avail"))
    return g.withColumn("rate", win_rate(F.col("shown"), F.col("avail"), k, prior))


def decisions(rows: DataFrame, rates: DataFrame, map_keys: list[str], market: str, fold: str = "season", game: str = "game", prior: float = PRIOR, max_weight: float = MAX_WEIGHT) -> DataFrame:
    """Per row of a test season: its game and the array of (game, score) it chose from.

    Maps with one game are no decision. Games keep the order of their name. A row meets its
    map's games and its market's rates as one array and one map, so no game is ever a row.
    """
    maps = [*dict.fromkeys([fold, *map_keys])]
    games = rows.select(*maps, game).distinct().groupBy(*maps).agg(F.sort_array(F.collect_set(game)).alias("_games")).filter(F.size("_games") > 1)
    asked = rows.select(*maps, market, F.col(game).alias("truth")).join(games, maps)
    asked = attach_rates(asked, rates.withColumnRenamed("fold", fold), market, (fold,))
    score = lambda g: game_score(rates_of(g, F.col("rates"), prior), max_weight)
    return asked.select(*maps, market, "truth", F.transform("_games", lambda g: F.struct(g.alias("game"), score(g).alias("score"))).alias("options"))


def predictions(dec: DataFrame, temperature: Column | float) -> DataFrame:
    """Add ``ranked`` (game, p by p then name), ``n``, ``p_top``, ``hit``, ``hit2``, ``p_true``.

    Probabilities have 12 digits, so that equal ones tie whatever order they were summed in.
    """
    p = softmax(F.transform("options", lambda o: o["score"]), temperature)
    df = dec.withColumn("_p", p)
    pairs = F.zip_with(F.transform("options", lambda o: o["game"]), F.col("_p"), lambda g, x: F.struct((-F.round(x, 12)).alias("np"), g.alias("game")))
    df = df.withColumn("_r", F.array_sort(pairs))
    df = df.withColumn("ranked", F.transform("_r", lambda r: F.struct(r["game"].alias("game"), (-r["np"]).alias("p"))))
    first, second = F.get("ranked", 0), F.get("ranked", 1)
    return df.select(
        *[c for c in dec.columns if c != "options"],
        "ranked",
        F.size("ranked").alias("n"),
        first["p"].alias("p_top"),
        (first["game"] == F.col("truth")).alias("hit"),
        ((first["game"] == F.col("truth")) | F.coalesce(second["game"] == F.col("truth"), F.lit(False))).alias("hit2"),
        F.coalesce(F.try_element_at(F.filter("ranked", lambda r: r["game"] == F.col("truth")), F.lit(1))["p"], F.lit(LOSS_FLOOR)).alias("p_true"),
    )


def log_loss(p_true: Column) -> Column:
    return F.avg(-F.log(F.greatest(p_true, F.lit(LOSS_FLOOR))))


def evaluate(pred: DataFrame) -> DataFrame:
    return pred.agg(F.count("*").alias("decisions"), F.avg(F.col("hit").cast("double")).alias("top1"), F.avg(F.col("hit2").cast("double")).alias("top2"), log_loss(F.col("p_true")).alias("log_loss"))


def accuracy_by(pred: DataFrame, column: str = "n") -> DataFrame:
    return pred.groupBy(column).agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count("*").alias("decisions"))


def calibration_bins(pred: DataFrame) -> DataFrame:
    """Per tenth of the leader's probability: decisions, observed rate, mid-band."""
    b = F.least(F.floor(F.col("p_top") * 10), F.lit(9)).cast("int")
    return pred.groupBy(b.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate")).withColumn("mid", (F.col("band") + 0.5) / 10)


def monotone_calibration(bins: DataFrame, min_n: int = 100, bands: int = 10) -> DataFrame:
    """``band``, ``upper``, ``value``: a band with few decisions takes the last usable rate
    (1/bands at first), then a running maximum; four digits."""
    spark = bins.sparkSession
    every = spark.range(bands).select(F.col("id").cast("int").alias("band"))
    up_to = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # ten rows
    df = every.join(bins, "band", "left").withColumn("_r", F.when(F.col("n") >= min_n, F.col("rate")))
    df = df.withColumn("_r", F.coalesce(F.last("_r", ignorenulls=True).over(up_to), F.lit(1.0 / bands)))
    return df.select("band", ((F.col("band") + 1) / bands).alias("upper"), F.round(F.max("_r").over(up_to), 4).alias("value"))


def calibration_error(bins: DataFrame, reported: DataFrame | None = None, min_n: int = 50, limit: float = 0.10) -> DataFrame:
    """One row: mean distance of reported and observed rates, over bands with enough decisions."""
    df = bins.filter(F.col("n") >= min_n)
    say = F.col("mid")
    if reported is not None:
        df, say = df.join(reported.select("band", "value"), "band"), F.col("value")
    return df.agg(F.avg(F.abs(say - F.col("rate"))).alias("error")).withColumn("too_far", F.col("error") > limit)


def fit_temperature(dec: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """``temperature``, ``log_loss`` of each grid value, best first (least loss, then least value).

    Each decision holds its options in an array, so all values are tried in one pass and
    only one average each is shuffled.
    """
    score = F.transform("options", lambda o: o["score"])
    at = F.array_position(F.transform("options", lambda o: o["game"]), F.col("truth")).cast("int")

    def loss(t: float) -> Column:
        p = F.coalesce(F.get(softmax(score, float(t)), at - 1), F.lit(LOSS_FLOOR))
        return F.when(at > 0, log_loss_one(p)).otherwise(log_loss_one(F.lit(LOSS_FLOOR)))

    wide = dec.agg(*[F.avg(loss(t)).alias(f"t{i}") for i, t in enumerate(grid)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("log_loss")) for i, t in enumerate(grid)])
    return wide.select(F.inline(pairs)).orderBy("log_loss", "temperature")


def log_loss_one(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(LOSS_FLOOR)))
