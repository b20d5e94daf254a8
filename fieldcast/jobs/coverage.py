"""Schedule and markets to answers (C4), probabilities (C5) and rollups (C14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import resolution
from ..operators.cuts import written


def _scored(markets: DataFrame, schedule: DataFrame, rates: DataFrame, keys: list[str], market: str, temperature: float) -> DataFrame:
    games = resolution.competing_games(schedule, keys)
    return resolution.scored_games(resolution.score_market_games(markets, games, market), rates, keys, market, temperature)


def game_probabilities(markets: DataFrame, schedule: DataFrame, rates: DataFrame, keys: list[str], market: str, actual: DataFrame | None = None, temperature: float = resolution.TEMPERATURE) -> DataFrame:
    """(keys, market, game, p, confirmed): 1 or 0 where the market's game is known."""
    flat = _scored(markets, schedule, rates, keys, market, temperature).select(*keys, market, F.inline("ranked"))
    if actual is None:
        return flat.withColumn("confirmed", F.lit(False))
    df = flat.join(actual.select(*keys, market, F.col("game").alias("_seen")), [*keys, market], "left")
    known = F.col("_seen").isNotNull()
    return df.withColumn("p", F.when(known, (F.col("_seen") == F.col("game")).cast("double")).otherwise(F.col("p"))).withColumn("confirmed", known).drop("_seen")


def resolve_schedule(markets: DataFrame, schedule: DataFrame, actual: DataFrame, rates: DataFrame, keys: list[str], market: str, national: DataFrame | None = None, calibration: list[tuple[float, float]] | None = None, temperature: float = resolution.TEMPERATURE) -> DataFrame:
    """What every market sees for every game of the schedule, who says so, and how surely.

    Games in no slot (a null key) depend on no market: those that ``national`` lists are local
    everywhere, the others have no row.
    """
    slotted = schedule.dropna(subset=keys)
    if national is None:
        national = schedule.select(*keys, "game").limit(0)
    scored = _scored(markets, slotted, rates, keys, market, temperature)
    df = resolution.resolve_coverage(scored, keys, market, national, actual, calibration)
    outside = national.join(national.dropna(subset=keys).select(*keys, "game"), [*keys, "game"], "left_anti")
    alone = resolution.score_market_games(markets, outside.select(*keys, F.array("game").alias("games")), market)
    alone = alone.withColumn("ranked", F.transform("games", lambda g: F.struct(g.alias("game"), F.lit(1.0).alias("p")))).drop("games")
    none = actual.limit(0)
    everywhere = resolution.resolve_coverage(alone, keys, market, outside.limit(0), none)
    return df.unionByName(everywhere.withColumn("source", F.lit("national")).withColumn("own_p", F.lit(1.0)))


def coverage_rollup(markets: DataFrame, schedule: DataFrame, rates: DataFrame, keys: list[str], market: str, actual: DataFrame, margin: float = resolution.MARGIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per game, markets led per game, toss-ups) over all markets."""
    flat = written(game_probabilities(markets, schedule, rates, keys, market, actual))
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("np"), "game")))
    scored = flat.groupBy(*keys, market).agg(pairs.alias("_r"), F.bool_or("confirmed").alias("confirmed"))
    scored = scored.withColumn("ranked", F.transform("_r", lambda x: F.struct(x["game"].alias("game"), (-x["np"]).alias("p")))).drop("_r")
    scored = written(scored)
    games = flat.groupBy(*keys).agg(F.sort_array(F.collect_set("game")).alias("games"))
    return resolution.market_rollup(scored, keys), resolution.leader_footprint(scored, games, keys), resolution.tossup_count(scored, margin)
