"""What each market sees: known, certain or predicted, and rollups by game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import BANDS, PRIOR, apply_calibration, band, game_score, softmax
from ..functions.text import game_teams, split_window_marker

#: Default temperature, margin of a toss-up, networks seen everywhere over the air.
TEMPERATURE, MARGIN = 12.0, 0.12
OTA = ("CBS", "FOX", "NBC", "ABC", "ESPN/ABC")


def national_broadcast(schedule: DataFrame, window: str = "slot") -> DataFrame:
    """Add ``national``: over the air, in no regional window, and alone at its time."""
    alone = F.count("*").over(Window.partitionBy("broadcast", "date", "time")) <= 1
    return schedule.withColumn("national", F.col("broadcast").isin(*OTA) & F.col(window).isNull() & alone)


def competing_games(schedule: DataFrame, keys: list[str], game: str = "game") -> DataFrame:
    """Games of each week and slot, sorted (bounded by the slot's schedule)."""
    return schedule.groupBy(*keys).agg(F.sort_array(F.collect_set(game)).alias("games"))


def score_market_games(markets: DataFrame, games: DataFrame, market: str, block: int = 1000) -> DataFrame:
    """Every market with every slot's games as one array row each: the grid is as large as its
    answer, and competitors stay together.

    Markets travel as arrays of about ``block`` names; a slot meets each block by its number,
    so the blocks are dealt over all tasks, however many markets there are.
    """
    names = markets.select(market).distinct()
    blocks = -(-names.count() // block) or 1
    held = names.groupBy(F.pmod(F.xxhash64(market), F.lit(blocks)).cast("int").alias("_block")).agg(F.collect_list(market).alias("_names"))
    dealt = games.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.join(held, "_block").withColumn(market, F.explode("_names")).drop("_block", "_names")


def attach_rates(rows: DataFrame, rates: DataFrame, market: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rates``: the map of team to rate of (``by``, market), null where nothing is known.

    A market's rates are as many as its teams, so a row meets them in one join.
    """
    on = [*by, market]
    known = rates.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("team", "rate"))).alias("rates"))
    return rows.join(known, on, "left")


def rates_of(game: Column, rates: Column, prior: float = PRIOR) -> Column:
    """Rates of a game's teams; ``prior`` for those unknown."""
    return F.transform(game_teams(game), lambda t: F.coalesce(F.try_element_at(rates, t), F.lit(prior)))


def scored_games(grid: DataFrame, rates: DataFrame, keys: list[str], market: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Per market and slot: games with probabilities, ranked (ties of 12 digits by name).

    Keys that ``rates`` has too, such as the season, choose the rates. A game without a team
    scores the prior.
    """
    g = attach_rates(grid, rates, market, tuple(k for k in keys if k in rates.columns))
    score = lambda x: F.coalesce(game_score(rates_of(x, F.col("rates"))), F.lit(PRIOR))
    g = g.withColumn("p", softmax(F.transform("games", score), temperature))
    g = g.withColumn("r", F.array_sort(F.zip_with("games", "p", lambda game, p: F.struct((-F.round(p, 12)).alias("np"), game.alias("game")))))
    return g.select(*keys, market, F.transform("r", lambda x: F.struct(x["game"].alias("game"), (-x["np"]).alias("p"))).alias("ranked"))


def own_probability(game: Column, ranked: Column) -> Column:
    """The probability of ``game`` itself among the ranked ones; 0 if it is not there."""
    return F.coalesce(F.get(F.filter(ranked, lambda r: r["game"] == game), F.lit(0))["p"], F.lit(0.0))


def leader_and_alternatives(scored: DataFrame, calibration: list[tuple[float, float]] | None = None, k: int = 2) -> DataFrame:
    """For each asked game of a market and slot: the best game and its calibrated confidence,
    the asked game's own probability and the band that follows from it, the next ``k`` games."""
    first = F.get("ranked", 0)
    asked = scored.withColumn("game", F.explode(F.transform("ranked", lambda r: r["game"])))
    own = own_probability(F.col("game"), F.col("ranked"))
    return asked.select(
        *[c for c in asked.columns if c != "ranked"],
        first["game"].alias("leader"),
        (apply_calibration(first["p"], calibration) if calibration else first["p"]).alias("confidence"),
        own.alias("own_p"),
        band(own).alias("band"),
        F.slice("ranked", 2, k).alias("alternatives"),
    )


def resolve_coverage(scored: DataFrame, keys: list[str], market: str, national: DataFrame, actual: DataFrame, calibration: list[tuple[float, float]] | None = None) -> DataFrame:
    """For each game that a market may ask for: who says what the market sees, and how surely.

    In order: ``national`` (rows of keys and game: seen everywhere), ``actual`` (rows of keys,
    market and game, with ``confidence`` where it is uncertain), ``certain`` (the only game of
    its slot), ``predicted`` (the best of ``scored``). Adds ``source``, ``seen``, ``confident``,
    ``confidence``, ``own_p`` (of the asked game, where it is predicted or national),
    ``alternatives``; ``local`` if the asked game is the one seen, window markers aside; ``band``
    of the asked game: from its own probability where it is predicted, else certain or maybe if
    it is local and unlikely if not; ``possibly_local`` if it is not local but maybe or possibly.
    """
    on = [*keys, market]
    seen = actual.select(*on, F.col("game").alias("_actual"), (F.col("confidence") if "confidence" in actual.columns else F.lit(None).cast("double")).alias("_sure"))
    cells = scored.join(seen, on, "left").withColumn("_n", F.size("ranked")).withColumn("_best", F.get("ranked", 0)["p"])
    df = leader_and_alternatives(cells, calibration)
    df = df.join(national.select(*keys, "game", F.lit(True).alias("_national")).distinct(), [*keys, "game"], "left")
    source = F.when(F.col("_national"), "national").when(F.col("_actual").isNotNull(), "actual").when(F.col("_n") == 1, "certain").otherwise("predicted")
    df = df.withColumn("source", source)
    is_from = lambda name: F.col("source") == name
    df = df.withColumn("seen", F.when(is_from("national"), F.col("game")).when(is_from("actual"), F.col("_actual")).otherwise(F.col("leader")))
    bare = lambda c: F.trim(split_window_marker(F.col(c))["game"])
    df = df.withColumn("local", bare("seen") == bare("game"))
    df = df.withColumn("confident", F.when(is_from("actual"), F.col("_sure").isNull()).when(is_from("predicted"), F.col("_best") >= BANDS[0][0]).otherwise(True))
    df = df.withColumn("confidence", F.when(is_from("actual"), F.coalesce("_sure", F.lit(1.0))).when(is_from("predicted"), F.col("confidence")).otherwise(1.0))
    told = F.when(~F.col("local"), "unlikely").when(F.col("confident"), "certain").otherwise("maybe")
    df = df.withColumn("band", F.when(is_from("predicted"), F.col("band")).otherwise(told))
    df = df.withColumn("own_p", F.when(is_from("predicted"), F.col("own_p")).when(is_from("national"), F.lit(1.0)))
    df = df.withColumn("alternatives", F.when(is_from("predicted"), F.col("alternatives")).otherwise(F.slice("alternatives", 1, 0)))
    df = df.withColumn("possibly_local", ~F.col("local") & F.col("band").isin("maybe", "possibly"))
    return df.select(*on, "game", "source", "seen", "local", "band", "possibly_local", "confident", "confidence", "own_p", "alternatives")


def lead_margin(scored: DataFrame) -> DataFrame:
    """Add ``margin`` of the best over the next; 1 where there is no next."""
    p = lambda i: F.get("ranked", i)["p"]
    return scored.withColumn("margin", p(0) - F.coalesce(p(1), F.lit(0.0)))


def market_rollup(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per game: markets, markets with p of a half or more, any confirmed."""
    flat = scored.select(*keys, "confirmed", F.explode("ranked").alias("r"))
    return flat.groupBy(*keys, F.col("r.game").alias("game")).agg(F.count("*").alias("markets"), F.count_if(F.col("r.p") >= 0.5).alias("likely"), F.bool_or("confirmed").alias("any_confirmed"))


def leader_footprint(scored: DataFrame, games: DataFrame, keys: list[str]) -> DataFrame:
    """Markets that each game leads, zero for those that lead none."""
    led = scored.groupBy(*keys, F.get("ranked", 0)["game"].alias("game")).agg(F.count("*").alias("led"))
    every = games.select(*keys, F.explode("games").alias("game")).distinct()
    return every.join(led, [*keys, "game"], "left").withColumn("led", F.coalesce("led", F.lit(0)))


def tossup_count(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    """One row: unconfirmed cells whose two best games are closer than ``margin``."""
    df = lead_margin(scored)
    return df.agg(F.count_if(~F.col("confirmed") & (F.size("ranked") > 1) & (F.col("margin") < margin)).alias("tossups"), F.count("*").alias("cells"))
