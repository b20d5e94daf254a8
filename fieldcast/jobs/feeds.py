"""Nested feeds to flat tables: odds (C9), projections (C10), players (C11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.collections import first_match, first_present
from ..functions.text import injury_label
from ..operators import basic, consensus, projections

ODDS = (
    "id string, commence_time string, away_team string, home_team string, bookmakers array<struct<last_update:string,"
    "markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
)
PLAYERS = "player struct<fullName:string,defaultPositionId:int,proTeamId:int,injuryStatus:string,stats:array<struct<statSourceId:int,scoringPeriodId:int,appliedTotal:double>>>"


def odds_consensus(raw: DataFrame, teams: DataFrame) -> DataFrame:
    """One row per event whose teams are known: medians of spread, total and moneyline.

    ``teams``: name, code. Both sides' points of a total are one pool; the first outcome of
    a name counts. Market updates and book updates make the last one.
    """
    df = basic.map_codes(basic.map_codes(raw.withColumns({"away": F.col("away_team"), "home": F.col("home_team")}), "away", teams, "name", "code"), "home", teams, "name", "code")
    books = df.select("id", "away_team", "home_team", F.explode_outer("bookmakers").alias("b"))
    rows = books.select("id", "away_team", "home_team", F.col("b.last_update").alias("bu"), F.explode_outer("b.markets").alias("m"))
    pick = lambda key, name, field: F.when(F.col("m.key") == key, consensus.outcome_named(F.col("m.outcomes"), name)[field])
    a, h = F.col("away_team"), F.col("home_team")
    med = lambda key, name, field: consensus.consensus_median(pick(key, name, field))
    agg = rows.groupBy("id").agg(
        F.struct(med("spreads", a, "point").alias("away_point"), med("spreads", a, "price").alias("away_price"), med("spreads", h, "point").alias("home_point"), med("spreads", h, "price").alias("home_price")).alias("spread"),
        F.struct(med("totals", "Over", "price").alias("over_price"), med("totals", "Under", "price").alias("under_price")).alias("_t"),
        F.struct(med("h2h", a, "price").alias("away"), med("h2h", h, "price").alias("home")).alias("moneyline"),
        consensus.last_update(F.col("bu"), F.col("m.last_update")).alias("last_update"),
    )
    point = consensus.pooled_total(rows, ["id"], pick("totals", "Over", "point"), pick("totals", "Under", "point"))
    out = df.select("id", "commence_time", "away", "home", consensus.books_count(F.col("bookmakers")).alias("books_count")).join(agg, "id").join(point, "id", "left")
    total = F.struct("point", F.col("_t.over_price").alias("over_price"), F.col("_t.under_price").alias("under_price"))
    return out.select(F.col("id").alias("event_id"), F.to_timestamp("commence_time").alias("commence_time"), "away", "home", "spread", total.alias("total"), "moneyline", "books_count", F.to_timestamp("last_update").alias("last_update"))


def projection_feed(raw: DataFrame, teams: DataFrame, positions: DataFrame, min_depth: dict[str, int] | None = None, cap: int = projections.CAP) -> DataFrame:
    """Ranked and trimmed projections: ``raw`` has week, ord and the players array's fields.

    Ranks come from the whole pool; zero rows, and team-weeks with nothing but DEF, go
    afterwards; then each team-week is trimmed.
    """
    p = F.col("player")
    hit = first_match(p["stats"], lambda s: (s["statSourceId"] == 1) & (s["scoringPeriodId"] == F.col("week")))
    df = raw.select("week", "ord", p["fullName"].alias("name"), p["proTeamId"].cast("string").alias("team"), p["defaultPositionId"].cast("string").alias("position"), injury_label(p["injuryStatus"]).alias("injury_status"), F.round(hit["appliedTotal"], 1).alias("points"))
    df = basic.map_codes(basic.map_codes(df.filter("points is not null and name <> ''"), "team", teams, "id", "code"), "position", positions, "id", "code")
    df = projections.position_rank(df, ["week"], "position", "points", ["ord"])
    df = projections.team_week_has_skill(projections.drop_zero(df, "points"), ["week", "team"], "position")
    return projections.depth_trim(df, ["week", "team"], "position", "points", "name", min_depth, cap, ("ord",))


def player_dictionary(raw: DataFrame, aliases: DataFrame, positions: list[str], team_names: DataFrame) -> DataFrame:
    """id, name, position, team of the wanted positions; a defence is named after its team.

    ``raw``: id, position, team, full_name, first_name, last_name. ``aliases``: alias, code.
    ``team_names``: code, name.
    """
    df = raw.filter(F.col("position").isin(*positions) & (F.coalesce("team", F.lit("")) != ""))
    df = basic.map_codes(df, "team", aliases, "alias", "code", drop_unmapped=False)
    df = df.join(basic.small(team_names.select(F.col("code").alias("team"), F.col("name").alias("_team"))), "team", "left")
    name = F.when(F.col("position") == "DEF", F.col("_team")).otherwise(first_present(F.col("full_name"), F.concat_ws(" ", "first_name", "last_name")))
    return df.select("id", name.alias("name"), "position", "team").filter("name <> ''")
