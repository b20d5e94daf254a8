"""Names to players, rosters to line-ups, line-ups to matchups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.collections import first_present, let
from .basic import small, top_k_per_group
from .cuts import written
from .ordering import number_rows
from .snapshots import best_row

#: Starting slots in their order with the positions that may fill them; bench slots follow.
SLOTS = [
    ("QB", ["QB"]), ("RB1", ["RB"]), ("RB2", ["RB"]), ("WR1", ["WR"]), ("WR2", ["WR"]), ("TE", ["TE"]),
    ("FLEX", ["RB", "WR", "TE"]), ("K", ["K"]), ("DEF", ["DEF"]),
]
BENCH = 6
#: Length of the substrings that names are indexed by.
GRAM = 3


def roster_week(projections: DataFrame, roster: DataFrame, week: int, key: str = "name_key") -> DataFrame:
    return projections.filter(F.col("week") == week).join(roster.select(key).distinct(), key, "left_semi")


def roster_game(rows: DataFrame, away: str, home: str, team: str = "team") -> DataFrame:
    return rows.filter(F.col(team).isin(away, home))


def week_entry(names: DataFrame, projections: DataFrame, key: str = "name_key", ord_cols: tuple[str, ...] = ("ord",)) -> DataFrame:
    """``names`` (key, week) with the first feed row of each, or nulls."""
    first = best_row(projections, [key, "week"], [F.col(c) for c in ord_cols])
    return names.join(first, [key, "week"], "left")


def import_roster(ids: DataFrame, dictionary: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found names in order, unknown ids, names without a projection).

    ``ids``: id, pos; ``dictionary``: id, name, name_key; ``known``: name_key. Of ids that
    come twice the first place counts.
    """
    first = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    named = first.join(dictionary.select("id", "name", "name_key"), "id", "left")
    unknown = named.filter(F.col("name").isNull()).select("id", "pos")
    named = named.filter(F.col("name").isNotNull())
    keys = known.select("name_key").distinct()
    return named.join(keys, "name_key", "left_semi"), unknown, named.join(keys, "name_key", "left_anti").select("id", "name")


def rosters_with_owner(rosters: DataFrame, users: DataFrame) -> DataFrame:
    """Rosters with their team's name; placeholder ids ``0`` and empty ones removed."""
    u = users.select(F.col("user_id").alias("owner_id"), "team_name", "display_name")
    df = rosters.join(u, "owner_id", "left")
    name = F.coalesce(F.nullif(first_present(F.col("team_name"), F.col("display_name")), F.lit("")), F.concat(F.lit("Roster "), F.col("roster_id").cast("string")))
    clean = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "0") & (x != ""))
    return df.select("roster_id", "owner_id", name.alias("name"), clean("starters").alias("starters"), clean("players").alias("players"))


def grams(text: Column, size: Column | int) -> Column:
    """Distinct substrings of ``size`` characters; empty for shorter texts."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    made = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))
    return F.when(F.length(text) >= size, made).otherwise(F.array().cast("array<string>"))


def query_grams(queries: DataFrame) -> DataFrame:
    """(query, gram): the grams of ``GRAM`` characters of each query, or itself if it is shorter."""
    q = queries.select("query").filter("query <> ''").distinct()
    return q.withColumn("gram", F.explode(grams(F.col("query"), F.least(F.length("query"), F.lit(GRAM)))))


def gram_index(keys: DataFrame, key: str = "name_key", queries: DataFrame | None = None) -> DataFrame:
    """(gram, key): every key under each of its substrings of one to ``GRAM`` characters, or with
    ``queries`` under those alone that :func:`containing` may look up for them.

    Written once; a key has at most ``GRAM`` times its length rows.
    """
    names = keys.select(key).filter(F.length(key) > 0).distinct()
    every = F.flatten(F.array(*[grams(F.col(key), n) for n in range(1, GRAM + 1)]))
    index = names.select(F.explode(every).alias("gram"), key)
    if queries is not None:
        index = index.join(small(query_grams(queries).select("gram").distinct()), "gram", "left_semi")
    return written(index)


def gram_counts(index: DataFrame, key: str = "name_key") -> DataFrame:
    """(gram, n, only): how many keys hold a gram, and the least of them."""
    return index.groupBy("gram").agg(F.count("*").alias("n"), F.min(key).alias("only"))


def containing(queries: DataFrame, index: DataFrame, counts: DataFrame, key: str = "name_key") -> DataFrame:
    """(query, key): keys that contain the query's text.

    A query reads the keys of its rarest gram alone, so how its text begins does not matter; one
    with a gram that no key holds reads none. Queries of fewer characters are grams themselves.
    """
    weighed = query_grams(queries).join(counts.select("gram", "n"), "gram", "left")
    rarest = weighed.groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    pairs = rarest.select("query", F.col("least.gram").alias("gram")).join(index, "gram")
    return pairs.filter(F.contains(F.col(key), F.col("query"))).select("query", key)


def resolve_name(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query`` key -> ``name_key`` found: the same key, else the only key that contains it.

    What has no equal key is looked up in the gram index: short queries are answered by the
    counts, longer ones compare the keys of their rarest gram. Empty queries find nothing.
    """
    q = queries.select("query").filter("query <> ''").distinct()
    keys = index.select("name_key").distinct()
    exact = q.join(keys, q["query"] == keys["name_key"]).select("query", "name_key")
    rest = q.join(exact.select("query"), "query", "left_anti")
    held = gram_index(keys)
    counts = written(gram_counts(held))
    short = rest.filter(F.length("query") <= GRAM).join(counts.filter("n = 1"), F.col("query") == F.col("gram")).select("query", F.col("only").alias("name_key"))
    hits = containing(rest.filter(F.length("query") > GRAM), held, counts)
    one = hits.groupBy("query").agg(F.count("*").alias("n"), F.min("name_key").alias("name_key")).filter("n = 1").select("query", "name_key")
    return exact.unionByName(short).unionByName(one)


def suggest(queries: DataFrame, pool: DataFrame, rostered: DataFrame, k: int = 6) -> DataFrame:
    """For each ``query`` the ``k`` best free names with ``rank``: those that start with it, then
    those that contain it, each by points.

    ``pool``: name_key (unique), points. Each task keeps the best ``k`` of a query before they
    meet, however many names a short query hits.
    """
    free = pool.join(rostered.select("name_key").distinct(), "name_key", "left_anti")
    index = gram_index(free)
    hits = containing(queries, index, written(gram_counts(index))).join(free, "name_key")
    order = [F.desc(F.startswith("name_key", "query")), F.desc("points"), F.col("name_key")]
    return top_k_per_group(hits, ["query"], order, k)


def candidates_for(asks: DataFrame, pool: DataFrame, entries: DataFrame, placed: DataFrame, slots: list[tuple[str, list[str] | None]], k: int) -> DataFrame:
    """Players who may fill a slot, the ``k`` best of each ask with ``rank``: eligible by
    position, not placed in another slot of the roster, named like the query; by the points of
    the asked week (0 without an entry), then name.

    ``asks``: ask (unique), roster, slot, query ('' asks for all), week; ``pool``: name_key
    (unique), position; ``entries``: name_key, week, points, ord (the first row of a week
    counts); ``placed``: roster, slot, name_key. Asks that differ in nothing else are answered
    once. Names are ranked once for each query, week and position asked for, over any number of
    tasks; an ask meets the first of them, as many as ``k`` and its roster's players of that
    position, since no more can be in another slot.
    """
    table = F.array(*[F.struct(F.lit(i).alias("id"), (F.array(*map(F.lit, p)) if p is not None else F.lit(None).cast("array<string>")).alias("positions")) for i, p in slots])
    slot = F.get(F.filter(table, lambda x: x["id"] == F.col("slot")), F.lit(0))
    alike = lambda *columns: reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    pool, placed = written(pool), written(placed)
    names = pool.select("name_key", "position")

    of = ["roster", "slot", "query", "week"]
    kinds = asks.select(*of).distinct().withColumn("_can", slot).filter("_can is not null")
    fits = F.col("_can.positions").isNull() | F.array_contains("_can.positions", F.col("position"))
    kinds = kinds.join(F.broadcast(names.select("position").distinct()), fits)  # positions of a game
    held = placed.join(names, "name_key").groupBy(F.col("roster").alias("_roster"), F.col("position").alias("_position")).agg(F.count("*").alias("_held"))
    kinds = kinds.join(held, (F.col("roster") == F.col("_roster")) & alike("position"), "left")
    kinds = written(kinds.select(*of, "position", (F.coalesce("_held", F.lit(0)) + k).alias("most")))

    lists = kinds.groupBy(*[F.col(c).alias(f"_{c}") for c in ("query", "week", "position")]).agg(F.max("most").alias("_most"))
    index = gram_index(names, queries=kinds)
    hits = containing(kinds, index, written(gram_counts(index))).join(names, "name_key").unionByName(names.withColumn("query", F.lit("")))
    hits = hits.join(small(lists), (F.col("query") == F.col("_query")) & alike("position")).select("query", F.col("_week").alias("week"), "position", "name_key", "_most")
    hits = written(week_entry(hits, entries.select("name_key", "week", "points", "ord")).select(*hits.columns, F.coalesce("points", F.lit(0.0)).alias("points")))
    ranked = number_rows(hits, ["query", "week", "position"], [F.desc("points"), F.asc("name_key")], name="place").filter("place <= _most")

    best = ranked.select(*[F.col(c).alias(f"_{c}") for c in ("query", "week", "position", "place")], "name_key", "points")
    places = kinds.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), "most")))
    free = places.join(best, alike("query", "week", "position", "place"))
    elsewhere = placed.select(F.col("roster").alias("_r"), F.col("slot").alias("_s"), F.col("name_key").alias("_k"))
    free = free.join(elsewhere, (F.col("roster") == F.col("_r")) & (F.col("name_key") == F.col("_k")) & (F.col("slot") != F.col("_s")), "left_anti")
    best = top_k_per_group(free, of, [F.desc("points"), F.col("name_key")], k).select(*[F.col(c).alias(f"_{c}") for c in of], "name_key", "points", "rank")
    return asks.join(best, alike(*of)).select("ask", "roster", "slot", "name_key", "points", "rank")


def line_up(players: Column, slots: list[tuple[str, list[str]]]) -> Column:
    """Map of a player's place to the slot taken: in slot order, each takes the first player of
    the sorted array ``players`` (structs with ``position``) who is eligible and unused."""
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, p)).alias("positions")) for i, p in slots])
    open_ = F.transform(players, lambda p, i: F.struct(i.alias("i"), p["position"].alias("position")))
    start = F.struct(open_.alias("open"), F.array().cast("array<struct<i:int,slot:string>>").alias("taken"))

    def fill(state: Column, slot: Column) -> Column:
        pick = F.get(F.filter(state["open"], lambda p: F.array_contains(slot["positions"], p["position"])), F.lit(0))

        def put(p: Column) -> Column:
            rest = F.filter(state["open"], lambda x: x["i"] != p["i"])
            one = F.array(F.struct(p["i"].alias("i"), slot["id"].alias("slot")))
            return F.when(p.isNull(), state).otherwise(F.struct(rest.alias("open"), F.concat(state["taken"], one).alias("taken")))

        return let(pick, put)

    return F.map_from_entries(F.aggregate(table, start, fill, lambda s: s["taken"]))


def auto_assign(players: DataFrame, roster: str = "roster_id", bench: int = BENCH, slots: list[tuple[str, list[str]]] = SLOTS) -> DataFrame:
    """Add ``slot``: the slots of every roster filled in their order, best points first (ties by
    ``ord``), from any table of slots and eligible positions; the bench takes the rest in order.

    A roster is a bounded group: its players are one array, folded over the slots.
    """
    each = F.struct((-F.coalesce("points", F.lit(0.0))).alias("_np"), "ord", "position", F.struct(*[c for c in players.columns if c != roster]).alias("_row"))
    held = players.groupBy(roster).agg(F.array_sort(F.collect_list(each)).alias("_players"))
    held = held.withColumn("_taken", line_up(F.col("_players"), slots))
    flat = held.select(roster, "_taken", F.posexplode("_players").alias("_i", "_p"))
    rows = flat.select(F.col(roster), *[F.col("_p._row").getField(c).alias(c) for c in players.columns if c != roster], F.try_element_at("_taken", F.col("_i")).alias("slot"))
    return bench_order(rows.select(*players.columns, "slot"), roster, bench)


def bench_order(df: DataFrame, roster: str, bench: int = BENCH) -> DataFrame:
    """Number those without a slot by points into the bench slots; the rest keep none."""
    open_ = F.col("slot").isNull()
    rank = F.row_number().over(Window.partitionBy(roster, open_).orderBy(F.desc("points"), "ord"))
    return df.withColumn("_br", rank).withColumn("slot", F.when(open_ & (F.col("_br") <= bench), F.concat(F.lit("BN"), F.col("_br").cast("string"))).otherwise(F.col("slot"))).drop("_br")


def weekly_matchup(mine: DataFrame, theirs: DataFrame, slots: DataFrame) -> DataFrame:
    """Slot by slot: both sides' players and points (0 without a projection); no rows unless
    both sides have a player. Inputs: pair, slot, name, points."""
    a = mine.select("pair", "slot", F.col("name").alias("mine"), F.coalesce("points", F.lit(0.0)).alias("my_points"))
    b = theirs.select("pair", "slot", F.col("name").alias("theirs"), F.coalesce("points", F.lit(0.0)).alias("their_points"))
    pairs = a.select("pair").distinct().join(b.select("pair").distinct(), "pair")
    grid = pairs.join(F.broadcast(slots.select("slot")))  # a fixed table of some 15 slots
    return grid.join(a, ["pair", "slot"], "left").join(b, ["pair", "slot"], "left").withColumn("my_points", F.coalesce("my_points", F.lit(0.0))).withColumn("their_points", F.coalesce("their_points", F.lit(0.0)))


def matchup_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair").agg(F.sum("my_points").alias("my_total"), F.sum("their_points").alias("their_total"))
