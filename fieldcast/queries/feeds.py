"""Quotes, projections, names, rosters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import name_key
from ..operators import basic, consensus, projections, rosters
from ..operators.cuts import written
from .registry import cte, query, table, view


@query(f"WITH {cte('quotes')} SELECT event, round(median(price), 2) AS price FROM quotes GROUP BY event")
def a10_consensus_median(spark, sf_dir):
    return view(spark, sf_dir, "quotes").groupBy("event").agg(consensus.consensus_median(F.col("price")).alias("price"))


_HOT = "CASE WHEN event % 3 = 0 THEN 0 ELSE event END"


@query(f"WITH {cte('quotes')}, q AS (SELECT {_HOT} AS event, price, point FROM quotes), pool AS (SELECT event, point AS p FROM q UNION ALL SELECT event, price FROM q) SELECT event, round(median(p), 2) AS middle FROM pool GROUP BY event")
def a10_a11_hot_event(spark, sf_dir):
    """Prices and points in one pool; one event holds a third of all quotes."""
    q = view(spark, sf_dir, "quotes").withColumn("event", F.expr(_HOT))
    pool = q.select("event", F.explode(F.array("point", "price")).alias("p"))
    return consensus.consensus_medians(pool, ["event"], "p", "middle")


@query(f"WITH {cte('quotes')} SELECT event, round(median(p), 2) AS point FROM (SELECT event, point AS p FROM quotes UNION ALL SELECT event, CASE WHEN price IS NOT NULL THEN point + 1 END FROM quotes) GROUP BY event")
def a11_pooled_total(spark, sf_dir):
    q = view(spark, sf_dir, "quotes")
    return consensus.pooled_total(q, ["event"], F.col("point"), F.when(F.col("price").isNotNull(), F.col("point") + 1))


@query(f"WITH {cte('quotes')} SELECT event, count(DISTINCT book) AS books_count, greatest(max(updated), max(CASE WHEN point > 25 THEN updated END)) AS last_update FROM quotes GROUP BY event")
def a12_books_last_update(spark, sf_dir):
    q = view(spark, sf_dir, "quotes")
    return q.groupBy("event").agg(F.size(F.collect_set("book")).cast("long").alias("books_count"), consensus.last_update(F.col("updated"), F.when(F.col("point") > 25, F.col("updated"))).alias("last_update"))


@query(
    f"""WITH {cte('quotes')}, o AS (SELECT event, side, price, row_number() OVER (PARTITION BY event, side ORDER BY book, l_orderkey, coalesce(price, -1), point) AS r FROM quotes)
    SELECT e.event, a.price AS a_price, n.price AS n_price FROM (SELECT DISTINCT event FROM quotes) e LEFT JOIN o a ON a.event = e.event AND a.side = 'A' AND a.r = 1 LEFT JOIN o n ON n.event = e.event AND n.side = 'N' AND n.r = 1"""
)
def j19_explode_outcomes(spark, sf_dir):
    q = view(spark, sf_dir, "quotes").withColumn("np", F.coalesce("price", F.lit(-1.0)))
    books = q.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("book", "l_orderkey", "np", "point", F.col("side").alias("name"), "price"))).alias("o"))
    return books.select("event", consensus.outcome_named(F.col("o"), "A")["price"].alias("a_price"), consensus.outcome_named(F.col("o"), "N")["price"].alias("n_price"))


PROJ = cte("projections")
RANKED = f"{PROJ}, ranked AS (SELECT *, row_number() OVER (PARTITION BY week, position ORDER BY points DESC, team, name) AS rank FROM projections)"


def _proj(spark, sf_dir):
    return view(spark, sf_dir, "projections")


@query(f"WITH {RANKED} SELECT week, team, position, name, points, rank, position || rank AS position_rank FROM ranked")
def w2_position_rank(spark, sf_dir):
    return projections.position_rank(_proj(spark, sf_dir), ["week"], "position", "points", ["team", "name"])


@query(f"WITH {RANKED} SELECT week, team, position, name, rank FROM ranked WHERE points > 0")
def p6_drop_zero(spark, sf_dir):
    df = projections.position_rank(_proj(spark, sf_dir), ["week"], "position", "points", ["team", "name"])
    return projections.drop_zero(df, "points").select("week", "team", "position", "name", "rank")


@query(f"WITH {PROJ} SELECT week, team, position, name FROM projections p WHERE (SELECT bool_or(position <> 'ECONOMY') FROM projections q WHERE q.week = p.week AND q.team = p.team)")
def a24_team_week_has_skill(spark, sf_dir):
    return projections.team_week_has_skill(_proj(spark, sf_dir), ["week", "team"], "position", lone="ECONOMY").select("week", "team", "position", "name")


DEPTH = {"ECONOMY": 2, "STANDARD": 3, "SMALL": 1}


@query(
    f"""WITH {PROJ}, a AS (SELECT *, row_number() OVER (PARTITION BY week, team, position ORDER BY points DESC, name) AS k FROM projections),
    b AS (SELECT *, row_number() OVER (PARTITION BY week, team ORDER BY CASE WHEN k <= CASE position WHEN 'ECONOMY' THEN 2 WHEN 'STANDARD' THEN 3 WHEN 'SMALL' THEN 1 ELSE 0 END THEN 0 ELSE 1 END, points DESC, name) AS i FROM a)
    SELECT week, team, position, name, points FROM b WHERE i <= 8"""
)
def w4_depth_trim(spark, sf_dir):
    return projections.depth_trim(_proj(spark, sf_dir), ["week", "team"], "position", "points", "name", DEPTH, cap=8)


@query(f"WITH {PROJ} SELECT count(*) AS n_rows, string_agg(DISTINCT lpad(week::VARCHAR, 2, '0'), ',' ORDER BY lpad(week::VARCHAR, 2, '0')) AS weeks FROM projections")
def a28_payload_counts(spark, sf_dir):
    df = _proj(spark, sf_dir).withColumn("week", F.lpad(F.col("week").cast("string"), 2, "0"))
    return basic.payload_counts(df).withColumn("weeks", F.array_join("weeks", ","))


PLAYERS = f"{PROJ}, players AS (SELECT week, team, position, 'p' || name AS name_key, points, row_number() OVER (PARTITION BY name ORDER BY week DESC, points DESC, team) AS r FROM projections), pool AS (SELECT * EXCLUDE (r) FROM players WHERE r = 1)"


def _pool(spark, sf_dir):
    from ..operators.snapshots import best_row

    df = _proj(spark, sf_dir).select("week", "team", "position", F.concat(F.lit("p"), F.col("name").cast("string")).alias("name_key"), "points")
    return df, best_row(df, ["name_key"], [-F.col("week"), -F.col("points"), F.col("team")])


_ASKED = "(SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'p' || s_suppkey WHEN 1 THEN 'p' || s_suppkey % 10 ELSE '' || s_suppkey % 100 END AS query FROM supplier)"


def _asked(spark, sf_dir):
    k = F.col("s_suppkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("p"), (k % 10).cast("string"))).otherwise((k % 100).cast("string"))
    return table(spark, sf_dir, "supplier").select(text.alias("query"))


@query(
    f"""WITH {PLAYERS}, free AS (SELECT name_key, points FROM pool WHERE position <> 'PROMO'), hit AS (SELECT query, name_key, points FROM {_ASKED} q JOIN free ON contains(name_key, query))
    SELECT query, name_key, points, row_number() OVER (PARTITION BY query ORDER BY starts_with(name_key, query) DESC, points DESC, name_key) AS rank FROM hit QUALIFY rank <= 6"""
)
def t1_suggest(spark, sf_dir):
    """Every supplier's number as typed text: names that start with it, then those that hold it."""
    _, pool = _pool(spark, sf_dir)
    taken = pool.filter("position = 'PROMO'")
    return rosters.suggest(_asked(spark, sf_dir), pool.select("name_key", "points"), taken).select("query", "name_key", "points", "rank")


_ASKS = "(SELECT s_suppkey AS ask, CAST(s_suppkey % 50 AS INT) AS roster, CASE s_suppkey % 3 WHEN 0 THEN 'FLEX' WHEN 1 THEN 'QB' ELSE 'BN1' END AS slot, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '' || s_suppkey % 40 END AS query, CAST(s_suppkey % 12 + 1 AS INT) AS week FROM supplier)"
_TABLE = [("QB", ["ECONOMY"]), ("FLEX", ["SMALL", "LARGE"]), ("BN1", None)]


@query(
    f"""WITH {PLAYERS}, placed AS (SELECT CAST(substr(name_key, 2)::INT % 50 AS INT) AS roster, CASE WHEN substr(name_key, 2)::INT % 3 = 0 THEN 'QB' ELSE 'FLEX' END AS slot, name_key FROM pool WHERE points > 60 AND substr(name_key, 2)::INT % 7 = 0),
    first AS (SELECT name_key, week, points FROM players QUALIFY row_number() OVER (PARTITION BY name_key, week ORDER BY team, points) = 1),
    hit AS (SELECT a.ask, a.roster, a.slot, p.name_key, coalesce(f.points, 0.0) AS points FROM {_ASKS} a JOIN pool p ON (a.slot = 'BN1' OR (a.slot = 'QB' AND p.position = 'ECONOMY') OR (a.slot = 'FLEX' AND p.position IN ('SMALL', 'LARGE'))) AND contains(p.name_key, a.query)
      LEFT JOIN first f ON f.name_key = p.name_key AND f.week = a.week
      WHERE NOT EXISTS (SELECT 1 FROM placed x WHERE x.roster = a.roster AND x.name_key = p.name_key AND x.slot <> a.slot))
    SELECT ask, roster, slot, name_key, points, row_number() OVER (PARTITION BY ask ORDER BY points DESC, name_key) AS rank FROM hit QUALIFY rank <= 5"""
)
def t2_candidates_for(spark, sf_dir):
    """Every supplier asks for a slot of its roster; every second one types a number.

    The feed is read once, for each player's first and best row of every week."""
    players, _ = _pool(spark, sf_dir)
    first, best = F.min_by("points", F.struct("team", "points")), F.min_by(F.struct("position", "points"), F.struct(-F.col("points"), "team"))
    weekly = written(players.groupBy("name_key", "week").agg(first.alias("points"), best.alias("best")))
    pool = written(weekly.groupBy("name_key").agg(F.max_by("best", "week").alias("best")).select("name_key", "best.*"))
    s, n = F.col("s_suppkey"), F.substring("name_key", 2, 20).cast("int")
    asks = table(spark, sf_dir, "supplier").select(s.alias("ask"), (s % 50).cast("int").alias("roster"), F.when(s % 3 == 0, "FLEX").when(s % 3 == 1, "QB").otherwise("BN1").alias("slot"), F.when(s % 2 == 0, "").otherwise((s % 40).cast("string")).alias("query"), (s % 12 + 1).cast("int").alias("week"))
    placed = pool.filter((F.col("points") > 60) & (n % 7 == 0)).select((n % 50).alias("roster"), F.when(n % 3 == 0, "QB").otherwise("FLEX").alias("slot"), "name_key")
    entries = weekly.withColumn("ord", F.lit(0))
    return rosters.candidates_for(asks, pool, entries, placed, _TABLE, 5).select("ask", "roster", "slot", "name_key", "points", "rank")


_SIX = "CASE position WHEN 'ECONOMY' THEN 'QB' WHEN 'STANDARD' THEN 'RB' WHEN 'SMALL' THEN 'WR' WHEN 'LARGE' THEN 'TE' WHEN 'MEDIUM' THEN 'K' ELSE 'DEF' END"


@query(
    f"""WITH {PROJ}, pl AS (SELECT week * 100 + team AS roster_id, {_SIX} AS position, name AS ord, points FROM projections),
    a AS (SELECT *, row_number() OVER (PARTITION BY roster_id, position ORDER BY points DESC, ord) AS pr FROM pl),
    b AS (SELECT *, CASE WHEN position IN ('RB', 'WR') AND pr <= 2 THEN position || pr WHEN position IN ('QB', 'TE', 'K', 'DEF') AND pr = 1 THEN position END AS s FROM a),
    c AS (SELECT *, s IS NULL AND position IN ('RB', 'WR', 'TE') AS fx FROM b),
    d AS (SELECT *, CASE WHEN fx AND row_number() OVER (PARTITION BY roster_id, fx ORDER BY points DESC, ord) = 1 THEN 'FLEX' ELSE s END AS s2 FROM c),
    e AS (SELECT *, row_number() OVER (PARTITION BY roster_id, s2 IS NULL ORDER BY points DESC, ord) AS br FROM d)
    SELECT roster_id, position, ord, points, CASE WHEN s2 IS NULL AND br <= 6 THEN 'BN' || br ELSE s2 END AS slot FROM e"""
)
def t4_w14_auto_assign(spark, sf_dir):
    df = _proj(spark, sf_dir).select((F.col("week") * 100 + F.col("team")).alias("roster_id"), F.expr(_SIX).alias("position"), F.col("name").alias("ord"), "points")
    return rosters.auto_assign(df)


_LINE_UP = [("QB", ["QB"]), ("RB1", ["RB"]), ("FLEX1", ["RB", "WR", "TE"]), ("FLEX2", ["RB", "WR", "TE"]), ("SUPER", ["QB", "RB", "WR", "TE"]), ("K", ["K"])]


@query(
    f"""WITH RECURSIVE {PROJ}, pl AS (SELECT week * 100 + team AS roster_id, {_SIX} AS position, name AS ord, points FROM projections),
    p AS (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY points DESC, ord) AS r FROM pl),
    slots AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{k}', {e})" for i, (k, e) in enumerate(_LINE_UP))}) t(i, slot, eligible)),
    fold(roster_id, i, used, took) AS (
      SELECT DISTINCT roster_id, 0, []::BIGINT[], NULL::BIGINT FROM p
      UNION ALL
      SELECT f.roster_id, f.i + 1, CASE WHEN min(p.r) IS NULL THEN f.used ELSE list_append(f.used, min(p.r)) END, min(p.r)
      FROM fold f JOIN slots s ON s.i = f.i + 1 LEFT JOIN p ON p.roster_id = f.roster_id AND list_contains(s.eligible, p.position) AND NOT list_contains(f.used, p.r)
      GROUP BY f.roster_id, f.i, f.used),
    taken AS (SELECT f.roster_id, took AS r, slot FROM fold f JOIN slots s ON s.i = f.i WHERE took IS NOT NULL),
    st AS (SELECT p.*, slot FROM p LEFT JOIN taken USING (roster_id, r)),
    b AS (SELECT *, row_number() OVER (PARTITION BY roster_id, slot IS NULL ORDER BY points DESC, ord) AS br FROM st)
    SELECT roster_id, position, ord, points, CASE WHEN slot IS NULL AND br <= 4 THEN 'BN' || br ELSE slot END AS slot FROM b"""
)
def t4_flexible_slots(spark, sf_dir):
    """Two FLEX slots and a superflex that takes quarterbacks too."""
    df = _proj(spark, sf_dir).select((F.col("week") * 100 + F.col("team")).alias("roster_id"), F.expr(_SIX).alias("position"), F.col("name").alias("ord"), "points")
    return rosters.auto_assign(df, bench=4, slots=_LINE_UP)


@query(
    f"""WITH {PLAYERS}, mine AS (SELECT DISTINCT 'p' || l_partkey AS name_key FROM lineitem WHERE l_linenumber = 1)
    SELECT w.week, name_key, points, team FROM players w JOIN mine USING (name_key) WHERE team IN (week, week + 12)"""
)
def j13_j14_roster_rows(spark, sf_dir):
    """Every week of a roster that holds the parts of each order's first line; a week's game is
    between the teams of its number and twelve more."""
    df, _ = _pool(spark, sf_dir)
    roster = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name_key"))
    weeks = [rosters.roster_game(rosters.roster_week(df, roster, w), w, w + 12) for w in range(1, 13)]
    return basic.append_batches(*weeks).select("week", "name_key", "points", "team")


@query(
    f"""WITH {PLAYERS}, ask AS (SELECT 'p' || (c_custkey * 3) AS name_key, CAST(c_custkey % 12 + 1 AS INT) AS week FROM customer),
    first AS (SELECT name_key, week, points, team FROM players QUALIFY row_number() OVER (PARTITION BY name_key, week ORDER BY team, points) = 1)
    SELECT name_key, week, points, team FROM ask LEFT JOIN first USING (name_key, week)"""
)
def j20_week_entry(spark, sf_dir):
    df, _ = _pool(spark, sf_dir)
    k = F.col("c_custkey")
    ask = table(spark, sf_dir, "customer").select(F.concat(F.lit("p"), (k * 3).cast("string")).alias("name_key"), (k % 12 + 1).cast("int").alias("week"))
    return rosters.week_entry(ask, df, ord_cols=("team", "points")).select("name_key", "week", "points", "team")


@query(
    """WITH ids AS (SELECT o_custkey AS id, min(o_orderkey) AS pos FROM orders GROUP BY 1), dict AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 4 <> 0)
    SELECT ids.id, pos, CASE WHEN name IS NULL THEN 'unknown' WHEN ids.id % 6 = 1 THEN 'found' ELSE 'unprojected' END AS kind FROM ids LEFT JOIN dict ON ids.id = dict.id"""
)
def j15_import_roster(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("pos"))
    d = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), name_key(F.col("c_name")).alias("name_key"))
    known = d.filter("id % 6 = 1").select("name_key")
    found, unknown, bare = rosters.import_roster(ids, d, known)
    pos = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    return found.select("id", "pos", F.lit("found").alias("kind")).unionByName(unknown.select("id", "pos", F.lit("unknown").alias("kind"))).unionByName(bare.select("id").join(pos, "id").select("id", "pos", F.lit("unprojected").alias("kind")))


@query("SELECT o_orderkey AS roster_id, CASE WHEN c_custkey IS NULL THEN 'Roster ' || o_orderkey WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS name, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 's' || o_custkey END AS starters FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def j16_rosters_with_owner(spark, sf_dir):
    s = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("roster_id"), F.col("o_custkey").alias("owner_id"), F.array(F.lit("0"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(s)).alias("starters"), F.array(s).alias("players"))
    u = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("team_name"), F.col("c_name").alias("display_name"))
    return rosters.rosters_with_owner(r, u).select("roster_id", "name", F.array_join("starters", ",").alias("starters"))


@query(
    """WITH keys AS (SELECT DISTINCT 'customer' || lpad(c_custkey::VARCHAR, 9, '0') AS name_key FROM customer),
    q AS (SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN 'customer' || lpad(s_suppkey::VARCHAR, 9, '0') WHEN 1 THEN 'customer' || lpad((s_suppkey // 10)::VARCHAR, 8, '0') WHEN 2 THEN 'r0000' || s_suppkey WHEN 3 THEN '' || s_suppkey ELSE lpad(s_suppkey::VARCHAR, 4, '0') END AS query FROM supplier),
    ex AS (SELECT query, name_key FROM q JOIN keys ON query = name_key), sub AS (SELECT query, count(*) AS n, min(name_key) AS name_key FROM q JOIN keys ON contains(name_key, query) WHERE query NOT IN (SELECT query FROM ex) GROUP BY query)
    SELECT query, name_key FROM ex UNION ALL SELECT query, name_key FROM sub WHERE n = 1"""
)
def j17_resolve_name(spark, sf_dir):
    """Whole keys, keys without their last digit (all start alike), middles, ends."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer"), pad(F.col("c_custkey"), 9)).alias("name_key"))
    s, start = F.col("s_suppkey"), F.lit("customer")
    q = F.when(s % 5 == 0, F.concat(start, pad(s, 9))).when(s % 5 == 1, F.concat(start, pad(F.floor(s / 10), 8))).when(s % 5 == 2, F.concat(F.lit("r0000"), s.cast("string"))).when(s % 5 == 3, s.cast("string")).otherwise(pad(s, 4))
    return rosters.resolve_name(table(spark, sf_dir, "supplier").select(q.alias("query")), keys)


@query(
    """WITH m AS (SELECT o_custkey AS pair, CAST(o_orderkey % 3 AS INT) AS slot, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), t AS (SELECT o_custkey AS pair, CAST(o_orderkey % 3 AS INT) AS slot, max(o_totalprice) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
    pairs AS (SELECT DISTINCT m.pair FROM m JOIN t ON m.pair = t.pair), g AS (SELECT pair, slot FROM pairs CROSS JOIN (VALUES (0), (1), (2)) s(slot))
    SELECT g.pair, round(sum(coalesce(m.p, 0)), 2) AS my_total, round(sum(coalesce(t.p, 0)), 2) AS their_total FROM g LEFT JOIN m ON m.pair = g.pair AND m.slot = g.slot LEFT JOIN t ON t.pair = g.pair AND t.slot = g.slot GROUP BY g.pair"""
)
def j18_weekly_matchup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), (F.col("o_orderkey") % 3).cast("int").alias("slot"), F.col("o_orderkey").alias("k"), "o_totalprice")
    side = lambda r: o.filter(F.col("k") % 2 == r).groupBy("pair", "slot").agg(F.max("o_totalprice").alias("points"), F.lit("x").alias("name"))
    slots = spark.createDataFrame([(0,), (1,), (2,)], "slot int")
    df = rosters.matchup_totals(rosters.weekly_matchup(side(0), side(1), slots))
    return df.select("pair", F.round("my_total", 2).alias("my_total"), F.round("their_total", 2).alias("their_total"))
