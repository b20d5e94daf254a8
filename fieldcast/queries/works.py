"""Composite jobs and sources over data that Spark derives from the tables."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_game_text
from ..jobs import boundaries, feeds, maps
from ..operators import images
from ..operators.cuts import shared_path, written
from ..sources import readers, writers
from .compaction import IDX, MAJOR
from .registry import cte, query, table, view
from .voting import MAP, assignments

# ---- images: each map shows the nations as stripes of 8 by 16 pixels; a stripe has a hole of
# another colour (pixels 3 to 5 of lines 3 to 6) and ends in a third one (its last three lines)

PALETTE = {"red": "8181FF", "blue": "FFAC83", "green": "81FF81", "purple": "FF81C8", "yellow": "81FFFF"}  # blue, green, red bytes
_NAMES = list(PALETTE)
_SHOWN = "SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS season, CAST(month(l_shipdate) AS INT) AS week, CASE WHEN l_returnflag = 'N' THEN 'CBS' ELSE 'FOX' END AS net, l_linenumber AS rev FROM {lineitem}"
_HUE = "((n_nationkey * n_nationkey + week + rev + shift) % 5)"
_NAMED = "CASE {} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_HUED = _NAMED.format(_HUE.replace("shift", "0"))


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_SHOWN, lineitem=table(spark, sf_dir, "lineitem"))
    name = F.concat(F.col("week").cast("string"), F.lit("-"), "net", F.lit("-E-V"), F.col("rev").cast("string"), F.lit(".png"))
    return df.withColumn("url", F.concat(F.lit("http://h/"), name)).withColumn("origin", F.concat(F.col("season").cast("string"), F.lit("/"), name))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ks"))
    fills = F.array(*[F.lit(x) for x in PALETTE.values()])
    hue = lambda k, shift, n: F.repeat(F.element_at(fills, ((k * k + F.col("week") + F.col("rev") + shift) % 5 + 1).cast("int")), F.lit(n))
    line = lambda stripe: F.array_join(F.transform("ks", stripe), "")
    full, holed, last = line(lambda k: hue(k, 0, 8)), line(lambda k: F.concat(hue(k, 0, 3), hue(k, 2, 3), hue(k, 0, 2))), line(lambda k: hue(k, 1, 8))
    pixels = F.concat(F.repeat(full, F.lit(3)), F.repeat(holed, F.lit(4)), F.repeat(full, F.lit(6)), F.repeat(last, F.lit(3)))
    df = _shown(spark, sf_dir).join(F.broadcast(nations))  # one row
    return df.select("origin", (8 * F.size("ks")).alias("width"), F.lit(16).alias("height"), F.unhex(pixels).alias("data"))


def _png(frames):
    for frame in frames:
        files = []
        for width, height, data in zip(frame["width"], frame["height"], frame["data"]):
            rgb = bytearray(data)
            rgb[0::3], rgb[2::3] = data[2::3], data[0::3]
            raw = b"".join(b"\0" + rgb[i * 3 * width : (i + 1) * 3 * width] for i in range(height))
            chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
            files.append(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
        yield pd.DataFrame({"name": frame["origin"], "content": files})


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame, DataFrame]:
    """The maps as PNG files, and one that is none: the folder, its listing, the decoded images."""
    path = shared_path(spark)
    made = _pictures(spark, sf_dir).repartition(8).mapInPandas(_png, "name string, content binary")
    bad = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.lit("0/bad.png").alias("name"), F.encode("r_name", "UTF-8").alias("content"))
    writers.write_files(made.unionByName(bad), path)
    listing = written(images.read_files(spark, path))
    return path, listing, images.read_images(spark, path, listing)


def _polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stripe with a hole for each nation; regions lie off the frame, but for the first, which
    has no ring, and the second, whose bounds alone meet the frame."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("poly"), (F.col("n_nationkey") * 8).cast("double").alias("at"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("poly"), F.lit(900.0).alias("at"))
    point = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    box = lambda x1, y1, x2, y2: F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))
    at = F.col("at")
    striped = F.array(F.array(box(at + 0.5, 0.5, at + 7.5, 15.5), box(at + 2.4, 2.4, at + 5.6, 6.6)))
    corner = F.array(F.array(F.array(point(-40.0, -40.0), point(30.0, -40.0), point(-40.0, 30.0))))  # a slope that misses the frame's corner
    parts = F.when(F.col("poly") == "r0", F.slice(striped, 1, 0)).when(F.col("poly") == "r1", corner).otherwise(striped)
    return nation.unionByName(region).select("poly", parts.alias("parts"), F.lit(200).alias("frame_w"), F.lit(16).alias("frame_h"))


_FILE = "season || '/' || week || '-' || net || '-E-V' || rev || '.png'"
_MAPS = _SHOWN.format(lineitem="lineitem")


@query(
    f"""WITH m AS (SELECT {_FILE} AS file, (week + rev) % 5 AS kind FROM ({_MAPS})), c AS (SELECT kind, count(*) AS copies FROM m GROUP BY kind)
    SELECT file, 200 AS width, 16 AS height, copies FROM m JOIN c USING (kind) UNION ALL SELECT '0/bad.png', -1, -1, 1"""
)
def s6_read_images(spark, sf_dir):
    """Every file with its image's size and how many files have the same bytes."""
    _, listing, decoded = _files(spark, sf_dir)
    df = listing.join(decoded.select("digest", "width", "height", "copies"), "digest")
    return df.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), "width", "height", "copies")


@query(
    f"""SELECT {_FILE} AS file, n_nationkey::VARCHAR AS poly, {_HUED} AS color, {_NAMED.format(_HUE.replace("shift", "1"))} AS other, true AS mixed FROM ({_MAPS}), nation"""
)
def c6_sample_polygons(spark, sf_dir):
    """Stripes of two colours: the larger wins, the other is seen, and that of the hole is not."""
    _, listing, decoded = _files(spark, sf_dir)
    votes = images.vote_polygons(images.sample_polygons(decoded, images.polygon_frames(_polygons(spark, sf_dir), decoded)))
    others = F.array_join(F.array_except(F.map_keys("counts"), F.array("color")), "|")
    votes = votes.select("digest", "poly", "color", others.alias("other"), ((F.col("confidence") > 0.6) & (F.col("confidence") < 1)).alias("mixed"))
    return listing.join(votes, "digest").select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), "poly", "color", "other", "mixed")


@query(
    f"""WITH n AS (SELECT season, week, net, rev, color, sum(n) AS n FROM (
      SELECT season, week, net, rev, {_HUED} AS color, 92 AS n FROM ({_MAPS}), nation UNION ALL SELECT season, week, net, rev, {_NAMED.format(_HUE.replace("shift", "1"))}, 24 FROM ({_MAPS}), nation
      UNION ALL SELECT season, week, net, rev, {_NAMED.format(_HUE.replace("shift", "2"))}, 12 FROM ({_MAPS}), nation) GROUP BY ALL)
    SELECT {_FILE} AS file, color FROM n QUALIFY row_number() OVER (PARTITION BY season, week, net, rev ORDER BY n DESC, color) = 1"""
)
def a27_dominant_color(spark, sf_dir):
    _, listing, decoded = _files(spark, sf_dir)
    return listing.join(images.dominant_color(decoded), "digest").select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("file"), "color")


@query(
    f"""WITH final AS (SELECT season, week, net, max(rev) AS rev FROM ({_MAPS}) GROUP BY ALL),
    hued AS (SELECT season, week, net, n_nationkey, {_HUED} AS color FROM final, nation),
    named AS (SELECT *, CASE WHEN color = 'yellow' AND net = 'FOX' AND week % 2 = 0 THEN 'Given @ Hand' WHEN color = 'yellow' THEN NULL WHEN color = 'red' THEN 'Rome' || week || ' @ Oslo' WHEN color = 'blue' THEN 'Bern vs Kyiv' ELSE 'A' || color || ' at B' END AS game FROM hued)
    SELECT season, week, net || '_EARLY' AS slot, n_nationkey::VARCHAR AS market, color, game, CASE WHEN color = 'red' AND week = 1 THEN 'LATE' ELSE 'EARLY' END AS effective_window,
      'ok' AS status, CASE WHEN game IS NULL THEN 'unresolved' ELSE 'resolved' END AS legend_status, game IS NULL AS review FROM named
    UNION ALL SELECT season, week, net || '_EARLY', 'r' || r_regionkey, NULL, NULL, 'EARLY', CASE WHEN r_regionkey = 0 THEN 'empty_polygon' ELSE 'outside_map' END, 'not_applicable', true FROM final, region"""
)
def c1_build_assignments(spark, sf_dir):
    """Files, a manifest with all revisions, attempts at legend pages and an override to
    assignments. A third of the maps is found by digest, a third by local name, the rest by URL;
    the cached page tells nothing, so the live one counts, or in every third week the archive's."""
    path, listing, decoded = _files(spark, sf_dir)
    shown = _shown(spark, sf_dir)
    digest = listing.select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("origin"), "digest")
    how = F.col("rev") % 3
    manifest = shown.join(digest, "origin").select(
        "season", "week", F.lit("").alias("slot"), F.lit("").alias("context"), F.col("url").alias("image_url"), F.lit("live").alias("page_source"), F.lit("").alias("capture_timestamp"),
        F.when(how == 0, "elsewhere.png").when(how == 1, F.concat(F.lit("old/"), "origin")).otherwise("").alias("local_path"), F.when(how == 0, F.col("digest")).otherwise("").alias("sha256"),
        F.lit("exists").alias("status"), F.lit(1).cast("long").alias("bytes"), F.col("rev").cast("long").alias("ord"))
    week = F.col("week").cast("string")
    part = lambda net: F.concat(F.lit(f"<h3>{net} EARLY</h3><p>Red: Rome"), week, F.lit(" @ Oslo"), F.when(F.col("week") == 1, " (LATE)").otherwise(""), F.lit("</p><p>Blue: Bern vs Kyiv</p><p>Green: Agreen at B</p><p>Purple: Apurple at B</p>"))
    pages = shown.select("season", "week").distinct().withColumn("html", F.concat(part("CBS"), part("FOX")))
    live = pages.select("season", "week", F.lit(1).alias("priority"), F.when(F.col("week") % 3 != 0, F.col("html")).alias("html"))
    attempts = live.unionByName(pages.select("season", "week", F.lit(2).alias("priority"), "html")).unionByName(pages.select("season", "week", F.lit(0).alias("priority"), F.lit("<h3>CBS EARLY</h3>").alias("html")))
    override = pages.filter("week % 2 = 0").select("season", "week", F.lit("FOX_EARLY").alias("slot"), F.lit("yellow").alias("color"), F.lit("Given @ Hand").alias("game"))
    df = maps.build_assignments(manifest, listing, decoded, _polygons(spark, sf_dir), attempts, override)
    return df.select("season", "week", "slot", "market", "color", "game", "effective_window", "status", "legend_status", "review")


# ---- compaction


@query(f"WITH {IDX}, n AS (SELECT season, week, slot, count(*) AS n_games FROM freq GROUP BY ALL) SELECT n.*, count(*) FILTER (WHERE f.idx > 0) AS n_exceptions, count(*) FILTER (WHERE s.review OR s.confidence < 0.70) AS n_uncertain FROM src s JOIN freq f USING (season, week, slot, game) JOIN n USING (season, week, slot) GROUP BY ALL")
def c2_compact_dataset(spark, sf_dir):
    """Sizes of the compact maps; the job stops if they do not give every row back."""
    compact, check = maps.build_compact_dataset(assignments(spark, sf_dir), MAP, "market")
    wrong = check.select(F.when(F.col("n_mismatch") > 0, F.raise_error(F.lit("the compact form loses rows"))).otherwise(0).alias("wrong"))
    sizes = compact.select(*MAP, F.size("g").cast("long").alias("n_games"), F.size("e").cast("long").alias("n_exceptions"), F.size("u").cast("long").alias("n_uncertain"))
    return sizes.crossJoin(F.broadcast(wrong)).drop("wrong")  # one row


@query(f"WITH {MAJOR} SELECT (SELECT count(*) FROM major) AS n_prefixes, (SELECT count(*) FROM zips JOIN major ON substr(zip, 1, 3) = prefix WHERE zone <> value) AS n_exact, 0::BIGINT AS n_wrong")
def c8_compact_prefix_table(spark, sf_dir):
    major, exact, wrong = maps.compact_prefix_table(view(spark, sf_dir, "zips"), "zip", "zone")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(major, "n_prefixes").crossJoin(n(exact, "n_exact")).crossJoin(n(wrong, "n_wrong"))  # one row each


# ---- feeds


@query(
    """WITH e AS (SELECT o_orderkey, o_custkey % 40 AS a, (o_custkey + 1) % 40 AS h FROM orders),
    b AS (SELECT l_orderkey, floor(l_extendedprice) AS price, l_quantity AS q, CAST(l_shipdate AS DATE) AS d FROM lineitem),
    pool AS (SELECT l_orderkey, median(x) AS point FROM (SELECT l_orderkey, q + 30 AS x FROM b UNION ALL SELECT l_orderkey, q + 31 FROM b) GROUP BY 1),
    m AS (SELECT l_orderkey, count(*) AS n, median(q) AS q, median(price) AS price, max(d) AS d FROM b GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS event_id, 'C' || a AS away, 'C' || h AS home, coalesce(n, 0) AS books_count, round(q, 2) AS away_point, round(-q, 2) AS home_point, round(price, 2) AS away_price,
      round(point, 2) AS total_point, round(price + 1, 2) AS over_price, round(price + 2, 2) AS moneyline_away, strftime(d, '%Y-%m-%d') AS last_update
    FROM e LEFT JOIN m ON m.l_orderkey = o_orderkey LEFT JOIN pool ON pool.l_orderkey = o_orderkey WHERE a < 32 AND h < 32"""
)
def c9_odds_consensus(spark, sf_dir):
    """Orders as events, their lines as bookmakers; teams 32 to 39 are unknown."""
    price, q = F.floor("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    out = lambda name, price, point=None: F.struct(name.alias("name"), price.alias("price"), (F.lit(None).cast("double") if point is None else point).alias("point"))
    a, h = F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")), F.concat(F.lit("T"), ((F.col("o_custkey") + 1) % 40).cast("string"))
    market = lambda key, *o: F.struct(F.lit(key).alias("key"), day.alias("last_update"), F.array(*o).alias("outcomes"))
    lines = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = F.array(market("spreads", out(a, price, q), out(h, price, -q), out(a, price + 9, q + 9)), market("totals", out(F.lit("Over"), price + 1, q + 30), out(F.lit("Under"), price, q + 31)), market("h2h", out(a, price + 2), out(h, price)))
    books = F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct(F.lit("1990-01-01").alias("last_update"), found.alias("markets"))))
    raw = lines.groupBy(F.col("o_orderkey").cast("string").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("commence_time"), a.alias("away_team"), h.alias("home_team")).agg(books.alias("bookmakers"))
    teams = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("k")).distinct().filter("k < 32").select(F.concat(F.lit("T"), "k").alias("name"), F.concat(F.lit("C"), "k").alias("code"))
    df = feeds.odds_consensus(raw, teams)
    return df.select("event_id", "away", "home", F.col("books_count").cast("long").alias("books_count"), "spread.away_point", "spread.home_point", "spread.away_price", F.col("total.point").alias("total_point"), "total.over_price", F.col("moneyline.away").alias("moneyline_away"), F.date_format("last_update", "yyyy-MM-dd").alias("last_update"))


_SPOTS = ["QB", "RB", "WR", "TE", "K", "DEF"]
_RESERVED = "CASE position WHEN 'QB' THEN 2 WHEN 'RB' THEN 3 WHEN 'WR' THEN 4 WHEN 'TE' THEN 2 ELSE 1 END"


@query(
    f"""WITH r AS (SELECT CAST(month(l_shipdate) AS INT) AS week, l_orderkey * 10 + l_linenumber AS ord, 'P' || l_partkey AS name, l_suppkey % 32 AS t, l_partkey % 7 AS p,
      CASE WHEN l_quantity = 1 THEN 0 ELSE round(l_extendedprice / 1000, 1) END AS points FROM lineitem),
    known AS (SELECT week, ord, name, 'C' || t AS team, CASE p {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SPOTS))} END AS position, points FROM r WHERE t < 30 AND p < 6),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY week, position ORDER BY points DESC, ord) AS rank FROM known),
    skilled AS (SELECT * FROM (SELECT *, bool_or(position <> 'DEF') OVER (PARTITION BY week, team) AS ok FROM ranked WHERE points > 0) WHERE ok),
    k AS (SELECT *, row_number() OVER (PARTITION BY week, team, position ORDER BY points DESC, name, ord) AS k FROM skilled),
    i AS (SELECT *, row_number() OVER (PARTITION BY week, team ORDER BY CASE WHEN k <= {_RESERVED} THEN 0 ELSE 1 END, points DESC, name, ord) AS i FROM k)
    SELECT week, ord, name, team, position, points, position || rank AS position_rank, 'Healthy' AS injury_status FROM i WHERE i <= 16"""
)
def c10_projection_feed(spark, sf_dir):
    """Lines as players of a week; teams 30 and 31 and position 6 are unknown."""
    week = F.month("l_shipdate").cast("int")
    points = F.when(F.col("l_quantity") == 1, 0.0).otherwise(F.col("l_extendedprice").cast("double") / 1000)
    stat = lambda source, period, total: F.struct(F.lit(source).alias("statSourceId"), period.alias("scoringPeriodId"), total.cast("double").alias("appliedTotal"))
    player = F.struct(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("fullName"),
        (F.col("l_partkey") % 7).cast("int").alias("defaultPositionId"),
        (F.col("l_suppkey") % 32).cast("int").alias("proTeamId"),
        F.lit(None).cast("string").alias("injuryStatus"),
        F.array(stat(0, week, F.lit(999)), stat(1, week + 1, F.lit(998)), stat(1, week, points), stat(1, week, F.lit(997))).alias("stats"),
    )
    raw = table(spark, sf_dir, "lineitem").select(week.alias("week"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), player.alias("player"))
    ids = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 32).alias("k")).distinct().filter("k < 30").select(F.col("k").cast("string").alias("id"), F.concat(F.lit("C"), "k").alias("code"))
    spots = table(spark, sf_dir, "region").agg(F.lit(1)).select(F.posexplode(F.array(*map(F.lit, _SPOTS))).alias("i", "code")).select(F.col("i").cast("string").alias("id"), "code")
    return feeds.projection_feed(raw, ids, spots).select("week", "ord", "name", "team", "position", "points", "position_rank", "injury_status")


@query(
    """SELECT c_custkey::VARCHAR AS id, CASE WHEN p = 'DEF' THEN 'Team ' || t WHEN c_custkey % 3 = 0 THEN 'First L' || c_custkey ELSE c_name END AS name, p AS position, CASE WHEN t = 'T3' THEN 'TX' ELSE t END AS team
    FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'QB' WHEN 1 THEN 'DEF' WHEN 2 THEN 'LB' ELSE 'K' END AS p, CASE WHEN c_custkey % 11 > 0 THEN 'T' || (c_nationkey % 5) END AS t FROM customer)
    WHERE p IN ('QB', 'DEF', 'K') AND t IS NOT NULL AND NOT (p = 'DEF' AND t = 'T3')"""
)
def c11_player_dictionary(spark, sf_dir):
    """Customers as players; team T3 has the alias TX, under which no name is known."""
    key = F.col("c_custkey")
    spot = F.element_at(F.array(*map(F.lit, ("QB", "DEF", "LB", "K"))), (key % 4 + 1).cast("int"))
    team = F.when(key % 11 > 0, F.concat(F.lit("T"), (F.col("c_nationkey") % 5).cast("string")))
    raw = table(spark, sf_dir, "customer").select(key.cast("string").alias("id"), spot.alias("position"), team.alias("team"), F.when(key % 3 == 0, "").otherwise(F.col("c_name")).alias("full_name"), F.lit("First").alias("first_name"), F.concat(F.lit("L"), key.cast("string")).alias("last_name"))
    teams = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("k")).distinct().select(F.concat(F.lit("T"), "k").alias("code"), F.concat(F.lit("Team T"), "k").alias("name"))
    aliases = teams.filter("code = 'T3'").select(F.col("code").alias("alias"), F.lit("TX").alias("code"))
    return feeds.player_dictionary(raw, aliases, ["QB", "DEF", "K"], teams)


# ---- boundaries


@query(
    """WITH c(pos, dx, dy) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0))
    SELECT n_nationkey::VARCHAR AS poly, n_name AS name, 0 AS part, 0 AS ring, CASE WHEN n_nationkey % 2 = 0 THEN pos ELSE 4 - pos END AS pos, n_nationkey * 0.5 + dx + n_regionkey * 10 AS x, dy + 1.0 AS y FROM nation, c"""
)
def c13_decode_topology(spark, sf_dir):
    """A file for each region, its nations as squares; odd ones run the other way."""
    n = table(spark, sf_dir, "nation")
    d = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((0, 0), (2, 0), (0, 2), (-2, 0), (0, -2))])
    place = F.dense_rank().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    n = n.select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("file"), F.col("n_regionkey"), place.alias("arc_id"))
    pts = n.select("file", "arc_id", "n_nationkey", "n_regionkey", F.posexplode(d).alias("pos", "d"))
    first = F.when(F.col("pos") == 0, F.col("n_nationkey")).otherwise(0)
    arcs = pts.select("file", "arc_id", "pos", (F.col("d.dx") + first).alias("dx"), F.col("d.dy").alias("dy"), F.array(F.lit(0.5), F.lit(0.5)).alias("scale"), F.array(F.col("n_regionkey") * 10.0, F.lit(1.0)).alias("translate"))
    refs = n.select("file", F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(0).alias("pos"), F.when(F.col("n_nationkey") % 2 == 0, F.col("arc_id")).otherwise(-F.col("arc_id") - 1).alias("arc_idx"))
    return boundaries.decode_topology(arcs, refs)


def _topologies(spark, sf_dir):
    """A TopoJSON file for each region: its nations as squares, odd ones run the other way, and
    every third one twice, as a MultiPolygon."""
    n = table(spark, sf_dir, "nation")
    k, place = F.col("n_nationkey"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    arc = F.array(*[F.array(x, F.lit(y)) for x, y in ((k, 0), (F.lit(2), 0), (F.lit(0), 2), (F.lit(-2), 0), (F.lit(0), -2))])
    at = F.when(k % 2 == 0, F.col("i")).otherwise(-F.col("i") - 1).cast("string")
    refs = F.when(k % 3 == 0, F.format_string("[[[%s]],[[%s]]]", at, at)).otherwise(F.format_string("[[%s]]", at))
    kind = F.when(k % 3 == 0, "MultiPolygon").otherwise("Polygon")
    one = F.format_string('{"type":"%s","id":"%d","properties":{"name":"%s"},"arcs":%s}', kind, k, "n_name", refs)
    each = n.withColumn("i", place).select("n_regionkey", F.struct("i", F.to_json(arc).alias("arc"), one.alias("shape")).alias("s"))
    region = each.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    doc = F.format_string('{"type":"Topology","transform":{"scale":[0.5,0.5],"translate":[%d,1]},"arcs":[%s],"objects":{"markets":{"type":"GeometryCollection","geometries":[%s]}}}', F.col("n_regionkey") * 10, F.array_join("s.arc", ","), F.array_join("s.shape", ","))
    path = shared_path(spark)
    writers.write_files(region.select(F.format_string("%d.json", "n_regionkey").alias("name"), F.encode(doc, "UTF-8").alias("content")), path)
    return path


_CORNERS = "c(pos, dx, dy) AS (VALUES (0, 0, 0), (1, 2, 0), (2, 2, 2), (3, 0, 2), (4, 0, 0))"


@query(f"WITH {_CORNERS} SELECT n_nationkey::VARCHAR AS poly, n_name AS name, part::INT AS part, 0 AS ring, (CASE WHEN n_nationkey % 2 = 0 THEN pos ELSE 4 - pos END)::INT AS pos, (n_nationkey + dx) * 0.5 + n_regionkey * 10 AS x, dy * 0.5 + 1 AS y FROM nation, c, (VALUES (0), (1)) t(part) WHERE part = 0 OR n_nationkey % 3 = 0")
def s5_read_topology(spark, sf_dir):
    return readers.read_boundaries(spark, _topologies(spark, sf_dir))


@query("SELECT n_nationkey::VARCHAR AS poly, round((n_nationkey + 1) * 0.5 + n_regionkey * 10, 3) AS x, 1.5 AS y FROM nation")
def c13_centroids(spark, sf_dir):
    return boundaries.centroids(readers.read_boundaries(spark, _topologies(spark, sf_dir)))


@query("WITH c(pos, dx, dy) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1)) SELECT n_nationkey::VARCHAR AS poly, n_name AS name, 0 AS part, 0 AS ring, pos, (n_nationkey + dx)::DOUBLE AS x, dy::DOUBLE AS y FROM nation, c")
def s5_read_boundaries(spark, sf_dir):
    """Nations written as GeoJSON, read as rings."""
    k = F.col("n_nationkey")
    pair = lambda x, y: F.array(x.cast("double"), F.lit(float(y)))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(pair(k, 0), pair(k + 1, 0), pair(k + 1, 1))).alias("coordinates"))
    feature = F.struct(F.create_map(F.lit("dma"), k.cast("string"), F.lit("name"), F.col("n_name")).alias("properties"), shape.alias("geometry"))
    doc = table(spark, sf_dir, "nation").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    path = shared_path(spark)
    doc.write.text(path)
    return readers.read_boundaries(spark, path)


# ---- sources and sinks: written, then read


@query("SELECT c_custkey, 'a \"' || c_name || '\", ' || chr(10) || 'b' AS said, c_mktsegment FROM customer")
def s1_s8_csv(spark, sf_dir):
    """Quotes, commas and line ends inside fields; other columns stay behind."""
    said = F.concat(F.lit('a "'), "c_name", F.lit('", \nb'))
    path = shared_path(spark)
    writers.write_table(table(spark, sf_dir, "customer").withColumn("said", said), ["c_custkey", "said", "c_mktsegment"], path, fmt="csv")
    return readers.read_csv(spark, path, "c_custkey long, said string, c_mktsegment string")


@query("SELECT 1 AS schema, s_suppkey, s_name, s_nationkey FROM supplier")
def s2_s9_json_payload(spark, sf_dir):
    """Every supplier, in as many documents as they fill."""
    path = shared_path(spark)
    writers.write_json_payload(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, schema=1)
    doc = readers.read_nested_json(spark, path, "schema int, rows array<struct<s_suppkey:long,s_name:string,s_nationkey:int>>")
    return doc.select("schema", F.inline("rows"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey AS region FROM nation")
def s3_keyed_json(spark, sf_dir):
    entry = F.struct(F.col("n_nationkey").cast("string").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("v"))
    path = shared_path(spark)
    table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.text(path)
    return readers.read_keyed_json(spark, path, "name:string,region:long")


@query("SELECT 1 AS schema, r_regionkey, r_name FROM region")
def s4_js_payload(spark, sf_dir):
    rows = writers.json_payload(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), schema=1)
    path = shared_path(spark)
    rows.select(F.concat(F.lit("/* made */ window.DATA = "), "value", F.lit(";")).alias("value")).write.text(path)
    return readers.read_js_payload(spark, path, "schema int, rows array<struct<r_regionkey:long,r_name:string>>").select("schema", F.inline("rows"))


@query("SELECT page_id, length(html) AS chars, md5(html) AS digest FROM pages")
def s7_read_pages(spark, sf_dir):
    """All pages in a few files, read back whole; null and empty ones too."""
    path = shared_path(spark)
    writers.write_pages(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "html"), path)
    got = readers.read_page_lines(spark, path)
    return got.select(F.col("url").cast("long").alias("page_id"), F.length("html").cast("long").alias("chars"), F.md5(F.encode("html", "UTF-8")).alias("digest"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def s10_publish_if(spark, sf_dir):
    """Published twice, refused once: what is read is the second."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    root = shared_path(spark)
    none = counts.filter("n < 0")
    writers.publish_if(counts.withColumn("n", F.col("n") + 1), none, root)
    writers.publish_if(counts, none, root, source=counts)
    try:
        writers.publish_if(counts.withColumn("n", F.when(F.col("o_custkey") == 1, F.col("n") + 2).otherwise(F.col("n"))), None, root, source=counts)
    except writers.Refused:
        return writers.published(spark, root)
    raise AssertionError("a wrong result was published")


@query(f"WITH {cte('samples')}, c AS (SELECT DISTINCT market FROM samples) SELECT market, CASE market % 3 WHEN 0 THEN 'T' || market || ' @ U' WHEN 1 THEN 'T' || market || ' at U (announcers late)' ELSE 'T' || market || ' vs U' END AS game FROM c")
def f2_clean_game_text(spark, sf_dir):
    m = F.col("market").cast("string")
    raw = F.when(F.col("market") % 3 == 0, F.concat(F.lit(" -  T"), m, F.lit("  @ U (Announcers: A, B) :"))).when(F.col("market") % 3 == 1, F.concat(F.lit("T"), m, F.lit(" at U (announcers late)"))).otherwise(F.concat(F.lit("– T"), m, F.lit("\n vs U (subject to blackout)")))
    return view(spark, sf_dir, "samples").select("market").distinct().select("market", clean_game_text(raw).alias("game"))
