"""Polygons, arcs, projections, clocks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, time
from ..operators import geometry
from .registry import cte, query, table, view

# A box for each nation in a 5x5 grid, without its top right quarter and with a hole.
RINGS = """rings AS (SELECT n_nationkey AS poly, 0 AS part, ring, pos, (n_nationkey % 5) * 10 + px AS x, CAST(floor(n_nationkey / 5) AS INT) * 10 + py AS y FROM {nation}
  CROSS JOIN (VALUES (0, 0, 0.0, 0.0), (0, 1, 10.0, 0.0), (0, 2, 10.0, 6.0), (0, 3, 6.0, 6.0), (0, 4, 6.0, 10.0), (0, 5, 0.0, 10.0), (1, 0, 2.0, 2.0), (1, 1, 4.0, 2.0), (1, 2, 4.0, 4.0), (1, 3, 2.0, 4.0)) p(ring, pos, px, py))"""
POINTS = "points AS (SELECT c_custkey AS id, (c_custkey * 7919 % 50000) / 1000.0 + 0.0005 AS x, (c_custkey * 104729 % 50000) / 1000.0 + 0.0005 AS y FROM {customer})"
_SQL_RINGS, _SQL_POINTS = RINGS.format(nation="nation"), POINTS.format(customer="customer")
INSIDE = f"""{_SQL_RINGS}, {_SQL_POINTS}, edges AS (SELECT poly, ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM rings WINDOW w AS (PARTITION BY poly, ring ORDER BY pos)),
hit AS (SELECT id, poly FROM points JOIN edges ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, poly HAVING count(*) % 2 = 1),
found AS (SELECT id, min(poly) AS poly FROM hit GROUP BY id)"""


def _shapes(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    rings = spark.sql(f"WITH {RINGS} SELECT poly, part, ring, pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM rings", nation=nation)
    points = spark.sql(f"WITH {POINTS} SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM points", customer=customer)
    return points, rings, nation.select(F.col("n_nationkey").alias("poly"), F.col("n_nationkey").alias("ord"))


@query(f"WITH {INSIDE} SELECT id, poly FROM found")
def j11_point_in_polygon(spark, sf_dir):
    return geometry.point_in_polygon(*_shapes(spark, sf_dir), max_edges=4)


@query(f"WITH {INSIDE} SELECT p.id, CASE WHEN p.id % 3 = 0 THEN 100 + p.id % 7 ELSE poly END AS market, CASE WHEN p.id % 3 = 0 THEN 'direct-table' WHEN poly IS NOT NULL THEN 'centroid-polygon' ELSE 'unresolved' END AS method FROM points p LEFT JOIN found f ON p.id = f.id")
def j10_zip_to_market(spark, sf_dir):
    points, rings, order = _shapes(spark, sf_dir)
    direct = points.filter("id % 3 = 0").select("id", (100 + F.col("id") % 7).alias("market"))
    return geometry.zip_to_market(points, direct, rings, order)


@query("SELECT l_orderkey AS arc_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, sum(l_linenumber) OVER w * 0.5 + 10 AS x, sum(l_quantity) OVER w * 0.5 + 20 AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def w10_decode_deltas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pos = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    arcs = li.select(F.col("l_orderkey").alias("arc_id"), pos.alias("pos"), F.col("l_linenumber").alias("dx"), F.col("l_quantity").alias("dy"))
    return geometry.decode_deltas(arcs, (0.5, 0.5), (10.0, 20.0)).select("arc_id", "pos.*", "x", "y")


_LL = "ll AS (SELECT c_custkey AS id, -125 + (c_custkey % 580) / 10.0 AS lon, 24 + (c_custkey % 250) / 10.0 AS lat FROM customer)"


def _ll(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (-125 + (k % 580) / 10.0).alias("lon"), (24 + (k % 250) / 10.0).alias("lat"))


@query(f"WITH {_LL}, m AS (SELECT *, ln(tan(pi() / 4 + radians(lat) / 2)) AS my FROM ll) SELECT id, round(21.10656425 * lon + 9.17874552 * my + 2656.72497789, 4) AS x, round(-0.0419217112 * lon - 1210.80604 * my + 1239.89688, 4) AS y FROM m")
def f19_lonlat_to_pixel(spark, sf_dir):
    p = geo.lonlat_to_pixel(F.col("lon"), F.col("lat"))
    return _ll(spark, sf_dir).select("id", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


_N = (math.sin(math.radians(29.5)) + math.sin(math.radians(45.5))) / 2
_C = math.cos(math.radians(29.5)) ** 2 + 2 * _N * math.sin(math.radians(29.5))


@query(f"WITH {_LL}, r AS (SELECT *, sqrt({_C!r} - 2 * {_N!r} * sin(radians(lat))) / {_N!r} AS rho, {_N!r} * radians(lon + 96) AS th FROM ll) SELECT id, round(rho * sin(th), 6) AS x, round({math.sqrt(_C - 2 * _N * math.sin(math.radians(37.5))) / _N!r} - rho * cos(th), 6) AS y FROM r")
def f20_albers_xy(spark, sf_dir):
    p = geo.albers_xy(F.col("lon"), F.col("lat"))
    return _ll(spark, sf_dir).select("id", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


# the boxes of the shapes: two make the ell, the third is the hole; in pixels, cut to the frame
_PIECES = """piece AS (SELECT n_nationkey AS poly, sign, ((n_nationkey % 5) * 10 + x1) * 40 - 240 AS lx, ((n_nationkey % 5) * 10 + x2) * 40 - 240 AS hx, (n_nationkey // 5 * 10 + y1) * 20 - 120 AS ly, (n_nationkey // 5 * 10 + y2) * 20 - 120 AS hy
  FROM nation, (VALUES (1, 0.0, 0.0, 10.0, 6.0), (1, 0.0, 6.0, 6.0, 10.0), (-1, 2.0, 2.0, 4.0, 4.0)) t(sign, x1, y1, x2, y2)),
clipped AS (SELECT poly, sum(sign * greatest(least(hx, 1279) - greatest(lx, 0), 0) * greatest(least(hy, 719) - greatest(ly, 0), 0))::DOUBLE AS area FROM piece GROUP BY poly)"""


@query(f"WITH {_PIECES} SELECT poly, round(area, 4) AS area, CASE WHEN area < 1 THEN 'outside_map' ELSE 'ok' END AS status, round(greatest(2.0, sqrt(greatest(area, 1.0) / 240)), 6) AS spacing FROM clipped")
def f28_frame_status(spark, sf_dir):
    """Ells with holes: some lie off the frame although their bounds meet it."""
    _, rings, _ = _shapes(spark, sf_dir)
    point = F.struct((F.col("x") * 40 - 240).alias("x"), (F.col("y") * 20 - 120).alias("y"))
    ring = rings.groupBy("poly", "part", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", point.alias("p")))), lambda v: v["p"]).alias("ps"))
    part = ring.groupBy("poly", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "ps"))), lambda v: v["ps"]).alias("rs"))
    df = part.groupBy("poly").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "rs"))), lambda v: v["rs"]).alias("parts"))
    df = df.withColumn("area", geo.polygon_area(geo.clip_polygon(F.col("parts"), F.lit(1280), F.lit(720))))
    return df.select("poly", F.round("area", 4).alias("area"), geo.frame_status(F.col("parts"), F.col("area")).alias("status"), F.round(geo.spacing(F.col("area"), 240), 6).alias("spacing"))


KICK = cte("kickoffs")
_TIME = "CASE WHEN h = 23 THEN 'TBD' ELSE ((h + 11) % 12 + 1) || ':' || lpad(mi::VARCHAR, 2, '0') || CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END END"
_ZONE = "CASE WHEN zone_no < 34 THEN [" + ", ".join(f"'{z}'" for z in time.ZONES) + "][zone_no + 1] END"


def _kick(spark, sf_dir):
    k = view(spark, sf_dir, "kickoffs")
    h = F.col("h")
    text = F.concat(((h + 11) % 12 + 1).cast("string"), F.lit(":"), F.lpad(F.col("mi").cast("string"), 2, "0"), F.when(h < 12, " AM").otherwise(" PM"))
    return k.withColumn("time", F.when(h == 23, "TBD").otherwise(text)).withColumn("zone", F.get(F.array(*map(F.lit, time.ZONES)), F.col("zone_no")))


@query(f"WITH {KICK} SELECT id, CASE WHEN h = 23 THEN NULL ELSE h * 60 + mi END AS minutes FROM kickoffs")
def f11_parse_et_time(spark, sf_dir):
    return _kick(spark, sf_dir).select("id", time.parse_et_time(F.col("time")).alias("minutes"))


# of a wall clock that comes twice, the earlier instant counts
_INSTANT = f"""k0 AS (SELECT *, {_ZONE} AS zone, day + to_minutes(h * 60 + mi) AS wall FROM kickoffs),
k1 AS (SELECT *, timezone('America/New_York', wall) AS u FROM k0),
k AS (SELECT *, CASE WHEN h < 23 THEN timezone('UTC', CASE WHEN timezone('America/New_York', u - INTERVAL 1 HOUR) = wall THEN u - INTERVAL 1 HOUR ELSE u END) END AS t FROM k1)"""


@query(f"WITH {KICK}, {_INSTANT} SELECT id, t AS instant FROM k")
def f12_et_instant(spark, sf_dir):
    """From the table of clocks; the column function must agree."""
    k = _kick(spark, sf_dir).withColumn("wall", time.wall_clock(F.col("day"), time.parse_et_time(F.col("time"))))
    k = time.to_instants(k, "wall", F.lit(time.HOME_ZONE), time.zone_rules(spark)).withColumn("alone", time.et_instant(F.col("day"), F.col("time")))
    same = F.col("instant").eqNullSafe(F.col("alone"))
    return k.select("id", F.when(same, F.col("instant")).otherwise(F.raise_error(F.lit("instants differ")).cast("timestamp_ntz")).alias("instant"))


# standard time is the lesser offset of January and July of a year; in three zones it changed within one
_MOVES = [("America/North_Dakota/Center", "1992-10-25 08:00", -360), ("America/Ojinaga", "1998-04-05 09:00", -420), ("America/Kentucky/Monticello", "2000-10-29 07:00", -300)]
_MOVED = " ".join(f"WHEN zone = '{z}' AND year(t) = {at[:4]} AND t >= TIMESTAMP '{at}' THEN {m}" for z, at, m in _MOVES)
_NAMED = f"""z AS (SELECT *, date_diff('minute', t, timezone(coalesce(zone, 'America/New_York'), timezone('UTC', t))) AS m,
  CASE {_MOVED} ELSE least(date_diff('minute', make_timestamp(year(t), 1, 15, 12, 0, 0.0), timezone(coalesce(zone, 'America/New_York'), timezone('UTC', make_timestamp(year(t), 1, 15, 12, 0, 0.0)))),
        date_diff('minute', make_timestamp(year(t), 7, 15, 12, 0, 0.0), timezone(coalesce(zone, 'America/New_York'), timezone('UTC', make_timestamp(year(t), 7, 15, 12, 0, 0.0))))) END AS std FROM k),
n AS (SELECT *, CASE std WHEN -240 THEN 'A' WHEN -300 THEN 'E' WHEN -360 THEN 'C' WHEN -420 THEN 'M' WHEN -480 THEN 'P' WHEN -540 THEN 'AK' WHEN -600 THEN 'H' END || CASE WHEN m > std THEN 'DT' ELSE 'ST' END AS abbr FROM z)"""


@query(
    f"""WITH {KICK}, {_INSTANT}, {_NAMED}, l AS (SELECT *, {_TIME} AS text, zone IS NOT NULL AND t IS NOT NULL AS told, timezone(coalesce(zone, 'America/New_York'), timezone('UTC', t)) AS there FROM n)
    SELECT id, CASE WHEN told THEN strftime(there, '%-I:%M %p') ELSE text END AS time, coalesce(abbr, '') AS abbr, rtrim(CASE WHEN told THEN strftime(there, '%-I:%M %p') ELSE text END || ' ' || coalesce(abbr, '')) AS label,
      CASE WHEN told THEN strftime(there, '%Y-%m-%d') ELSE strftime(day, '%Y-%m-%d') END AS day, CASE WHEN told THEN CAST(there AS DATE) <> day ELSE false END AS shifted, NOT told OR zone = 'America/New_York' AS at_home FROM l"""
)
def f13_c12_local_clock(spark, sf_dir):
    """All 34 zones, and viewers without one; the hours of both changes and TBD are kept."""
    from ..jobs.kickoffs import kickoff_localised

    df = kickoff_localised(_kick(spark, sf_dir), "day", "time", "zone")
    return df.select("id", F.col("local_time").alias("time"), F.col("zone_abbr").alias("abbr"), "label", F.date_format("local_date", "yyyy-MM-dd").alias("day"), "shifted", "at_home")


@query(f"WITH {KICK}, {_INSTANT}, {_NAMED} SELECT id, zone, CASE WHEN zone IS NOT NULL THEN abbr END AS abbr FROM n")
def f14_zone_abbr(spark, sf_dir):
    k = _kick(spark, sf_dir).withColumn("t", time.et_instant(F.col("day"), F.col("time")))
    return time.zone_abbr(k, "t", "zone").select("id", "zone", F.col("zone_abbr").alias("abbr"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INT) AS season, dayofweek(o_orderdate) = 0 AS sunday FROM orders")
def f15_f16_season_sunday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", time.season_of(F.col("o_orderdate")).alias("season"), time.is_sunday(F.col("o_orderdate")).alias("sunday"))


@query(f"WITH {KICK} SELECT id, CASE WHEN dayofweek(day) = 0 AND h = 13 THEN network || '_EARLY' WHEN dayofweek(day) = 0 AND h = 16 THEN network || '_LATE' END AS slot FROM kickoffs")
def p7_broadcast_window(spark, sf_dir):
    k = view(spark, sf_dir, "kickoffs")
    text = F.when(F.col("h") == 13, "1:00 PM").when(F.col("h") == 16, F.when(F.col("mi") % 2 == 0, "4:05 PM").otherwise("4:25 PM")).otherwise("8:20 PM")
    return k.select("id", time.broadcast_window(F.col("day"), F.col("network"), text).alias("slot"))
