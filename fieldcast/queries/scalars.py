"""Scalar functions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections, color, geo, numeric, text
from ..operators import legends
from .registry import query, table


@query("SELECT c_custkey, 'customer' || lpad(c_custkey::VARCHAR, 9, '0') AS k FROM customer")
def f1_name_key(spark, sf_dir):
    k = F.col("c_custkey")
    suffix = F.get(F.array(F.lit(" Jr."), F.lit(" III"), F.lit(" sr"), F.lit("")), (k % 4).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_key(F.concat("c_name", suffix)).alias("k"))


_GAME = "(o_custkey % 40) || '' || CASE o_orderkey % 3 WHEN 0 THEN ' @ ' WHEN 1 THEN ' vs. ' ELSE ' - ' END || (o_custkey % 7) || CASE o_orderkey % 5 WHEN 0 THEN ' (LATE)' WHEN 1 THEN ' (early)' ELSE '' END"


def _games(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    mid = F.when(o % 3 == 0, " @ ").when(o % 3 == 1, " vs. ").otherwise(" - ")
    end = F.when(o % 5 == 0, " (LATE)").when(o % 5 == 1, " (early)").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat((c % 40).cast("string"), mid, (c % 7).cast("string"), end).alias("g"))


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 40)::VARCHAR ELSE '' END AS away, CASE WHEN o_orderkey % 3 < 2 THEN (o_custkey % 7)::VARCHAR ELSE '' END AS home FROM orders")
def f3_split_matchup(spark, sf_dir):
    m = text.split_matchup(F.col("g"))
    return _games(spark, sf_dir).select("o_orderkey", m["away"].alias("away"), m["home"].alias("home"))


@query(f"SELECT o_orderkey, regexp_replace({_GAME}, ' \\((LATE|early)\\)$', '') AS game, CASE o_orderkey % 5 WHEN 0 THEN 'LATE' WHEN 1 THEN 'EARLY' ELSE '' END AS \"window\" FROM orders")
def f4_split_window_marker(spark, sf_dir):
    m = text.split_window_marker(F.col("g"))
    return _games(spark, sf_dir).select("o_orderkey", m["game"].alias("game"), m["window"].alias("window"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey % 40) || '|' || (o_custkey % 7) WHEN o_orderkey % 3 = 1 THEN (o_custkey % 40) || ' vs. ' || (o_custkey % 7) ELSE (o_custkey % 40) || ' - ' || (o_custkey % 7) END AS teams FROM orders")
def f5_game_teams(spark, sf_dir):
    return _games(spark, sf_dir).select("o_orderkey", F.array_join(text.game_teams(F.col("g")), "|").alias("teams"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'grey' WHEN 1 THEN 'light_blue' WHEN 2 THEN 'light_blue' ELSE lower(replace(p_name, ' ', '_')) END AS color FROM part")
def f6_canonical_color(spark, sf_dir):
    s = F.col("p_size") % 4
    raw = F.when(s == 0, " Gray ").when(s == 1, "Cyan").when(s == 2, "Light  Blue").otherwise(F.upper("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_color(raw).alias("color"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Healthy' WHEN 'O' THEN 'IR' ELSE 'Some New Code' END AS label FROM orders")
def f7_injury_label(spark, sf_dir):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", F.lit(None).cast("string")).when((s == "O") & (F.col("o_orderkey") % 2 == 0), "INJURY_RESERVE").when(s == "O", "injury_reserve").otherwise("some_NEW_code")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.injury_label(raw).alias("label"))


@query("SELECT s_suppkey, n_name || ' @ ' || s_name AS game FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 4")
def f8_game_label(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 4")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", text.game_label(F.col("n_name"), F.col("s_name")).alias("game"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_custkey::VARCHAR END AS league, 'u' || c_custkey AS username FROM customer")
def f9_league_username(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    raw = F.when(F.col("c_custkey") % 3 == 0, k).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("https://x.example/leagues/"), k, F.lit("/team"))).otherwise("none")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("@u"), k)).otherwise(F.concat(F.lit("https://x.example/user/u"), k, F.lit("/")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.league_id(raw).alias("league"), text.username(name).alias("username"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CBS_EARLY' WHEN 1 THEN 'FOX_LATE' WHEN 2 THEN 'FOX_SPECIAL' END AS slot FROM orders")
def f10_heading_slot(spark, sf_dir):
    r = F.col("o_orderkey") % 4
    raw = F.when(r == 0, "CBS  early games").when(r == 1, "Fox 4:25 PM").when(r == 2, "FOX Tuesday late").otherwise("Sunday early")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.heading_slot(raw).alias("slot"))


@query("SELECT l_orderkey, l_linenumber, round(0.75 * greatest(l_discount, l_tax) + 0.25 * (l_discount + l_tax) / 2, 6) AS score FROM lineitem")
def f17_game_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(numeric.game_score(F.array("l_discount", "l_tax")), 6).alias("score"))


_CAL = [((i + 1) / 10, round((i + 1) ** 2 / 100, 2)) for i in range(10)]


@query("SELECT l_orderkey, l_linenumber, round(power(least(greatest(ceil(round(l_quantity / 5, 6)), 1), 10), 2) / 100, 2) AS p FROM lineitem")
def f18_apply_calibration(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.apply_calibration(F.col("l_quantity") / 50, _CAL).alias("p"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 30 THEN 'likely' WHEN l_quantity >= 17.5 THEN 'maybe' WHEN l_quantity >= 7.5 THEN 'possibly' ELSE 'unlikely' END AS band, CASE WHEN l_tax = 0 THEN 'in' WHEN l_quantity >= 42.5 THEN 'highest' WHEN l_quantity >= 30 THEN 'high' WHEN l_quantity >= 17.5 THEN 'medium' WHEN l_quantity >= 7.5 THEN 'low' WHEN l_quantity >= 2.5 THEN 'trace' ELSE 'none' END AS intensity FROM lineitem")
def p10_p11_bands(spark, sf_dir):
    p = F.col("l_quantity") / 50
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.band(p).alias("band"), numeric.intensity_class(p, F.col("l_tax") == 0).alias("intensity"))


_RGB = "px AS (SELECT l_orderkey, l_linenumber, (l_partkey * 37 % 256)::INT AS r, (l_suppkey * 91 % 256)::INT AS g, (l_orderkey * 53 % 256)::INT AS b FROM lineitem)"
_HSV = f"""{_RGB}, mx AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px),
hsv AS (SELECT *, CASE WHEN hi = lo THEN 0.0 WHEN r = hi THEN 60.0 * (g - b) / (hi - lo) WHEN g = hi THEN 120 + 60.0 * (b - r) / (hi - lo) ELSE 240 + 60.0 * (r - g) / (hi - lo) END AS h0, CASE WHEN hi = 0 THEN 0.0 ELSE (hi - lo)::DOUBLE / hi END AS s, hi / 255.0 AS v FROM mx),
hs AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM hsv)"""


def _d(t):
    return f"sqrt(2.0 * (r - {t[0]}) * (r - {t[0]}) + 4.0 * (g - {t[1]}) * (g - {t[1]}) + 3.0 * (b - {t[2]}) * (b - {t[2]}))"


def _px(spark, sf_dir):
    c = lambda n, m: (F.col(n) * m % 256).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey", 37).alias("r"), c("l_suppkey", 91).alias("g"), c("l_orderkey", 53).alias("b"))


@query(f"WITH {_HSV} SELECT l_orderkey, l_linenumber, r, g, b, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v, round({_d(color.SEA)}, 6) AS dist FROM hs")
def f21_rgb_to_hsv(spark, sf_dir):
    rgb = [F.col(x) for x in "rgb"]
    hsv = color.rgb_to_hsv(*rgb)
    return _px(spark, sf_dir).select("l_orderkey", "l_linenumber", *"rgb", *[F.round(hsv[x], 6).alias(x) for x in "hsv"], F.round(color.rgb_distance(*rgb, color.SEA), 6).alias("dist"))


@query(
    f"""WITH {_HSV} SELECT l_orderkey, l_linenumber, r, g, b, CASE WHEN v < 0.30 THEN NULL WHEN s < 0.12 THEN CASE WHEN {_d(color.GREY)} <= 60 THEN 'grey' END WHEN {_d(color.SEA)} < 75 THEN NULL
    WHEN h >= 10 AND h < 45 AND s <= 0.40 AND v <= 0.86 AND {_d(color.BROWN)} < {_d(color.ORANGE)} THEN 'brown'
    WHEN h >= 345 OR h < 15 THEN 'red' WHEN h < 50 THEN 'orange' WHEN h < 80 THEN 'yellow' WHEN h < 165 THEN 'green' WHEN h < 200 THEN 'light_blue' WHEN h < 260 THEN 'blue' WHEN h < 315 THEN 'purple' ELSE 'pink' END AS color FROM hs"""
)
def f22_classify_rgb(spark, sf_dir):
    return _px(spark, sf_dir).select("l_orderkey", "l_linenumber", *"rgb", color.classify_rgb(F.col("r"), F.col("g"), F.col("b")).alias("color"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'purple' WHEN 2 THEN 'green' ELSE '' END AS color FROM lineitem")
def f30_color_name_from_hex(spark, sf_dir):
    r = F.col("l_linenumber") % 4
    raw = F.when(r == 0, "#ff7f7f").when(r == 1, "#123456").when(r == 2, "#00FF00").otherwise("")
    key = F.create_map(F.lit("Purple"), F.lit("#123456"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", color.color_name_from_hex(raw, key).alias("color"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 2) AS m, round(l_extendedprice / 7, 4) AS q FROM lineitem")
def f23_round_to(spark, sf_dir):
    x = F.col("l_extendedprice") / 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.round_to(x, 2).alias("m"), numeric.round_to(x, 4).alias("q"))


@query("SELECT o_orderkey, o_custkey % 3 || ',' || o_custkey % 5 || ',7,' || o_custkey % 3 AS ring FROM orders WHERE o_custkey % 3 <> 7")
def f24_stitch_ring(spark, sf_dir):
    c = F.col("o_custkey")
    arcs = F.array(F.array(c % 3, c % 5), F.array(c % 5, F.lit(7).cast("bigint")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(geo.stitch_ring(arcs).cast("array<string>"), ",").alias("ring"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 > 3 THEN o_custkey % 7 WHEN o_custkey % 11 > 3 THEN o_custkey % 11 END AS hit FROM orders")
def f25_first_match(spark, sf_dir):
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", collections.first_match(F.array(c % 7, c % 11), lambda x: x > 3).alias("hit"))


@query("""SELECT o_orderkey, '{"a":"' || (o_custkey % 5) || '","b":"' || (o_custkey % 3) || '","c":"x"}' AS json FROM orders""")
def f26_f27_maps_json(spark, sf_dir):
    s = lambda m: (F.col("o_custkey") % m).cast("string")
    merged = collections.merge_maps(F.create_map(F.lit("c"), F.lit("x"), F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), s(3), F.lit("a"), s(5)))
    return table(spark, sf_dir, "orders").select("o_orderkey", collections.sorted_json(merged).alias("json"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def f27_parse_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", collections.parse_json(F.col("props"), "k bigint")["k"].alias("k"))


@query(r"SELECT page_id, regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)/*$', 1) AS name, regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages")
def f29_url_name_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_name(F.col("url")).alias("name"), text.url_stem(F.col("url")).alias("stem"))


def _map_urls(spark, sf_dir):
    k = F.col("l_orderkey")
    net = F.when(k % 3 == 0, "CBS").when(k % 3 == 1, "fox").otherwise("map")
    letter = F.get(F.array(*[F.lit(x) for x in ("-E", "_L", "-S", "-T", "")]), (k % 5).cast("int"))
    url = F.concat(F.lit("https://x.example/2024/"), F.lpad((k % 18).cast("string"), 2, "0"), F.lit("-"), net, letter, F.lit("-V"), F.col("l_linenumber").cast("string"), F.lit(".png"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", url.alias("url"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 3 = 2 THEN 'UNKNOWN' ELSE CASE l_orderkey % 3 WHEN 0 THEN 'CBS' ELSE 'FOX' END || '_' || CASE l_orderkey % 5 WHEN 0 THEN 'EARLY' WHEN 1 THEN 'LATE' WHEN 3 THEN 'SPECIAL' ELSE 'SINGLE' END END AS slot, l_linenumber AS revision FROM lineitem"""
)
def p8_p9_slot_revision(spark, sf_dir):
    u = F.col("url")
    return _map_urls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", text.normalize_slot(u, F.lit(""), F.lit("")).alias("slot"), text.revision_from_url(u).alias("revision"))


# the pages hold no map images or comments with keys: both are put in front of each page's own markup
@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '0' ELSE '' END || (page_id % 7) || '.png,z.png' AS images, (page_id % 90)::INT AS swatch, length(html) AS chars FROM pages WHERE html IS NOT NULL")
def f31_f33_page_images(spark, sf_dir):
    p = F.col("page_id")
    name = F.concat(F.when(p % 2 == 0, "0").otherwise(""), (p % 7).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, ("png", "gif", "jpeg", "webp"))), (p % 4 + 1).cast("int"))
    html = F.concat(F.lit("<img src='/swatches/"), (p % 90).cast("string"), F.lit("."), kind, F.lit("?v' ><IMG SRC=\"a/z.png\"><img src='https://x.example/q/"), name, F.lit(".png'><img src='a/z.png'>"), F.col("html"))
    df = table(spark, sf_dir, "pages").filter("html is not null")
    return df.select("page_id", F.array_join(text.page_images(html), ",").alias("images"), text.swatch_number(html).alias("swatch"), F.length("html").cast("long").alias("chars"))


@query("SELECT page_id, 'grey:#00AA' || lpad((page_id % 90 + 10)::VARCHAR, 2, '0') || ',red:#FF7F7F' AS key FROM pages WHERE html IS NOT NULL")
def f32_color_key(spark, sf_dir):
    html = F.concat(F.lit("<b>blue: #111111</b><!-- Red: #ff7f7f Gray=#00aa"), (F.col("page_id") % 90 + 10).cast("string"), F.lit("-->"), F.col("html"))
    entries = F.array_sort(F.map_entries(text.color_key(html)))
    df = table(spark, sf_dir, "pages").filter("html is not null")
    return df.select("page_id", F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("key"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_extract_all(html, '<(h1|h2|p|div|li)[ >]', 1) AS tags FROM pages),
    n AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM t),
    h AS (SELECT *, CASE WHEN tag IN ('h1', 'h2') OR (tag = 'p' AND pos % 4 = 0) THEN tag || pos END AS heading FROM n),
    f AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slot FROM h)
    SELECT page_id, slot, count(*) AS lines FROM f WHERE tag IN ('p', 'li') GROUP BY page_id, slot"""
)
def w11_section_fill(spark, sf_dir):
    """Every line of a page stands under the latest heading before it, or under none: titles and
    every fourth node that is a paragraph are headings."""
    found = F.regexp_extract_all("html", F.lit("<(h1|h2|p|div|li)[ >]"), F.lit(1))
    nodes = table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "tag"))
    heading = F.col("tag").isin("h1", "h2") | ((F.col("tag") == "p") & (F.col("pos") % 4 == 0))
    nodes = nodes.withColumn("heading", F.when(heading, F.concat("tag", F.col("pos").cast("string"))))
    return legends.section_fill(nodes, ["page_id"]).filter("tag in ('p', 'li')").groupBy("page_id", "slot").agg(F.count("*").alias("lines"))


@query(
    """WITH p AS (SELECT page_id, page_id % 5 AS k FROM pages)
    SELECT page_id, 'CBS_EARLY' AS slot, 'red' AS color, 'Home' || k || ' @ Away' AS game, false AS ambiguous FROM p
    UNION ALL SELECT page_id, 'FOX_LATE', 'light_blue', CASE WHEN k > 0 THEN 'X' || k || ' at Y' END, k = 0 FROM p
    UNION ALL SELECT page_id, 'FOX_LATE', 'green', 'No Game', false FROM p"""
)
def c7_extract_legend(spark, sf_dir):
    """Legends put before each page's own markup: swatches, colour keys, leading names, a disagreement."""
    k = (F.col("page_id") % 5).cast("string")
    legend = F.concat(
        F.lit("<h3>CBS EARLY</h3><p><img src='/swatches/1.png'> Home"), k, F.lit(" @ Away</p><!-- Cyan: #123456 --><h3>FOX LATE</h3><p><font color='#123456'>X"), k, F.lit(" at Y</font></p>"),
        F.when(k == "0", "<p>Light Blue: Other vs Y</p>").otherwise(""), F.lit("<p>Green: No Game</p>"),
    )
    df = table(spark, sf_dir, "pages").select("page_id", F.concat(legend, F.coalesce("html", F.lit(""))).alias("html"))
    return legends.extract_legend(df, ["page_id"]).drop("games")
