"""Worked examples of the column functions."""

import datetime as dt

from pyspark.sql import functions as F

from fieldcast.functions import collections, color, geo, numeric, text, time


def one(spark, expr, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'date' if isinstance(v, dt.date) else 'long'}" for n, v in zip(names, row))
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def each(spark, f, cases):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, x string")
    got = {r["i"]: r["r"] for r in df.select("i", f(F.col("x")).alias("r")).collect()}
    for i, (k, want) in enumerate(cases.items()):
        assert got[i] == want, (k, got[i], want)


def test_names(spark):
    each(spark, text.name_key, {"A.J. Brown Jr.": "ajbrown", "aj brown": "ajbrown", "Kenneth Walker III": "kennethwalker", "": "", "Vivian V": "vivian"})
    each(spark, text.canonical_color, {"Light Blue": "light_blue", " GRAY ": "grey", "cyan": "light_blue", "red": "red"})
    each(spark, text.injury_label, {"OUT": "Out", "INJURY_RESERVE": "IR", "NEW_CODE": "New Code", "": "Healthy"})
    each(spark, text.username, {"@me": "me", "https://x.example/user/me/?a": "me", "me": "me"})
    each(spark, text.league_id, {"123": "123", "https://x.example/leagues/45/team": "45", "?leagueId=77": "77", "none": None})


def test_games(spark):
    each(spark, text.clean_game_text, {"  A @  B (to be announced) ": "A @ B", "A @ B (LATE)": "A @ B (LATE)", "- A at B | ": "A at B", "A @ B (subject to change)": "A @ B"})
    each(spark, lambda c: F.concat_ws("|", text.split_matchup(c)["away"], text.split_matchup(c)["home"]), {"Pittsburgh @ NY Jets": "Pittsburgh|NY Jets", "NO GAME": "|", "A vs. B": "A|B", "A versus B": "A|B"})
    each(spark, lambda c: F.concat_ws("|", text.split_window_marker(c)["game"], text.split_window_marker(c)["window"]), {"A @ B (late)": "A @ B|LATE", "A @ B": "A @ B|"})
    each(spark, lambda c: F.array_join(text.game_teams(c), "|"), {"A @ B (EARLY)": "A|B", "NO GAME": "NO GAME", "A vs B": "A vs B"})
    each(spark, text.heading_slot, {"FOX TUESDAY": "FOX_SPECIAL", "CBS Early Games": "CBS_EARLY", "fox  4:25": "FOX_LATE", "CBS single": "CBS_SINGLE", "CBS": None, "NBC late": None})


def test_urls(spark):
    e = F.lit("")
    each(spark, lambda c: text.normalize_slot(c, e, e), {"https://h/13-CBS-L-V2.png": "CBS_LATE", "h/01-FOX-V4.png": "FOX_SINGLE", "x/09-FOX-T.png": "FOX_SPECIAL", "http://h/x.png": "UNKNOWN", "/a/CBS_E.png?q": "CBS_EARLY"})
    each(spark, lambda c: text.normalize_slot(F.lit("http://h/x.png"), c, e), {"CBS late": "CBS_LATE", "FOX": "UNKNOWN", "fox early": "FOX_EARLY"})
    each(spark, text.revision_from_url, {"h/13-CBS-L-V2.png": 2, "h/01-FOX-V4.png": 4, "h/09-FOX-T.png": 0})
    each(spark, text.url_stem, {"http://h/a/b.c.png?x": "b.c", "http://h": "", ".hidden": ".hidden"})
    each(spark, text.plausible_zip, {" 501 ": "00501", "12345-6789": "12345", "1234x": None})


def test_time(spark):
    each(spark, time.parse_et_time, {"1:00 PM": 780, "12:05 AM": 5, "12:00 PM": 720, "TBD": None})
    at = lambda d, t: one(spark, time.et_instant(F.col("d"), F.col("t")), d=d, t=t)
    assert at(dt.date(2026, 9, 13), "1:00 PM") == dt.datetime(2026, 9, 13, 17)
    assert at(dt.date(2026, 12, 13), "1:00 PM") == dt.datetime(2026, 12, 13, 18)
    assert at(dt.date(2026, 9, 13), "TBD") is None
    local = one(spark, time.local_clock(time.et_instant(F.col("d"), F.lit("1:00 PM")), F.lit("America/Phoenix")), d=dt.date(2026, 9, 13))
    assert (local["time"], local["date"], local["shifted"]) == ("10:00 AM", dt.date(2026, 9, 13), False)
    assert one(spark, time.season_of(F.col("d")), d=dt.date(2026, 1, 4)) == 2025
    assert one(spark, time.season_of(F.col("d")), d=dt.date(2026, 7, 1)) == 2026
    names = spark.sql("select timestamp_ntz'2026-09-13 17:00:00' as t, explode(array('America/Phoenix', 'America/New_York', 'America/Puerto_Rico', 'Europe/Paris')) as z")
    assert {r["z"]: r["zone_abbr"] for r in time.zone_abbr(names, "t", "z").collect()} == {"America/Phoenix": "MST", "America/New_York": "EDT", "America/Puerto_Rico": "AST", "Europe/Paris": "GMT+2"}


def test_every_wall_clock_has_one_period(spark):
    """Through a year and more of five zones, minute steps at the changes: instants and wall
    clocks each lie in one period, and equal the zone database's."""
    from zoneinfo import ZoneInfo

    zones = ["America/New_York", "America/Phoenix", "America/Adak", "America/Indiana/Knox", "America/Winnipeg"]
    rules = time.zone_rules(spark, tuple(zones), 2005, 2007)
    walls = spark.range(0, 2 * 366 * 24 * 2).selectExpr("timestamp_ntz'2005-12-30 00:15:00' + id * interval 30 minutes AS w")
    df = walls.join(rules.select("zone").distinct()).cache()
    df = time.in_zones(time.to_instants(df, "w", F.col("zone"), rules), "instant", F.col("zone"), rules)
    rows = df.filter("year(w) < 2008 and year(instant) < 2008").collect()
    assert len(rows) == df.filter("year(w) < 2008 and year(instant) < 2008").select("w", "zone").distinct().count()
    for r in rows:
        at = r.w.replace(tzinfo=ZoneInfo(r.zone))
        utc = at.astimezone(dt.timezone.utc)
        assert r.instant == utc.replace(tzinfo=None), (r.zone, r.w)
        there = utc.astimezone(ZoneInfo(r.zone))
        assert (r.there, r.zone_abbr) == (there.replace(tzinfo=None), there.tzname()), (r.zone, r.w)


def test_kickoffs_in_words(spark):
    from fieldcast.jobs.kickoffs import kickoff_localised

    rows = [(dt.date(2026, 9, 13), "8:20 PM", "America/Los_Angeles"), (dt.date(2026, 9, 13), "11:30 PM", "America/Juneau"), (dt.date(2026, 1, 4), "TBD", "America/Boise"), (dt.date(2026, 9, 13), "1:00 PM", None), (dt.date(2026, 9, 13), "12:30 AM", "America/Indiana/Knox")]
    got = [tuple(r)[4:] for r in kickoff_localised(spark.createDataFrame(rows, "day date, text string, zone string").coalesce(1), "day", "text", "zone").collect()]
    assert got[0] == ("5:20 PM", "PDT", "5:20 PM PDT", dt.date(2026, 9, 13), False, False)
    assert got[1] == ("7:30 PM", "AKDT", "7:30 PM AKDT", dt.date(2026, 9, 13), False, False)
    assert got[2] == ("TBD", "", "TBD", dt.date(2026, 1, 4), False, True)
    assert got[3] == ("1:00 PM", "EDT", "1:00 PM EDT", dt.date(2026, 9, 13), False, True)
    assert got[4] == ("11:30 PM", "CDT", "11:30 PM CDT", dt.date(2026, 9, 12), True, False)


def test_numbers(spark):
    for p, want in ((0.60, "likely"), (0.35, "maybe"), (0.15, "possibly"), (0.149, "unlikely")):
        assert one(spark, numeric.band(F.col("p")), p=p) == want
    table = [((i + 1) / 10, i / 10) for i in range(10)]
    assert one(spark, numeric.apply_calibration(F.col("p"), table), p=0.6) == 0.5
    assert one(spark, numeric.apply_calibration(F.col("p"), table), p=0.61) == 0.6
    assert one(spark, numeric.win_rate(F.col("s"), F.col("a")), s=1.0, a=3.0) == 0.28125
    p = one(spark, numeric.softmax(F.array(F.lit(0.28125), F.lit(0.40625)), 10.0))
    assert abs(p[1] - 0.777300) < 1e-6 and abs(sum(p) - 1) < 1e-12
    assert one(spark, numeric.intensity_class(F.lit(None).cast("double"), F.lit(False))) == "no_data"


def test_colors(spark):
    for rgb, want in {(255, 129, 129): "red", (131, 172, 255): "blue", (158, 229, 158): "green", (190, 190, 190): "grey", (200, 161, 140): "brown", (255, 193, 131): "orange", (209, 240, 255): None, (10, 10, 10): None}.items():
        assert one(spark, color.classify_rgb(F.col("r"), F.col("g"), F.col("b")), r=rgb[0], g=rgb[1], b=rgb[2]) == want
    assert one(spark, color.color_name_from_hex(F.lit("#855c33"))) == "brown"
    assert one(spark, color.color_name_from_hex(F.lit("zz"))) == ""


def test_arrays_and_maps(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, geo.stitch_ring(F.array(a(1, 2, 3), a(3, 4), a(4, 5)))) == [1, 2, 3, 4, 5, 1]
    assert one(spark, collections.first_present(F.lit(None).cast("string"), F.lit(" "), F.lit(" v "))) == "v"
    assert one(spark, collections.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))) == {"a": "1", "b": "2"}
    ring = lambda *ps: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ps])
    assert abs(one(spark, geo.ring_area(ring((0, 0), (4, 0), (4, 4), (0, 4)))) - 16) < 1e-9
    cut = lambda *ps: one(spark, geo.ring_area(geo.clip_ring(ring(*ps), F.lit(11), F.lit(9))))  # noqa: E731  the frame is 10 by 8
    assert cut((-5, -5), (5, -5), (5, 5), (-5, 5)) == 25 and cut((2, 2), (4, 2), (4, 3)) == 1
    assert cut((-9, -9), (30, -9), (30, 30), (-9, 30)) == 80 and cut((11, 0), (20, 0), (20, 5)) == 0
    ell = ((-6, -6), (4, -6), (4, 0), (0, 0), (0, 4), (-6, 4))
    assert cut(*ell) == 0 and abs(cut((-2, 4), (5, -3), (12, 4), (5, 11)) - 72) < 1e-9
    assert cut((1, 1), (9, 1), (9, 12), (7, 12), (7, 3), (3, 3), (3, 12), (1, 12)) == 8 * 2 + 4 * 5
    key = one(spark, text.color_key(F.lit("<!-- Red: #ff7f7f\nLight Blue = #00FFFF Red: #111111 -->")))
    assert key == {"red": "#111111", "light_blue": "#00FFFF"}
