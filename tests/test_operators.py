"""Worked examples of operators and jobs."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fieldcast.jobs import boundaries, feeds, maps, prediction
from fieldcast.operators import basic, compaction, consensus, geometry, images, legends, projections, rosters, snapshots, voting, win_model
from fieldcast.sources import readers, writers
from fieldcast.streaming.latest import keep_latest, latest


def test_final_revision(spark):
    rows = [(2024, 1, "S", 2, "wayback", "20240101", 5, 0), (2024, 1, "S", 2, "live", "", 5, 1), (2024, 1, "S", 1, "live", "20250101", 9, 2), (2024, 2, "S", 1, None, "20240101", None, 3), (2024, 2, "S", 1, None, "20240102", None, 4)]
    df = spark.createDataFrame(rows, "season int, week int, slot string, revision int, source string, capture string, bytes long, ord long")
    got = snapshots.select_final(df, ["season", "week", "slot"], "revision", "source", "capture", "bytes", ["ord"])
    assert sorted(r["ord"] for r in got.collect()) == [1, 4]
    again = snapshots.select_final(got, ["season", "week", "slot"], "revision", "source", "capture", "bytes", ["ord"])
    assert sorted(r["ord"] for r in again.collect()) == [1, 4]


@pytest.mark.parametrize("red, blue, none, status, review", [(14, 6, 5, "ok", False), (11, 9, 0, "mixed_boundary", True), (11, 0, 0, "low_samples", True), (0, 0, 3, "no_color", True), (12, 0, 60, "low_colored_share", True)])
def test_vote(spark, red, blue, none, status, review):
    rows = [(1, "red", True)] * red + [(1, "blue", True)] * blue + [(1, None, False)] * none
    v = voting.majority_vote(spark.createDataFrame(rows, "market int, color string, ok boolean"), ["market"], "color", "ok")
    v = v.withColumn("status", voting.classification_status(F.col("valid"), F.col("total"), F.col("confidence"))).withColumn("game", F.when(F.col("color").isNotNull(), "A @ B"))
    r = v.withColumn("review", voting.review_flag(F.col("status"), F.col("color"), F.col("game"), F.lit(False), F.col("confidence"))).first()
    assert (r["status"], r["review"], r["valid"], r["total"]) == (status, review, red + blue, red + blue + none)


def test_compaction_round_trip(spark):
    rows = [(1, 1, "X", 0.9, False), (1, 2, "X", 0.55, False), (1, 3, "X", 0.8, False), (1, 4, "Y", 0.9, False)]
    df = spark.createDataFrame(rows, "week int, market int, game string, confidence double, review boolean")
    compact, proof = maps.build_compact_dataset(df, ["week"], "market")
    r = compact.first()
    assert (r["g"], r["d"], r["e"], r["u"]) == (["X", "Y"], 0, {"4": 1}, {"2": 0.55})
    assert proof.first().asDict() == {"n_rows": 4, "n_mismatch": 0}
    assert compaction.verify_roundtrip(compact.limit(0), df, ["week"], "market", "game").first()["n_mismatch"] == 4


def test_prefix_table(spark):
    df = spark.createDataFrame([("00100", "A"), ("00101", "A"), ("00102", "B"), ("00200", "B")], "zip string, zone string")
    major, exact, wrong = maps.compact_prefix_table(df, "zip", "zone")
    assert {(r["prefix"], r["value"]) for r in major.collect()} == {("001", "A"), ("002", "B")}
    assert [(r["code"], r["value"]) for r in exact.collect()] == [("00102", "B")] and wrong.count() == 0


def _history(spark):
    rows = [(2021, 1, "S", 1, "P @ Q"), (2021, 1, "S", 2, "R @ S"), (2022, 1, "S", 1, "R @ S"), (2022, 1, "S", 2, "P @ Q")]
    return spark.createDataFrame(rows, "season int, week int, slot string, market int, game string")


def test_win_rates(spark):
    final = {(r["market"], r["team"]): r["rate"] for r in prediction.train_rates(_history(spark), ["season", "week", "slot"], "market", final=True).filter("fold = 2023").collect()}
    assert (final[1, "P"], final[1, "R"]) == (0.28125, 0.40625)
    folds = prediction.train_rates(_history(spark), ["season", "week", "slot"], "market").select("fold").distinct()
    assert [r["fold"] for r in folds.collect()] == [2022]  # a season is not in its own fold
    dec = prediction.decisions_of(_history(spark), ["season", "week", "slot"], "market")
    e = win_model.evaluate(win_model.predictions(dec.filter("season = 2022"), 10.0)).first()
    assert e["decisions"] == 2 and e["top2"] == 1.0
    out = prediction.fit(_history(spark).unionByName(_history(spark).withColumn("season", F.col("season") + 2)), ["season", "week", "slot"], "market", 2024)
    assert out["temperature"] in win_model.GRID and out["metrics"].first()["decisions"] == 2


def test_calibration(spark):
    bins = spark.createDataFrame([(3, 200, 0.40, 0.35), (5, 150, 0.35, 0.55), (9, 500, 0.90, 0.95), (7, 20, 0.99, 0.75)], "band int, n long, rate double, mid double")
    got = [r["value"] for r in win_model.monotone_calibration(bins).orderBy("band").collect()]
    assert got == [0.1, 0.1, 0.1, 0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.9]


def test_depth_trim(spark):
    rows = [(1, "T", f"w{i:02}", "WR", 30.0 - i) for i in range(20)] + [(1, "T", "k", "K", 0.1), (1, "D", "d", "DEF", 9.0)]
    df = projections.team_week_has_skill(spark.createDataFrame(rows, "week int, team string, name string, position string, points double"), ["week", "team"], "position")
    got = projections.depth_trim(df, ["week", "team"], "position", "points", "name").collect()
    assert len(got) == 16 and {r["name"] for r in got} == {"k", *(f"w{i:02}" for i in range(15))}


def test_position_rank(spark):
    rows = [(1, "a", "WR", 10.0, 0), (1, "b", "WR", 8.0, 1), (1, "c", "WR", 8.0, 2), (1, "d", "WR", 0.0, 3)]
    df = projections.position_rank(spark.createDataFrame(rows, "week int, name string, position string, points double, ord int"), ["week"], "position", "points", ["ord"])
    assert {r["name"]: r["position_rank"] for r in df.collect()} == {"a": "WR1", "b": "WR2", "c": "WR3", "d": "WR4"}


def test_medians(spark):
    q = spark.createDataFrame([(1, -110.0, 44.0, 44.0), (1, -105.0, 45.0, None), (1, None, None, None), (2, None, None, None)], "id int, p double, o double, u double")
    assert {r["id"]: r["m"] for r in q.groupBy("id").agg(consensus.consensus_median(F.col("p")).alias("m")).collect()} == {1: -107.5, 2: None}
    assert {r["id"]: r["point"] for r in consensus.pooled_total(q, ["id"], F.col("o"), F.col("u")).collect()} == {1: 44.0, 2: None}


def test_point_in_polygon(spark):
    square = [(0, 0, 0, 0, 0.0, 0.0), (0, 0, 0, 1, 4.0, 0.0), (0, 0, 0, 2, 4.0, 4.0), (0, 0, 0, 3, 0.0, 4.0), (0, 0, 1, 0, 1.0, 1.0), (0, 0, 1, 1, 2.0, 1.0), (0, 0, 1, 2, 2.0, 2.0), (0, 0, 1, 3, 1.0, 2.0)]
    rings = spark.createDataFrame(square, "poly int, part int, ring int, pos int, x double, y double")
    pts = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.5, 1.5), (3, 5.0, 5.0)], "id int, x double, y double")
    order = spark.createDataFrame([(0, 0)], "poly int, ord int")
    assert [(r["id"], r["poly"]) for r in geometry.point_in_polygon(pts, rings, order).collect()] == [(1, 0)]


def test_auto_assign(spark):
    rows = [(1, "QB", 20.0), (1, "QB", 18.0), (1, "RB", 15.0), (1, "RB", 14.0), (1, "RB", 13.0), (1, "WR", 12.0), (1, "WR", 11.0), (1, "WR", 16.0), (1, "TE", 5.0), (1, "K", 3.0), (1, "DEF", 2.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "roster_id int, position string, points double, ord int")
    got = {r["ord"]: r["slot"] for r in rosters.auto_assign(df).collect()}
    assert got == {0: "QB", 1: "BN1", 2: "RB1", 3: "RB2", 4: "FLEX", 5: "WR2", 6: "BN2", 7: "WR1", 8: "TE", 9: "K", 10: "DEF"}


def test_resolve_name(spark):
    idx = spark.createDataFrame([("ajbrown",), ("tombrown",), ("kennethwalker",), ("xy",)], "name_key string")
    q = spark.createDataFrame([("ajbrown",), ("brown",), ("walker",), ("x",), ("nobody",), ("",)], "query string")
    assert {(r["query"], r["name_key"]) for r in rosters.resolve_name(q, idx).collect()} == {("ajbrown", "ajbrown"), ("walker", "kennethwalker"), ("x", "xy")}


def png(path, width, height, pixel):
    raw = b"".join(b"\0" + bytes(c for x in range(width) for c in pixel(x, y)) for y in range(height))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


PARTS = "array<array<array<struct<x:double,y:double>>>>"


def box(x1, x2, y1=0.0, y2=720.0):
    return [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]


def test_images_to_assignments(spark, tmp_path):
    png(tmp_path / "13-CBS-L-V2.png", 128, 72, lambda x, y: (255, 129, 129) if x < 64 else (131, 172, 255))
    (tmp_path / "copy.png").write_bytes((tmp_path / "13-CBS-L-V2.png").read_bytes())
    (tmp_path / "bad.png").write_bytes(b"no image")
    listing = images.read_files(spark, str(tmp_path))
    files = images.read_images(spark, str(tmp_path), listing)
    assert listing.count() == 3 and sorted((r["width"], r["copies"]) for r in files.collect()) == [(-1, 1), (128, 2)]
    shapes = [("501", [[box(10.0, 600.0)]]), ("502", [[box(700.0, 1200.0)]]), ("503", [[box(2000.0, 2100.0)]]), ("504", []), ("505", [[[(-900.0, -900.0), (850.0, -900.0), (-900.0, 850.0)]]])]
    polys = spark.createDataFrame([(p, s, 1280, 720) for p, s in shapes], f"poly string, parts {PARTS}, frame_w int, frame_h int")
    digest = hashlib.sha256((tmp_path / "copy.png").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([(2024, 1, "", "", "http://h/13-CBS-L-V2.png", "live", "", "gone/away.png", "downloaded", digest, 5, 0), (2024, 1, "", "", "http://h/x.png", "live", "", "", "downloaded", "", 5, 1)], "season int, week int, slot string, context string, image_url string, page_source string, capture_timestamp string, local_path string, status string, sha256 string, bytes long, ord long")
    html = "<h3>CBS LATE</h3><p><img src='/swatches/1.png'> Pittsburgh @ NY Jets (LATE)</p><p>Blue: Miami at Buffalo</p>"
    attempts = spark.createDataFrame([(2024, 1, 0, "<p>nothing</p>"), (2024, 1, 1, None), (2024, 1, 2, html), (2024, 1, 3, "<h3>CBS LATE</h3><p>Red: A at B</p>")], "season int, week int, priority int, html string")
    none = spark.createDataFrame([], "season int, week int, slot string, color string, game string")
    got = {r["market"]: r for r in maps.build_assignments(manifest, listing, files, polys, attempts, none).collect()}
    want = {"501": ("red", "Pittsburgh @ NY Jets", "ok"), "502": ("blue", "Miami at Buffalo", "ok"), "503": (None, None, "outside_map"), "504": (None, None, "empty_polygon"), "505": (None, None, "outside_map")}
    assert {m: (r["color"], r["game"], r["status"]) for m, r in got.items()} == want
    assert (got["501"]["away_team"], got["501"]["home_team"], got["501"]["effective_window"], got["501"]["review"]) == ("Pittsburgh", "NY Jets", "LATE", False)
    assert {r["color"] for r in images.dominant_color(files).collect()} <= {"red", "blue"}


def test_sampled_points(spark):
    """Every sampled pixel lies in its polygon and not in its hole; a sliver gets more points, and
    one between grid lines its middle; the count follows the target."""
    width, height = 400, 300
    data = bytes(v for y in range(height) for x in range(width) for v in (x % 256, y % 256, x // 256 + 2 * (y // 256)))
    files = spark.createDataFrame([("a", 1, "a", width, height, 3, bytearray(data))], "digest string, copies int, path string, width int, height int, channels int, data binary")
    shapes = [("big", [[box(-50.0, 200.0, 20.0, 220.0), box(100.0, 140.0, 60.0, 180.0)]]), ("far", [[box(500.0, 600.0)]]), ("parts", [[box(210.0, 300.0, 0.0, 100.0)], [box(250.0, 390.0, 150.0, 290.0)]]), ("sliver", [[box(301.0, 303.0, 5.0, 8.0)]]), ("thin", [[[(310.0, 5.0), (390.0, 9.5), (310.0, 6.0)]]])]
    polys = spark.createDataFrame([(p, s, width, height) for p, s in shapes], f"poly string, parts {PARTS}, frame_w int, frame_h int")
    seen = {}
    for r in images.sample_polygons(files, images.polygon_frames(polys, files)).collect():
        seen.setdefault(r["poly"], []).extend([(r["b"] + 256 * (r["r"] % 2), r["g"] + 256 * (r["r"] // 2))] * r["n"])
    assert set(seen) == {"big", "parts", "sliver", "thin"}
    assert all(x <= 200 and 20 <= y <= 220 and not (101 <= x <= 139 and 61 <= y <= 179) for x, y in seen["big"])
    assert 150 < len(seen["big"]) < 300 and 150 < len(seen["parts"]) < 300
    assert all((210 <= x <= 300 and y <= 100) or (250 <= x <= 390 and 150 <= y <= 290) for x, y in seen["parts"])
    assert len(seen["sliver"]) == 30 and len(seen["thin"]) >= 20


def test_legend(spark):
    html = "<!-- Purple: #123456 --><h2>FOX EARLY</h2><div><font color='#123456'>x</font> A @ B</div><div><font color='#123456'>x</font> C @ D</div><h2>FOX LATE</h2><p>Red: E at F</p><p>no matchup</p>"
    got = {(r["slot"], r["color"]): (r["games"], r["ambiguous"]) for r in legends.extract_legend(spark.createDataFrame([(1, html), (2, None)], "page int, html string"), ["page"]).collect()}
    assert got == {("FOX_EARLY", "purple"): (["x A @ B", "x C @ D"], True), ("FOX_LATE", "red"): (["E at F"], False)}


def test_odds(spark, tmp_path):
    (tmp_path / "o.json").write_text(
        '[{"id":"e","commence_time":"2026-09-13T17:00:00Z","away_team":"A","home_team":"B","bookmakers":[{"last_update":"2026-09-01T00:00:00Z","markets":['
        '{"key":"totals","last_update":"2026-09-02T00:00:00Z","outcomes":[{"name":"Over","price":-110,"point":44},{"name":"Under","price":-105,"point":45}]},'
        '{"key":"h2h","outcomes":[{"name":"A","price":120},{"name":"B","price":-140}]}]},{"markets":[{"key":"h2h","outcomes":[{"name":"A","price":130}]}]}]},{"id":"x","away_team":"?","home_team":"B","bookmakers":[]}]'
    )
    raw = readers.read_nested_json(spark, str(tmp_path / "o.json"), feeds.ODDS)
    r = feeds.odds_consensus(raw, spark.createDataFrame([("A", "AA"), ("B", "BB")], "name string, code string")).collect()
    assert len(r) == 1 and (r[0]["away"], r[0]["total"]["point"], r[0]["moneyline"]["away"], r[0]["spread"]["away_point"], r[0]["books_count"]) == ("AA", 44.5, 125.0, None, 2)
    assert str(r[0]["last_update"])[:10] == "2026-09-02"


def test_projection_feed(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"player":{"fullName":"Ann","defaultPositionId":3,"proTeamId":7,"injuryStatus":"OUT","stats":[{"statSourceId":0,"scoringPeriodId":1,"appliedTotal":9},{"statSourceId":1,"scoringPeriodId":1,"appliedTotal":12.34}]}}\n'
    )
    raw = readers.read_nested_json(spark, str(tmp_path / "p.json"), feeds.PLAYERS).withColumns({"week": F.lit(1), "ord": F.lit(0)})
    r = feeds.projection_feed(raw, spark.createDataFrame([("7", "T")], "id string, code string"), spark.createDataFrame([("3", "WR")], "id string, code string")).first()
    assert (r["name"], r["team"], r["points"], r["position_rank"], r["injury_status"]) == ("Ann", "T", 12.3, "WR1", "Out")


def test_player_dictionary(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"1":{"position":"QB","team":"WSH","full_name":"","first_name":"Al","last_name":"B"},"2":{"position":"DEF","team":"T"},"3":{"position":"LB","team":"T","full_name":"C"}}')
    raw = readers.read_keyed_json(spark, str(tmp_path / "k.json"), "position:string,team:string,full_name:string,first_name:string,last_name:string")
    got = feeds.player_dictionary(raw, spark.createDataFrame([("WSH", "WAS")], "alias string, code string"), ["QB", "DEF"], spark.createDataFrame([("T", "Tigers")], "code string, name string"))
    assert {(r["id"], r["name"], r["team"]) for r in got.collect()} == {("1", "Al B", "WAS"), ("2", "Tigers", "T")}


def test_topology(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"type":"Topology","transform":{"scale":[0.5,0.5],"translate":[10,20]},"arcs":[[[4,2],[-1,1],[0,3]],[[4,2],[2,2],[-3,2]]],"objects":{"m":{"geometries":[{"type":"Polygon","id":"501","properties":{"name":"N"},"arcs":[[0,-2]]}]}}}')
    rings = readers.read_boundaries(spark, str(tmp_path / "t.json")).orderBy("pos").collect()
    assert [(r["x"], r["y"]) for r in rings] == [(12.0, 21.0), (11.5, 21.5), (11.5, 23.0), (13.0, 22.0), (12.0, 21.0)]
    assert boundaries.centroids(spark.createDataFrame(rings)).first()["x"] == 12.25
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"properties":{"dma":"9","name":"G"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}}]}')
    assert readers.read_boundaries(spark, str(tmp_path / "g.json")).count() == 3
    (tmp_path / "bad.json").write_text('{"type":"Other"}')
    with pytest.raises(Exception, match="not a boundary file"):
        readers.read_boundaries(spark, str(tmp_path / "bad.json")).count()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfname,n\n"a ""b"", c",1\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "name string, n int").collect()] == [('a "b", c', 1)]
    (tmp_path / "d.js").write_text('window.D = {"v": 3};\n')
    assert readers.read_js_payload(spark, str(tmp_path / "d.js"), "v int").first()["v"] == 3
    (tmp_path / "p.html").write_text("<p>x</p>")
    assert readers.read_pages(spark, str(tmp_path / "p.html")).first()["html"] == "<p>x</p>"
    df = spark.createDataFrame([(1, "x", 9)], "a int, b string, c int")
    writers.write_json_payload(df.select("a", "b"), str(tmp_path / "out"), schema=1)
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == '{"schema":1,"rows":[{"a":1,"b":"x"}]}'
    root = str(tmp_path / "pub")
    writers.publish_if(df, df.limit(0), root, ["b", "a"])
    with pytest.raises(writers.Refused):
        writers.publish_if(df, df, root)
    with pytest.raises(writers.Refused):
        writers.publish_if(df.limit(0), df.limit(0), root)
    assert [tuple(r) for r in writers.published(spark, root).collect()] == [("x", 1)]


def test_stream_of_snapshots(spark, tmp_path):
    merge = keep_latest(spark, str(tmp_path / "s"), ["k"], lambda: [-F.col("week"), F.col("ord")])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, week int, ord int")
    merge(batch(("a", 1, 0), ("b", 1, 1)), 0)
    merge(batch(("a", 2, 2)), 1)
    merge(batch(("a", 2, 2)), 1)
    assert {tuple(r) for r in latest(spark, str(tmp_path / "s")).collect()} == {("a", 2, 2), ("b", 1, 1)}
    parts = lambda: sorted(p.name for p in (tmp_path / "s").glob("v-*/_bucket=*"))
    assert len(parts()) == 4  # each batch wrote its own buckets alone
    merge(batch().limit(0), 2)
    assert len(parts()) == 4 and latest(spark, str(tmp_path / "none")) is None


def test_small_tables_only(spark):
    assert basic.small(spark.range(5), rows=4)._jdf.queryExecution().logical().toString().count("ResolvedHint") == 0
