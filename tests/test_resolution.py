"""The resolver on hand-made schedules: every source, bands of the asked game, markers."""

import pytest
from pyspark.sql import functions as F

from fieldcast.jobs import coverage
from fieldcast.operators import resolution

K = ["week", "slot"]


@pytest.fixture(scope="module")
def answers(spark):
    """Market m favours A by far; o knows nothing. Slot X has two games, Y three, Z one."""
    schedule = spark.createDataFrame([(1, "X", "A @ B"), (1, "X", "C @ D"), (1, "Y", "A @ B"), (1, "Y", "C @ D"), (1, "Y", "E @ F"), (1, "Z", "C @ D"), (1, None, "G @ H"), (1, None, "I @ J")], "week int, slot string, game string")
    markets = spark.createDataFrame([("m",), ("o",)], "market string")
    rates = spark.createDataFrame([("m", "A", 0.9), ("m", "B", 0.5), ("m", "C", 0.1), ("m", "D", 0.1)], "market string, team string, rate double")
    national = spark.createDataFrame([(1, None, "G @ H")], "week int, slot string, game string")
    actual = spark.createDataFrame([(1, "X", "o", "C @ D (LATE)", None), (1, "Y", "o", "E @ F", 0.55)], "week int, slot string, market string, game string, confidence double")
    df = coverage.resolve_schedule(markets, schedule, actual, rates, K, "market", national, [(0.5, 0.4), (1.0, 0.8)])
    return {(r.market, r.slot, r.game): r for r in df.collect()}


def test_a_losing_game_is_unlikely(answers):
    win, lose = answers["m", "X", "A @ B"], answers["m", "X", "C @ D"]
    assert win.source == lose.source == "predicted" and win.seen == lose.seen == "A @ B"
    assert (win.local, win.band) == (True, "likely") and (lose.local, lose.band, lose.possibly_local) == (False, "unlikely", False)
    assert lose.own_p < 0.02 and win.confidence == lose.confidence == 0.8 and win.confident
    assert [a.game for a in win.alternatives] == ["C @ D"]


def test_unsure_games_are_possible(spark, answers):
    """Three games that nobody knows: each has a third, the first by name leads."""
    df = coverage.resolve_schedule(
        spark.createDataFrame([("o",)], "market string"),
        spark.createDataFrame([(1, "Y", g) for g in ("A @ B", "C @ D", "E @ F")], "week int, slot string, game string"),
        spark.createDataFrame([], "week int, slot string, market string, game string"),
        spark.createDataFrame([], "market string, team string, rate double"),
        K,
        "market",
    )
    got = {r.game: r for r in df.collect()}
    assert {g: (r.local, r.band, r.possibly_local) for g, r in got.items()} == {"A @ B": (True, "possibly", False), "C @ D": (False, "possibly", True), "E @ F": (False, "possibly", True)}
    assert got["C @ D"].own_p == pytest.approx(1 / 3) and not got["C @ D"].confident


def test_known_games(answers):
    seen, other = answers["o", "X", "C @ D"], answers["o", "X", "A @ B"]
    assert (seen.source, seen.local, seen.band, seen.confidence) == ("actual", True, "certain", 1.0)
    assert (other.local, other.band, other.own_p, other.alternatives) == (False, "unlikely", None, [])
    unsure = answers["o", "Y", "E @ F"]
    assert (unsure.band, unsure.confidence, unsure.confident) == ("maybe", 0.55, False)
    assert answers["m", "Z", "C @ D"].source == "certain" and answers["m", "Z", "C @ D"].band == "certain"


def test_games_in_no_slot(answers):
    for market in ("m", "o"):
        got = answers[market, None, "G @ H"]
        assert (got.source, got.local, got.band, got.own_p) == ("national", True, "certain", 1.0)
        assert (market, None, "I @ J") not in answers


def test_blocks_of_markets(spark):
    markets = spark.range(2500).select(F.col("id").cast("string").alias("market"))
    games = spark.createDataFrame([("X", ["a", "b"]), ("Y", ["c"])], "slot string, games array<string>")
    got = resolution.score_market_games(markets, games, "market", block=100)
    assert got.count() == 5000 and got.select("slot", "market").distinct().count() == 5000
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert resolution.score_market_games(markets.limit(0), games, "market").count() == 0
