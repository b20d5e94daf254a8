"""Win rates, folds, calibration, resolution and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs import coverage, prediction
from ..operators import basic, resolution, win_model
from ..operators.cuts import written
from .registry import query
from .voting import CELLS, assignments

M = ["season", "week", "slot"]
RATES = f"""{CELLS}, src AS (SELECT * FROM flagged WHERE game IS NOT NULL),
team_map AS (SELECT season, week, slot, trim(unnest(string_split(game, ' @ '))) AS team, game FROM (SELECT DISTINCT season, week, slot, game FROM src)),
team_n AS (SELECT season, week, slot, team, count(*) AS games FROM team_map GROUP BY ALL),
avail AS (SELECT season, market, team, sum(games)::BIGINT AS avail_n FROM src JOIN team_n USING (season, week, slot) GROUP BY ALL),
shown AS (SELECT season, market, team, count(*) AS shown_n FROM (SELECT season, market, trim(unnest(string_split(game, ' @ '))) AS team FROM src) GROUP BY ALL),
counts AS (SELECT season, market, team, avail_n, coalesce(shown_n, 0) AS shown_n FROM avail LEFT JOIN shown USING (season, market, team)),
seasons AS (SELECT DISTINCT season FROM src),
folds AS (SELECT a.season AS fold, b.season, pow(2, dense_rank() OVER (PARTITION BY a.season ORDER BY b.season) - 1) AS weight FROM seasons a JOIN seasons b ON b.season < a.season),
rates AS (SELECT fold, market, team, sum(shown_n * weight) AS shown, sum(avail_n * weight) AS avail, (sum(shown_n * weight) + 1.25) / (sum(avail_n * weight) + 5) AS rate FROM counts JOIN folds USING (season) GROUP BY fold, market, team)"""


def _src(spark, sf_dir):
    return basic.resolved_only(assignments(spark, sf_dir))


def _counts(spark, sf_dir):
    return win_model.season_counts(_src(spark, sf_dir), M, "market")


@query(f"WITH {RATES} SELECT * FROM counts")
def a3_team_win_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"WITH {RATES} SELECT season, market, team, round((shown_n + 1.25) / (avail_n + 5), 6) AS rate FROM counts")
def a4_win_rate(spark, sf_dir):
    from ..functions.numeric import win_rate

    return _counts(spark, sf_dir).select("season", "market", "team", F.round(win_rate(F.col("shown_n"), F.col("avail_n")), 6).alias("rate"))


@query(f"WITH {RATES} SELECT fold, season, weight FROM folds")
def w6_w13_folds_weights(spark, sf_dir):
    return win_model.recency_weight(win_model.expanding_folds(_src(spark, sf_dir)))


@query(f"WITH {RATES} SELECT fold, market, team, round(shown, 6) AS shown, round(avail, 6) AS avail, round(rate, 6) AS rate FROM rates")
def c3_train_rates(spark, sf_dir):
    df = prediction.train_rates(_src(spark, sf_dir), M, "market")
    return df.select("fold", "market", "team", *[F.round(c, 6).alias(c) for c in ("shown", "avail", "rate")])


DECIDED = f"""{RATES}, games AS (SELECT season, week, slot, game, count(*) OVER (PARTITION BY season, week, slot) AS n FROM (SELECT DISTINCT season, week, slot, game FROM src)),
asked AS (SELECT s.season, s.week, s.slot, s.market, s.game AS truth, g.game, g.n FROM src s JOIN games g USING (season, week, slot) WHERE n > 1),
team_rate AS (SELECT a.*, coalesce(r.rate, 0.25) AS rate FROM (SELECT *, trim(unnest(string_split(game, ' @ '))) AS team FROM asked) a LEFT JOIN rates r ON r.fold = a.season AND r.market = a.market AND r.team = a.team),
score AS (SELECT season, week, slot, market, truth, game, n, 0.75 * max(rate) + 0.25 * avg(rate) AS s FROM team_rate GROUP BY ALL),
soft AS (SELECT *, exp((s - max(s) OVER w) * 10) / sum(exp((s - ms) * 10)) OVER w AS p FROM (SELECT *, max(s) OVER (PARTITION BY season, week, slot, market, truth) AS ms FROM score) WINDOW w AS (PARTITION BY season, week, slot, market, truth)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY season, week, slot, market, truth ORDER BY round(p, 12) DESC, game) AS r FROM soft),
pred AS (SELECT season, week, slot, market, truth, any_value(n) AS n, max(CASE WHEN r = 1 THEN p END) AS p_top, bool_or(r = 1 AND game = truth) AS hit, bool_or(r <= 2 AND game = truth) AS hit2, max(CASE WHEN game = truth THEN p END) AS p_true FROM ranked GROUP BY season, week, slot, market, truth),
bins AS (SELECT least(floor(p_top * 10), 9)::INT AS band, count(*) AS n, avg(hit::INT) AS rate, (least(floor(p_top * 10), 9) + 0.5) / 10 AS mid FROM pred GROUP BY 1, 4),
cal0 AS (SELECT b.band, (b.band + 1) / 10.0 AS upper, CASE WHEN bins.n >= 100 THEN rate END AS r FROM (SELECT unnest(generate_series(0, 9))::INT AS band) b LEFT JOIN bins ON b.band = bins.band),
cal AS (SELECT band, upper, round(max(coalesce(lr, 0.1)) OVER (ORDER BY band), 4) AS value FROM (SELECT band, upper, last_value(r IGNORE NULLS) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) AS lr FROM cal0))"""


def _decisions(spark, sf_dir):
    return prediction.decisions_of(_src(spark, sf_dir), M, "market")


def _pred(spark, sf_dir):
    return win_model.predictions(_decisions(spark, sf_dir), 10.0)


@query(f"WITH {DECIDED} SELECT season, week, slot, market, truth, n::INT AS n, round(p_top, 6) AS p_top, round(p_true, 6) AS p_true FROM pred")
def w9_softmax_predictions(spark, sf_dir):
    return _pred(spark, sf_dir).select(*M, "market", "truth", "n", F.round("p_top", 6).alias("p_top"), F.round("p_true", 6).alias("p_true"))


@query(f"WITH {DECIDED} SELECT count(*) AS decisions, round(avg(hit::INT), 6) AS top1, round(avg(hit2::INT), 6) AS top2, round(avg(-ln(greatest(p_true, 1e-9))), 6) AS log_loss FROM pred")
def a5_evaluate(spark, sf_dir):
    e = win_model.evaluate(_pred(spark, sf_dir))
    return e.select("decisions", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "log_loss")])


@query(f"WITH {DECIDED} SELECT n::INT AS n, count(*) AS decisions, round(avg(hit::INT), 6) AS accuracy FROM pred GROUP BY n")
def a6_accuracy_by(spark, sf_dir):
    return win_model.accuracy_by(_pred(spark, sf_dir)).select("n", "decisions", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {DECIDED} SELECT band, n, round(rate, 6) AS rate, round(mid, 2) AS mid FROM bins")
def a7_calibration_bins(spark, sf_dir):
    return win_model.calibration_bins(_pred(spark, sf_dir)).select("band", "n", F.round("rate", 6).alias("rate"), F.round("mid", 2).alias("mid"))


@query(f"WITH {DECIDED} SELECT season, week, slot, market, game, r::INT AS rank, round(p, 6) AS p FROM ranked")
def w7_rank_games(spark, sf_dir):
    """Every option of every decision with its rank."""
    ranked = _pred(spark, sf_dir).select(*M, "market", F.posexplode("ranked").alias("rank", "g"))
    return ranked.select(*M, "market", "g.game", (F.col("rank") + 1).alias("rank"), F.round("g.p", 6).alias("p"))


# bands 0 and 4 move out of the ten, so that two gaps are to be filled; no row is left out
_BINS = "bins AS (SELECT CASE b WHEN 0 THEN 10 WHEN 4 THEN 14 ELSE b END AS band, count(*) AS n, avg(CASE WHEN l_discount > 0.04 THEN 1.0 ELSE 0.0 END) AS rate, (b + 0.5) / 10 AS mid FROM (SELECT *, CAST(l_quantity AS INT) % 10 AS b FROM lineitem) GROUP BY 1, 4)"


def _bins(spark, sf_dir):
    from .registry import table

    b = F.col("l_quantity").cast("int") % 10
    df = table(spark, sf_dir, "lineitem").select("l_discount", b.alias("b"), F.when(b.isin(0, 4), b + 10).otherwise(b).alias("band"))
    return df.groupBy("band", "b").agg(F.count("*").alias("n"), F.avg((F.col("l_discount") > 0.04).cast("double")).alias("rate")).select("band", "n", "rate", ((F.col("b") + 0.5) / 10).alias("mid"))


@query(
    f"""WITH {_BINS}, cal0 AS (SELECT b.band, (b.band + 1) / 10.0 AS upper, CASE WHEN bins.n >= 100 THEN rate END AS r FROM (SELECT unnest(generate_series(0, 9))::INT AS band) b LEFT JOIN bins ON b.band = bins.band)
    SELECT band, upper, round(max(coalesce(lr, 0.1)) OVER (ORDER BY band), 4) AS value FROM (SELECT band, upper, last_value(r IGNORE NULLS) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) AS lr FROM cal0)"""
)
def w5_monotone_calibration(spark, sf_dir):
    return win_model.monotone_calibration(_bins(spark, sf_dir))


@query(f"WITH {_BINS} SELECT round(avg(abs(mid - rate)), 6) AS error, avg(abs(mid - rate)) > 0.10 AS too_far FROM bins WHERE n >= 50")
def a8_mean_calibration_error(spark, sf_dir):
    return win_model.calibration_error(_bins(spark, sf_dir)).withColumn("error", F.round("error", 6))


GRID_SQL = "(VALUES (2.0), (4.0), (6.0), (8.0), (10.0), (12.0), (15.0), (20.0), (25.0), (30.0), (40.0)) g(t)"


@query(
    f"""WITH {DECIDED}, tried AS (SELECT t, season, week, slot, market, truth, game, exp((s - max(s) OVER w) * t) AS e FROM score CROSS JOIN {GRID_SQL} WINDOW w AS (PARTITION BY t, season, week, slot, market, truth)),
    ps AS (SELECT t, truth, game, e / sum(e) OVER (PARTITION BY t, season, week, slot, market, truth) AS p FROM tried)
    SELECT CAST(t AS DOUBLE) AS temperature, round(avg(-ln(greatest(p, 1e-9))), 6) AS log_loss FROM ps WHERE game = truth GROUP BY t"""
)
def a9_fit_temperature(spark, sf_dir):
    return win_model.fit_temperature(_decisions(spark, sf_dir)).select("temperature", F.round("log_loss", 6).alias("log_loss"))


GRIDDED = f"""{RATES}, sched AS (SELECT DISTINCT season, week, slot, game FROM src), markets AS (SELECT DISTINCT market FROM src),
actual AS (SELECT season, week, slot, market, game AS seen FROM src WHERE NOT review),
sg AS (SELECT season, week, slot, market, game, 0.75 * max(rate) + 0.25 * avg(rate) AS s FROM (
  SELECT x.season, x.week, x.slot, x.market, x.game, coalesce(r.rate, 0.25) AS rate FROM (SELECT season, week, slot, market, game, trim(unnest(string_split(game, ' @ '))) AS team FROM sched CROSS JOIN markets) x
  LEFT JOIN rates r ON r.fold = x.season AND r.market = x.market AND r.team = x.team) GROUP BY ALL),
pp AS (SELECT season, week, slot, market, game, round(exp((s - ms) * 12) / sum(exp((s - ms) * 12)) OVER (PARTITION BY season, week, slot, market), 12) AS p FROM (SELECT *, max(s) OVER (PARTITION BY season, week, slot, market) AS ms FROM sg)),
rk AS (SELECT *, row_number() OVER (PARTITION BY season, week, slot, market ORDER BY p DESC, game) AS r FROM pp),
q AS (SELECT pp.* EXCLUDE (p), CASE WHEN seen IS NULL THEN p WHEN seen = pp.game THEN 1.0 ELSE 0.0 END AS p, seen IS NOT NULL AS known FROM pp LEFT JOIN actual USING (season, week, slot, market)),
qr AS (SELECT *, row_number() OVER (PARTITION BY season, week, slot, market ORDER BY p DESC, game) AS r FROM q)"""


def _grid(spark, sf_dir):
    """Rows, schedule, each season's rates from the seasons before it, and what is known of the markets."""
    src = written(_src(spark, sf_dir))
    rates = prediction.train_rates(src, M, "market").withColumnRenamed("fold", "season")
    return src, src.select(*M, "game").distinct(), rates, src.filter("not review").select(*M, "market", "game")


def _scored(spark, sf_dir):
    src, sched, rates, actual = _grid(spark, sf_dir)
    games = resolution.competing_games(sched, M)
    scored = resolution.scored_games(resolution.score_market_games(src, games, "market"), rates, M, "market")
    known = actual.select(*M, "market", F.lit(True).alias("confirmed"))
    return src, games, written(scored.join(known, [*M, "market"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False))))


@query(f"WITH {GRIDDED} SELECT season, week, slot, string_agg(game, '|' ORDER BY game) AS games FROM sched GROUP BY season, week, slot")
def j6_competing_games(spark, sf_dir):
    sched = _src(spark, sf_dir).select(*M, "game")
    return resolution.competing_games(sched, M).withColumn("games", F.array_join("games", "|"))


@query(f"WITH {GRIDDED} SELECT season, week, slot, market, game, round(p, 6) AS p, known AS confirmed FROM q")
def c5_j7_j8_game_probabilities(spark, sf_dir):
    src, sched, rates, actual = _grid(spark, sf_dir)
    df = coverage.game_probabilities(src, sched, rates, M, "market", actual)
    return df.select(*M, "market", "game", F.round("p", 6).alias("p"), "confirmed")


CAL = [((i + 1) / 10, round(0.05 + 0.1 * i, 2)) for i in range(10)]
_CONFIDENCE = "CASE " + " ".join(f"WHEN p <= {u} THEN {v}" for u, v in CAL[:-1]) + f" ELSE {CAL[-1][1]} END"
_BAND = "CASE WHEN p >= 0.6 THEN 'likely' WHEN p >= 0.35 THEN 'maybe' WHEN p >= 0.15 THEN 'possibly' ELSE 'unlikely' END"


_CELL = "season, week, slot, market"
_LEAD = f"lead AS (SELECT {_CELL}, max(CASE WHEN r = 1 THEN game END) AS leader, max(CASE WHEN r = 1 THEN p END) AS best, coalesce(string_agg(game, '|' ORDER BY r) FILTER (WHERE r IN (2, 3)), '') AS alternatives, max(CASE WHEN r = 2 THEN p END) AS next_p, count(*) AS n FROM rk GROUP BY {_CELL})"


@query(
    f"""WITH {GRIDDED}, {_LEAD}
    SELECT {_CELL}, game, leader, {_CONFIDENCE.replace("p <=", "best <=")} AS confidence, round(p, 6) AS own_p, {_BAND} AS band, alternatives, round(next_p, 6) AS next_p
    FROM rk JOIN lead USING ({_CELL})"""
)
def a25_leader(spark, sf_dir):
    """For every game of every market and slot: the leader, and the game's own probability."""
    _, _, scored = _scored(spark, sf_dir)
    df = resolution.leader_and_alternatives(scored, CAL)
    names = F.array_join(F.transform("alternatives", lambda x: x["game"]), "|")
    return df.select(*M, "market", "game", "leader", "confidence", F.round("own_p", 6).alias("own_p"), "band", names.alias("alternatives"), F.round(F.get("alternatives", 0)["p"], 6).alias("next_p"))


@query(f"WITH {GRIDDED} SELECT season, week, slot, market, round(max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0), 6) AS margin FROM rk GROUP BY season, week, slot, market")
def w8_lead_margin(spark, sf_dir):
    _, _, scored = _scored(spark, sf_dir)
    return resolution.lead_margin(scored).select(*M, "market", F.round("margin", 6).alias("margin"))


@query(f"WITH {GRIDDED} SELECT season, week, slot, pp.game, count(*) AS markets, count(*) FILTER (WHERE p >= 0.5) AS likely, bool_or(seen IS NOT NULL) AS any_confirmed FROM pp LEFT JOIN actual USING (season, week, slot, market) GROUP BY season, week, slot, pp.game")
def a18_market_rollup(spark, sf_dir):
    _, _, scored = _scored(spark, sf_dir)
    return resolution.market_rollup(scored, M)


@query(f"WITH {GRIDDED} SELECT season, week, slot, game, coalesce(led, 0) AS led FROM sched LEFT JOIN (SELECT season, week, slot, game, count(*) AS led FROM rk WHERE r = 1 GROUP BY ALL) USING (season, week, slot, game)")
def a19_leader_footprint(spark, sf_dir):
    _, games, scored = _scored(spark, sf_dir)
    return resolution.leader_footprint(scored, games, M)


_TOSSUPS = "SELECT count(*) FILTER (WHERE NOT known AND n > 1 AND m < 0.12) AS tossups, count(*) AS cells FROM (SELECT max(CASE WHEN r = 1 THEN p END) - coalesce(max(CASE WHEN r = 2 THEN p END), 0) AS m, count(*) AS n, bool_or(known) AS known FROM {} GROUP BY season, week, slot, market)"


@query(f"WITH {GRIDDED}, mark AS (SELECT rk.*, seen IS NOT NULL AS known FROM rk LEFT JOIN actual USING (season, week, slot, market)) {_TOSSUPS.format('mark')}")
def a20_tossup_count(spark, sf_dir):
    _, _, scored = _scored(spark, sf_dir)
    return resolution.tossup_count(scored)


@query(
    f"""WITH {GRIDDED}, {_LEAD}, national AS (SELECT season, week, slot, min(game) AS game FROM sched WHERE week = 1 GROUP BY ALL),
    known AS (SELECT {_CELL}, game || CASE WHEN market % 2 = 0 THEN ' (LATE)' ELSE '' END AS seen, CASE WHEN review THEN confidence END AS sure FROM src WHERE NOT review OR market % 3 = 0),
    told AS (SELECT {_CELL}, rk.game, p, leader, best, alternatives, n.game IS NOT NULL AS is_national, k.seen, k.sure,
      CASE WHEN n.game IS NOT NULL THEN 'national' WHEN k.seen IS NOT NULL THEN 'actual' WHEN lead.n = 1 THEN 'certain' ELSE 'predicted' END AS source
      FROM rk JOIN lead USING ({_CELL}) LEFT JOIN known k USING ({_CELL}) LEFT JOIN national n ON n.season = rk.season AND n.week = rk.week AND n.slot = rk.slot AND n.game = rk.game),
    local AS (SELECT * EXCLUDE (seen), CASE source WHEN 'national' THEN game WHEN 'actual' THEN seen ELSE leader END AS seen FROM told),
    banded AS (SELECT *, regexp_replace(seen, '[ ]*[(](LATE|EARLY)[)][ ]*$', '') = game AS local, CASE source WHEN 'actual' THEN sure IS NULL WHEN 'predicted' THEN best >= 0.6 ELSE true END AS confident FROM local),
    final AS (SELECT *, CASE WHEN source = 'predicted' THEN {_BAND} WHEN NOT local THEN 'unlikely' WHEN confident THEN 'certain' ELSE 'maybe' END AS band FROM banded)
    SELECT {_CELL}, game, source, seen, local, band, NOT local AND band IN ('maybe', 'possibly') AS possibly_local, confident,
      round(CASE source WHEN 'actual' THEN coalesce(sure, 1.0) WHEN 'predicted' THEN {_CONFIDENCE.replace("p <=", "best <=")} ELSE 1.0 END, 6) AS confidence,
      round(CASE source WHEN 'predicted' THEN p WHEN 'national' THEN 1.0 END, 6) AS own_p, CASE WHEN source = 'predicted' THEN alternatives ELSE '' END AS alternatives FROM final"""
)
def j9_c4_resolve_schedule(spark, sf_dir):
    """The first game of the first week's slots is shown nationally; elsewhere what is known
    (with a marker in every second market, uncertain where it is under review), certain or
    predicted."""
    src, sched, rates, _ = _grid(spark, sf_dir)
    national = sched.filter("week = 1").groupBy(*M).agg(F.min("game").alias("game"))
    known = src.filter(~F.col("review") | (F.col("market") % 3 == 0))
    marked = F.concat("game", F.when(F.col("market") % 2 == 0, " (LATE)").otherwise(""))
    known = known.select(*M, "market", marked.alias("game"), F.when(F.col("review"), F.col("confidence")).alias("confidence"))
    df = coverage.resolve_schedule(src, sched, known, rates, M, "market", national, CAL)
    names = F.array_join(F.transform("alternatives", lambda x: x["game"]), "|")
    return df.withColumns({"confidence": F.round("confidence", 6), "own_p": F.round("own_p", 6), "alternatives": names})


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'NBC' ELSE 'CBS' END AS broadcast, CAST(o_orderdate AS DATE) AS date, 'T' || (o_orderkey % 9) AS time, CASE WHEN o_orderkey % 4 = 0 THEN 'CBS_EARLY' END AS slot FROM orders)
    SELECT o_orderkey, slot IS NULL AND count(*) OVER (PARTITION BY broadcast, date, time) <= 1 AS national FROM s"""
)
def p14_national_broadcast(spark, sf_dir):
    from .registry import table

    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c % 3 == 0, "NBC").otherwise("CBS").alias("broadcast"), F.to_date("o_orderdate").alias("date"), F.concat(F.lit("T"), (o % 9).cast("string")).alias("time"), F.when(o % 4 == 0, "CBS_EARLY").alias("slot"))
    return resolution.national_broadcast(s).select("o_orderkey", "national")


def _rollups(spark, sf_dir):
    src, sched, rates, actual = _grid(spark, sf_dir)
    return coverage.coverage_rollup(src, sched, rates, M, "market", actual)


@query(f"WITH {GRIDDED} SELECT season, week, slot, game, count(*) AS markets, count(*) FILTER (WHERE p >= 0.5) AS likely, bool_or(known) AS any_confirmed FROM q GROUP BY season, week, slot, game")
def c14_coverage_rollup(spark, sf_dir):
    return _rollups(spark, sf_dir)[0]


@query(f"WITH {GRIDDED} SELECT season, week, slot, game, coalesce(led, 0) AS led FROM sched LEFT JOIN (SELECT season, week, slot, game, count(*) AS led FROM qr WHERE r = 1 GROUP BY ALL) USING (season, week, slot, game)")
def c14_leader_footprint(spark, sf_dir):
    return _rollups(spark, sf_dir)[1]


@query(f"WITH {GRIDDED} {_TOSSUPS.format('qr')}")
def c14_tossups(spark, sf_dir):
    return _rollups(spark, sf_dir)[2]


FITTED = f"""{DECIDED}, tried AS (SELECT t, season, week, slot, market, truth, game, exp((s - max(s) OVER w) * t) AS e FROM score CROSS JOIN {GRID_SQL} WINDOW w AS (PARTITION BY t, season, week, slot, market, truth)),
tp AS (SELECT t, season, week, slot, market, truth, game, round(e / sum(e) OVER (PARTITION BY t, season, week, slot, market, truth), 12) AS p FROM tried),
held AS (SELECT max(season) AS season FROM score), trained AS (SELECT max(season) AS season FROM score WHERE season < (SELECT season FROM held)),
best AS (SELECT t FROM (SELECT t, round(avg(-ln(greatest(p, 1e-9))), 9) AS loss FROM tp WHERE game = truth AND season = (SELECT season FROM trained) GROUP BY t) ORDER BY loss, t LIMIT 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY season, week, slot, market, truth ORDER BY p DESC, game) AS r FROM tp WHERE t = (SELECT t FROM best)),
fp AS (SELECT season, market, count(*) AS n, max(CASE WHEN r = 1 THEN p END) AS p_top, bool_or(r = 1 AND game = truth) AS hit, bool_or(r <= 2 AND game = truth) AS hit2, max(CASE WHEN game = truth THEN p END) AS p_true FROM fr GROUP BY season, week, slot, market, truth),
fb AS (SELECT least(floor(p_top * 10), 9)::INT AS band, count(*) AS n, avg(hit::INT) AS rate FROM fp WHERE season < (SELECT season FROM held) GROUP BY 1)"""


def _fit(spark, sf_dir):
    src = written(_src(spark, sf_dir))
    return prediction.fit(src, M, "market", src.agg(F.max("season")).first()[0])


@query(f"WITH {FITTED} SELECT (SELECT CAST(t AS DOUBLE) FROM best) AS temperature, count(*) AS decisions, round(avg(hit::INT), 6) AS top1, round(avg(hit2::INT), 6) AS top2, round(avg(-ln(greatest(p_true, 1e-9))), 6) AS log_loss FROM fp WHERE season = (SELECT season FROM held)")
def c3_fit_holdout(spark, sf_dir):
    """The last season is held out: the others' temperature, and the metrics on it."""
    got = _fit(spark, sf_dir)
    return got["metrics"].select(F.lit(got["temperature"]).alias("temperature"), "decisions", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "log_loss")])


@query(
    f"""WITH {FITTED}, c0 AS (SELECT b.band, (b.band + 1) / 10.0 AS upper, CASE WHEN fb.n >= 100 THEN rate END AS r FROM (SELECT unnest(generate_series(0, 9))::INT AS band) b LEFT JOIN fb ON b.band = fb.band)
    SELECT band, upper, round(max(coalesce(lr, 0.1)) OVER (ORDER BY band), 4) AS value FROM (SELECT band, upper, last_value(r IGNORE NULLS) OVER (ORDER BY band ROWS UNBOUNDED PRECEDING) AS lr FROM c0)"""
)
def c3_fit_calibration(spark, sf_dir):
    return _fit(spark, sf_dir)["calibration"]


@query(f"WITH {FITTED} SELECT n::INT AS n, count(*) AS decisions, round(avg(hit::INT), 6) AS accuracy FROM fp WHERE season = (SELECT season FROM held) GROUP BY n")
def c3_fit_by_games(spark, sf_dir):
    return _fit(spark, sf_dir)["by_games"].select("n", "decisions", F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {RATES}, w AS (SELECT season, pow(2, dense_rank() OVER (ORDER BY season) - 1) AS weight FROM seasons) SELECT market, team, round((sum(shown_n * weight) + 1.25) / (sum(avail_n * weight) + 5), 3) AS rate FROM counts JOIN w USING (season) GROUP BY market, team")
def c3_export_model(spark, sf_dir):
    return prediction.export_model(_src(spark, sf_dir), M, "market")
