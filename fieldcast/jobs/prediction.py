"""History to model: rates, temperature, calibration and holdout metrics (C3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import win_model
from ..operators.cuts import written


def train_rates(rows: DataFrame, map_keys: list[str], market: str, final: bool = False) -> DataFrame:
    """Rates of every fold (trained on all earlier seasons); with ``final``, also of the fold
    after the last season. Season counts are made once and reweighted for each fold; the rows
    are written once, since counts and seasons read them."""
    rows = written(rows)
    counts = written(win_model.season_counts(rows, map_keys, market))
    seasons = counts.select("season").distinct()
    if final:
        seasons = seasons.unionByName(counts.agg((F.max("season") + 1).cast(counts.schema["season"].dataType).alias("season")))
    weights = win_model.recency_weight(win_model.expanding_folds(seasons))
    return win_model.fold_rates(counts, weights, market)


def decisions_of(rows: DataFrame, map_keys: list[str], market: str) -> DataFrame:
    """Every decision of every season with the rates of its own fold."""
    rows = written(rows)
    return win_model.decisions(rows, train_rates(rows, map_keys, market), map_keys, market)


def fit(rows: DataFrame, map_keys: list[str], market: str, holdout: int) -> dict[str, DataFrame | float]:
    """Temperature and calibration from the seasons before ``holdout``, metrics on it."""
    dec = written(decisions_of(rows, map_keys, market))
    before, test = dec.filter(F.col("season") < holdout), dec.filter(F.col("season") == holdout)
    last = before.agg(F.max("season")).first()[0]
    best = win_model.fit_temperature(before.filter(F.col("season") == last)).first()
    temperature = float(best["temperature"])
    bins = win_model.calibration_bins(win_model.predictions(before, temperature))
    pred = win_model.predictions(test, temperature)
    return {
        "temperature": temperature,
        "calibration": win_model.monotone_calibration(bins),
        "metrics": win_model.evaluate(pred),
        "by_games": win_model.accuracy_by(pred),
        "bins": win_model.calibration_bins(pred),
    }


def export_model(rows: DataFrame, map_keys: list[str], market: str) -> DataFrame:
    """Rates for the season to come, three digits."""
    rates = train_rates(rows, map_keys, market, final=True)
    last = rates.agg(F.max("fold").alias("fold"))
    return rates.join(F.broadcast(last), "fold").select(market, "team", F.round("rate", 3).alias("rate"))
