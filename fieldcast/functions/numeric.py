"""Scores, bands, calibration and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .collections import let

#: Cuts of the named bands, of the intensity classes, and the model's constants.
BANDS = [(0.60, "likely"), (0.35, "maybe"), (0.15, "possibly")]
INTENSITIES = [(0.85, "highest"), (0.60, "high"), (0.35, "medium"), (0.15, "low"), (0.05, "trace")]
PRIOR, PRIOR_WEIGHT, MAX_WEIGHT = 0.25, 5.0, 0.75


def band(p: Column) -> Column:
    c = F.lit("unlikely")
    for cut, name in reversed(BANDS):
        c = F.when(p >= cut, name).otherwise(c)
    return c


def intensity_class(p: Column, confirmed: Column) -> Column:
    """no_data for null; in or out where confirmed; else by cuts."""
    c = F.lit("none")
    for cut, name in reversed(INTENSITIES):
        c = F.when(p >= cut, name).otherwise(c)
    return F.when(p.isNull(), "no_data").when(confirmed, F.when(p > 0, "in").otherwise("out")).otherwise(c)


def win_rate(shown: Column, avail: Column, k: float = PRIOR_WEIGHT, prior: float = PRIOR) -> Column:
    """Share of showings, drawn towards ``prior`` by ``k`` pseudo-showings."""
    return (shown + k * prior) / (avail + k)


def game_score(rates: Column, max_weight: float = MAX_WEIGHT) -> Column:
    """Weighted best and mean rate of a game's teams; null for no team."""
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return let(rates, lambda r: max_weight * F.array_max(r) + (1 - max_weight) * total(r) / F.nullif(F.size(r), F.lit(0)))


def softmax(scores: Column, temperature: Column | float) -> Column:
    """Array of exp(t * (s - max)) over their sum."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    weights = lambda s: let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp((x - top) * t)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return let(let(scores, weights), lambda e: let(total(e), lambda n: F.transform(e, lambda x: x / n)))


def apply_calibration(p: Column, table: list[tuple[float, float]]) -> Column:
    """Value of the first band whose upper end is ``p`` or more, else of the last band."""
    bands = F.array(*[F.struct(F.lit(float(u)).alias("upper"), F.lit(float(v)).alias("value")) for u, v in table])
    return F.when(p.isNotNull(), F.coalesce(F.try_element_at(F.filter(bands, lambda b: b["upper"] >= p), F.lit(1))["value"], F.lit(float(table[-1][1]))))


def round_to(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def to_number(raw: Column) -> Column:
    """Finite double or null."""
    d = raw.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")), d)
