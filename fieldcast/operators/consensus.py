"""Median consensus over nested quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals


def outcome_named(outcomes: Column, name: Column | str) -> Column:
    """The first outcome of that name in an array; null if there is none."""
    n = F.lit(name) if isinstance(name, str) else name
    return F.try_element_at(F.filter(outcomes, lambda o: o["name"] == n), F.lit(1))


def consensus_median(value: Column) -> Column:
    """Exact median without nulls, two digits; null of nothing."""
    return F.round(F.median(value), 2)


def pooled_total(quotes: DataFrame, keys: list[str], over: Column, under: Column) -> DataFrame:
    """Median of both sides' points in one pool."""
    pool = quotes.select(*keys, F.explode(F.array(over, under)).alias("point"))
    return pool.groupBy(*keys).agg(consensus_median(F.col("point")).alias("point"))


def books_count(books: Column) -> Column:
    return F.coalesce(F.nullif(F.size(books), F.lit(-1)), F.lit(0))


def last_update(book: Column, market: Column) -> Column:
    """Latest of both columns over a group (aggregate)."""
    return F.greatest(F.max(book), F.max(market))


def consensus_medians(quotes: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key the median of its values, two digits, null if it has none: for keys of any size.

    Equal values are counted where they lie; the counts are summed up in order over ranges, so
    that the middle of a key with a third of all quotes is found without gathering its values.
    """
    counts = quotes.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    t = running_totals(counts, keys, [F.asc(value)], "_n", "_upto", "_total")
    least = lambda k: F.min(F.when(F.col("_upto") >= k, F.col(value)))
    found = t.groupBy(*keys).agg(least(F.floor((F.col("_total") + 1) / 2)).alias("_lo"), least(F.floor(F.col("_total") / 2) + 1).alias("_hi"))
    middle = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.round((F.col("_lo") + F.col("_hi")) / 2, 2).alias(name))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return quotes.select(*keys).distinct().join(middle, on, "left").select(*keys, name)
