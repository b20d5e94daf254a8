"""Filters, lookups, unions, top-k: small operators that the jobs share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import to_number
from .cuts import written
from .ordering import number_rows

#: A lookup table is broadcast only up to so many rows; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keep_status(df: DataFrame, column: str, allowed: tuple[str, ...] = ("downloaded", "exists")) -> DataFrame:
    return df.filter(F.col(column).isin(*allowed))


def resolved_only(df: DataFrame, column: str = "game") -> DataFrame:
    """Rows whose game is neither null nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def skipped_count(df: DataFrame, column: str = "game") -> DataFrame:
    """One row: ``skipped`` rows without a game, of ``total``."""
    return df.agg(F.count_if(F.col(column).isNull() | (F.col(column) == "")).alias("skipped"), F.count("*").alias("total"))


def map_codes(df: DataFrame, column: str, dim: DataFrame, key: str, code: str, drop_unmapped: bool = True) -> DataFrame:
    """Replace ``column`` by its code; unmapped rows go, or keep their value."""
    d = small(dim.select(F.col(key).alias("_key"), F.col(code).alias("_code")))
    out = df.join(d, F.col(column) == F.col("_key"), "inner" if drop_unmapped else "left")
    return out.withColumn(column, F.coalesce(F.col("_code").cast("string"), F.col(column).cast("string"))).drop("_key", "_code")


def season_week_filter(df: DataFrame, season: int | None = None, week: int | None = None) -> DataFrame:
    for name, value in (("season", season), ("week", week)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def finite_coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows whose coordinates are finite numbers, as doubles."""
    return df.withColumn(lat, to_number(F.col(lat))).withColumn(lon, to_number(F.col(lon))).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())


def exclude_markets(df: DataFrame, column: str, codes: list) -> DataFrame:
    return df.filter(~F.col(column).isin(*codes))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value, most common first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def distinct_sets(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values of each key."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def final_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def final_places(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """Add each row's place in the final order, from 1; equal keys in the order of the input."""
    return number_rows(df, [], [F.asc(k) for k in keys], name=name)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; ``order`` should end in a unique column."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def intern_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of both tables, sorted and numbered from 0, over any number of tasks."""
    values = a.select(column).unionByName(b.select(column)).filter(F.col(column).isNotNull()).distinct()
    return number_rows(values, [], [F.asc(column)], name="idx", first=0)


def overlay(defaults: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """Live values replace defaults; ``differs`` where both exist and disagree."""
    d, v = defaults.select(key, F.col(value).alias("_d")), live.select(key, F.col(value).alias("_v"))
    return d.join(v, key, "full").select(key, F.coalesce("_v", "_d").alias(value), F.coalesce(F.col("_d") != F.col("_v"), F.lit(False)).alias("differs"))


def append_batches(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered_concat_except(first: Column, rest: Column) -> Column:
    """The first array's elements, then those of the second that are not among them, each once."""
    return F.array_distinct(F.concat(first, F.array_except(rest, first)))


def table_digest(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per key ``by``, or of the whole table: number of rows ``n`` and ``digest``, a sum over
    their hashes that does not depend on their order; summed up before anything is shuffled."""
    columns = sorted(df.columns)
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    h = F.xxhash64(nulls, *columns)
    made = [F.count("*").alias("n"), F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.sum(F.xxhash64(h).cast("decimal(38,0)")).cast("string")).alias("digest")]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def differing_keys(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Keys whose rows differ between two tables, as multisets: one aggregate of each is joined,
    whatever the number of rows of a key."""
    left, right = (table_digest(t, by).select(F.struct(*by).alias(f"_k{i}"), F.struct("n", "digest").alias(f"_d{i}")) for i, t in enumerate((a, b.select(a.columns))))
    both = left.join(right, F.col("_k0").eqNullSafe(F.col("_k1")), "full").filter(~F.col("_d0").eqNullSafe(F.col("_d1")))
    return both.select(F.coalesce("_k0", "_k1").alias("_k")).select("_k.*")


def mismatches(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows of ``a`` that ``b`` does not have, as often as they are missing.

    With ``by`` only the rows of keys that differ at all are compared.
    """
    b = b.select(a.columns)
    if by:
        keys = written(differing_keys(a, b, by)).select(F.struct(*by).alias("_k"))
        a, b = (t.join(keys, F.struct(*by).eqNullSafe(F.col("_k")), "left_semi") for t in (a, b))
    return a.exceptAll(b)


def payload_counts(df: DataFrame, week: str = "week") -> DataFrame:
    """Row count and sorted distinct weeks of a feed."""
    return df.agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_set(week)).alias("weeks"))


def missing_batches(expected: DataFrame, got: DataFrame, key: str = "week") -> DataFrame:
    return expected.select(key).distinct().join(got.select(key).distinct(), key, "left_anti")
