"""Default-plus-exceptions tables and the proof that they lose nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .voting import FLOOR


def frequency_index(rows: DataFrame, keys: list[str], value: str, ord_col: str) -> DataFrame:
    """``keys``, ``value``, ``n`` and ``idx``: 0 for the most frequent, ties by first seen."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ord_col).alias("_first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first", value)
    return n.withColumn("idx", F.row_number().over(order) - 1).drop("_first")


def compact_map(rows: DataFrame, keys: list[str], market: str, value: str, ord_col: str, confidence: str, review: str | None = None, floor: float = FLOOR) -> DataFrame:
    """Per map: games by frequency ``g``, default index ``d``, exceptions ``e`` (market ->
    index) and uncertain markets ``u`` (market -> confidence, two digits).

    Uncertain are markets below ``floor`` or in review; an unreadable confidence is 0. A
    map's rows are one per market, so its arrays are bounded by the number of markets.
    """
    idx = frequency_index(rows, keys, value, ord_col).drop("n")
    conf = F.coalesce(F.col(confidence).try_cast("double") if rows.schema[confidence].dataType.simpleString() == "string" else F.col(confidence), F.lit(0.0))
    odd = (conf < floor) | (F.col(review) if review else F.lit(False))
    df = rows.join(idx, [*keys, value]).withColumn("_conf", conf).withColumn("_odd", odd)
    code = F.col(market).cast("string")
    entry = lambda test, v: F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.when(test, F.struct(code.alias("k"), v.alias("v")))))))
    out = df.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct("idx", F.col(value).alias("v")))).alias("_g"),
        entry(F.col("idx") > 0, F.col("idx")).alias("e"),
        entry(F.col("_odd"), F.round("_conf", 2)).alias("u"),
    )
    return out.select(*keys, F.transform("_g", lambda x: x["v"]).alias("g"), F.lit(0).alias("d"), "e", "u")


def lookup_with_default(markets: DataFrame, compact: DataFrame, keys: list[str], market: str) -> DataFrame:
    """The answer for each market: its exception, else the map's default; with the
    uncertain confidence where there is one."""
    code = F.col(market).cast("string")
    df = markets.join(compact, keys, "left")
    idx = F.coalesce(F.try_element_at("e", code), F.col("d"))
    return df.withColumn("answer", F.get("g", idx)).withColumn("uncertain", F.try_element_at("u", code)).drop("g", "d", "e", "u")


def verify_roundtrip(compact: DataFrame, source: DataFrame, keys: list[str], market: str, value: str) -> DataFrame:
    """One row: ``n_rows`` of the source and ``n_mismatch`` that the compact form gets wrong
    (a missing map is wrong)."""
    got = lookup_with_default(source, compact, keys, market)
    return got.agg(F.count("*").alias("n_rows"), F.count_if(~F.col(value).eqNullSafe(F.col("answer"))).alias("n_mismatch"))


def prefix_majority(values: DataFrame, code: str, value: str, length: int = 3) -> tuple[DataFrame, DataFrame]:
    """(prefix -> majority value, exceptions code -> value). Ties go to the smallest value.

    Counted once by (prefix, value); the majority is a grouped maximum.
    """
    rows = values.select(F.col(code).alias("code"), F.col(value).alias("value"), F.substring(code, 1, length).alias("prefix"))
    n = rows.groupBy("prefix", "value").agg(F.count("*").alias("n"))
    major = n.groupBy("prefix").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    out = rows.join(major.withColumnRenamed("value", "_major"), "prefix").filter(~F.col("value").eqNullSafe(F.col("_major"))).select("code", "value")
    return major, out


def longest_prefix(codes: DataFrame, code: str, exact: DataFrame, prefix: DataFrame, length: int = 3) -> DataFrame:
    """Add ``found``: the exact entry, else the prefix's, else null."""
    e = exact.select(F.col("code").alias("_c"), F.col("value").alias("_e"))
    p = prefix.select(F.col("prefix").alias("_p"), F.col("value").alias("_v"))
    df = codes.join(e, F.col(code) == F.col("_c"), "left").join(p, F.substring(code, 1, length) == F.col("_p"), "left")
    return df.withColumn("found", F.coalesce("_e", "_v")).drop("_c", "_e", "_p", "_v")


def purity(values: DataFrame, code: str, value: str, length: int = 3) -> DataFrame:
    """Distinct values of each prefix and whether it is mixed."""
    g = values.groupBy(F.substring(code, 1, length).alias("prefix")).agg(F.count_distinct(value).alias("n_values"))
    return g.withColumn("mixed", F.col("n_values") > 1)
