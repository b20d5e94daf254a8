"""Ranking and depth-constrained trimming of a projection feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import number_rows

#: Reserved players of a position for each team and week, and the cap.
MIN_DEPTH = {"QB": 2, "RB": 3, "WR": 4, "TE": 2, "K": 1, "DEF": 1}
CAP = 16


def position_rank(df: DataFrame, keys: list[str], position: str, points: str, ord_cols: list[str]) -> DataFrame:
    """Add ``rank`` (1.. by points, ties in feed order) and its label, like ``WR4``.

    Groups are few and large, and many rows have no points: they are numbered across ranges of
    the whole order, so neither a group nor a value is sorted in one task.
    """
    df = number_rows(df, [*keys, position], [F.desc(points), *[F.col(c) for c in ord_cols]], name="rank")
    return df.withColumn("rank", F.col("rank").cast("long")).withColumn("position_rank", F.concat(F.col(position), F.col("rank").cast("string")))


def drop_zero(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) > 0)


def team_week_has_skill(df: DataFrame, keys: list[str], position: str, lone: str = "DEF") -> DataFrame:
    """Rows of team-weeks with any position but ``lone``."""
    ok = df.groupBy(*keys).agg(F.bool_or(F.col(position) != lone).alias("_ok")).filter("_ok").select(*keys)
    return df.join(ok, keys, "left_semi")


def depth_trim(df: DataFrame, keys: list[str], position: str, points: str, name: str, min_depth: dict[str, int] | None = None, cap: int = CAP, ord_cols: tuple[str, ...] = ()) -> DataFrame:
    """At most ``cap`` rows of a group: each position's best are reserved up to its depth,
    the rest fill up by points, then name. Reserves together fit under the cap."""
    depth = MIN_DEPTH if min_depth is None else min_depth
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in depth.items() for x in p]), F.col(position)), F.lit(0)) if depth else F.lit(0)
    order = [F.desc(points), F.col(name), *ord_cols]
    # no row beyond the cap of its position can be under the cap of its group: they go before the second sort
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, position).orderBy(*order))).filter(F.col("_k") <= cap)
    df = df.withColumn("_free", (F.col("_k") > limit).cast("int"))
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_free", *order))).filter(F.col("_i") <= cap).drop("_k", "_free", "_i")
