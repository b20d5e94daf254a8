"""Row numbers in any order, over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import written

_PARTITION = 33  # bits of a row's place within its partition


def _laid_out(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Rows dealt to ranges of (group, order, place in the input), sorted there and written with
    their place, ``_at``, whose high bits are the range's number."""
    place = F.monotonically_increasing_id()
    keys = [F.col(c) for c in by] + order + [F.col("_place")]
    rows = df.withColumn("_place", place).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(rows.drop("_place").withColumn("_at", place))


def _joined(rows: DataFrame, by: list[str], runs: DataFrame) -> DataFrame:
    """``rows`` with the row of their range and group."""
    on = F.shiftright("_at", _PARTITION) == F.col("_run")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(runs, on)


def _before(by: list[str], column: str) -> tuple[Column, Column]:
    """What the group's earlier ranges sum up to, and all of its ranges."""
    group = Window.partitionBy(*by)
    return F.coalesce(F.sum(column).over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum(column).over(group)


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str = "n", first: int = 1, total: str | None = None) -> DataFrame:
    """Add ``name``: the row's number, from ``first``, in its group ``by`` in the order ``order``.

    A group may span any number of ranges, whatever its ties: a range's rows start where the
    group's earlier ranges end, which a running count over one row for each range and group
    tells. So neither a group nor a value is ever sorted in one task. ``total`` adds the group's
    count. Null is a group. Rows that ``order`` leaves equal are numbered in the order of the
    input, which must then be the same when read again, as that of files is.
    """
    rows = _laid_out(df, by, order)
    runs = rows.groupBy(*by, F.shiftright("_at", _PARTITION).alias("_part")).agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    before, all_of = _before(by, "_n")
    runs = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_run"), (before - F.col("_lo") + first).alias("_base"), all_of.alias("_total"))
    out = _joined(rows, by, runs).withColumn(name, F.col("_base") + F.col("_at"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, name, *([total] if total else []))


def running_totals(df: DataFrame, by: list[str], order: list[Column], weight: str, name: str, total: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the group's rows up to this one, and the group's
    ``total``, over ranges as in ``number_rows``."""
    rows = _laid_out(df, by, order).withColumn("_part", F.shiftright("_at", _PARTITION))
    here = F.sum(weight).over(Window.partitionBy(*by, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.groupBy(*by, "_part").agg(F.sum(weight).alias("_w"))
    before, all_of = _before(by, "_w")
    runs = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_run"), before.alias("_base"), all_of.alias(total))
    return _joined(rows.withColumn("_here", here), by, runs).withColumn(name, F.col("_base") + F.col("_here")).select(*df.columns, name, total)
