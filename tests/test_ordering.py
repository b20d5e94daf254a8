"""Row numbers against a plain sort, with hot groups, ties, nulls and repeated rows."""

import random

from pyspark.sql import functions as F

from fieldcast.operators import cuts
from fieldcast.operators.ordering import number_rows


def plain(rows):
    """Numbers by group: sorted by (v, w), nulls first."""
    want, seen = [], {}
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2]))
    for r in sorted(rows, key=key):
        seen[r[0]] = seen.get(r[0], 0) + 1
        want.append((*r, seen[r[0]]))
    return sorted(want, key=str)


def test_against_a_plain_sort(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([0, 0, 0, 1, None]), rng.randrange(50)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(7)
    got = number_rows(df, ["g"], [F.asc("v"), F.asc("w")], total="size").collect()
    assert sorted([(r.g, r.v, r.w, r.n) for r in got], key=str) == plain(rows)
    sizes = {g: sum(r[0] == g for r in rows) for g in ("a", "b", None)}
    assert all(r["size"] == sizes[r.g] for r in got)


def test_one_value_in_all_rows_spans_partitions(spark):
    df = spark.range(40_000).selectExpr("1 AS g", "0.0 AS v", "id % 2 AS x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_rows(df, [], [F.desc("v")], first=0, name="i")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.agg(F.count_distinct("i"), F.min("i"), F.max("i")).first()[:] == (40_000, 0, 39_999)
    made = spark.read.parquet(cuts._made[-1])
    parts = made.groupBy(F.shiftright("_at", 33)).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 20_000


def test_empty(spark):
    assert number_rows(spark.createDataFrame([], "g string, v int"), ["g"], [F.asc("v")]).count() == 0


def test_written_once_and_released(spark):
    import os

    a = cuts.written(spark.range(5))
    assert cuts.written(a) is a
    cuts.release(a)
    assert not os.path.exists(a.cut_path)


def test_running_totals_and_medians(spark):
    """Sums up to each row over many ranges; medians of a key with most of the values."""
    import statistics

    from fieldcast.operators.consensus import consensus_medians
    from fieldcast.operators.ordering import running_totals

    rng = random.Random(8)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, *range(200)]), rng.randrange(4)) for _ in range(4000)] + [("none", None, 1)]
    df = spark.createDataFrame(rows, "k string, v int, w int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(df, ["k"], [F.asc("v")], "w", "upto", "total").collect()
        medians = {r["k"]: r["m"] for r in consensus_medians(df, ["k"], "v", "m").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("hot", "a", None, "none"):
        mine = sorted(((r.upto, r.v if r.v is not None else -1, r.w) for r in got if r.k == k), key=lambda x: (x[1], x[0]))
        total = sum(r[2] for r in rows if r[0] == k)
        assert [m[0] for m in mine] == sorted(m[0] for m in mine) and mine[-1][0] == total
        assert sum(m[2] for m in mine) == total
        values = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert medians[k] == (statistics.median(values) if values else None)
