"""Name search against brute force, typed text that starts alike, hot grams; line-ups by hand."""

import itertools
import random

from pyspark.sql import functions as F

from fieldcast.operators import projections, rosters

KEYS = ["customer%04d" % i for i in range(300)] + ["ajbrown", "anthonybrown", "kennethwalker", "xy", "é", "aaaa", "aaaaa"]


def test_containing_against_brute_force(spark):
    rng = random.Random(3)
    queries = {k[a : a + n] for k in KEYS for a, n in [(rng.randrange(6), rng.randrange(1, 9))]} | {"zzz", "customer", "customer00", "brown", "a", "aaa", "aaaa", "customer029", ""}
    index = rosters.gram_index(spark.createDataFrame([(k,) for k in KEYS + KEYS], "name_key string"))
    got = rosters.containing(spark.createDataFrame([(q,) for q in queries], "query string"), index, rosters.gram_counts(index)).collect()
    assert sorted((r["query"], r["name_key"]) for r in got) == sorted((q, k) for q in queries for k in KEYS if q and q in k)


def test_resolve_against_brute_force(spark):
    queries = ["customer0007", "customer02", "customer029", "029", "brown", "walker", "x", "é", "zzz", "", "aaaa", "aaaaa", "aaa", "jb", "customer"]

    def want(q):
        hits = [k for k in KEYS if k == q] or [k for k in KEYS if q and q in k]
        return hits[0] if len(hits) == 1 else None

    got = rosters.resolve_name(spark.createDataFrame([(q,) for q in queries * 2], "query string"), spark.createDataFrame([(k,) for k in KEYS], "name_key string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((q, want(q)) for q in queries if want(q))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_suggest(spark):
    pool = spark.createDataFrame([(k, float(i % 17)) for i, k in enumerate(KEYS)], "name_key string, points double")
    taken = spark.createDataFrame([("customer0016",)], "name_key string")
    got = rosters.suggest(spark.createDataFrame([("001",), ("c",), ("brown",)], "query string"), pool, taken, 4)
    for q, rows in itertools.groupby(sorted(got.collect(), key=lambda r: (r["query"], r["rank"])), key=lambda r: r["query"]):
        free = [(k, float(i % 17)) for i, k in enumerate(KEYS) if q in k and k != "customer0016"]
        assert [r["name_key"] for r in rows] == [k for k, _ in sorted(free, key=lambda x: (not x[0].startswith(q), -x[1], x[0]))[:4]]


def shuffled_records(spark, first_stage=0):
    """Records that stages from ``first_stage`` on have shuffled, and the next stage's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    held = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    stages = [held.apply(i) for i in range(held.size())]
    return sum(s.shuffleWriteRecords() for s in stages if s.stageId() >= first_stage), max((s.stageId() for s in stages), default=-1) + 1


def best_candidates(ask, pool, entries, placed, slots, k):
    """By hand, the ``k`` best of one ask (roster, slot, query, week)."""
    roster, slot, query, week = ask
    if slot not in slots or query is None:
        return []
    elsewhere = {n for r, s, n in placed if r == roster and r is not None and s != slot}
    points = {n: p for n, w, p, _ in sorted(entries, key=lambda e: -e[3]) if w == week}
    free = [(n, points.get(n) or 0.0) for n, position in pool if (slots[slot] is None or position in slots[slot]) and n not in elsewhere and query in n]
    return [(n, p, i + 1) for i, (n, p) in enumerate(sorted(free, key=lambda x: (-x[1], x[0]))[:k])]


def test_candidates_against_brute_force(spark):
    """Rosters of no, few and nearly all players, players in two slots or without a position, nulls."""
    rng = random.Random(7)
    slots = {"QB": ["QB"], "FLEX": ["RB", "WR"], "BN": None}
    pool = [(k, rng.choice(["QB", "RB", "WR", "TE", None])) for k in KEYS]
    entries = [(k, w, rng.choice([0.0, 1.5, 2.0, 9.0, None]), i) for k in KEYS[::2] + ["stranger"] for w in (1, 2, 3) for i in range(rng.randrange(3))]
    placed = [(1, "QB", k) for k in KEYS[:250]] + [(r, rng.choice(["QB", "FLEX"]), rng.choice([*KEYS, "stranger"])) for r in (2, 3, 3, 3) for _ in range(20)]
    asks = [(r, s, q, w) for r in (1, 2, 3, 4, None) for s in ("QB", "FLEX", "BN", "none") for q in ("", "0", "customer02", "brown", "zzz", None) for w in (1, 3, 9, None)]
    got = rosters.candidates_for(
        spark.createDataFrame([(i, *a) for i, a in enumerate(asks + asks[::3])], "ask int, roster int, slot string, query string, week int"),
        spark.createDataFrame(pool, "name_key string, position string"),
        spark.createDataFrame(entries, "name_key string, week int, points double, ord int"),
        spark.createDataFrame(placed, "roster int, slot string, name_key string"),
        list(slots.items()), 4,
    )
    assert got.columns == ["ask", "roster", "slot", "name_key", "points", "rank"]
    want = [(i, a[0], a[1], *row) for i, a in enumerate(asks + asks[::3]) for row in best_candidates(a, pool, entries, placed, slots, 4)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 1000


def test_candidates_of_many_asks_alike(spark):
    """Asks that are alike, and lists that are, are not joined with names again and again."""
    names = [(f"p{i}", "QB" if i % 2 else "RB") for i in range(1000)]
    placed = [(r, "RB", f"p{(37 * r + i) % 1000}") for r in range(5) for i in range(8)]
    slots, asks = {"QB": ["QB"], "BN": None}, [(i % 5, "QB" if i % 2 else "BN", "1" if i % 4 else "", 1) for i in range(4000)]
    entries = [(n, 1, float(i % 50), 0) for i, (n, _) in enumerate(names)]
    made = [
        spark.createDataFrame(rows, schema).coalesce(1)
        for rows, schema in (
            ([(i, *a) for i, a in enumerate(asks)], "ask int, roster int, slot string, query string, week int"), (names, "name_key string, position string"),
            (entries, "name_key string, week int, points double, ord int"), (placed, "roster int, slot string, name_key string"),
        )
    ]
    first = shuffled_records(spark)[1]
    got = rosters.candidates_for(*made, list(slots.items()), 3).collect()
    rows, _ = shuffled_records(spark, first)
    by_hand = {a: best_candidates(a, names, entries, placed, slots, 3) for a in set(asks)}
    assert sorted((r["ask"], r["name_key"], r["points"], r["rank"]) for r in got) == sorted((i, *row) for i, a in enumerate(asks) for row in by_hand[a])
    assert rows < 60_000, rows  # 3000 asks for "1" hit some 620000 names


def test_line_up_against_brute_force(spark):
    """Random slot tables: each slot in turn takes the best unused eligible player."""
    rng = random.Random(5)
    slots = [("A", ["QB"]), ("B", ["RB", "WR"]), ("C", ["RB", "WR"]), ("D", ["QB", "RB", "WR", "TE"]), ("E", ["DEF"])]
    rows = [(r, rng.choice(["QB", "RB", "WR", "TE", None]), rng.choice([1.0, 2.0, None]), i) for r in range(30) for i in range(rng.randrange(0, 9))]
    df = spark.createDataFrame(rows, "roster_id int, position string, points double, ord int").withColumn("i", F.lit("x"))
    got = {(r["roster_id"], r["ord"]): r["slot"] for r in rosters.auto_assign(df, bench=2, slots=slots).collect()}
    assert len(got) == len(rows)
    for roster in range(30):
        mine = sorted((x for x in rows if x[0] == roster), key=lambda x: (-(x[2] or 0), x[3]))
        want = {}
        for slot, eligible in slots:
            pick = next((x for x in mine if x[3] not in want and x[1] in eligible), None)
            if pick:
                want[pick[3]] = slot
        rest = [x for x in mine if x[3] not in want]
        rest.sort(key=lambda x: (x[2] is None, -(x[2] or 0), x[3]))  # the bench: no points last
        want |= {x[3]: f"BN{i + 1}" for i, x in enumerate(rest[:2])}
        assert {o: s for (r, o), s in got.items() if r == roster and s} == want


def test_many_rows_without_points(spark):
    """One week and position of zero points: numbered over many tasks, in feed order."""
    df = spark.range(200_000).selectExpr("1 AS week", "'WR' AS position", "0.0D AS points", "id AS ord")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = projections.position_rank(df, ["week"], "position", "points", ["ord"])
        assert got.filter("rank <> ord + 1").count() == 0 and got.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    from fieldcast.operators import cuts

    sizes = spark.read.parquet(cuts._made[-1]).groupBy(F.shiftright("_at", 33)).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 100_000
