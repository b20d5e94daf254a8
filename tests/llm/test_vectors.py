"""Near vectors with saturated lists, large and stretched components, copies and the audit."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def truth(every, lab):
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= vectors.THRESHOLD) & (np.array(lab)[:, None] == np.array(lab))
    np.fill_diagonal(near, False)
    label = np.arange(len(every))
    while True:
        new = np.array([min(label[i], label[near[i]].min(initial=label[i])) for i in range(len(every))])
        if (new == label).all():
            return near.sum(1), label
        label = new


def planted(seed=2):
    """A dense group of 700, a chain of 600 (its ends far apart), pairs, copies and noise."""
    rng = np.random.default_rng(seed)
    d = 24
    dense = rng.standard_normal(d) + 0.09 * rng.standard_normal((700, d))
    turn = np.linspace(0, 3.0, 600)
    plane = np.linalg.qr(rng.standard_normal((d, 2)))[0]
    chain = np.stack([np.cos(turn), np.sin(turn)], 1) @ plane.T + 0.004 * rng.standard_normal((600, d))
    base = rng.standard_normal((200, d))
    pairs = base[:150] + 0.08 * rng.standard_normal((150, d))
    every = np.concatenate([dense, chain, base, pairs, dense[:5], chain[:5], base[:5]]).astype(np.float32)
    lab = [0] * 700 + [1] * 600 + [i % 3 for i in range(200)] + [i % 3 for i in range(150)] + [0] * 5 + [1] * 5 + [i % 3 for i in range(5)]
    order = rng.permutation(len(every))
    return every[order], [lab[i] for i in order]


def test_planted_groups(spark):
    every, lab = planted()
    df, recall = vectors.find_near(frame(spark, [(i, v.tolist(), x) for i, (v, x) in enumerate(zip(every, lab))]))
    got = {r["vec_id"]: r for r in df.collect()}
    degree, comp = truth(every, lab)
    assert degree.max() > 256 and max(collections.Counter(comp).values()) > 512
    assert recall >= vectors.MIN_RECALL
    assert [got[i]["n_links"] for i in range(len(every))] == degree.tolist()
    assert [got[i]["component_id"] for i in range(len(every))] == comp.tolist()


def test_shells_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_BLOCK", 16)
    every, lab = planted(3)
    chain = [(i, v) for i, (v, x) in enumerate(zip(every, lab)) if x == 1][:400]
    degree, _ = truth(np.array([v for _, v in chain]), [0] * len(chain))
    rows = [(i, chain[0][0], 1 + i % 3, v.tolist()) for i, v in chain]
    got = {r["id"]: r["links"] for r in vectors._region_links(spark.createDataFrame(rows, "id long, comp long, n long, v array<float>"), vectors.THRESHOLD).collect()}
    unit = np.array([v for _, v in chain], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= vectors.THRESHOLD
    np.fill_diagonal(near, False)
    want = near @ np.array([1 + i % 3 for i, _ in chain])
    assert [got.get(i, 0) for i, _ in chain] == want.tolist()


def test_audit_sees_missing_links(spark):
    every, _ = planted(4)
    reps = spark.createDataFrame([(i, 1, len(v), 1, v.tolist()) for i, v in enumerate(every[:300])], "id long, part long, size int, n long, v array<float>")
    degree, _ = truth(every[:300], [0] * 300)
    table = lambda f: spark.createDataFrame([(i, f(int(n))) for i, n in enumerate(degree) if n], "id long, links long")
    assert vectors.audit(reps, table(lambda n: n), 0.98)[0] == 1.0
    low, rests_on = vectors.audit(reps, table(lambda n: n // 2), 0.98)
    assert low < 0.6 and rests_on > 50
    assert vectors.audit(reps, table(lambda n: 0).filter("id < 0"), 0.98)[0] == 0.0


def test_low_recall_stops_the_job(spark, monkeypatch):
    monkeypatch.setattr(vectors, "audit", lambda *a: (0.5, 10))
    with pytest.raises(RuntimeError):
        vectors.near_vectors(frame(spark, [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)]))


def test_more_tables_for_more_vectors():
    assert len(vectors.tables_for(0)) == len(vectors.tables_for(1000)) == vectors.TABLES
    assert 10 <= len(vectors.tables_for(10**6)) < len(vectors.tables_for(10**9)) < 40


def test_odd_vectors(spark):
    """Empty table, other columns, null and repeated ids, ties, sizes that differ, long vectors."""
    wide = [float(i % 7) for i in range(5000)]
    rows = [(1, wide, 1), (2, wide, 1), (None, wide, 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0], 1), (5, [-1.0], 1), (6, [], 1), (7, [2.0], 1)]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "v", "n", "part", "size", "comp", "able", "a", "b", "s")})
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect() if r["vec_id"])
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 4, False)]
    assert vectors.near_vectors(df.limit(0)).count() == 0
