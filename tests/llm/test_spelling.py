"""Spelling variants against brute force, over several shards and turns, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import spelling

DOC = "doc_id long, text string"


def near(a, b):
    """Exactly one edit apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, min_length, min_count, ratio=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "[" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    form, n_near = {}, {}
    for w, n in counts.items():
        them = [v for v in counts if near(w, v)]
        n_near[w] = len(them)
        best = min(them, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, n_near[w], form[w] and counts[form[w]]) for w, n in counts.items())


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("word", "n", "name", "form", "root")})
    out = spelling.group_variants(df.repartition(3), **kw)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def some(rng, n):
    def text():
        return "".join(rng.choice(["ab", "b", "A", "éa", "ÀB", "b", "ba"]) * rng.randint(1, 2) + rng.choice([" ", "", "", "-"]) for _ in range(rng.randint(0, 60)))

    return [(rng.choice([i, i, None]), rng.choice([text(), text(), text(), None, ""])) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"shard_words": 7, "broadcast_bytes": 400}, {"shard_words": 1, "broadcast_bytes": 1}])
def test_against_brute_force(spark, kw):
    rows = some(random.Random(len(kw)), 60)
    want = plain(rows, 2, 2)
    assert len(want) > 30 and any(w[1] for w in want)
    if kw.get("shard_words") == 1:
        rows = rows[:12]
        want = plain(rows, 2, 2)
    assert run(spark, rows, min_length=2, min_count=2, **kw) == want


def test_chains_and_ties(spark):
    """Forms lead on to roots; of equally frequent near words the smallest is the form."""
    words = {"colours": 1000, "colour": 200, "colou": 40, "colo": 8, "kittan": 50, "kittbn": 50, "kitten": 5, "lonely": 7}
    rows = [(1, " ".join([w] * n)) for w, n in words.items()]
    got = {r[0]: r for r in run(spark, rows, min_length=4)}
    assert got["colo"][1:3] == ("colou", "colours") and got["colou"][2] == "colours"
    assert got["kitten"][1] == "kittan" and got["kitten"][4] == 2 and got["lonely"][4] == 0
    assert got == {r[0]: r for r in plain(rows, 4, 5)}


def test_automaton(spark):
    """All edits, at both ends, with repeated letters, in tries of one word and of many."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(400)})
    trie = spelling.build_trie(words, [i + 1 for i in range(len(words))])
    for w in [*words[:200], "", "a", "zz", "abababab"]:
        assert spelling.neighbours(w, trie) == {v: i + 1 for i, v in enumerate(words) if near(w, v)}


def test_odd_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), (1, ""), (2, "... 12 -")]) == []
    rows = [(1, "Straße " * 200_000)] + [(2, "strasse STRASSE")] * 3 + [(None, "straßen")] * 6
    assert run(spark, rows) == plain(rows, 6, 5)


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert run(spark, rows, shard_words=50) == plain(rows, 6, 5)
