"""Fingerprints against brute force: edited texts, likenesses of paragraphs, odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import fingerprints

DOC = "doc_id long, text string"


def paragraphs(text):
    words = [[w[i : i + 60] for w in re.findall(r"\S+", line) for i in range(0, len(w), 60)] for line in text.split("\n")]
    return [" ".join(line[i : i + 32]) for line in words for i in range(0, len(line), 32)]


def alike(a, b):
    x, y = Counter(paragraphs(a)), Counter(paragraphs(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def plain(rows):
    """Rows with distinct (id, text), or equal rows."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(text, edited), alike(text, after)))
    return sorted(want, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("id", "k", "h", "n", "pos", "next", "own", "edited", "times", "take")})
    out = fingerprints.fingerprints(df.repartition(3))
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return out.collect()


def checked(spark, rows):
    got = run(spark, rows)
    have, want = sorted(((r[0], r[1], r[2], r[5], r[6]) for r in got), key=str), plain(rows)
    assert [h[:3] for h in have] == [w[:3] for w in want]
    for h, w in zip(have, want):
        assert h[3:] == pytest.approx(w[3:], abs=1e-9)
    prints = {}
    for r in got:
        text = next(t or "" for i, t in rows if i == r["doc_id"] and len(t or "") == r["n_chars"])
        prints.setdefault(text, set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    return got


def some(rng, n, most):
    def text():
        return "".join(rng.choice([f"w{rng.randrange(300)}", "é", "xyz", "x" * 70]) + rng.choice([" ", " ", " ", ". ", "\n", "\n\n"]) for _ in range(rng.randint(0, most)))

    return [(i, text()) for i in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = some(rng, 60, 200) + [(100 + i, t) for i, t in some(rng, 6, 6000)]
    rng.shuffle(rows)
    checked(spark, rows)


def test_odd_rows(spark):
    """Empty and null texts, repeats of one line, equal texts, a null id."""
    same = "one line\n" * 3000
    rows = [(1, None), (2, ""), (3, "abc"), (4, same), (5, same + "one line\n"), (6, same), (None, "x y z. " * 40), (8, "no end " * 30_000), (9, "é" * 9000)]
    checked(spark, rows)
    checked(spark, [(3, "one two. three four")])
    assert run(spark, []) == []


def test_equal_rows(spark):
    """Equal rows follow each other; each but the last has itself as the next."""
    rows = [(1, "a b c. d e f. g")] * 5 + [(2, "other words. and more")]
    got = checked(spark, rows)
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 1) == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_differences_name_the_paragraphs(spark):
    """What peeling recovers are the digests of the paragraphs that differ; one stuck table is
    made again, larger."""
    a = [f"line {i}" for i in range(900)]
    for b in (a[:880] + ["new"], a[:500] + [f"more {i}" for i in range(700)], [], a):
        df = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string")
        df = df.select(fingerprints.digests(F.col("a")).alias("a"), fingerprints.digests(F.col("b")).alias("b")).withColumn("k", F.greatest(fingerprints.table_bits(F.size("a")), fingerprints.table_bits(F.size("b"))))
        df = df.withColumn("s", fingerprints.sketch(F.col("a"), F.col("k"))).withColumn("t", fingerprints.sketch(F.col("b"), F.col("k")))
        r = df.select("a", "b", fingerprints.differences(F.col("a"), F.col("b"), F.col("k"), F.col("s"), F.col("t")).alias("d")).first()
        assert set(r["d"]["gone"]) == set(r["a"]) - set(r["b"]) and set(r["d"]["came"]) == set(r["b"]) - set(r["a"])
        assert len(r["d"]["gone"]) == len(set(a) - set(b)) and len(r["d"]["came"]) == len(set(b) - set(a))


def test_peeling_alone_suffices(spark):
    """Without the last way out: random versions are told apart by peeling."""
    rng = random.Random(7)
    texts = ["\n".join(f"{rng.random()}" for _ in range(rng.choice([5, 10, 15, 16]))) for _ in range(300)]
    df = spark.createDataFrame(list(zip(texts, texts[1:] + texts[:1])), "a string, b string")
    df = df.select(fingerprints.digests(F.col("a")).alias("a"), fingerprints.digests(F.col("b")).alias("b"))
    found = F.coalesce(*[fingerprints._again(F.col("a"), F.col("b"), *r) for r in fingerprints.RETRIES])
    assert df.select(found.alias("d")).filter("d is null").count() <= 1
