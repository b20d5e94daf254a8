"""Null, repeated, empty and odd rows of the classifier, URL rules, packing and SimHash."""

import random

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import common, packing, quality_classifier, simhash, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def made(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    return df.withColumns({c: F.lit(1) for c in ("id", "t", "fp", "salt", "length", "key", "grade", "x", "_text", "_id", "_grade", "buckets", "piece_", "node")})


def test_one_row_for_each_labelled_document(spark, monkeypatch):
    """A labelled id with thousands of rows sends one of them to the driver."""
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["good", "fine", "bad", "ugly"], k=20)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, f"another text {k}") for k in range(2000)] + [(None, "x y"), (7, None)]
    graded = spark.createDataFrame([(i, i % 3) for i in range(40)] + [(None, 1)], "doc_id long, grade int")
    seen = []
    fit = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda b, d, g, n: seen.append(len(g)) or fit(b, d, g, n))
    model = quality_classifier.train(made(spark, rows), graded)
    assert seen == [40]
    got = quality_classifier.score(made(spark, rows), model)
    assert got.count() == len(rows)
    again = quality_classifier.train(made(spark, rows[::-1]), graded)
    assert (model.weights == again.weights).all() and model.thresholds == pytest.approx(again.thresholds)


def test_classifier_on_empty_tables(spark):
    none = made(spark, [])
    graded = spark.createDataFrame([], "doc_id long, grade int")
    model = quality_classifier.train(none, graded)
    assert quality_classifier.score(none, model).count() == 0
    assert quality_classifier.keep_good(none, model).count() == 0
    rows = made(spark, [(1, None), (None, ""), (2, "w " * 300_000), (2, "w " * 300_000)])
    assert {(r["doc_id"], r["kept"]) for r in quality_classifier.score(rows, model).collect() if r["doc_id"] != 2} == {(1, False), (None, False)}
    assert quality_classifier.keep_good(rows, model).columns == rows.columns


def plain_score(model, text):
    b, d = quality_classifier.features((text or "").encode())
    z = sum(float(model.weights[i]) for i in b) + float(d @ model.dense)
    above = [1 / (1 + pytest.importorskip("math").exp(t - z)) for t in model.thresholds]
    return (sum(above), above[-1]) if len(b) else (0.0, 0.0)


def test_scores_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(80)] + ["BAD!!", "#"], k=rng.randint(0, 90)))) for i in range(300)]
    graded = spark.createDataFrame([(i, t.count("BAD") and 1 or 2) for i, t in rows], "doc_id long, grade int")
    docs = made(spark, rows)
    model = quality_classifier.train(docs, graded)
    for r in quality_classifier.score(docs, model).collect():
        want = plain_score(model, rows[r["doc_id"]][1])
        assert (r["expected_grade"], r["p_top"]) == pytest.approx(want, abs=1e-5)
        assert r["kept"] == (want[1] >= quality_classifier.MIN_TAIL) or abs(want[1] - 0.5) < 1e-5


def test_repeated_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    rows = [(1, "http://a.example.com/en/x")] * 3000 + [(None, None), (2, "http://x.net/fr/" + "y" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS id", "2 AS key", "3 AS salt", "4 AS host", "5 AS rule", "6 AS range").repartition(8)
    got = url_filter.judge_urls(df, rules)
    assert got.filter("page_id = 1 and verdict = 'block' and rule = 'example.com/en/'").count() == 3000
    assert got.filter("page_id = 2 and verdict = 'block'").count() == 1 and got.count() == 3002


def test_simhash_rows(spark):
    long = " ".join(f"w{k % 977}" for k in range(450_000))
    rows = [(1, long), (2, long + " tail"), (3, long), (3, long), (None, "a b c d"), (5, ""), (6, None), (7, " ")]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(made(spark, rows)).collect()}
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[1][0] == by_id[3][0] and by_id[3][1] == by_id[2][1] == 1
    assert {by_id[i] for i in (5, 6, 7)} == {("0" * 16, 5)}
    assert simhash.simhash_components(made(spark, []).limit(0)).count() == 0


def test_packing_on_repeated_rows(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rows = [(1, "a b")] * 50 + [(None, "a b")] * 30 + [(None, None), (2, "word " * 20_000)]
    got = packing.pack(made(spark, rows), path).collect()
    assert len(got) == 50 + 30 + 1 + 5
    places = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(places) == len(got)


class Session:
    """Of a session without ``spark.checkpoint.dir``: its master."""

    def __init__(self, master):
        self.sparkContext = self.conf = self
        self.master = master

    def get(self, key, default):
        return default


def test_cut_points_need_a_shared_folder():
    assert common.shared_dir(Session("local[4]")).startswith("/")
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            common.shared_dir(Session(master))


def test_clean_up(spark):
    import os

    common.materialize(spark.range(3))
    path = common._made[-1]
    assert os.path.isdir(path)
    common.clean_up(spark)
    assert not os.path.exists(path) and not common._made
