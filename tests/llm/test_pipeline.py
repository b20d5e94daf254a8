"""The corpus pipeline, stage by stage, on a small planted corpus."""

import random

import corpus_pipeline
import pytest
from fieldcast.llm import near_text, queries


def test_registered():
    names = queries.queries()
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    clean = [" ".join(rng.choices(words, k=120)) for _ in range(150)]
    rude = [" ".join([*rng.choices(words, k=100), "scoundrel", "scoundrel", "villain"]) for _ in range(60)]
    loud = [" ".join(w.upper() + "!!" for w in rng.choices(words, k=100)) for _ in range(60)]
    copies = [clean[0]] * 5
    short = ["too short"] * 3
    texts = clean + rude + loud + copies + short
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 210 <= i < 270), int(150 <= i < 210)) for i in range(270)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = out.cache()
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert left[0] == set(range(275))
    assert left[1] == {*range(150), *range(270, 275)}
    assert left[2] == set(range(150))
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(range(150))


def test_near_dedup_rows_without_ids(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    a, b, c, d, e = (" ".join(rng.choices(words, k=120)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, c), (7, e), (7, e), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    texts = [x[1] for x in got]
    assert {(None, a), (None, b), (5, d), (3, c), (7, e)} <= set(got)
    assert all(texts.count(t) == 1 for t in (a, b, c, d, e))


def _edited_copies():
    """Texts with copies edited in places, some in a large group, around a similarity of 0.8."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for group in range(40):
        base = rng.choices(words, k=200)
        texts.append(" ".join(base))
        for _ in range(60 if group == 0 else 3):
            copy = list(base)
            for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6])):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def _brute_links(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("block", [near_text._BLOCK, 4])
def test_near_dedup_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(near_text, "_BLOCK", block)
    texts = _edited_copies()
    links = _brute_links(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    want = {i for i in root if find(i) == i}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    # nothing unlinked goes; of the linked pairs at least 97 % are found
    assert want <= got
    assert len(got - want) <= 0.03 * (len(texts) - len(want))


def test_near_dedup_odd_tables(spark):
    """Empty table, clashing column names, very long texts, maps, rows that come from no file."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    edited = [w if rng.random() > 0.01 else "edited" for w in long]
    rows = [(2, " ".join(long)), (1, " ".join(edited)), (3, "a b c"), (4, "a b c"), (5, "a b"), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    for c in ("file", "at", "row", "key", "node", "rank", "bands", "minima", "fp", "component", "_metadata"):
        docs = docs.selectExpr("*", f"1 AS `{c}`")
    docs = docs.selectExpr("*", "map('k', 1) AS m")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 0), (0, 0), (1, len(" ".join(edited))), (3, 5), (5, 3)]
