"""Line frequency of the quality rules: distinct documents, copies, ids, names, and its SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldcast.llm import queries, quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"
NOTICE = " ".join(f"notice{i}" for i in range(40))


def made(spark, texts, hosts=None, ids=None):
    hosts, ids = hosts or ["s"] * len(texts), ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", h, None if t is None else len(t)) for i, t, h in zip(ids, texts, hosts)], DOC)


def body(seed, lines=12, words=8):
    r = random.Random(seed)
    return "\n".join(" ".join(f"w{r.randrange(10**6)}" for _ in range(words)) for _ in range(lines))


def over_limit(texts, share=quality_rules.MAX_LINE_SHARE, least=quality_rules.MIN_LINE_DOCS):
    """Normalised lines of one host that too many of its distinct documents hold."""
    docs = {t or "" for t in texts}
    held = {}
    for t in docs:
        for line in {" ".join(x.split()).lower() for x in t.split("\n") if x.split()}:
            held[line] = held.get(line, 0) + 1
    return {line for line, n in held.items() if n > least and n > share * len(docs)}


def want(texts):
    over = over_limit(texts)
    return {i: "\n".join(x for x in t.split("\n") if " ".join(x.split()).lower() not in over) for i, t in enumerate(texts)}


def kept(spark, texts):
    return {r["doc_id"]: r["text"] for r in quality_rules.keep_good(made(spark, texts)).collect()}


def test_notice_that_is_the_longest_line_of_300_documents(spark):
    texts = [body(i) + "\n" + NOTICE + "\nshort and shared" for i in range(300)]
    assert over_limit(texts) == {NOTICE, "short and shared"}
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(made(spark, texts)).collect()}
    assert all(r["n_words"] == 139 and r["words_left"] == 96 and r["kept"] for r in got.values())
    assert kept(spark, texts) == want(texts)


def test_notice_in_a_host_full_of_copies(spark):
    texts = [body(i) + "\nshort and shared" for i in range(25)] + [body(99)] * 3000
    assert over_limit(texts) == {"short and shared"}
    assert kept(spark, texts) == want(texts)


def test_copies_keep_their_lines(spark):
    texts = [body(1) + "\n" + NOTICE] * 100 + [NOTICE + "\n" + NOTICE] * 30 + [body(2)]
    assert over_limit(texts) == set()
    got = kept(spark, texts)
    assert [got[i] for i in range(100)] == texts[:100] and got[130] == texts[130]


def test_depleted_documents_go(spark):
    texts = [f"{NOTICE}\n{body(i, 1, 11 + i)}" for i in range(60)]
    got = kept(spark, texts)
    assert got == {i: t for i, t in want(texts).items() if len(t.split()) >= 0.5 * len(texts[i].split())} and 0 < len(got) < 60


def test_rows_are_judged_by_themselves(spark):
    """Null and repeated ids, a null and an empty host, repeated rows, and any column name."""
    texts = [body(1), "two words", body(2), None, body(3), body(3)]
    df = made(spark, texts, ["s", "s", None, None, "", ""], [1, 1, None, None, 7, 7])
    for c in ("_gone", "_id", "_host", "row", "host", "gone", "hit", "left", "key", "of", "lines", "a.b"):
        df = df.withColumn(c, F.lit(c))
    got = quality_rules.keep_good(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["row"], r["a.b"]) for r in got.collect()) == sorted([(1, texts[0], "row", "a.b"), (0, texts[2], "row", "a.b"), (7, texts[4], "row", "a.b"), (7, texts[5], "row", "a.b")])
    counts = quality_rules.quality_rules(df.drop("a.b"))
    assert counts.count() == 6 and counts.filter("kept").count() == 4


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_windows_of_texts_longer_than_the_positions(spark, bits):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 60))) for _ in range(60)] + ["x y z " * 400]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.with_text_counts(made(spark, texts), "text", bits).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        assert got[i] == len({j for k, x in enumerate(win) if win.count(x) > 1 for j in (k, k + 1, k + 2)})


def test_sql_where_the_rule_fires(spark, tmp_path):
    """The registered query and its SQL on hosts with boilerplate, copies and odd rows."""
    rng = random.Random(8)
    texts, hosts = [], []
    for h in ("s0", "s1", None):
        texts += [f"{body(rng.random(), 9)}\n{NOTICE}" for _ in range(40)] + [f"{NOTICE.upper()} \n{body(rng.random(), 1, 30)}" for _ in range(20)] + [body(h)] * 50 + ["", None, " \n"]
        hosts += [h] * 113
    made(spark, texts, hosts).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.sql(queries.OP10_SQL)
    rows = sorted(tuple(r[c] for c in sql.columns) for r in got.collect())
    assert rows == sorted(sql.fetchall())
    assert sum(not r[-1] and not r[-2] for r in rows) == 60
