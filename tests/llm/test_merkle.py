"""The Merkle manifest against a plain one, in small blocks and with odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def reduced(nodes, fanout):
    """Root of a list of digests, and each one's siblings as (left, right), level by level."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            for j in range(len(run)):
                for i in members[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            held.append([i for m in members[k : k + fanout] for i in m])
        nodes, members = up, held
    return nodes[0], paths


def plain(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf_of(r))))
        trees.append((mine, *reduced([leaf_of(r) for r in mine], fanout)))
    root, tops = reduced([t[1] for t in trees], fanout)
    want = []
    for (mine, subroot, paths), above in zip(trees, tops):
        for r, path in zip(mine, paths):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            digest = leaf_of((*r[:3], r[3] + 1, r[4]) if changed and r[3] is not None else r)
            for a, b in path:
                digest = sha(a + digest + b)
            want.append((r[0], leaf_of(r), subroot, root, sha("".join(a + b for a, b in path)), digest, digest == root))
    return sorted(want, key=str)


def run(spark, rows, **kw):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("id", "tree", "pos", "size", "leaf", "digest", "root", "block")})
    out = merkle.manifest(df.repartition(3), COLUMNS, "doc_id", "lang", {"n_chars": F.col("n_chars") + 1}, changed, **kw)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def some(rng, n):
    langs = ["en"] * 6 + ["de", "é", "", None]
    return [(i, rng.choice(["a", None]), rng.choice(langs), rng.choice([None, i]), rng.choice(["", None, "é x" * 9, "y" * 50_000])) for i in range(n)]


@pytest.mark.parametrize("fanout, block, n", [(2, 4096, 300), (2, 8, 300), (3, 10, 200), (2, 4, 7), (2, 2, 40)])
def test_against_a_plain_tree(spark, fanout, block, n):
    rng = random.Random(n + block)
    rows = some(rng, n)
    rng.shuffle(rows)
    assert run(spark, rows, fanout=fanout, block=block) == plain(rows, fanout)


def test_odd_rows(spark):
    """A lone row, null and repeated ids, equal rows, an empty table."""
    assert run(spark, [(5, None, None, None, None)]) == plain([(5, None, None, None, None)], 2)
    rows = [(1, "s", "en", 3, "abc")] * 30 + [(None, "s", "en", 3, "abc")] * 3 + [(1, "s", "en", 3, "abd"), (None, None, None, None, None)]
    assert run(spark, rows, block=4) == plain(rows, 2)
    assert run(spark, []) == []


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 37}", i, "t") for i in range(100)]
    assert run(spark, rows, block=4) == plain(rows, 2)


def test_untampered(spark):
    df = spark.createDataFrame(some(random.Random(1), 50), DOC)
    out = merkle.manifest(df, COLUMNS, "doc_id", "lang")
    assert out.filter("not verified").count() == 0 and out.count() == 50
