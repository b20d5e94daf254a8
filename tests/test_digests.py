"""Order-free digests against multisets; files and pages written and read back."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldcast.operators import basic, images
from fieldcast.sources import readers, writers


def test_differing_keys_against_multisets(spark):
    rng = random.Random(6)
    one = lambda: (rng.choice([1, 2, 3, 4, None]), rng.choice([1, None, 5]), rng.choice(["x", None]))
    a = [one() for _ in range(200)]
    b = [r for r in a if r[0] != 3] + [(3, 1, "x")] + [one() for _ in range(3)]
    rng.shuffle(b)
    schema = "k int, v int, t string"
    x, y = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).select("t", "v", "k")
    by = {k: (Counter(r for r in a if r[0] == k), Counter(r for r in b if r[0] == k)) for k in {r[0] for r in a + b}}
    want = {k for k, (p, q) in by.items() if p != q}
    assert {r["k"] for r in basic.differing_keys(x, y, ["k"]).collect()} == want and 3 in want
    rows = Counter(map(tuple, basic.mismatches(x, y, ["k"]).collect()))
    assert rows == Counter(a) - Counter(b) == Counter(map(tuple, basic.mismatches(x, y).collect()))
    assert basic.table_digest(x).first() == basic.table_digest(x.select("t", "k", "v").orderBy("v")).first()


def test_nulls_change_the_digest(spark):
    a, b = spark.createDataFrame([(1, None)], "a int, b int"), spark.createDataFrame([(None, 1)], "a int, b int")
    assert basic.table_digest(a).first()["digest"] != basic.table_digest(b).first()["digest"]


def test_publishing_compares_what_was_written(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "id % 3 AS x")
    root = str(tmp_path / "p")
    writers.publish_if(df, None, root, source=df)
    with pytest.raises(writers.Refused):
        writers.publish_if(df.withColumn("x", F.when(F.col("id") == 7, 9).otherwise(F.col("x"))), None, root, source=df)
    assert writers.published(spark, root).filter("x = 9").count() == 0


def test_files_and_pages(spark, tmp_path):
    rows = [("a/1.bin", b"\x00\xff"), ("a/2.bin", b""), ("b.bin", b"\x00\xff"), ("c.bin", None)]
    df = spark.createDataFrame([(n, c and bytearray(c)) for n, c in rows], "name string, content binary")
    for _ in range(2):  # again: the same files
        writers.write_files(df, str(tmp_path / "f"))
    listing = images.read_files(spark, str(tmp_path / "f"))
    assert sorted(r["length"] for r in listing.collect()) == [2, 2]  # Spark leaves empty files out
    assert [(r["copies"], r["path"][-5:]) for r in images.distinct_files(listing).collect()] == [(2, "1.bin")]
    pages = [("1", "<p>a\nb</p>\r\n"), ("2", None), ("3", ""), ("3", "\x1e é")]
    writers.write_pages(spark.createDataFrame(pages, "url string, html string").coalesce(2), str(tmp_path / "w"))
    assert sorted(map(tuple, readers.read_page_lines(spark, str(tmp_path / "w")).collect()), key=str) == sorted(pages, key=str)
