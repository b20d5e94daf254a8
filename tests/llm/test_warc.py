"""Archives: overwriting, records of every type, foreign headers, ties and many shared digests."""

import gzip

import pytest

from fieldcast.llm import warc

SCHEMA = "page_id long, url string, html string"


def record(kind, block, media="", extra=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Length: {len(block)}", *([f"Content-Type: {media}"] if media else []), *extra]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_payloads_of_every_type(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nthe page"
    made = [
        record("warcinfo", b"software: x\r\n\r\nno body", "application/warc-fields"),
        record("request", b"POST / HTTP/1.1\r\nHost: a\r\n\r\nq=1", "application/http;msgtype=request"),
        record("response", http, "application/http; msgtype=response"),
        record("response", b"raw \r\n\r\n dns", "text/dns"),
        record("resource", b"HTTP/ not a message", "text/plain"),
        record("conversion", b"text of it\r\n\r\nmore", "text/plain"),
        record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "application/http;msgtype=response"),
        record("response", b"HTTP/1.1 200 OK\r\nnever ends", "application/http"),
        record("metadata", b""),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in made))
    (tmp_path / ".hidden.warc").write_bytes(b"junk")
    want = [("warcinfo", b"software: x\r\n\r\nno body"), ("request", b"q=1"), ("response", b"the page"), ("response", b"raw \r\n\r\n dns"), ("resource", b"HTTP/ not a message"), ("conversion", b"text of it\r\n\r\nmore"), ("revisit", None), ("response", b"HTTP/1.1 200 OK\r\nnever ends"), ("metadata", b"")]
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    key = lambda p: (p[0], p[1] or b"")
    got = [(r["record_type"], None if r["payload"] is None else bytes(r["payload"]), r["payload_length"]) for r in df.collect()]
    assert sorted(got, key=key) == sorted([(k, p, None if p is None else len(p)) for k, p in want] * 2, key=key)
    # lengths without payloads, and neither of the two
    lengths = spark.read.format("warc").schema("record_type string, payload_length long").load(str(tmp_path))
    assert sorted((r[0], r[1] or 0) for r in lengths.collect()) == sorted((k, len(p or b"")) for k, p in want * 2)
    assert spark.read.format("warc").schema("record_type string").load(str(tmp_path)).filter("record_type in ('request', 'revisit')").count() == 4


def test_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.register(spark)
    page = lambda i: warc.to_records(spark.createDataFrame([(i, "u", f"page {i}")], SCHEMA))
    held = lambda: sorted(bytes(r["payload"]).decode() for r in spark.read.format("warc").load(path).collect())
    page(1).write.format("warc").mode("append").save(path)
    page(2).write.format("warc").mode("append").save(path)
    assert held() == ["page 1", "page 2"]
    page(3).write.format("warc").mode("overwrite").save(path)
    assert held() == ["page 3"]
    page(4).filter("false").write.format("warc").mode("overwrite").save(path)
    assert held() == []


def test_other_types_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = [("<a>", "resource", "u", None, None, None, bytearray(b"HTTP/1.1 is no head\r\n\r\nhere")), ("<b>", "metadata", None, None, None, None, None)]
    spark.createDataFrame(rows, warc.SCHEMA).write.format("warc").mode("append").save(str(tmp_path / "w"))
    got = {r["record_id"]: bytes(r["payload"]) for r in spark.read.format("warc").load(str(tmp_path / "w")).collect()}
    assert got == {"<a>": b"HTTP/1.1 is no head\r\n\r\nhere", "<b>": b""}


@pytest.mark.parametrize("small", [0, 500_000])
def test_ties_repeated_rows_and_other_columns(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(warc, "_SMALL", small)
    rows = [(5, "a", "x"), (5, "b", "x"), (3, "c", "x"), (None, "d", "x"), (None, "e", "y"), (7, "f", "z" * 3_000_000), (7, "f", "z" * 3_000_000), (8, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS hex", "3 AS payload", "4 AS keeper", "5 AS length")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(df, str(tmp_path / "w")).collect())
    big = (7, "response", None, 3_000_000)
    assert got == [(0, "response", None, 1), (0, "revisit", 5, 1), (3, "revisit", 5, 1), (5, "response", None, 1), (5, "response", None, 1), big, big, (8, "response", None, 0)]


def test_broken_archives(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("response", b"0123456789", "text/plain")[:-9])
    warc.register(spark)
    with pytest.raises(Exception, match="ends inside a record"):
        spark.read.format("warc").load(str(tmp_path)).collect()
