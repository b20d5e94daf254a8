"""WARC archives as a Python data source, written and read.

``spark.read.format("warc").load(folder)`` plans one partition per archive file. Columns that
the declared schema leaves out are not made; filters on ``record_type`` and on header columns
are pushed down and tested on the parsed headers, and the body of a record that is not wanted,
or of which only headers are asked for, is skipped, not decoded.

``df.write.format("warc").mode("append").save(folder)`` writes gzip members, one per record,
into files of a bounded size. A task writes under a name of its own; the driver makes the
files of the tasks that succeeded visible by renaming, so a task that runs again leaves none
twice. With mode ``overwrite`` the archives that were there go when the new ones are visible.

The payload of a record whose block is an HTTP message is the message's body, of other
records the block; revisits have none.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialize, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"

#: The header that holds each column.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "payload_length": "X-Payload-Length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILE_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
_BLOCK = 1 << 20
_SMALL = 500_000


def open_store(url: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URL or a local path."""
    if urlsplit(url).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(url).path
    return fs.FileSystem.from_uri(url)


def base32(hexes: Column) -> Column:
    """Base32 of a SHA-1 in hex digits: ten of these are eight digits of base 32."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexes, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _clean(value: str) -> str:
    """Header values hold no line ends; percent-encode them as in a URI."""
    return value.replace("%0D", "%250D").replace("%0A", "%250A").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(row: dict) -> bytes:
    """One record, uncompressed: responses carry their payload after HTTP headers, records of
    other types as their block; revisits carry HTTP headers alone."""
    kind = row["record_type"]
    payload = row["payload"] if row["payload"] is not None else b""
    http = kind in ("response", "revisit")
    body, media = payload, "application/octet-stream"
    if http:
        head, media = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", "application/http;msgtype=response"
        body = head + (b"\r\n" if kind == "revisit" else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    lines = ["WARC/1.1", "WARC-Date: 1970-01-01T00:00:00Z", f"Content-Type: {media}"]
    lines += [f"{HEADERS[k]}: {_clean(str(row[k]))}" for k in HEADERS if row.get(k) is not None]
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        files: list[tuple[str, str]] = []
        sink, size = None, 0
        for batch in iterator:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.append((f"{folder}/.{name}.open", f"{folder}/{name}"))
                    sink, size = store.open_output_stream(files[-1][0], compression=None), 0
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = deflate.compress(record_bytes(row)) + deflate.flush()
                sink.write(data)
                size += len(data)
                if size >= _FILE_BYTES:
                    sink.close()
                    sink = None
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = open_store(self.path)
        store.create_dir(folder, recursive=True)
        old = archives_in(store, folder) if self.overwrite else []
        for m in messages:
            for a, b in m.files if m else []:
                store.move(a, b)
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            for a, _b in m.files if m else []:
                if store.get_file_info(a).is_file:
                    store.delete_file(a)


def archives_in(store: fs.FileSystem, folder: str) -> list[str]:
    """The archives below a folder; hidden files are none."""
    found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and not x.base_name.startswith((".", "_")) and x.path.endswith((".warc", ".warc.gz")))


@dataclass
class Archive(InputPartition):
    path: str


class _Source:
    """Decompressed bytes of an archive, gzip members or plain, read block by block."""

    def __init__(self, stream, name: str):
        self.stream, self.gz = stream, name.endswith(".gz")
        self.inflate, self.held, self.rest = None, bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.stream.read(_BLOCK)
        self.rest = b""
        if not data:
            return False
        if not self.gz:
            self.held += data
            return True
        self.inflate = self.inflate or zlib.decompressobj(31)
        self.held += self.inflate.decompress(data, _BLOCK)
        self.rest = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, None
        return True

    def head(self) -> bytes | None:
        """Up to the empty line that ends a header block; None at the end of the archive."""
        while True:
            while self.held[:2] == b"\r\n":
                del self.held[:2]
            at = self.held.find(b"\r\n\r\n")
            if at >= 0:
                out = bytes(self.held[:at])
                del self.held[: at + 4]
                return out
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return None

    def http_head(self, n: int) -> int:
        """Passes the HTTP headers at the start of a block of ``n`` bytes; their length."""
        at = -1
        while at < 0 and len(self.held) < n:
            at = self.held.find(b"\r\n\r\n", 0, n)
            if at < 0 and not self._more():
                raise ValueError("an archive ends inside a record")
        at = self.held.find(b"\r\n\r\n", 0, n) if at < 0 else at
        if at < 0 or not self.held.startswith(b"HTTP/") and not self.held[:at].split(b"\r\n")[0].rstrip().endswith((b"HTTP/1.0", b"HTTP/1.1")):
            return 0
        del self.held[: at + 4]
        return at + 4

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        while n:
            if not self.held and not self._more():
                raise ValueError("an archive ends inside a record")
            k = min(n, len(self.held))
            del self.held[:k]
            n -= k


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.names
        self.schema = schema
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo | In | IsNotNull | StringStartsWith) and column in HEADERS and column != "payload_length":
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Archive]:
        store, folder = open_store(self.path)
        return [Archive(x) for x in archives_in(store, folder)] or [Archive("")]

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            v = row[f.attribute[0]]
            if v is None or (isinstance(f, EqualTo | StringStartsWith) and not (v == f.value if isinstance(f, EqualTo) else v.startswith(f.value))) or (isinstance(f, In) and v not in f.value):
                return False
        return True

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        rows: list[dict] = []
        held = 0
        for row in self._records(partition.path):
            rows.append(row)
            held += 200 + len(row.get("payload") or b"")
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _records(self, path: str) -> Iterator[dict]:
        if not path:
            return
        store, _ = open_store(self.path)
        with store.open_input_stream(path, compression=None) as stream:
            source = _Source(stream, path)
            while (head := source.head()) is not None:
                lines = head.decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:40]!r}")
                got = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                size = int(got["content-length"])
                row = {k: got.get(h.lower()) for k, h in HEADERS.items()}
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] is not None else None
                row["payload"] = None
                wanted = self._wanted(row) and row["record_type"] != "revisit"
                if wanted and ("payload" in self.columns or ("payload_length" in self.columns and row["payload_length"] is None)):
                    size -= source.http_head(size) if got.get("content-type", "").lower().startswith("application/http") else 0
                    row["payload_length"] = size
                    if "payload" in self.columns:
                        row["payload"], size = source.take(size), 0
                source.skip(size)
                if self._wanted(row):
                    yield {k: row[k] for k in self.columns}


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make format ``warc`` known to the session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers import no user modules
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records for ``pages``, in the source's schema.

    Of rows with equal payloads of ``min_bytes`` or more, that with the largest id is the
    response, the others revisit it. Equal payloads meet as digests: the largest id of each
    shared digest is a grouped maximum. Up to ``_SMALL`` shared digests (some 60 MB) go to
    where the payloads lie, which then don't move; more are joined by sorting, which can be
    split where one payload is a third of all rows. A null html is an empty payload, a null
    url no header. Rows with a null id are responses, unless an equal payload with an id
    stands in for them; of repeated rows with the largest id each is a response. Other
    columns are not read; payloads of any length are whole; an empty table gives no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hex", F.sha1("payload")).withColumn("length", F.length("payload").cast("long"))
    shared = rows.groupBy("hex", "length").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") > 1)
    shared = materialize(shared.select("hex", "length", "keeper"))
    few = shared.limit(_SMALL + 1).count() <= _SMALL
    rows = rows.join(F.broadcast(shared) if few else shared, ["hex", "length"], "left")
    again = (F.col("length") >= min_bytes) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    uri = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))

    return rows.select(
        uri(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(again, uri(F.col("keeper"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), base32(F.col("hex"))).alias("payload_digest"),
        F.col("length").alias("payload_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_of(uri: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract({uri}, '^<urn:x-page:(.*)>$', 1), '') as bigint)")


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages``, then read the archives: the rows as they are there.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. For responses,
    bytes and digest are of the payload that was read; revisits hold none, so theirs come
    from the headers. A digest that differs from its header's stops the job.
    """
    spark = pages.sparkSession
    register(spark)
    folder = folder or shared_dir(spark)
    to_records(pages, min_bytes=min_bytes).write.format("warc").mode("append").save(folder)
    return read_records(spark, folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)

    got = spark.read.format("warc").load(folder)
    said = F.regexp_replace("payload_digest", "^sha1:", "")
    return got.select(
        page_of("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.when(F.col("payload").isNull() | (base32(F.sha1("payload")) == said), said).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: "), said))).alias("payload_digest"),
        "record_type",
        page_of("refers_to").alias("refers_to"),
    )
