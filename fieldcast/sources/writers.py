"""Writers with fixed fields, JSON payloads, and publishing behind a check."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.basic import table_digest
from ..operators.ordering import running_totals

#: Bytes of rows that fill a JSON document; a task holds whole ones.
DOCUMENT_BYTES = 1 << 20


class Refused(RuntimeError):
    """The check found something; the old output is as it was."""


def write_table(df: DataFrame, fields: list[str], path: str, partition_by: tuple[str, ...] = (), fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The given fields in their order; other columns are left out."""
    writer = df.select(*fields).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def _document(df: DataFrame, meta: dict) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in meta.items()], "rows")).alias("value"))


def json_payload(df: DataFrame, **meta) -> DataFrame:
    """One row, one compact JSON document: the meta fields and all rows under ``rows``.

    For results of bounded size only: the rows meet in one value.
    """
    return _document(df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows")), meta)


def json_payloads(df: DataFrame, document_bytes: int = DOCUMENT_BYTES, **meta) -> DataFrame:
    """Documents as of :func:`json_payload`, each with a run of the sorted rows: as many as the
    rows fill, one without rows if there are none.

    A row is in the document in which its text begins, so a document exceeds ``document_bytes``
    by one row and the meta fields at most.
    """
    row = F.struct(*df.columns)
    sized = df.withColumn("_bytes", F.octet_length(F.to_json(row)) + 1)  # a comma
    sized = running_totals(sized, [], [F.col(c) for c in df.columns], "_bytes", "_upto", "_all")
    rows = sized.select(F.floor((F.col("_upto") - F.col("_bytes")) / document_bytes).alias("_at"), row.alias("_row"))
    first = df.sparkSession.range(1).select(F.col("id").alias("_at"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    return _document(rows.unionByName(first).groupBy("_at").agg(F.array_sort(F.collect_list("_row")).alias("rows")), meta)


def write_json_payload(df: DataFrame, path: str, mode: str = "errorifexists", document_bytes: int = DOCUMENT_BYTES, **meta) -> None:
    """A file for each document of :func:`json_payloads`, so that ``read_nested_json`` reads all."""
    json_payloads(df, document_bytes, **meta).write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_files(df: DataFrame, path: str) -> None:
    """A file for each row (``name``, which may hold folders, and ``content``) below ``path``.

    Tasks write to any store that their file-system library opens. A file appears when it is
    whole, and a task that runs again puts the same one in its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = "://" not in path and not path.startswith("file:")
        store, root = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{root.rstrip('/')}/{name}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                part = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, at)
            yield batch.select([0])

    df.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def write_pages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Pages (``url``, ``html``) as JSON lines, many to a file: as many files as partitions."""
    df.select("url", "html").write.mode(mode).json(path)


def publish_if(df: DataFrame, mismatches: DataFrame | None, root: str, fields: list[str] | None = None, source: DataFrame | None = None) -> str:
    """Write ``df`` below ``root`` and point ``root/current`` to it, unless ``mismatches``
    has a row or ``df`` has none; then raise, and what was published stays.

    With ``source`` the written files must hold the same rows, told by one digest of each side.
    Readers take the newest pointer (:func:`published`). The new files are complete and compared
    before the pointer is written, so a lost job changes nothing.
    """
    if mismatches is not None and mismatches.take(1):
        raise Refused("the result does not reproduce its source")
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    fields = fields or df.columns
    write_table(df, fields, path)
    made = df.sparkSession.read.schema(df.select(*fields).schema).parquet(path)
    if not made.take(1):
        raise Refused("the result is empty")
    if source is not None and table_digest(made).first() != table_digest(source.select(*fields)).first():
        raise Refused("what was written is not its source")
    pointer = df.sparkSession.range(1).select(F.lit(path).alias("path"), F.current_timestamp().alias("at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/current")
    return path


def published(spark, root: str) -> DataFrame:
    """The table that was published last."""
    pointer = spark.read.parquet(f"{root.rstrip('/')}/current")
    return spark.read.parquet(pointer.agg(F.max_by("path", "at")).first()[0])
