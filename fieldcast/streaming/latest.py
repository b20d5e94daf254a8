"""Keeping the newest row of each key while batches arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import best_row

#: Parts of a table by its keys' hash; a batch rewrites those that it touches.
BUCKETS = 64


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """The newest path of each bucket: ``BUCKETS`` rows at most."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    newest = spark.read.parquet(f"{root}/current").groupBy("bucket").agg(F.max_by("path", "at").alias("path"))
    return {r["bucket"]: r["path"] for r in newest.collect()}


def latest(spark: SparkSession, root: str, buckets: set[int] | None = None) -> DataFrame | None:
    """The table as last published, or those buckets of it; null if there is none yet."""
    paths = [f"{p}/_bucket={b}" for b, p in _pointers(spark, root).items() if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def keep_latest(spark: SparkSession, root: str, keys: list[str], order: Callable[[], list[Column]], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merge each batch with the published table and keep the
    first row of each key by ``order``.

    Only the buckets that the batch touches are read and written anew; one pointer file then
    shows them all at once. A batch that comes again changes nothing, and one that fails leaves
    what was published.
    """
    root = root.rstrip("/")

    def merge(batch: DataFrame, _batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        if not touched:
            return
        old = latest(spark, root, touched)
        rows = best_row(batch if old is None else old.select(batch.columns).unionByName(batch), keys, order())
        path = f"{root}/v-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
        pointer = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(touched)))).alias("bucket"), F.lit(path).alias("path"), F.current_timestamp().alias("at"))
        pointer.coalesce(1).write.mode("append").parquet(f"{root}/current")

    return merge
