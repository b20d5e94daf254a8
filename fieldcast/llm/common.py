"""Pieces that several operators share: written cut points and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent and all runs in one local process, as in tests, a temporary
    folder takes its place and goes with the process. Executors of a cluster would each
    write to their own disk there, so without the setting a cluster's job stops here.
    """
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            _own_dir = tempfile.mkdtemp(prefix="fieldcast-")
            atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        base = _own_dir
    _made.append(f"{base.rstrip('/')}/fieldcast-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> None:
    """Delete the folders that this process wrote as cut points.

    Results that are still lazy read them: call it when the job's results are stored.
    """
    while _made:
        _delete(spark, _made.pop())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends at the files.

    A lost executor costs the tasks it ran, not the work before this point, and what is
    read twice is computed once.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path  # on the table itself: a registry would keep every plan alive
    return out


def release(*cuts: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nothing will read again."""
    for cut in cuts:
        _delete(cut.sparkSession, cut.cut_path)
        _made.remove(cut.cut_path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Label every node that has an edge with the smallest node reachable from it.

    Alternates two star steps: each node passes its smallest neighbour to its larger
    neighbours, then to its smaller ones. Both are one grouped minimum (partial
    aggregation) and one equi-join, so a hub's edges are never gathered in one group.
    Every round is written to the shared folder; only its two-number digest reaches the
    driver. Self-loops, repeated edges and null ends are ignored.

    Returns ``node``, ``component`` (``component <= node``).
    """
    kind = edges.schema[a].dataType
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    e = materialize(e.distinct())
    digest = _digest(e)
    for _ in range(max_rounds):
        if digest[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(last)
        before, digest = digest, _digest(e)
        if before == digest:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").cast(kind).alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _digest(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)
