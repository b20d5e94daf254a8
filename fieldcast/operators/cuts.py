"""Tables written where lineage is cut, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_made: list[str] = []


def shared_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``.

    In a local process without that setting a temporary folder takes its place and goes with
    the process; on a cluster without it this is an error.
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


def written(df: DataFrame) -> DataFrame:
    """``df`` from files: what several steps read is made once, and outlives its executors.

    A table that this function returned is given back as it is, so steps may each ask for it.
    """
    if getattr(df, "cut_path", None):
        return df
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete the files of written tables that nothing will read again."""
    for cut in cuts:
        _delete(cut.sparkSession, cut.cut_path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process wrote here; lazy results still read it, so call it last."""
    for path in list(_made):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)
