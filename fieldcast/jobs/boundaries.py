"""TopoJSON to rings and centroids (C13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import stitch_ring
from ..operators.geometry import decode_deltas


def decode_topology(arcs: DataFrame, refs: DataFrame) -> DataFrame:
    """Rings as poly, name, part, ring, pos, x, y: arcs are summed up, turned round where
    the reference is negative, joined without their doubled ends, and closed.

    Arcs are told apart by ``file`` too where there is one, and carry their file's scale and
    translation.
    """
    keys = ["file"] if "file" in arcs.columns and "file" in refs.columns else []
    pts = decode_deltas(arcs, (1.0, 1.0), (0.0, 0.0), tuple(keys))
    at = lambda c, i: F.col(c) * F.get("scale", i) + F.get("translate", i)
    lines = pts.groupBy(*keys, "arc_id").agg(F.array_sort(F.collect_list(F.struct("pos", at("x", 0).alias("x"), at("y", 1).alias("y")))).alias("line"))
    lines = lines.withColumn("line", F.transform("line", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    used = refs.withColumn("arc_id", F.when(F.col("arc_idx") < 0, -F.col("arc_idx") - 1).otherwise(F.col("arc_idx")))
    used = used.join(lines, [*keys, "arc_id"]).withColumn("line", F.when(F.col("arc_idx") < 0, F.reverse("line")).otherwise(F.col("line")))
    rings = used.groupBy(*keys, "code", "name", "part", "ring").agg(stitch_ring(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda a: a["line"])).alias("r"))
    return rings.select(F.col("code").alias("poly"), "name", "part", "ring", F.posexplode("r").alias("pos", "p")).select("poly", "name", "part", "ring", "pos", "p.x", "p.y")


def centroids(rings: DataFrame, digits: int = 3) -> DataFrame:
    """Mean of the bounds of each polygon, rounded."""
    mid = lambda c: F.round((F.min(c) + F.max(c)) / 2, digits).alias(c)
    return rings.groupBy("poly").agg(mid("x"), mid("y"))
