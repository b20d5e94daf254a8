"""Image files by their contents, samples of polygons in images, and an image's main colour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import classify_rgb
from ..functions.geo import clip_polygon, frame_status, polygon_area, spacing
from .voting import majority_vote

SAMPLES = 240
#: All polygons of all image sizes travel with each task; more of them than this stop the job.
MAX_POLYGONS = 20_000
#: Image sizes that polygons are clipped for; an archive has a few.
MAX_SIZES = 1000
#: A polygon with fewer sample points gets more, up to the second, in so many tries.
FEW_POINTS, MORE_POINTS, TRIES = 20, 30, 3000

PARTS = "array<array<array<struct<x:double,y:double>>>>"


def _plain(path: Column) -> Column:
    """A path as both readers write it."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with the digest of their bytes: path, name, length, digest (lower-case SHA-256).

    Spark leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(_plain(F.col("path")).alias("path"), F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length", F.sha2("content", 256).alias("digest"))


def distinct_files(listing: DataFrame) -> DataFrame:
    """One file of each content, the smallest path, with the number of its ``copies``."""
    return listing.groupBy("length", "digest").agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def read_images(spark: SparkSession, path: str, listing: DataFrame) -> DataFrame:
    """Decoded images of a folder, one for each content of ``listing``: digest, copies, path,
    width, height, channels, data (BGR bytes); undecodable ones have width -1."""
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    decoded = decoded.select(_plain(F.col("image.origin")).alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")
    return decoded.join(distinct_files(listing), "path").select("digest", "copies", "path", "width", "height", "channels", "data")


def polygon_frames(polygons: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every polygon in every image size: its status, clipped area, bounds and sample spacing.

    ``polygons``: poly, ``parts`` (parts > rings > points, in the pixels of a frame of
    ``frame_w`` by ``frame_h``); ``sizes``: width, height. Sizes are few; polygons are scaled
    and clipped once for each.
    """
    sizes = sizes.filter("width > 0").select("width", "height").distinct()
    if sizes.limit(MAX_SIZES + 1).count() > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} image sizes")
    df = polygons.select("poly", "parts", "frame_w", "frame_h").join(F.broadcast(sizes))
    sx, sy = F.col("width") / F.col("frame_w"), F.col("height") / F.col("frame_h")
    scaled = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))))
    df = df.withColumn("parts", scaled).withColumn("_clipped", clip_polygon(F.col("parts"), F.col("width"), F.col("height")))
    df = df.withColumn("area", F.coalesce(polygon_area(F.col("_clipped")), F.lit(0.0))).withColumn("_points", F.flatten(F.flatten("_clipped")))
    bound = {n: f(F.col("_points").getField(n[1])) for n, f in (("lx", F.array_min), ("ly", F.array_min), ("hx", F.array_max), ("hy", F.array_max))}
    df = df.withColumns({"status": frame_status(F.col("parts"), F.col("area")), **bound})
    return df.drop("_clipped", "_points", "frame_w", "frame_h")


class _Shape:
    """A polygon's edges, and which of given points lie inside."""

    def __init__(self, parts: list):
        rings = [np.array([(p["x"], p["y"]) for p in ring], float) for part in parts for ring in part if len(ring)]
        ends = [np.roll(r, -1, axis=0) for r in rings]
        self.x1, self.y1 = np.concatenate(rings).T
        self.x2, self.y2 = np.concatenate(ends).T

    def crossings(self, y: float) -> np.ndarray:
        """Sorted places at which the scan line crosses the edges."""
        span = (self.y1 > y) != (self.y2 > y)
        x1, y1, x2, y2 = self.x1[span], self.y1[span], self.x2[span], self.y2[span]
        return np.sort((x2 - x1) * (y - y1) / (y2 - y1) + x1)

    def inside(self, x: np.ndarray, y: float) -> np.ndarray:
        found = self.crossings(y)
        return (len(found) - np.searchsorted(found, x, side="right")) % 2 == 1

    def points(self, lx: float, ly: float, hx: float, hy: float, step: float, off: float, enough: int, few: int) -> np.ndarray:
        """A grid's points inside, line by line; one in the widest span at middle height; more
        from a low-discrepancy sequence if these are few."""
        xs = np.arange(lx + off * step, hx + 1e-9, step)
        lines = [(xs[self.inside(xs, y)], y) for y in np.arange(ly + off * step, hy + 1e-9, step)]
        out = [(x, y) for some, y in lines for x in some]
        middle = (ly + hy) / 2
        cuts = np.clip(self.crossings(middle), lx, hx)
        if len(cuts) >= 2:
            k = int(np.argmax(cuts[1::2] - cuts[::2]))
            out.append(((cuts[2 * k] + cuts[2 * k + 1]) / 2, middle))
        for i in range(1, TRIES + 1) if len(out) < few else ():
            if len(out) >= enough:
                break
            x, y = lx + (i * 0.7548776662466927 % 1) * (hx - lx), ly + (i * 0.5698402909980532 % 1) * (hy - ly)
            if self.inside(np.array([x]), y)[0]:
                out.append((x, y))
        return np.rint(np.array(out, float).reshape(-1, 2)).astype(int)


def sample_polygons(images: DataFrame, frames: DataFrame, key: str = "digest", target: int = SAMPLES, min_valid: int = 12) -> DataFrame:
    """Pixels at a grid inside each polygon, counted: ``key``, poly, r, g, b, n.

    ``frames``: of ``polygon_frames``; those with status ok are sampled. The grid's spacing
    follows the clipped area for about ``target`` points; its offset comes from the polygon's
    place by name, so a run gives the same points again. A size's points are found once in a
    task, by scan lines, and kept; an image then gives up its pixels at all of them at once, and
    leaves the task as one row for each polygon and pixel value. The polygons of all markets
    (some hundred, ``MAX_POLYGONS`` at most) travel with the task.
    """
    held = frames.filter("status = 'ok'").select("width", "height", "poly", "parts", "lx", "ly", "hx", "hy", spacing(F.col("area"), target).alias("step"))
    found = held.limit(MAX_POLYGONS + 1).collect()
    if len(found) > MAX_POLYGONS:
        raise ValueError(f"more than {MAX_POLYGONS} polygons")
    by_size: dict[tuple[int, int], list] = {}
    for r in sorted(found, key=lambda r: r["poly"]):
        by_size.setdefault((r["width"], r["height"]), []).append(r)
    few, enough = max(FEW_POINTS, min_valid), max(MORE_POINTS, 2 * min_valid)

    def placed(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
        """Pixel numbers of a size's sample points, and the number of each one's polygon."""
        at, of = [np.zeros(0, int)], [np.zeros(0, int)]
        for k, r in enumerate(by_size.get((width, height), [])):
            p = _Shape(r["parts"]).points(r["lx"], r["ly"], r["hx"], r["hy"], r["step"], k * 0.6180339887 % 1, enough, few)
            p = p[(p[:, 0] >= 0) & (p[:, 0] < width) & (p[:, 1] >= 0) & (p[:, 1] < height)]
            at.append(p[:, 1] * width + p[:, 0])
            of.append(np.full(len(p), k))
        return np.concatenate(at), np.concatenate(of)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, width, height, channels, data in batch.itertuples(index=False):
                if width <= 0:
                    continue
                if (width, height) not in known:
                    known[width, height] = placed(width, height)
                at, of = known[width, height]
                pixels = np.frombuffer(data, np.uint8).reshape(width * height, channels)[at]
                pixels = pixels[:, :3] if channels >= 3 else np.repeat(pixels[:, :1], 3, axis=1)
                packed = ((of.astype(np.int64) << 8 | pixels[:, 2]) << 8 | pixels[:, 1]) << 8 | pixels[:, 0]
                value, n = np.unique(packed, return_counts=True)
                polys = [r["poly"] for r in by_size.get((width, height), [])]
                yield pd.DataFrame({"key": name, "poly": [polys[k] for k in value >> 24], "r": (value >> 16 & 255).astype(int), "g": (value >> 8 & 255).astype(int), "b": (value & 255).astype(int), "n": n})

    kind = frames.schema["poly"].dataType.simpleString()
    out = images.select(key, "width", "height", "channels", "data").mapInPandas(run, f"key string, poly {kind}, r int, g int, b int, n long")
    return out.withColumnRenamed("key", key)


def vote_polygons(samples: DataFrame, keys: tuple[str, ...] = ("digest", "poly")) -> DataFrame:
    """Majority colour of each polygon; uncoloured pixels count in the total only."""
    df = samples.withColumn("color", classify_rgb(F.col("r"), F.col("g"), F.col("b"))).withColumn("_ok", F.col("color").isNotNull())
    return majority_vote(df, list(keys), "color", "_ok", weight="n")


def dominant_color(images: DataFrame, key: str = "digest") -> DataFrame:
    """Most frequent colour of each image, without uncoloured and grey pixels.

    Distinct pixel values are counted per image before any row leaves the task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, width, height, channels, data in frame.itertuples(index=False):
                if width > 0:
                    p = np.frombuffer(data, np.uint8).reshape(-1, channels)[:, :3].astype(np.int64)
                    value, n = np.unique((p[:, -1] << 16) | (p[:, p.shape[1] // 2] << 8) | p[:, 0], return_counts=True)
                    yield pd.DataFrame({"key": name, "r": (value >> 16).astype(int), "g": (value >> 8 & 255).astype(int), "b": (value & 255).astype(int), "n": n})

    px = images.select(key, "width", "height", "channels", "data").mapInPandas(run, "key string, r int, g int, b int, n long")
    named = px.withColumn("color", classify_rgb(F.col("r"), F.col("g"), F.col("b"))).filter("color is not null and color <> 'grey'")
    counts = named.groupBy("key", "color").agg(F.sum("n").alias("n"))
    return counts.groupBy("key").agg(F.min_by("color", F.struct(-F.col("n"), F.col("color"))).alias("color")).withColumnRenamed("key", key)
