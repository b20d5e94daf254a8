"""Picking one row of many captures: final revisions, latest weeks, good sources, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Which source wins between equal revisions.
SOURCE_RANK = {"live": 2, "wayback": 1}


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (end it in a unique column).

    The pick is a grouped minimum of one struct, so it is combined before the shuffle and no
    key's rows are sorted together. ``order`` holds sort values, smallest first.
    """
    columns = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select(*keys, "_row.*").select(df.columns)


def inverted(text: Column) -> Column:
    """A sort value that puts larger texts first: each UTF-8 byte's hex digits inverted."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def select_final(manifest: DataFrame, keys: list[str], revision: str, source: str, capture: str, size: str, ord_cols: list[str]) -> DataFrame:
    """Per key the largest (revision, source rank, capture text, size); the first row of a full tie."""
    rank = F.lit(0)
    for name, r in SOURCE_RANK.items():
        rank = F.when(F.col(source) == name, r).otherwise(rank)
    return best_row(manifest, keys, [-F.coalesce(F.col(revision), F.lit(0)), -rank, inverted(F.coalesce(F.col(capture).cast("string"), F.lit(""))), -F.coalesce(F.col(size), F.lit(0)), *[F.col(c) for c in ord_cols]])


def latest_per_key(df: DataFrame, key: str, week: str, ord_cols: list[str]) -> DataFrame:
    """Newest week of each key; of equal weeks the first row."""
    return best_row(df, [key], [-F.col(week), *[F.col(c) for c in ord_cols]])


def first_good_source(attempts: DataFrame, keys: list[str], found: str, priority: str) -> DataFrame:
    """Per key the first attempt by priority that found something, else the first of all,
    whose ``status`` is then failed."""
    good = F.coalesce(F.col(found) > 0, F.lit(False))
    picked = best_row(attempts, keys, [(~good).cast("int"), F.col(priority)])
    return picked.withColumn("status", F.when(good, "ok").otherwise("failed"))


def resolve_files(manifest: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a file to each manifest row (``keys``, unique; ``sha256``, ``local_name``, ``url_name``).

    ``listing``: ``path``, ``name``, ``digest``. The digest's match holds first, then the
    local name's, then the URL name's; of several files the smallest path. Null if none.
    """
    rules = [("sha256", "digest"), ("local_name", "name"), ("url_name", "name")]
    found = None
    for rank, (mine, theirs) in enumerate(rules):
        # of the files of one name or content the smallest is all that counts
        first = listing.groupBy(F.col(theirs).alias("_k")).agg(F.min("path").alias("path"))
        hit = manifest.select(*keys, F.col(mine).alias("_k")).filter("_k <> ''").join(first, "_k").select(*keys, F.lit(rank).alias("rule"), "path")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(*keys).agg(F.min(F.struct("rule", "path")).alias("_b")).select(*keys, "_b.rule", "_b.path")
    return manifest.join(best, keys, "left")


def missing_pages(maps: DataFrame, page_images: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``revision_mismatch``: the page shows images of this map, and none is the one
    that was classified (``map_name``)."""
    seen = maps.select(*keys, "map_name").distinct().join(page_images, keys).groupBy(*keys, "map_name").agg(F.bool_and(F.col("name") != F.col("map_name")).alias("revision_mismatch"))
    return maps.join(seen, [*keys, "map_name"], "left").withColumn("revision_mismatch", F.coalesce("revision_mismatch", F.lit(False)))
