"""URL rules by a sort-merge range join of reversed-host keys.

A host's labels are turned round (``www.example.com`` -> ``com.example.www.``), so a host and
all its subdomains are the keys that start with one prefix: an interval. Sorted by key, with
rules before the URLs of the same key, intervals nest like brackets: a sweep keeps a stack of
the rules that are open, and the URL at hand fits those on the stack whose path begins its own.

URLs are cut into ranges of (key, salt) by the keys of a small sample (it decides where the
cuts lie, not what is judged), as a range sort does; a host with a third of all URLs spans
many ranges, and so does one page's row that comes in many partitions (the salt holds the
partition, which is the same when a task runs again). A rule goes to the ranges that its interval meets,
so no rule table is sent to everyone, however many rules there are.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_SAMPLE_PER_RANGE = 20


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))).otherwise("")
    cut = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 0)
    return _ascii_lower(F.regexp_extract(cut, r"^[^/]*", 0)), F.regexp_extract(cut, r"^[^/]*(.*)$", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each with a dot; hosts without a name get ``.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The longest fitting rule and its verdict, one row per row of ``pages``.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the URL's
    path starts with the rule's; the longest (host and path together, then host) wins; of
    equal rules with different verdicts, block. URLs that no rule fits get ``default`` and a
    null rule; so do null URLs and such without ``://``, whose host and path are empty.
    Rules with a null or empty host, or a null path or verdict, fit nothing. Repeated rows
    come back as often as given; other columns are not read; empty tables are fine.
    """
    spark = pages.sparkSession
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("_url"))
    host, path = url_parts(F.col("_url"))
    urls = urls.select("id", host.alias("host"), path.alias("path"), F.xxhash64("id", "_url", F.spark_partition_id()).alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    usable = rules.filter("host <> '' and path is not null and verdict is not null")
    usable = usable.groupBy(_ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    usable = usable.withColumn("key", host_key(F.col("host")))

    share = min(1.0, _SAMPLE_PER_RANGE * ranges / max(pages.count(), 1))  # so many rows are expected, whatever the table's size
    sample = urls.select("key", "salt").sample(share, seed=7).collect()
    points = sorted((r["key"], r["salt"]) for r in sample)
    bounds = sorted(set(points[_SAMPLE_PER_RANGE // 2 :: _SAMPLE_PER_RANGE]))

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(bounds, x) for x in zip(key, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_met(key: pd.Series) -> pd.Series:
        # the interval's keys start with ``key``; U+10FFFF sorts after all that may follow
        low = [bisect.bisect_right(bounds, (k, -(1 << 63))) for k in key]
        high = [bisect.bisect_right(bounds, (k + "\U0010ffff", 0)) for k in key]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(low, high)])

    text = F.lit(None).cast("string")
    left = urls.select(range_of("key", "salt").alias("range"), "key", F.lit(1).alias("kind"), "id", "host", "path", text.alias("verdict"))
    right = usable.select(F.explode(ranges_met("key")).alias("range"), "key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema[id_col].dataType).alias("id"), "host", "path", "verdict")
    both = left.unionByName(right).repartitionByRange(ranges, "range").sortWithinPartitions("range", "key", "kind", "path", "id")
    kind = pages.schema[id_col].dataType.simpleString()

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_rules = None, []  # (key, [(path, length, rule, verdict), ...]) from the outermost in
        for frame in frames:
            rule, verdict = [], []
            for rng, key, is_url, host, path, v in zip(frame["range"], frame["key"], frame["kind"], frame["host"], frame["path"], frame["verdict"]):
                if rng != at:
                    at, open_rules = rng, []
                while open_rules and not key.startswith(open_rules[-1][0]):
                    open_rules.pop()
                if not is_url:
                    if not open_rules or open_rules[-1][0] != key:
                        open_rules.append((key, []))
                    open_rules[-1][1].append((path, host + path, v))
                    continue
                fit = [(len(name), len(k), name, v) for k, own in open_rules for p, name, v in own if path.startswith(p)]
                best = max(fit, default=(0, 0, None, default))
                rule.append(best[2])
                verdict.append(best[3])
            out = frame.loc[frame["kind"] == 1, ["id", "host", "path"]]
            yield out.assign(rule=pd.Series(rule, index=out.index, dtype=object), verdict=pd.Series(verdict, index=out.index, dtype=object))

    judged = both.mapInPandas(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
