"""Near copies of texts: 5-word Jaccard similarity of 0.8 or more, confirmed exactly.

Rows are told apart by where they lie (file and row), so ids may be null or repeated and the
texts themselves travel twice only: those of candidates to be confirmed, and all once when the
copies are taken out. Each text leaves a sketch where it lies: its SimHash, hashed bands of
minima over the same shingles, and one byte of each minimum.

Candidates are the links of the SimHash trie join (``TRIE_BITS`` or fewer, which is all it can
select by), and, since at a similarity of 0.8 two SimHashes differ in about ten bits, texts
that share a band: a pair at 0.8 does with a chance of 99.6 %. Candidates whose sketches agree
in too few minima go; the others are confirmed by the two whole sets of shingles.

Groups with an equal band are compared in full if small. In a large one all are first compared
with one member, another for each band; what is then not in the group's largest component is
compared with every member outside its own component, in blocks that hold the texts: first
sketch by sketch, then, where sketches agree, set by set, so only links leave a task, one for
each component that they join. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, materialize, release
from .simhash import majority_bits, near_forest, shingle_hashes
from .vectors import whole_groups

WIDTH, LEAST = 5, 0.8
BANDS, MINIMA = 14, 5
#: Bits of 64 by which the trie join's links may differ.
TRIE_BITS = 3
#: Equal minima of 70 below which a pair is no candidate: at 0.8 they are 56 with a deviation
#: of 3.3, so 99.9 % of such pairs have more.
AGREE = 45
_SMALL = 32
_BLOCK = 256
_CHUNK = 100_000
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 63, BANDS * MINIMA, np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's 5-word shingles, sorted."""
    parts = [np.array(h, np.uint64) for h in shingle_hashes(text, WIDTH)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def _minima(every: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``BANDS`` hashes for each non-empty set in ``every``, and a byte of each minimum."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    low = np.zeros((len(starts), BANDS * MINIMA), np.uint8)
    for k in range(BANDS * MINIMA):
        h = (every ^ _XOR[k]) * _ODD[k]
        h ^= h >> np.uint64(32)
        least = np.minimum.reduceat(h, starts)
        low[:, k] = (least * _PRIME >> np.uint64(56)).astype(np.uint8)
        band = k // MINIMA
        mixed = (out[:, band] ^ least) * _PRIME + np.uint64(band)
        out[:, band] = mixed ^ (mixed >> np.uint64(29))
    return out, low


SKETCH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("minima", T.BinaryType())])


def sketches(texts: DataFrame) -> DataFrame:
    """``texts`` with ``fp`` (SimHash), ``bands`` and ``minima`` in place of its last column, the
    text in UTF-8; null for wordless texts."""
    fields = texts.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, names = batch.columns[-1], [*(f.name for f in fields), *SKETCH.names]
            at = 0
            while at < batch.num_rows:
                held, first, total = [], at, 0
                while at < batch.num_rows and total < _CHUNK:
                    held.append(shingle_set(column[at].as_py()))
                    total += len(held[-1])
                    at += 1
                size = np.array([len(s) for s in held])
                full = np.flatnonzero(size)
                fp, bands, low = np.zeros(len(held), np.int64), np.zeros((len(held), BANDS), np.int64), np.zeros((len(held), BANDS * MINIMA), np.uint8)
                if len(full):
                    every, sizes = np.concatenate([held[i] for i in full]), size[full]
                    starts = np.cumsum(sizes) - sizes
                    got, low[full] = _minima(every, starts)
                    bands[full], fp[full] = got.view(np.int64), majority_bits(every, starts, sizes).view(np.int64)
                none = size == 0
                lists = [None if x else row for x, row in zip(none, bands)]
                made = [pa.array(fp, mask=none), pa.array(lists, pa.list_(pa.int64())), pa.array([None if x else row.tobytes() for x, row in zip(none, low)], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, at - first) for c in batch.columns[:-1]), *made], names=names)

    return texts.mapInArrow(run, T.StructType([*fields, *SKETCH.fields]))


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a``, ``b``, ``agree`` of the distinct pairs of different nodes with ``AGREE`` equal minima or more."""
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), F.col("minima").alias(f"m{s}")), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("ma", "mb"))
            agree = (x == y).sum(1)
            near = pa.array(agree >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(agree.astype(np.int32)).filter(near)], names=["a", "b", "agree"])

    return pairs.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long, agree int")


def confirm(pairs: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose texts (``node``, ``text`` in UTF-8) are similar to ``least`` or more."""
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lru_cache(maxsize=64)(shingle_set)
        for batch in batches:
            near = [jaccard(made(x.as_py()), made(y.as_py())) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are not in one component yet."""
    columns = pairs.columns
    for s in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")), s, "left")
    return pairs.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*columns)


class _Links:
    """Confirmed links, and the components that they make."""

    def __init__(self, texts: DataFrame, least: float):
        self.texts, self.least = texts, least
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def add(self, left: DataFrame, turns: int) -> None:
        """Confirm candidates (``a``, ``b``, ``agree``): for ``turns`` turns one partner for each
        text, which settles most components; then all that are still between two."""
        for turn in range(turns + 1):
            left = materialize(left if self.labels is None else _apart(left, self.labels))
            if not left.take(1):
                return
            ask = left
            if turn < turns:
                both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
                best = both.groupBy("a").agg(F.max_by("b", F.struct("agree", F.xxhash64("a", "b"))).alias("b"))
                ask = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            ask = materialize(ask.select("a", "b"))
            self.include(materialize(confirm(ask, self.texts, self.least)))
            left = left.join(ask, ["a", "b"], "left_anti")

    def include(self, found: DataFrame) -> None:
        """Take confirmed links in, and find the components anew."""
        self.links = found if self.links is None else self.links.unionByName(found)
        self.labels = materialize(connected_components(self.links))


def _outsiders(many: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float) -> DataFrame:
    """Confirmed links (``a``, ``b``) of large groups (``band``, ``node``) between a text that is
    not in its group's largest component and one in another component.

    A group is cut into blocks of its members; those outside the largest component go to each
    of its blocks, in blocks of their own. The texts travel with them: a pair whose sketches
    agree and which no link of the block joins yet is confirmed there, so that a task sends no
    more links than its blocks have components, however many pairs are nearly similar.
    """
    many = many.join(nodes.select("node", "minima"), "node")
    if labels is not None:
        many = many.join(labels, "node", "left")
    many = materialize(many.select("band", "node", "minima", F.coalesce("component", "node").alias("comp") if labels is not None else F.col("node").alias("comp")))
    main = many.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.ceil(F.sum("n") / _BLOCK).alias("blocks"))
    rows = materialize(many.join(materialize(main), "band").withColumn("h", F.xxhash64("node", F.lit(3))).withColumn("outside", F.col("comp") != F.col("main")))
    out_blocks = rows.filter("outside").groupBy("band").agg(F.ceil(F.count("*") / _BLOCK).alias("others"))
    rows = rows.join(materialize(out_blocks), "band")  # groups with outsiders only
    block, other = F.pmod("h", "blocks"), F.pmod(F.shiftright("h", 20), F.col("others"))
    inside = rows.select("band", block.alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("y"), F.lit(0).alias("side"), "node", "comp", "minima")
    outside = rows.filter("outside").select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("x"), other.alias("y"), F.lit(1).alias("side"), "node", "comp", "minima")
    units = inside.unionByName(outside).select(F.xxhash64("band", "x", "y").alias("unit"), "side", "node", "comp", "minima").join(texts, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit", 1):  # one unit at a time: it holds texts
            unit, side, node, comp = (table.column(c).to_numpy() for c in ("unit", "side", "node", "comp"))
            low = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8).reshape(len(unit), -1)
            text = table.column("text")
            edge = np.append(np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])), len(unit))
            for lo, hi in zip(edge, edge[1:]):
                mid = lo + int(np.searchsorted(side[lo:hi], 1))
                of = comp[lo:hi].copy()  # grows together as links are found
                made = lru_cache(maxsize=None)(lambda i: shingle_set(text[int(i)].as_py()))
                links = []
                for k in range(mid, hi):
                    agree = (low[lo:mid] == low[k]).sum(1)
                    # the likeliest first: one link makes the others of its component needless
                    for i in np.argsort(-agree, kind="stable"):
                        if agree[i] < AGREE:
                            break
                        if of[i] != of[k - lo] and jaccard(made(lo + i), made(k)) >= least:
                            links.append((node[lo + i], node[k]))
                            of[of == of[i]] = of[k - lo]
                if links:
                    ends = np.array(links)
                    yield pa.RecordBatch.from_arrays([pa.array(ends.min(1)), pa.array(ends.max(1))], names=["a", "b"])

    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = units.select("unit", "side", "node", "comp", "minima", "text")
    return units.repartition(parts, "unit").sortWithinPartitions("unit", "side", "node").mapInArrow(run, "a long, b long").distinct()


def near_components(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """``node``, ``component`` of the texts that are near another; others have no row.

    ``nodes``: node (long, distinct) and the sketch's columns. ``texts_of`` gives ``node``,
    ``text`` (UTF-8) of a table of nodes. Components are those of all pairs found, each of
    a similarity of ``least`` or more; every link on which one rests is confirmed, pairs
    already in one component are not compared again.
    """
    nodes = nodes.filter("bands is not null")
    # by the trie: equal SimHashes meet at their first node, near ones at that of the other
    first = nodes.groupBy("fp").agg(F.min("node").alias("y"))
    same = nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("y").alias("b"))
    trie = near_forest(nodes.select("fp"), TRIE_BITS).join(first.select(F.col("fp").alias("a"), F.col("y").alias("x")), "a").join(first.select(F.col("fp").alias("b"), "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    held = nodes.select("node", F.explode("bands").alias("band"))
    size = held.groupBy("band").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "band")).alias("y")).filter("n > 1")
    held = materialize(held.join(materialize(size), "band"))
    few = held.filter(F.col("n") <= _SMALL).groupBy("band").agg(F.collect_list("node").alias("s"))
    few = few.select("s", F.posexplode("s").alias("i", "a")).select("a", F.explode(F.slice("s", F.col("i") + 2, F.lit(_SMALL))).alias("b"))
    many = held.filter(F.col("n") > _SMALL)
    pairs = same.unionByName(trie).unionByName(few).unionByName(many.select(F.col("node").alias("a"), F.col("y").alias("b")))
    pairs = materialize(_agreeing(pairs, nodes))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct()
    texts = materialize(texts_of(asked))
    links = _Links(texts, least)
    links.add(pairs, 1)
    if many.take(1):
        links.include(materialize(_outsiders(many.select("band", "node"), nodes, texts, links.labels, least)))
    release(texts, held)
    return links.labels if links.labels is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def located(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), ``file`` and ``at`` (the row's number in it) of every row.

    Rows that come from no files are written first.
    """

    def place(df: DataFrame) -> DataFrame:
        own = df.metadataColumn("_metadata")
        return df.select(F.struct("*").alias("row"), own["file_path"].alias("file"), own["row_index"].alias("at"))

    try:
        return place(docs)
    except AnalysisException:
        return place(materialize(docs))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that links make, one row stays.

    That is the row with the smallest id, null last, then with the smallest other columns.
    Equal texts, null and empty ones too, are one group each; texts without a word are near no
    other. Rows are told apart by where they lie, so a null or repeated id never takes a
    different text out, and of rows repeated whole one stays. Columns may have any name; an
    empty table gives an empty result; texts of any length are compared whole.
    """
    rows = located(docs)
    item = lambda c: F.col("row").getField(c)
    rest = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and not isinstance(f.dataType, T.MapType | T.VariantType)]
    rank = F.struct(item(id_col).isNull().alias("none"), item(id_col).alias("id"), *[item(c).alias(f"c{i}") for i, c in enumerate(rest)])
    text = item(text_col).cast("binary")
    made = sketches(rows.select(F.coalesce(F.md5(text), F.lit("")).alias("key"), rank.alias("rank"), "file", "at", text.alias("text")))
    first = materialize(made).groupBy("key").agg(F.min(F.struct("rank", "file", "at", *SKETCH.names)).alias("x"))
    first = materialize(first.select("key", F.xxhash64("key").alias("node"), "x.*"))

    def texts_of(nodes: DataFrame) -> DataFrame:
        # candidates grow with the corpus: join by sorting at every size
        places = first.select("node", "file", "at").join(nodes, "node")
        return rows.select("file", "at", item(text_col).cast("binary").alias("text")).join(places.hint("merge"), ["file", "at"]).select("node", "text")

    labels = materialize(near_components(first.select("node", *SKETCH.names), texts_of, least))
    linked = first.select("key", "node", F.struct("rank", "key").alias("order")).join(labels, "node")
    best = linked.groupBy("component").agg(F.min("order").alias("order")).select("order.key")
    gone = materialize(linked.select("key").join(best, "key", "left_anti"))
    kept = first.select("key", "file", "at").join(gone, "key", "left_anti").select("file", "at")
    return rows.join(materialize(kept).hint("merge"), ["file", "at"], "left_semi").select("row.*")
