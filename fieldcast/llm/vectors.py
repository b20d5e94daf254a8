"""Near-duplicate vectors by NN-descent.

Exact copies are folded first. A neighbour graph starts from sorted hyperplane codes (near
vectors share leading bits in some of several tables, more tables for more vectors) and is
refined by joins of neighbours of neighbours until it settles. The edges at the threshold are
the links.

A list that holds nothing but links is saturated: its vector may have more than the list
shows. The lists of its whole component are then enlarged to every link in it. Two angles to
two pivots put a member into a shell; by the triangle inequality links only join equal and
adjacent shells, so these alone are compared, in blocks, and counted where they are compared.

The recall is audited against brute force on hashed samples of all and of linked vectors; if
it is low, more tables are added and the graph is refined again; below ``FLOOR`` the job stops.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize

THRESHOLD = 0.98
#: Weaker neighbours lead nowhere and are not kept.
EXPLORE = 0.5
LIST = 12
TABLES = 8
#: So many of the isolated pairs the first tables should find.
START_RECALL = 0.98
ROUNDS = 8
_AHEAD = 6
_BITS = 40
_BLOCK = 256
_AUDIT, _AUDIT_MOST = 256, 1024
_SALTS, _SALTED_ROWS = 16, 50_000
MIN_RECALL, FLOOR = 0.97, 0.9

_log = logging.getLogger(__name__)


def usable(vector: Column) -> Column:
    """No null or non-finite component, and not zero (null for null)."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables cut where the sorted column ``key`` changes, of ``rows`` rows or a group more."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            k = table.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                n -= cut
    if n:
        yield pa.Table.from_batches(held)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Borders of the runs of equal keys, from 0 to the length."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def _edges(a: list, b: list, s: list) -> pa.RecordBatch:
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(cat(a, np.int64)), pa.array(cat(b, np.int64)), pa.array(cat(s, np.float64))], names=["a", "b", "s"])


def _start(reps: DataFrame, tables: range, explore: float) -> DataFrame:
    """Pairs that lie close in the order of some table's codes, of similarity ``explore``."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("size"))
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                unit = unit_rows(part.column("v"))
                for t in tables:
                    planes = np.random.default_rng(1000 * t + 7).standard_normal((int(d), _BITS))
                    bits = (unit @ planes > 0).astype(np.int64) @ (1 << np.arange(_BITS - 1, -1, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(unit), t, np.int32)), part.column("part"), pa.array(bits), part.column("id"), part.column("v")], names=["t", "part", "code", "id", "v"])

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "t", 20_000):
            part, ids = table.column("part").to_numpy(), table.column("id").to_numpy()
            out: tuple[list, list, list] = ([], [], [])
            edge = _runs(part, table.column("t").to_numpy())
            for lo, hi in zip(edge, edge[1:]):
                unit = unit_rows(table.column("v").slice(lo, hi - lo))
                for step in range(1, min(_AHEAD, hi - lo - 1) + 1):
                    s = np.einsum("ij,ij->i", unit[:-step], unit[step:])
                    near = np.flatnonzero(s >= explore)
                    out[0].append(ids[lo:hi][near])
                    out[1].append(ids[lo:hi][near + step])
                    out[2].append(s[near])
            yield _edges(*out)

    kind = reps.schema["v"].dataType.simpleString()
    coded = reps.mapInArrow(code, f"t int, part long, code long, id long, v {kind}")
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = coded.repartitionByRange(n, "t", "part", "code", "id").sortWithinPartitions("t", "part", "code", "id")
    return placed.mapInArrow(ahead, "a long, b long, s double")


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best neighbours of each node, in two steps so that hubs are no single group."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).groupBy("a", "b").agg(F.max("s").alias("s"))
    order = [F.desc("s"), F.xxhash64("a", "b"), "b"]
    both = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(_SALTS)))
    few = both.withColumn("r", F.row_number().over(Window.partitionBy("a", "salt").orderBy(*order))).filter(F.col("r") <= k)
    return few.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(*order))).filter(F.col("r") <= k).select("a", "b", "s")


def _refine(graph: DataFrame, reps: DataFrame, explore: float) -> DataFrame:
    """Pairs among each node's neighbours (neighbours of neighbours), of ``explore`` or more."""
    around = graph.join(reps.select(F.col("id").alias("b"), "v"), "b").select("a", "b", "v")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "a"):
            b, edge = table.column("b").to_numpy(), _runs(table.column("a").to_numpy())
            unit = unit_rows(table.column("v"))
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(edge, edge[1:]):
                if hi - lo < 2:
                    continue
                s = unit[lo:hi] @ unit[lo:hi].T
                i, j = np.nonzero(np.triu(s >= explore, 1))
                if len(i):
                    x, y = b[lo:hi][i], b[lo:hi][j]
                    out[0].append(np.minimum(x, y))
                    out[1].append(np.maximum(x, y))
                    out[2].append(s[i, j])
            yield _edges(*out)

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return around.repartition(n, "a").sortWithinPartitions("a").mapInArrow(pairs, "a long, b long, s double")


def tables_for(n: int, threshold: float = THRESHOLD) -> range:
    """So many tables that a pair at the threshold meets in one with a chance of ``START_RECALL``."""
    same_bit = 1 - math.acos(min(threshold, 1.0)) / math.pi
    met = same_bit ** max(math.log2(max(n, 1) / _AHEAD), 1.0)
    return range(max(TABLES, math.ceil(math.log(1 - START_RECALL) / math.log(1 - met))) if met < 1 else TABLES)


def _saturated(graph: DataFrame, threshold: float, size: int) -> DataFrame:
    """``a`` of the nodes whose list is full of links."""
    return graph.filter(F.col("s") >= threshold).groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= size).select("a")


def _angles(members: DataFrame, pivots: DataFrame, name: str) -> DataFrame:
    """Add the angle of each member to its component's pivot (``comp``, ``p``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, p = batch.schema.get_field_index("v"), batch.schema.get_field_index("p")
            got = np.zeros(batch.num_rows)
            sizes = np.asarray(pa.compute.list_value_length(batch.column(i)))
            for d in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == d))
                cosine = np.einsum("ij,ij->i", unit_rows(batch.column(i).take(at)), unit_rows(batch.column(p).take(at)))
                got[np.asarray(at)] = np.arccos(np.clip(cosine, -1, 1))
            yield batch.drop_columns(["p"]).append_column(name, pa.array(got))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in members.schema.fields)
    return members.join(pivots, "comp").select(*members.columns, "p").mapInArrow(run, f"{fields}, {name} double")


def _region_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links of each vector in its component: ``id``, ``links`` (copies of others count each).

    ``members``: id, comp, n, v; a component's name is the id of one member, its first pivot;
    the one farthest from it is the second. Members of a shell are numbered and cut into
    blocks; a task compares two blocks, so a component of any size is never gathered.
    """
    width = math.acos(min(threshold, 1.0)) + 1e-6
    # pivots are tables of their own: a join with an aggregate on ``comp`` could not split a large component
    members = materialize(members)
    first = materialize(members.filter("id = comp").select("comp", F.col("v").alias("p")))
    members = materialize(_angles(members, first, "a1"))
    second = members.groupBy("comp").agg(F.max_by("id", F.struct("a1", "id")).alias("id"))
    second = materialize(second.join(members.select("id", F.col("v").alias("p")), "id").select("comp", "p"))
    shells = materialize(_angles(members, second, "a2").select("comp", F.floor(F.col("a1") / width).alias("k1"), F.floor(F.col("a2") / width).alias("k2"), "id", "n", "v"))

    key = ["comp", "k1", "k2"]
    place = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("id")) - 1
    salted = shells.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(_SALTS, shells.count() // _SALTED_ROWS))))
    size = salted.groupBy(*key, "salt").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(*key, "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    cells = shells.groupBy(*key).agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    around = cells.select(*key, F.explode(step).alias("d1")).withColumn("d2", F.explode(step))
    around = around.select("comp", F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("k1") + F.col("d1")).alias("k1"), (F.col("k2") + F.col("d2")).alias("k2")).join(cells, key)
    around = around.groupBy("comp", F.col("c1").alias("k1"), F.col("c2").alias("k2")).agg(F.collect_list(F.struct(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "blocks")).alias("others"))
    around = materialize(around)

    rows = salted.withColumn("place", place).join(size, [*key, "salt"]).withColumn("block", F.floor((F.col("place") + F.col("base")) / _BLOCK))
    rows = rows.join(around, key).select("comp", "k1", "k2", "block", "id", "n", "v", F.inline("others"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own, other = F.struct("k1", "k2", "block"), F.struct(F.col("o1").alias("k1"), F.col("o2").alias("k2"), F.col("other").alias("block"))
    rows = rows.select(F.xxhash64("comp", F.least(own, other), F.greatest(own, other)).alias("unit"), (own > other).alias("late"), "id", "n", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "unit"):
            edge = _runs(table.column("unit").to_numpy())
            late = np.asarray(table.column("late").combine_chunks().to_numpy(zero_copy_only=False), bool)
            ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
            links = np.zeros(len(ids), np.int64)
            for lo, hi in zip(edge, edge[1:]):
                unit = unit_rows(table.column("v").slice(lo, hi - lo))
                mid = lo + int(np.count_nonzero(~late[lo:hi]))
                if mid == hi:
                    near = unit @ unit.T >= threshold
                    np.fill_diagonal(near, False)
                    links[lo:hi] = near @ n[lo:hi]
                else:
                    near = unit[: mid - lo] @ unit[mid - lo :].T >= threshold
                    links[lo:mid], links[mid:hi] = near @ n[mid:hi], n[lo:mid] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["id", "links"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "unit").sortWithinPartitions("unit", "late", "id").mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def audit(reps: DataFrame, linked: DataFrame, threshold: float, sample: int = _AUDIT, most: int = _AUDIT_MOST) -> tuple[float, int]:
    """(recall, number of vectors with true links it rests on), against brute force.

    ``linked``: id, links. One hashed sample is of all vectors, grown from ``sample`` to
    ``most`` while under a tenth of ``sample`` have links; another of the vectors with links
    found. Each asked vector is compared with all of its part; each with true links counts
    once, with the share of them that was found. The lower of the two samples' means is the
    recall; 1.0 where no asked vector has a true link.
    """
    spark = reps.sparkSession
    known = reps.join(linked, "id", "left").select("id", "part", "size", "n", "v", F.coalesce("links", F.lit(0)).alias("links"))
    order = [F.xxhash64("id", F.lit(5)), "id"]

    def asked(rows: DataFrame, count: int) -> list[tuple[int, int]]:
        """(true, found) of the asked vectors."""
        got = rows.orderBy(*order).limit(count).collect()
        queries: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for key in {(r["part"], r["size"]) for r in got}:
            own = [r for r in got if (r["part"], r["size"]) == key]
            queries[key] = (np.array([r["id"] for r in own]), unit_rows(pa.array([r["v"] for r in own])))
        shared = spark.sparkContext.broadcast(queries)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, size = np.asarray(batch.column("part")), np.asarray(batch.column("size"))
                ids, n = np.asarray(batch.column("id")), np.asarray(batch.column("n"))
                out: tuple[list, list] = ([], [])
                for (p, d), (q, unit) in shared.value.items():
                    at = np.flatnonzero((part == p) & (size == d))
                    if len(at):
                        near = (unit @ unit_rows(batch.column("v").take(pa.array(at))).T >= threshold) & (q[:, None] != ids[at])
                        out[0].append(q)
                        out[1].append(near @ n[at])
                cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cat(out[0])), pa.array(cat(out[1]))], names=["id", "links"])

        true = reps.select("part", "size", "id", "n", "v").mapInArrow(find, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
        true = {r["id"]: r["links"] for r in true.collect()}  # a number for each asked vector
        return [(true[r["id"]], r["links"]) for r in got if true.get(r["id"])]

    every = asked(known, sample)
    while 10 * len(every) < sample < most:
        sample = min(4 * sample, most)
        every = asked(known, sample)
    some = asked(known.filter("links > 0"), _AUDIT)
    means = [sum(min(f, t) / t for t, f in x) / len(x) for x in (every, some) if x]
    return min(means, default=1.0), len(every) + len(some)


def find_near(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, rounds: int = ROUNDS, min_recall: float = MIN_RECALL) -> tuple[DataFrame, float]:
    """The rows of :func:`near_vectors`, and the audited recall of their links."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    able = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    good = rows.filter("able").select("id", "v", F.xxhash64("label", F.size("v")).alias("part"))
    reps = good.groupBy("part", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = materialize(reps.withColumn("size", F.size("v")).select("id", "part", "size", "n", "v"))

    tables, edges, recall = tables_for(reps.count(), threshold), None, 1.0
    for _ in range(3):
        start = _start(reps, tables, EXPLORE)
        edges = start if edges is None else edges.unionByName(start)
        graph = materialize(_top(edges, LIST))
        settled, links = _state(graph, threshold), graph
        for _ in range(rounds if settled[0] else 0):
            found = materialize(_refine(graph, reps, EXPLORE).distinct())
            links = links.unionByName(found)
            graph = materialize(_top(graph.unionByName(found), LIST))
            before, settled = settled, _state(graph, threshold)
            if settled[0] <= 1.01 * before[0] and settled[1] <= 1.005 * before[1]:
                break
        edges = links
        labels = materialize(connected_components(links.filter(F.col("s") >= threshold)))
        full = _saturated(graph, threshold, LIST).join(labels, F.col("a") == F.col("node")).select("component").distinct()
        named = materialize(labels.join(full.withColumn("full", F.lit(True)), "component", "left").select(F.col("node").alias("id"), F.col("component").alias("comp"), F.coalesce("full", F.lit(False)).alias("full")))
        # lists that are not full hold all links found; the others' components are compared
        kept = graph.filter(F.col("s") >= threshold).join(named.filter("not full").select(F.col("id").alias("a")), "a")
        few = kept.join(reps.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
        linked = few
        if named.filter("full").take(1):
            linked = few.unionByName(_region_links(reps.join(named.filter("full").select("id", "comp"), "id").select("id", "comp", "n", "v"), threshold))
        linked = materialize(linked)
        recall, rests_on = audit(reps, linked, threshold)
        _log.info("recall %.4f on %d vectors with links, %d tables", recall, rests_on, tables.stop)
        if recall >= min_recall:
            break
        tables = range(tables.stop, 3 * tables.stop)
    if recall < FLOOR:
        raise RuntimeError(f"only {recall:.3f} of the links were found")

    own = reps.select("id", "part", "v", "n").join(linked, "id", "left").join(named.select("id", "comp"), "id", "left")
    own = own.select("part", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("comp", "id").alias("component_id"))
    yes = good.join(own, ["part", "v"]).select("id", "n_links", "component_id")
    no = rows.filter("not able").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = yes.unionByName(no).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
    return out, recall


def _state(graph: DataFrame, threshold: float) -> tuple[int, int]:
    """Edges, and links among them."""
    row = graph.agg(F.count("*").alias("n"), F.count_if(F.col("s") >= threshold).alias("links")).first()
    return row["n"], row["links"]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, rounds: int = ROUNDS, min_recall: float = MIN_RECALL) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their labels are equal and not null, their sizes are equal and their
    cosine is ``threshold`` or more. Null and zero vectors, such with null or non-finite
    components and rows with a null id or label link with nothing (``n_links`` 0, their own
    component, kept). Repeated rows are vectors of their own, so they link with each other.
    Other columns are not read; an empty table gives an empty result. Below ``min_recall``
    it searches on; a ``RuntimeError`` says that less than ``FLOOR`` of the links were found.
    """
    return find_near(vectors, id_col, vector_col, label_col, threshold, rounds, min_recall)[0]
