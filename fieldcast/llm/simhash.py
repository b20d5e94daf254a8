"""SimHash fingerprints and their near pairs by a binary-trie self-join.

A fingerprint's bits, from the top, are its path in a binary trie. Two tries are joined by
walking node pairs together: going down on different bits costs one error, and a pair that
has spent its budget is dropped with all that is below it.

On a cluster the walk's upper part is data: with a budget of k errors, one of k+1 blocks of
bits is equal in both fingerprints, so each fingerprint is turned k+1 times to bring another
block to the top, and only those under one top node can meet (pairs that differ there spend
no budget in another turn). A top node with more than ``leaf_rows`` rows is cut further by
the same walk over a table of node pairs, so that a task gets two bounded subtries, not a
group. The lower part of the walk runs inside tasks, level by level on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize

_LANES = np.uint64(0x0101010101010101)
_CHUNK_WORDS = 200_000
_STEP = 6


def shingle_hashes(text: bytes | None, width: int = 3, seed: int = 42) -> Iterator[list[int]]:
    """XXH64 of every word shingle, in bounded lists. ``text`` is UTF-8; A-Z are lowered."""
    words = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if 0 < len(words) <= width:
        yield [digest(b" ".join(words), seed)]
    elif words:
        for at in range(0, len(words) - width + 1, _CHUNK_WORDS):
            part = words[at : at + _CHUNK_WORDS + width - 1]
            joined, ends = b" ".join(part), list(accumulate(len(w) + 1 for w in part))
            yield [digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[width - 1 :])]


def majority_bits(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per group of ``hashes`` (uint64): the bits set in over half of them."""
    out = np.zeros(len(starts), np.uint64)
    full = sizes > 0
    if not full.any():
        return out
    starts, sizes = starts[full], sizes[full]
    # byte lanes hold up to 255, so add up runs of at most 255 hashes first
    runs = -(-sizes // 255)
    first = np.concatenate([[0], np.cumsum(runs)[:-1]])
    begin = np.repeat(starts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    value = np.zeros(len(starts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, begin).astype("<u8")
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        major = counts * 2 > sizes[:, None]
        for byte in range(8):
            value |= major[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = value
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``id_col`` and ``fp`` (long, the 64 bits) of every row; null or wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes, done, held = [], [], [], 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                n = 0
                for h in shingle_hashes(texts[i].as_py(), width, seed):
                    parts.append(np.array(h, np.uint64))
                    n += len(h)
                sizes.append(n)
                held += n
                if held >= 1_000_000 or i == batch.num_rows - 1:
                    size = np.array(sizes, np.int64)
                    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                    done.append(majority_bits(every, np.cumsum(size) - size, size))
                    parts, sizes, held = [], [], 0
            fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, fp long").select(F.col("id").alias(id_col), "fp")


def _rotl(x: Column, n: int) -> Column:
    return x if n == 0 else F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(start from the top, width) of budget+1 blocks over 64 bits."""
    cuts = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _walk(keys: np.ndarray, roots: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (positions in the sorted ``keys``) within ``budget`` errors.

    ``roots``: arrays alo, ahi, blo, bhi of node pairs; a node is a run of ``keys`` that
    share their first ``depth`` bits at least; equal runs are self pairs. A pair of two
    single keys is settled by its XOR. The frontier is kept small by walking halves.
    """
    err = np.bitwise_count((keys[roots[0]] ^ keys[roots[2]]) >> np.uint64(64 - depth)).astype(np.int8) if depth else np.zeros(len(roots[0]), np.int8)
    ok = err <= budget
    stack = [(depth, *(r[ok] for r in roots), err[ok])]
    ones: dict[int, np.ndarray] = {}
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > 500_000:
            h = len(alo) // 2
            stack += [(d, *(x[h:] for x in (alo, ahi, blo, bhi, err))), (d, *(x[:h] for x in (alo, ahi, blo, bhi, err)))]
            continue
        own = (alo == blo) & (ahi == bhi)
        single = (ahi - alo == 1) & (bhi - blo == 1)
        settle = single & ~own
        i, j = alo[settle], blo[settle]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        if near.any():
            yield i[near], j[near]
        go = ~single
        if not go.any():
            continue
        alo, ahi, blo, bhi, err, own = (x[go] for x in (alo, ahi, blo, bhi, err, own))
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        x = ~own
        made = [
            (alo, am, blo, bm, err),
            (am, ahi, bm, bhi, err),
            (alo, am, bm, bhi, err + 1),
            (am[x], ahi[x], blo[x], bm[x], err[x] + 1),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(p) for p in zip(*made))
        keep = (alo < ahi) & (blo < bhi) & (err <= budget)
        if keep.any():
            stack.append((d + 1, *(p[keep] for p in (alo, ahi, blo, bhi, err))))


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) of the components that ``pairs`` make of 0..n-1."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def near_forest(fps: DataFrame, budget: int = 2, leaf_rows: int = 128) -> DataFrame:
    """Links that join each distinct ``fp`` (long) with those at ``budget`` bits or fewer.

    Returns ``a``, ``b``: not all links but, for each pair of subtries met in a task, a
    spanning forest of them, so the rows grow with the fingerprints also where thousands
    lie within the budget of each other. The components are those of all links.
    """
    blocks = _blocks(budget)
    # a top node is hot when it holds several times an even share of all fingerprints
    leaf_rows = max(leaf_rows, 4 * fps.count() >> min(w for _, w in blocks))
    turned = fps.select("fp").filter("fp is not null").distinct().select(
        F.explode(F.array(*[F.struct(F.lit(r).alias("turn"), _rotl(F.col("fp"), at).alias("key"), F.shiftrightunsigned(_rotl(F.col("fp"), at), 64 - width).alias("top")) for r, (at, width) in enumerate(blocks)])).alias("x")
    ).select("x.*")
    count = turned.groupBy("turn", "top").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(turned.join(count, ["turn", "top"]).select("turn", "top", "key", "n"))
    calm = met.filter(F.col("n") <= leaf_rows).select(F.xxhash64("turn", "top").alias("unit"), "turn", F.lit(0).alias("side"), "key")
    hot = met.filter(F.col("n") > leaf_rows).select("turn", "top", "key")
    units = calm
    if hot.take(1):
        units = units.unionByName(_hot_units(hot, min(w for _, w in blocks), budget, leaf_rows))
    depth = min(w for _, w in blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                table = pa.Table.from_batches(held).combine_chunks()
                unit = table.column("unit").to_numpy()
                cut = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
                if cut:
                    yield _join_units(table.slice(0, cut), depth, budget, blocks)
                rest = table.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield _join_units(pa.Table.from_batches(held).combine_chunks(), depth, budget, blocks)

    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return units.repartition(parts, "unit").sortWithinPartitions("unit", "side", "key").mapInArrow(run, "a long, b long")


def _join_units(table: pa.Table, depth: int, budget: int, blocks: list[tuple[int, int]]) -> pa.RecordBatch:
    unit, side, turn = (table.column(x).to_numpy() for x in ("unit", "side", "turn"))
    key = table.column("key").to_numpy().view(np.uint64)
    order = np.lexsort((key, side, unit))
    unit, side, turn, key = unit[order], side[order], turn[order], key[order]
    start = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])]))
    end = np.append(start[1:], len(unit))
    second = np.flatnonzero(side[start] == 1)
    alone = np.ones(len(start), bool)
    alone[second] = alone[second - 1] = False
    a, b = np.flatnonzero(alone), np.flatnonzero(alone)
    a, b = np.concatenate([a, second - 1]), np.concatenate([b, second])
    at, to = _forest(len(key), _walk(key, (start[a], end[a], start[b], end[b]), depth, budget))
    shift = np.array([s for s, _ in blocks], np.uint64)

    def back(i: np.ndarray) -> pa.Array:
        s, k = shift[turn[i]], key[i]
        return pa.array(np.where(s == 0, k, (k >> s) | (k << ((np.uint64(64) - s) & np.uint64(63)))).view(np.int64))

    return pa.RecordBatch.from_arrays([back(at), back(to)], names=["a", "b"])


def _hot_units(hot: DataFrame, depth: int, budget: int, leaf_rows: int) -> DataFrame:
    """Cut tries with more than ``leaf_rows`` keys into leaves and pair these by the walk.

    ``pairs`` holds node pairs by (depth, prefix) of both nodes. Each pass replaces nodes
    above the limit by their descendants ``_STEP`` bits below and drops the pairs whose
    shared prefix bits differ in more than ``budget`` places.
    """
    rows = hot.withColumn("d", F.lit(depth)).withColumn("p", F.shiftrightunsigned("key", 64 - depth))
    pairs = rows.select("turn", "top", F.col("d").alias("da"), F.col("p").alias("pa"), F.col("d").alias("db"), F.col("p").alias("pb")).distinct()
    pairs = materialize(pairs)
    while depth < 64:
        over = rows.groupBy("turn", "top", "d", "p").agg(F.count("*").alias("n")).filter((F.col("n") > leaf_rows) & (F.col("d") == depth))
        if not over.take(1):
            break
        deeper = min(64, depth + _STEP)
        over = materialize(over.select("turn", "top", "d", "p", F.lit(True).alias("cut")))
        rows = rows.join(over, ["turn", "top", "d", "p"], "left").select(
            "turn", "top", "key", F.when(F.col("cut"), deeper).otherwise(F.col("d")).alias("d"), F.when(F.col("cut"), F.shiftrightunsigned("key", 64 - deeper)).otherwise(F.col("p")).alias("p")
        )
        rows = materialize(rows)
        child = rows.filter(F.col("d") == deeper).select("turn", "top", F.lit(depth).alias("d0"), F.shiftrightunsigned("p", deeper - depth).alias("p0"), F.col("d").alias("d1"), F.col("p").alias("p1")).distinct()
        for s in "ab":
            c = child.select("turn", "top", F.col("d0").alias(f"d{s}"), F.col("p0").alias(f"p{s}"), "d1", "p1")
            pairs = pairs.join(c, ["turn", "top", f"d{s}", f"p{s}"], "left").withColumn(f"d{s}", F.coalesce("d1", f"d{s}")).withColumn(f"p{s}", F.coalesce("p1", f"p{s}")).drop("d1", "p1")
        low = F.least("da", "db")
        differ = F.expr("bit_count(shiftrightunsigned(pa, da - least(da, db)) ^ shiftrightunsigned(pb, db - least(da, db)))")
        # a node met itself once; its children meet in both orders, of which one is kept
        once = (low < F.greatest("da", "db")) | (F.col("pa") <= F.col("pb"))
        pairs = materialize(pairs.filter((differ <= budget) & once).distinct())
        depth = deeper
    u = F.xxhash64("turn", "top", "da", "pa", "db", "pb").alias("unit")
    a = rows.join(pairs.select("turn", "top", F.col("da").alias("d"), F.col("pa").alias("p"), u), ["turn", "top", "d", "p"])
    b = rows.join(pairs.filter("da <> db or pa <> pb").select("turn", "top", F.col("db").alias("d"), F.col("pb").alias("p"), u), ["turn", "top", "d", "p"])
    return a.select("unit", "turn", F.lit(0).alias("side"), "key").unionByName(b.select("unit", "turn", F.lit(1).alias("side"), "key"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents link when their fingerprints differ in ``budget`` bits or fewer;
    ``component_id`` is the smallest id reachable. Null and empty texts have fingerprint
    zero and link like any other. Repeated rows come back as often as they were given; rows
    with a null id get their component from the others. Other columns of ``docs`` are not
    read, so their names cannot clash. An empty table gives an empty result.
    """
    fp = materialize(fingerprints(docs, id_col, text_col, width))
    least = materialize(fp.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    labels = connected_components(near_forest(least, budget)).select(F.col("node").alias("fp"), "component")
    by_fp = least.join(labels, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    by_fp = materialize(by_fp)
    lowest = by_fp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = by_fp.join(lowest, "component").select("fp", "component_id")
    return fp.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
