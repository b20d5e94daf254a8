"""Graded text quality by cumulative-link (ordinal logistic) regression on hashed text.

One weight vector is shared by all grades; ordered thresholds cut its score into grades:
P(grade > k) = sigmoid(score - threshold[k]). That gives an expected grade and the chance of
the top grades, which selection uses. Features: hashed distinct words and word beginnings
(marks removed, A-Z lowered), shares of neighbouring character classes, and how much the words repeat.

The model is fitted on at most ``max_fit`` labelled documents, those with the lowest hash of
their id; all documents are scored where they lie.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FIT = 12_000
BUCKETS = 1 << 20
#: Buckets that take part: in so many texts at least, whose mean grade is so many standard
#: errors from the mean of all.
MIN_DOCS = 12
MIN_LEAN = 4.0
MIN_TAIL = 0.5

_MARKS = b".,;:!?\"()[]{}'*#$%&|<>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASSES = 20
_STEM = 5


def _byte_classes() -> np.ndarray:
    out = np.full(256, 1, np.uint8)  # other marks
    out[0x80:] = 2
    for i, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!", b"?", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"-")):
        out[np.frombuffer(group, np.uint8)] = 3 + i
    return out


_CLASS = _byte_classes()
DENSE = _CLASSES * _CLASSES + 2


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words, and the dense features, of one UTF-8 text."""
    words = text.translate(_LOWER, _MARKS).split()
    kinds = set(words)
    stems = {w[:_STEM] for w in kinds}
    buckets = np.fromiter(map(zlib.crc32, chain(kinds, map(b"\0".__add__, stems))), np.uint32, len(kinds) + len(stems)) & np.uint32(BUCKETS - 1)
    dense = np.zeros(DENSE, np.float32)
    if len(text) > 1:
        c = _CLASS[np.frombuffer(text, np.uint8)].astype(np.uint16)
        dense[:-2] = np.sqrt(np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES) / (len(c) - 1))
    if words:
        dense[-2] = 1 - len(kinds) / len(words)
        dense[-1] = sum(map(eq, words, words[1:])) / len(words)
    return buckets, dense


@dataclass
class OrdinalModel:
    weights: np.ndarray  # float32 per bucket
    dense: np.ndarray  # float64 per dense feature
    thresholds: np.ndarray  # ascending

    def score(self, buckets: np.ndarray, dense: np.ndarray) -> float:
        return float(self.weights[buckets].sum(dtype=np.float64) + dense @ self.dense)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return _sigmoid(np.asarray(score)[..., None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _minimise(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            alphas.append(a)
            q -= a * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.abs(g).sum(), 1e-12)
        for (s, y, r), a in zip(steps, reversed(alphas)):
            q += s * (a - r * (y @ q))
        t, slope = 1.0, -(g @ q)
        while True:
            new = x - t * q
            v, h = f(new)
            if v <= value + 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = new - x, h - g
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        done = abs(value - v) < 1e-7 * max(1.0, abs(value))
        x, value, g = new, v, h
        if done:
            break
    return x


def fit(buckets: list[np.ndarray], dense: np.ndarray, grades: np.ndarray, n_grades: int, l2_words: float = 1.0, l2_dense: float = 0.01, rounds: int = 80, min_docs: int = MIN_DOCS, min_lean: float = MIN_LEAN) -> OrdinalModel:
    """Penalised maximum likelihood; buckets in fewer than ``min_docs`` texts,
    or whose texts' mean grade leans less than ``min_lean`` standard errors, get 0.

    Thresholds are a first value and positive gaps, so they stay ordered.
    """
    n = len(grades)
    flat = np.concatenate(buckets) if buckets else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(buckets), dtype=np.int32), [len(b) for b in buckets])
    docs_with = np.bincount(flat, minlength=BUCKETS)
    away = grades - grades.mean() if n else np.zeros(0)
    lean = np.bincount(flat, away[row], BUCKETS) / np.sqrt(np.maximum(docs_with, 1) * max(away.var() if n else 0, 1e-9))
    used = np.flatnonzero((docs_with >= min_docs) & (np.abs(lean) >= min_lean))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    col = place[flat]
    row, col = row[col >= 0], col[col >= 0]
    m, d = len(used), dense.shape[1]
    mean = dense.mean(0) if n else np.zeros(d)
    centred = dense - mean
    upper, lower = grades < n_grades - 1, grades > 0

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, v, first, gaps = x[:m], x[m : m + d], x[m + d], np.exp(x[m + d + 1 :])
        th = first + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, w[col], n) + centred @ v
        hi = np.where(upper, _sigmoid(th[np.minimum(grades, n_grades - 2)] - z), 1.0)  # P(y <= grade)
        lo = np.where(lower, _sigmoid(th[np.maximum(grades - 1, 0)] - z), 0.0)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dz = dhi - dlo
        dth = np.zeros(n_grades - 1)
        np.add.at(dth, grades[upper], -dhi[upper])
        np.add.at(dth, grades[lower] - 1, dlo[lower])
        tail = np.cumsum(dth[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, dz[row], m) + l2_words * w, dz @ centred + l2_dense * v, [dth.sum()], tail[1:] * gaps])
        return float(-np.log(p).sum() + 0.5 * l2_words * (w @ w) + 0.5 * l2_dense * (v @ v)), grad

    share = np.array([((grades > k).sum() + 1) / (n + 2) for k in range(n_grades - 1)])
    start = -np.log(share / (1 - share))
    x0 = np.concatenate([np.zeros(m + d), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
    x = _minimise(loss, x0, rounds)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = x[:m]
    v = x[m : m + d]
    th = x[m + d] + np.concatenate([[0.0], np.cumsum(np.exp(x[m + d + 1 :]))])
    return OrdinalModel(weights, v, th + mean @ v)


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grades of the ``labels`` table: 0 abusive, 1 poor, 2 good; null if unrated."""
    return F.when(toxic > 0, 0).when(quality == 0, 1).when(quality > 0, 2)


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_grades: int = 3, max_fit: int = MAX_FIT) -> OrdinalModel:
    """Fit on the labelled documents with the lowest id hashes, ``max_fit`` at most.

    ``graded``: id and ``grade`` (0..n_grades-1). Null ids and grades are left out; of an
    id's grades the lowest holds, of its texts the one with the lowest hash, so no more than
    ``max_fit`` rows of numbers reach the driver. Null texts count as empty. Without any
    labelled document, or with empty tables, all scores are alike and every grade is as
    likely. Other columns are not read.
    """
    rated = graded.filter(F.col(id_col).isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy(id_col).agg(F.min("grade").cast("int").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64(id_col), id_col).limit(max_fit)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text")).join(F.broadcast(chosen), id_col)
    rows = rows.select("_grade", "_text", F.col(id_col).cast("string").alias("_id"), F.xxhash64("_text").alias("_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([d.tobytes() for _, d in got], pa.binary()), *batch.columns[2:]], names=["grade", "buckets", "dense", "id", "key"])

    made = rows.mapInArrow(run, "grade int, buckets binary, dense binary, id string, key long")
    got = made.groupBy("id").agg(F.min_by(F.struct("grade", "buckets", "dense"), "key").alias("x")).select("id", "x.*").toArrow().sort_by("id")
    grades = got.column("grade").to_numpy().astype(np.int64)
    buckets = [np.frombuffer(x, np.uint32) for x in got.column("buckets").to_pylist()]
    dense = np.stack([np.frombuffer(x, np.float32) for x in got.column("dense").to_pylist()]).astype(np.float64) if len(grades) else np.zeros((0, DENSE))
    return fit(buckets, dense, grades, n_grades)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """``id_col``, ``expected_grade``, ``p_top`` (chance of the top grade) and ``kept`` per row.

    Kept are rows with ``p_top >= min_tail``. Texts without a word, null ones too, have
    grade 0 and are not kept. Repeated rows come back as often as given, rows with a null id
    too; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            words = np.zeros(batch.num_rows, bool)
            for i, x in enumerate(batch.column(1)):
                b, d = features(x.as_py())
                z[i], words[i] = m.score(b, d), len(b) > 0
            above = m.above(z) * words[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, -1]), pa.array((above[:, -1] >= min_tail) & words)], names=["id", "expected_grade", "p_top", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, expected_grade double, p_top double, kept boolean").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: OrdinalModel, text_col: str = "text", min_tail: float = MIN_TAIL) -> DataFrame:
    """The rows of ``docs`` with ``p_top >= min_tail``, all columns, in one pass over the texts.

    Rows are judged by their text alone and pass whole, so ids may be null or repeated and
    columns have any name. Texts without a word, null ones too, go; repeated rows stay or go
    together; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = []
            for x in batch.column(batch.schema.get_field_index(text_col)):
                b, d = features((x.as_py() or "").encode())
                keep.append(bool(len(b)) and float(m.above(np.array(m.score(b, d)))[-1]) >= min_tail)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
