"""Points in polygons against a plain ray cast: dense polygons, holes, hot cells; clipped rings."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldcast.operators import geometry

RING = "poly int, part int, ring int, pos int, x double, y double"


def plain(points, shapes):
    """First polygon that holds each point, by an even-odd ray over all edges of a part."""
    found = {}
    for poly in sorted(shapes, reverse=True):
        for part in shapes[poly]:
            hit = np.zeros(len(points), bool)
            for ring in part:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                    if y1 != y2:
                        hit ^= ((y1 > points[:, 1]) != (y2 > points[:, 1])) & (points[:, 0] < (x2 - x1) * (points[:, 1] - y1) / (y2 - y1) + x1)
            found |= {i: poly for i in np.nonzero(hit)[0]}
    return found


def check(spark, points, shapes, **kw):
    rows = [(p, k, r, i, float(x), float(y)) for p, parts in shapes.items() for k, part in enumerate(parts) for r, ring in enumerate(part) for i, (x, y) in enumerate(ring)]
    rings = spark.createDataFrame(rows, RING)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    order = spark.createDataFrame([(p, p) for p in shapes], "poly int, ord int")
    got = {r["id"]: r["poly"] for r in geometry.point_in_polygon(df, rings, order, **kw).collect()}
    assert got == plain(np.array(points, float), shapes)
    return rings


def star(n, cx, cy, r, rng):
    return [(cx + r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_small_shapes_on_whole_numbers(spark):
    """Points on corners, borders and heights of vertices, as the ray rule has them."""
    ell = [(0, 0), (10, 0), (10, 6), (6, 6), (6, 10), (0, 10)]
    shapes = {0: [[ell, [(2, 2), (4, 2), (4, 4), (2, 4)]], [[(20, 0), (30, 0), (25, 9)]]], 1: [[[(5, 5), (25, 5), (25, 25), (5, 25)]]]}
    points = [(x / 2, y / 2) for x in range(-2, 64) for y in range(-2, 54)]
    check(spark, points, shapes, max_edges=5)


def test_stars_with_holes(spark):
    rng = random.Random(1)
    shapes = {k: [[star(rng.choice([5, 60, 300]), rng.uniform(0, 50), rng.uniform(0, 50), rng.uniform(1, 12), rng)] for _ in range(2)] for k in range(6)}
    shapes[6] = [[star(400, 25, 25, 24, rng), star(100, 25, 25, 6, rng)]]
    check(spark, [(rng.uniform(-2, 55), rng.uniform(-2, 55)) for _ in range(1500)], shapes, max_edges=8)


def test_a_dense_polygon_with_a_hot_cell(spark):
    """Twenty thousand points in one ring, and most of the asked ones in one spot: no cell
    keeps more than its share of edges."""
    rng = random.Random(2)
    dense = [star(20_000, 0, 0, 10, rng)]
    points = [(6.5 + rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for _ in range(800)] + [(rng.uniform(-11, 11), rng.uniform(-11, 11)) for _ in range(200)]
    rings = check(spark, points, {3: [dense]}, max_edges=300)
    leaves = geometry.polygon_cells(rings, 300).leaves
    assert leaves.agg(F.max(F.size("edges"))).first()[0] <= 300


def test_no_polygons(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert geometry.point_in_polygon(points, spark.createDataFrame([], RING), spark.createDataFrame([], "poly int, ord int")).count() == 0
