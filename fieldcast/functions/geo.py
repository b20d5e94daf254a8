"""Projections and rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .collections import let

#: Frame of the maps and the affine fit of pixels to (longitude, mercator y, 1).
FRAME = (1280.0, 720.0)
X_FIT = (21.10656425, 9.17874552, 2656.72497789)
Y_FIT = (-0.0419217112, -1210.80604, 1239.89688)
#: Standard parallels and origin of the conic projection, in degrees.
PARALLELS, ORIGIN = (29.5, 45.5), (37.5, -96.0)


def mercator_y(lat: Column) -> Column:
    """Mercator ordinate; latitudes beyond 85 degrees are taken as 85."""
    phi = F.radians(F.least(F.lit(85.0), F.greatest(F.lit(-85.0), lat)))
    return F.log(F.tan(math.pi / 4 + phi / 2))


def lonlat_to_pixel(lon: Column, lat: Column, width: Column | float = FRAME[0], height: Column | float = FRAME[1]) -> Column:
    """Struct ``x``, ``y`` in an image of the given size."""
    m = mercator_y(lat)
    fit = lambda c: c[0] * lon + c[1] * m + c[2]
    return F.struct((fit(X_FIT) * (width / FRAME[0])).alias("x"), (fit(Y_FIT) * (height / FRAME[1])).alias("y"))


def albers_xy(lon: Column, lat: Column) -> Column:
    """Struct ``x``, ``y`` of the equal-area conic projection."""
    a, b, o = (math.radians(x) for x in (*PARALLELS, ORIGIN[0]))
    n = (math.sin(a) + math.sin(b)) / 2
    c = math.cos(a) ** 2 + 2 * n * math.sin(a)
    top = math.sqrt(c - 2 * n * math.sin(o)) / n
    rho = F.sqrt(F.greatest(F.lit(0.0), c - 2 * n * F.sin(F.radians(lat)))) / n
    turn = n * (F.radians(lon) - math.radians(ORIGIN[1]))
    return F.struct((rho * F.sin(turn)).alias("x"), (top - rho * F.cos(turn)).alias("y"))


def ring_area(ring: Column) -> Column:
    """Area of a ring of points (structs ``x``, ``y``; closed or not) by the shoelace sum."""

    def twice(r: Column) -> Column:
        after = lambda i: F.get(r, (i + 1) % F.size(r))
        return F.aggregate(F.transform(r, lambda p, i: p["x"] * after(i)["y"] - after(i)["x"] * p["y"]), F.lit(0.0), lambda a, v: a + v)

    return F.abs(let(ring, twice)) / 2


def _cut(ring: Column, axis: str, limit: Column, sign: int) -> Column:
    """The ring's part on one side of a line: of each point what lies before it, and itself."""
    within = lambda p: (p[axis] - limit) * sign >= 0

    def met(p: Column, q: Column) -> Column:
        t = F.try_divide(limit - q[axis], p[axis] - q[axis])
        at = lambda c: limit if c == axis else q[c] + t * (p[c] - q[c])
        return F.struct(at("x").cast("double").alias("x"), at("y").cast("double").alias("y"))

    def cut(r: Column) -> Column:
        def step(p: Column, i: Column) -> Column:
            q = F.get(r, (i + F.size(r) - 1) % F.size(r))
            here = F.when(within(p), F.array(p)).otherwise(F.slice(r, 1, 0))
            return F.when(within(p) != within(q), F.concat(F.array(met(p, q)), here)).otherwise(here)

        return F.flatten(F.transform(r, step))

    return let(ring, cut)


def clip_ring(ring: Column, width: Column, height: Column) -> Column:
    """The ring's part in the frame from 0 to ``width`` - 1 and ``height`` - 1: cut at one side
    of the frame after the other. Parts that fall apart stay joined along the frame's border."""
    for axis, limit, sign in (("x", F.lit(0.0), 1), ("x", width - 1.0, -1), ("y", F.lit(0.0), 1), ("y", height - 1.0, -1)):
        ring = _cut(ring, axis, limit, sign)
    return ring


def clip_polygon(parts: Column, width: Column, height: Column) -> Column:
    """All rings of all parts (the first of a part is its border, the others are holes) clipped."""
    return F.transform(parts, lambda part: F.transform(part, lambda r: clip_ring(r, width, height)))


def polygon_area(parts: Column) -> Column:
    """Area of the parts without their holes."""
    part = lambda rings: F.aggregate(F.transform(rings, lambda r, i: F.when(i == 0, ring_area(r)).otherwise(-ring_area(r))), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(parts, part), F.lit(0.0), lambda a, v: a + v)


def frame_status(parts: Column, clipped_area: Column) -> Column:
    """empty_polygon without a point; outside_map if less than one square pixel lies in the
    frame; else ok."""
    points = F.coalesce(F.size(F.flatten(F.flatten(parts))), F.lit(0))
    return F.when(parts.isNull() | (points <= 0), "empty_polygon").when(clipped_area < 1.0, "outside_map").otherwise("ok")


def spacing(clipped_area: Column, target: int) -> Column:
    """Distance of sample points for about ``target`` of them, two pixels at least."""
    return F.greatest(F.lit(2.0), F.sqrt(F.greatest(clipped_area, F.lit(1.0)) / target))


def stitch_ring(arcs: Column) -> Column:
    """Join arcs (arrays of points) end to end without the doubled joints; close the ring."""
    line = F.flatten(F.transform(arcs, lambda a, i: F.when(i == 0, a).otherwise(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))))))
    return F.when((F.size(line) > 0) & (F.get(line, 0) != F.get(line, F.size(line) - 1)), F.concat(line, F.slice(line, 1, 1))).otherwise(line)
