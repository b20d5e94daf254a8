"""Delta-coded arcs, and points in polygons by quadtree cells and edge parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import written


def decode_deltas(arcs: DataFrame, scale: tuple[float, float], translate: tuple[float, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Positions of delta-coded arc points (``keys``, arc_id, pos, dx, dy) as ``x``, ``y``."""
    w = Window.partitionBy(*keys, "arc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return arcs.withColumn("x", F.sum("dx").over(w) * scale[0] + translate[0]).withColumn("y", F.sum("dy").over(w) * scale[1] + translate[1])


#: Edges that a cell keeps before it is cut in four, and how often it is.
MAX_EDGES, MAX_LEVEL = 32, 24
_CELL = ["poly", "part", "level", "cx", "cy"]
_EDGE = ["x1", "y1", "x2", "y2"]


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edges of rings (poly, part, ring, pos, x, y): each point to the next, the last to the first."""
    w = Window.partitionBy("poly", "part", "ring").orderBy("pos")
    first = Window.partitionBy("poly", "part", "ring").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in "xy")
    return rings.select("poly", "part", F.col("x").alias("x1"), F.col("y").alias("y1"), nx.alias("x2"), ny.alias("y2")).filter("x1 <> x2 or y1 <> y2")


def _right_of(e, x: Column, y: Column) -> Column:
    """The edge crosses the ray from (x, y) to the right."""
    return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"], F.lit(False))


def _between(e, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """How often the edge is crossed on the way from (x0, y0) up to the height y, then right to x."""
    level = _right_of(e, x0, y) & ~_right_of(e, x, y)
    upright = ((e["x1"] > x0) != (e["x2"] > x0)) & (F.try_divide((e["y2"] - e["y1"]) * (x0 - e["x1"]), e["x2"] - e["x1"]) + e["y1"]).between(y0, y)
    return level.cast("int") + F.coalesce(upright, F.lit(False)).cast("int")


def _touches(e, x0: Column, y0: Column, size: Column) -> Column:
    """The edge meets the cell: their bounds do, and the cell's corners are not all on one side."""
    x3, y3 = x0 + size, y0 + size
    bounds = (F.least(e["x1"], e["x2"]) <= x3) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y3) & (F.greatest(e["y1"], e["y2"]) >= y0)
    sides = [(e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]) for x in (x0, x3) for y in (y0, y3)]
    return bounds & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


class Cells:
    """Polygons cut into cells that each hold few edges: ``leaves`` (cell, odd, edges) on ``levels``
    of a grid that starts at (``ox``, ``oy``) with cells of ``base`` over two to the level."""

    def __init__(self, leaves: DataFrame, levels: list[int], ox: float, oy: float, base: float):
        self.leaves, self.levels, self.ox, self.oy, self.base = leaves, levels, ox, oy, base

    def size(self, level: Column) -> Column:
        return self.base / F.pow(F.lit(2.0), level)

    def corner(self, cell: Column, level: Column, origin: float) -> Column:
        return origin + cell * self.size(level)


def polygon_cells(rings: DataFrame, max_edges: int = MAX_EDGES, max_level: int = MAX_LEVEL) -> Cells:
    """A quadtree of each polygon's part, refined where its edges are dense.

    A part begins with the one to four cells of about its size. A cell knows whether its lower
    left corner is inside, and cells with more than ``max_edges`` edges are cut in four: an edge
    goes to the quarters it meets, and a quarter's corner is inside if the way to it from the
    cell's corner crosses edges an odd number of times. Every level is one pass over the
    edges of the cells that are still too full; no polygon is ever one row.
    """
    e = rings.agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy")).first()
    extent = max((e["hx"] or 0.0) - (e["lx"] or 0.0), (e["hy"] or 0.0) - (e["ly"] or 0.0), 1e-9) if e["lx"] is not None else 1.0
    base = 1.0618 * extent  # so that points of few digits lie on no cell's border
    grid = Cells(None, [], (e["lx"] or 0.0) - 0.0271828 * extent, (e["ly"] or 0.0) - 0.0314159 * extent, base)
    col = {c: F.col(c) for c in _EDGE}
    x0, y0, size = grid.corner(F.col("cx"), F.col("level"), grid.ox), grid.corner(F.col("cy"), F.col("level"), grid.oy), grid.size(F.col("level"))

    box = rings.groupBy("poly", "part").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"))
    wide = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"), F.lit(base / 2**max_level))
    box = box.withColumn("level", F.floor(F.log2(base / wide)).cast("int"))
    at = lambda c, origin: F.floor((F.col(c) - origin) / grid.size(F.col("level")))
    roots = box.withColumn("cx", F.explode(F.sequence(at("lx", grid.ox), at("hx", grid.ox)))).withColumn("cy", F.explode(F.sequence(at("ly", grid.oy), at("hy", grid.oy)))).select(*_CELL)
    pairs = polygon_edges(rings).join(roots, ["poly", "part"]).withColumn("crossed", _right_of(col, x0, y0).cast("int"))

    leaves, levels = None, set()
    while True:
        pairs = written(pairs.withColumn("met", _touches(col, x0, y0, size)).filter("met or crossed > 0"))
        cells = pairs.groupBy(*_CELL).agg((F.sum("crossed") % 2 == 1).alias("odd"), F.count_if("met").alias("n"))
        full = (F.col("n") > max_edges) & (F.col("level") < max_level)
        some = cells.agg(F.collect_set("level").alias("levels"), F.max(full).alias("full")).first()
        done = cells.filter(~full & (F.col("odd") | (F.col("n") > 0)))
        levels |= set(some["levels"] or [])
        edges = F.collect_list(F.when(F.col("met"), F.struct(*_EDGE))).alias("edges")
        held = pairs if not some["full"] else pairs.join(done.select(*_CELL), _CELL, "left_semi")
        made = held.groupBy(*_CELL).agg((F.sum("crossed") % 2 == 1).alias("odd"), edges).filter(F.col("odd") | (F.size("edges") > 0))
        leaves = made if leaves is None else leaves.unionByName(made)
        if not some["full"]:
            grid.leaves, grid.levels = leaves, sorted(levels)
            return grid
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")
        split = pairs.filter("met").join(cells.filter(full).select(*_CELL), _CELL, "left_semi").select(*_CELL, *_EDGE, quarter)
        px, py = (grid.corner(F.col(c) * 2 + F.col(f"q.{k}"), F.col("level") + 1, o) for c, k, o in (("cx", "i", grid.ox), ("cy", "j", grid.oy)))
        crossed = _between(col, x0, y0, px, py)
        # a quarter's count is that of its cell's edges and, as one more row, whether the cell's corner is inside
        edges_of = split.select("poly", "part", (F.col("level") + 1).alias("level"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"), *_EDGE, crossed.alias("crossed"))
        corner = cells.filter(full & F.col("odd")).select(*_CELL, quarter)
        nowhere = [F.lit(float("-inf")).alias(c) for c in _EDGE]
        corner = corner.select("poly", "part", (F.col("level") + 1).alias("level"), (F.col("cx") * 2 + F.col("q.i")).alias("cx"), (F.col("cy") * 2 + F.col("q.j")).alias("cy"), *nowhere, F.lit(1).alias("crossed"))
        pairs = edges_of.unionByName(corner)


def point_in_polygon(points: DataFrame, rings: DataFrame, order: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """The first polygon (by ``order``: poly, ord) that holds each point: id, poly.

    Even-odd rule over all edges of a part, so holes count out. A point meets the cells that it
    lies in, one for each part nearby, and is inside if the cell's corner is and the way from
    there crosses the cell's few edges an even number of times, or the other way round. Points
    in no polygon have no row.
    """
    grid = polygon_cells(rings, max_edges)
    if not grid.levels:
        return points.select("id").join(order.select("poly").limit(0)).select("id", "poly")
    levels = F.explode(F.array(*map(F.lit, grid.levels)))
    at = lambda c, o: F.floor((F.col(c) - o) / grid.size(F.col("level")))
    here = points.select("id", "x", "y").withColumn("level", levels).withColumn("cx", at("x", grid.ox)).withColumn("cy", at("y", grid.oy))
    met = here.join(grid.leaves, ["level", "cx", "cy"])
    x0, y0 = grid.corner(F.col("cx"), F.col("level"), grid.ox), grid.corner(F.col("cy"), F.col("level"), grid.oy)
    ways = F.aggregate("edges", F.col("odd").cast("int"), lambda a, e: a + _between(e, x0, y0, F.col("x"), F.col("y")))
    inside = met.filter(ways % 2 == 1)
    return inside.join(order, "poly").groupBy("id").agg(F.min_by("poly", "ord").alias("poly"))


def zip_to_market(points: DataFrame, direct: DataFrame, rings: DataFrame, order: DataFrame) -> DataFrame:
    """id, market and method: the direct table first, then the polygon that holds the point;
    ``unresolved`` otherwise."""
    d = points.join(direct.select("id", F.col("market").alias("_m")), "id", "left")
    hit = d.filter(F.col("_m").isNotNull()).select("id", F.col("_m").alias("market"), F.lit("direct-table").alias("method"))
    rest = d.filter(F.col("_m").isNull()).select("id", "x", "y")
    found = point_in_polygon(rest, rings, order)
    more = rest.select("id").join(found, "id", "left").select("id", F.col("poly").alias("market"), F.when(F.col("poly").isNotNull(), "centroid-polygon").otherwise("unresolved").alias("method"))
    return hit.unionByName(more)
