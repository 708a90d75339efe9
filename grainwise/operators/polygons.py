"""Polygon operators on an index of edges: containment, and the nearest outline within a limit.

Cells are squares of a grid. An edge is listed once per cell that it crosses, and a cell inside a ring carries nothing
but the zone, so the index grows with edges and covered cells; no ring is copied. All joins are equalities on cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.numeric import EARTH_KM

#: Where the grid lines of the containment index lie, off round coordinates, where ring corners tend to be.
GRID_SHIFT = 0.00217318
#: Slack in degrees when edges are listed: a cell too many does no harm.
SLACK = 1e-9
METRES = EARTH_KM * 1000.0 * math.pi / 180.0


def ring_edges(polygons: DataFrame, zone: str) -> DataFrame:
    """(zone, x1, y1, x2, y2): the edges of each ring, the closing one included; edges without length are left out."""
    ring = polygons.select(F.col(zone).alias("zone"), "ring", F.posexplode("ring").alias("_i", "_a"))
    after = F.get("ring", F.pmod(F.col("_i") + 1, F.size("ring")))
    edges = ring.select("zone", F.col("_a.lon").alias("x1"), F.col("_a.lat").alias("y1"), after["lon"].alias("x2"), after["lat"].alias("y2"))
    return edges.where("x1 <> x2 OR y1 <> y2")


def _crossing_x(y: Column) -> Column:
    """Where an edge meets the horizontal line ``y`` (NULL if it is horizontal itself)."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")


def _listed(edges: DataFrame, step: float, shift: float, width) -> DataFrame:
    """One row per edge and cell (cy, cx) that it may cross; ``width`` gives the cell width of a row of cells."""
    row = lambda y: F.floor((y - shift) / step).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(row(low - SLACK), row(high + SLACK))))
    inside = lambda y: F.least(F.greatest(y, low), high)
    bottom, top = inside(F.col("cy") * step + shift), inside((F.col("cy") + 1) * step + shift)
    a, b = F.coalesce(_crossing_x(bottom), "x1"), F.coalesce(_crossing_x(top), "x2")
    column = lambda x: F.floor((x - shift) / width(F.col("cy"))).cast("long")
    return rows.withColumn("cx", F.explode(F.sequence(column(F.least(a, b) - SLACK), column(F.greatest(a, b) + SLACK))))


def covering(polygons: DataFrame, zone: str, cell: float) -> tuple[DataFrame, DataFrame]:
    """The index of a set of rings: (zone, cy, cx) of the cells whose upper right corner is inside, and the listed edges."""
    edges = ring_edges(polygons, zone)
    listed = _listed(edges, cell, GRID_SHIFT, lambda _: F.lit(cell))
    # Upper sides of the rows: each edge crosses such a line once at most, and crossings pair up to inner stretches.
    line = lambda y: F.ceil((y - GRID_SHIFT) / cell).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    lines = edges.withColumn("top", F.explode(F.sequence(line(low) - 1, line(high) + 1)))
    at = F.col("top") * cell + GRID_SHIFT
    crossed = lines.where((F.col("y1") > at) != (F.col("y2") > at)).select("zone", "top", _crossing_x(at).alias("x"))
    stretches = crossed.groupBy("zone", "top").agg(F.sort_array(F.collect_list("x")).alias("x"))
    pair = F.expr("transform(sequence(1, size(x) div 2), k -> named_struct('a', x[2 * k - 2], 'b', x[2 * k - 1]))")
    stretches = stretches.select("zone", (F.col("top") - 1).alias("cy"), F.inline(pair))
    # Corners at or right of a and left of b; the corner of column cx lies at (cx + 1) * cell.
    corner = lambda x: F.ceil((x - GRID_SHIFT) / cell).cast("long") - 1
    stretches = stretches.where(corner(F.col("a")) < corner(F.col("b")))
    inner = stretches.select("zone", "cy", F.explode(F.sequence(corner(F.col("a")), corner(F.col("b")) - 1)).alias("cx"))
    return inner, listed


def point_in_polygon(points: DataFrame, polygons: DataFrame, point_id: str, zone: str, cell: float = 0.25) -> DataFrame:
    """Left join of points to the polygon around them; the smallest zone id wins an overlap.

    A point is inside if the upper right corner of its cell is, but for each edge that the way there crosses: right to the
    side of the cell, then up. Only edges of the cell can, and they are counted by a partial sum.
    """
    inner, listed = covering(polygons, zone, cell)
    keyed = points.select(F.col(point_id).alias("_p"), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    keyed = keyed.withColumns({"cy": F.floor((F.col("_y") - GRID_SHIFT) / cell).cast("long"), "cx": F.floor((F.col("_x") - GRID_SHIFT) / cell).cast("long")}).where("cy IS NOT NULL AND cx IS NOT NULL")
    side, top = (F.col("cx") + 1) * cell + GRID_SHIFT, (F.col("cy") + 1) * cell + GRID_SHIFT
    met = keyed.join(listed, ["cy", "cx"])
    x = _crossing_x(F.col("_y"))
    right = ((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))) & (F.col("_x") < x) & (x <= side)
    y = (F.col("y2") - F.col("y1")) * (side - F.col("x1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)) + F.col("y1")
    up = ((F.col("x1") > side) != (F.col("x2") > side)) & (F.col("_y") < y) & (y <= top)
    crossed = met.select("_p", "zone", (right.cast("int") + F.coalesce(up, F.lit(False)).cast("int")).alias("n"))
    corners = keyed.join(inner, ["cy", "cx"]).select("_p", "zone", F.lit(1).alias("n"))
    inside = crossed.unionByName(corners).groupBy("_p", "zone").agg(F.sum("n").alias("n")).where("n % 2 = 1")
    best = inside.groupBy("_p").agg(F.min("zone").alias(zone)).withColumnRenamed("_p", point_id)
    return points.join(best, point_id, "left")


def segment_distance_m(lat: Column, lon: Column) -> Column:
    """Metres from a point to the edge (x1, y1, x2, y2), in a plane that touches the globe at the point."""
    east = F.cos(F.radians(lat)) * METRES
    ax, ay = (F.col("x1") - lon) * east, (F.col("y1") - lat) * METRES
    bx, by = (F.col("x2") - lon) * east, (F.col("y2") - lat) * METRES
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    px, py = ax + t * dx, ay + t * dy
    return F.sqrt(px * px + py * py)


def nearest_outline(points: DataFrame, polygons: DataFrame, point_id: str, zone: str, max_m: float, digits: int = 6) -> DataFrame:
    """(point_id, zone, dist_m) of the nearest outline within ``max_m`` metres; ties go to the smallest zone.

    Edges are listed in cells at least as high and as wide as the limit. A point probes the cells that its circle can
    touch, three rows of two or three, so what it meets depends on the edges near it alone. The distance of an edge is
    rounded to ``digits`` before it is compared. Outlines don't reach across the 180th meridian.
    """
    step = max_m / METRES * 1.01

    def width(row: Column) -> Column:
        """The limit in degrees of longitude at the side of the row that is further from the equator."""
        far = F.least(F.greatest(F.abs(row), F.abs(row + 1)) * step, F.lit(89.0))
        return F.lit(step) / F.cos(F.radians(far))

    listed = _listed(ring_edges(polygons, zone), step, 0.0, width)
    probes = points.select(F.col(point_id).alias("_p"), F.col("lat").alias("_y"), F.col("lon").alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    row = F.floor(F.col("_y") / step).cast("long")
    probes = probes.withColumn("cy", F.explode(F.sequence(row - 1, row + 1)))
    # The circle's reach in longitude, at the row's far side or the point's own, whichever is wider.
    reach = F.greatest(width(F.col("cy")), F.lit(step) / F.cos(F.radians(F.least(F.abs(F.col("_y")), F.lit(89.0)))))
    column = lambda x: F.floor(x / width(F.col("cy"))).cast("long")
    probes = probes.withColumn("cx", F.explode(F.sequence(column(F.col("_x") - reach), column(F.col("_x") + reach))))
    met = probes.join(listed, ["cy", "cx"]).select("_p", "zone", F.round(segment_distance_m(F.col("_y"), F.col("_x")), digits).alias("d")).where(F.col("d") <= max_m)
    best = met.groupBy("_p").agg(F.min(F.struct("d", "zone")).alias("_b"))
    return best.select(F.col("_p").alias(point_id), F.col("_b.zone").alias(zone), F.col("_b.d").alias("dist_m"))


def nearest_polygon_fallback(points: DataFrame, polygons: DataFrame, point_id: str, zone: str, max_m: float = 500.0, cell: float = 0.25) -> DataFrame:
    """Every point with its zone, ``match_method`` (within, nearest, or none) and ``dist_m`` (0 within, NULL for none).

    ``points`` have one row per id.
    """
    inside = point_in_polygon(points, polygons, point_id, zone, cell)
    outside = inside.where(F.col(zone).isNull()).drop(zone)
    near = nearest_outline(outside, polygons, point_id, zone, max_m)
    snapped = outside.join(near, point_id, "left").withColumn("match_method", F.when(F.col(zone).isNotNull(), "nearest").otherwise("none"))
    within = inside.where(F.col(zone).isNotNull()).withColumns({"match_method": F.lit("within"), "dist_m": F.lit(0.0)})
    return within.unionByName(snapped)
