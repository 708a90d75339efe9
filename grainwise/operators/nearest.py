"""The k nearest sites of every point, by a tree of cells that are split where sites are many.

A cell with more than ``LEAF`` sites is cut into 4 x 4 smaller ones, so the tree is deep in clusters and shallow elsewhere,
and empty cells don't exist. A point descends level by level, by equi-joins on the parent cell. Each cell keeps the number
of its sites and their bounding box, which give a least and a greatest distance to the point: once cells with k sites or
more lie within some distance, cells that begin beyond it are dropped. Only the leaves that are left are opened.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.functions.numeric import EARTH_KM, haversine_km, planar_degrees, radian_euclidean_km
from grainwise.session import cut_lineage

METRICS = {"haversine": haversine_km, "radian_euclidean": radian_euclidean_km, "planar": planar_degrees}

#: Sites of a cell that isn't split any further.
LEAF = 16
#: Cells of this size, in degrees, aren't split: distinct sites in one are within some ten centimetres.
FINEST = 4.0**-10
#: The top level has at most 2 x 2 cells and a level 16 times those above, so these levels have at most 16,384 rows.
SMALL_LEVELS = 4


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size)).cast("long")


def _located(df: DataFrame) -> DataFrame:
    return df.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


def cell_tree(sites: DataFrame, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the tree, coarse to fine, and the sites with the leaf they lie in.

    A level has lv, cy, cx, py, px (the parent cell), n, split and the box south, north, west, east. ``sites`` has t, ta, to;
    the result adds lv, cy and cx. Levels are stored; the driver reads the extent and whether any cell is still too full.
    """
    extent = sites.agg(F.min("ta"), F.max("ta"), F.min("to"), F.max("to")).first()
    if extent is None or extent[0] is None:
        return [], sites.limit(0).withColumns({"lv": F.lit(0), "cy": F.lit(0).cast("long"), "cx": F.lit(0).cast("long")})
    wide = max(extent[1] - extent[0], extent[3] - extent[2], FINEST)
    size = 4.0 ** math.ceil(math.log(wide, 4))
    size = size if size >= wide else size * 4
    levels, closed, lv, rows = [], None, 0, sites
    while True:
        placed = rows.withColumns({"lv": F.lit(lv), "cy": _cell(F.col("ta"), size), "cx": _cell(F.col("to"), size)})
        box = [F.min("ta").alias("south"), F.max("ta").alias("north"), F.min("to").alias("west"), F.max("to").alias("east")]
        nodes = placed.groupBy("lv", "cy", "cx").agg(F.count("*").alias("n"), *box)
        above = [F.floor(F.col(c) / 4).cast("long") if lv else F.lit(0).cast("long") for c in ("cy", "cx")]
        level = cut_lineage(nodes.withColumns({"py": above[0], "px": above[1], "split": (F.col("n") > leaf) & F.lit(size > FINEST)}))
        levels.append(level)
        placed = cut_lineage(placed.join(level.select("cy", "cx", "split"), ["cy", "cx"]))
        done = placed.where("NOT split").select("t", "ta", "to", "lv", "cy", "cx")
        closed = done if closed is None else closed.unionByName(done)
        if not level.where("split").take(1):
            return levels, closed
        rows, size, lv = placed.where("split").select("t", "ta", "to"), size / 4, lv + 1


def _box_distance(metric: str, far: bool) -> Column:
    """Bound of the distance from (la, lo) to any place in the box: the least one, or the greatest one if ``far``."""
    la, lo, south, north, west, east = (F.col(c) for c in ("la", "lo", "south", "north", "west", "east"))
    zero = F.lit(0.0)
    if far:
        dlat, dlon = F.greatest(F.abs(la - south), F.abs(la - north)), F.greatest(F.abs(lo - west), F.abs(lo - east))
    else:
        dlat, dlon = F.greatest(south - la, la - north, zero), F.greatest(west - lo, lo - east, zero)
    if metric != "haversine":
        return METRICS[metric](zero, zero, dlat, dlon)
    ends = [F.cos(F.radians(south)), F.cos(F.radians(north))]
    turn = F.lit(360.0)
    if far:
        dlon = F.least(dlon, F.lit(180.0))
        narrow = F.when((south <= 0) & (north >= 0), F.lit(1.0)).otherwise(F.greatest(*ends))
    else:
        inside = F.pmod(lo - west, turn) <= east - west
        dlon = F.when(inside, zero).otherwise(F.least(F.pmod(west - lo, turn), F.pmod(lo - east, turn)))
        narrow = F.least(*ends)
    h = F.pow(F.sin(F.radians(dlat) / 2), 2.0) + F.cos(F.radians(la)) * narrow * F.pow(F.sin(F.radians(dlon) / 2), 2.0)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.greatest(h, zero), F.lit(1.0))))


def leaves_in_reach(points: DataFrame, levels: list[DataFrame], k: int, metric: str) -> DataFrame:
    """la, lo and the leaf (lv, cy, cx) of every leaf that may hold one of the k nearest sites. ``points`` has distinct la, lo."""
    none = F.lit(0).cast("long")
    open_cells = points.select("la", "lo", F.lit(-1).alias("lv"), none.alias("cy"), none.alias("cx"), none.alias("n"), F.lit(0.0).alias("near"), F.lit(0.0).alias("far"))
    own = W.partitionBy("la", "lo")
    for depth, level in enumerate(levels):
        child = level.select(F.col("lv").alias("c_lv"), F.col("cy").alias("c_cy"), F.col("cx").alias("c_cx"), F.col("n").alias("c_n"), "py", "px", "south", "north", "west", "east")
        child = F.broadcast(child) if depth < SMALL_LEVELS else child
        # A leaf of a level above has no children and stays as it is.
        met = open_cells.join(child, (F.col("lv") == depth - 1) & (F.col("cy") == F.col("py")) & (F.col("cx") == F.col("px")), "left")
        found = F.col("c_lv").isNotNull()
        pick = lambda new, old: F.when(found, new).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
        met = met.select(
            "la", "lo", pick(F.col("c_lv"), "lv"), pick(F.col("c_cy"), "cy"), pick(F.col("c_cx"), "cx"), pick(F.col("c_n"), "n"),
            pick(_box_distance(metric, far=False), "near"), pick(_box_distance(metric, far=True), "far"),
        )
        # Cells up to this one hold at least k sites; a cell that begins further away holds none of the nearest.
        held = met.withColumn("held", F.sum("n").over(own.orderBy("far", "lv", "cy", "cx").rowsBetween(W.unboundedPreceding, W.currentRow)))
        limit = F.min(F.when(F.col("held") >= k, F.col("far"))).over(own)
        # The slack covers rounding of distances.
        open_cells = held.withColumn("limit", limit).where("limit IS NULL OR near <= limit * 1.000001 + 1e-8").drop("held", "limit")
    return open_cells.select("la", "lo", "lv", "cy", "cx")


def candidates(points: DataFrame, sites: DataFrame, k: int, metric: str, leaf: int = LEAF, digits: int = 9) -> DataFrame:
    """la, lo, t and the rounded distance d of every site in the leaves in reach of a point. ``points`` has distinct la, lo."""
    levels, placed = cell_tree(sites, leaf)
    if not levels:
        return points.join(placed.select("t"), F.lit(False)).select("la", "lo", "t", F.lit(0.0).alias("d"))
    reach = leaves_in_reach(points, levels, k, metric)
    d = F.round(METRICS[metric](F.col("la"), F.col("lo"), F.col("ta"), F.col("to")), digits)
    return reach.join(placed, ["lv", "cy", "cx"]).select("la", "lo", "t", d.alias("d"))


def k_nearest(
    src: DataFrame, tgt: DataFrame, src_id: str, tgt_id: str, k: int = 1, metric: str = "haversine", exclude_self: bool = False,
    leaf: int = LEAF, digits: int = 9,
) -> DataFrame:
    """The k nearest targets of every source point: (src_id, tgt_id, distance, rank); ties go to the smallest id.

    A point with fewer than k targets has fewer rows; one without coordinates (NULL or NaN), or without any target, has one
    row of NULLs. ``exclude_self`` leaves out the target with the point's own id. Repeated rows of ``src`` are answered each
    (under ``exclude_self`` once), targets without coordinates are nobody's neighbours. Points of equal coordinates descend
    as one, and of the targets at one place only as many first ids take part as can be
    among the nearest.
    """
    want = k + 1 if exclude_self else k
    sites = _located(tgt).select(F.col(tgt_id).alias("t"), F.col("lat").cast("double").alias("ta"), F.col("lon").cast("double").alias("to")).distinct()
    here = W.partitionBy("ta", "to").orderBy("t")
    sites = cut_lineage(sites.withColumn("r", F.row_number().over(here)).where(F.col("r") <= want).drop("r"))
    points = _located(src).select(F.col("lat").cast("double").alias("la"), F.col("lon").cast("double").alias("lo")).distinct()
    by_distance = W.partitionBy("la", "lo").orderBy("d", "t")
    best = candidates(points, sites, want, metric, leaf, digits).withColumn("rank", F.row_number().over(by_distance).cast("long")).where(F.col("rank") <= want)
    every = src.select(F.col(src_id).alias("s"), F.col("lat").cast("double").alias("s_la"), F.col("lon").cast("double").alias("s_lo"))
    if not exclude_self:
        out = every.join(best, (F.col("s_la") == F.col("la")) & (F.col("s_lo") == F.col("lo")), "left")
    else:
        every = every.distinct()
        out = every.join(best, (F.col("s_la") == F.col("la")) & (F.col("s_lo") == F.col("lo")) & (F.col("s") != F.col("t")), "left").drop("rank")
        own = W.partitionBy("s", "s_la", "s_lo").orderBy("d", "t")
        out = out.withColumn("rank", F.when(F.col("t").isNotNull(), F.row_number().over(own).cast("long"))).where(F.col("rank").isNull() | (F.col("rank") <= k))
    return out.select(F.col("s").alias(src_id), F.col("t").alias(tgt_id), F.col("d").alias("distance"), "rank")
