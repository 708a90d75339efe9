"""Spatial operators as equi-joins on grid cells: nearest site, zonal shares,
grid sampling and distance-weighted surfaces. No cross join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.operators import nearest, ordering
from grainwise.operators.profile import ratio


def nearest_neighbor(src: DataFrame, tgt: DataFrame, src_id: str, tgt_id: str, metric: str = "haversine", exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """Nearest target of every source point: (src_id, tgt_id, distance); see :func:`grainwise.operators.nearest.k_nearest`."""
    return nearest.k_nearest(src, tgt, src_id, tgt_id, 1, metric, exclude_self, digits=digits).drop("rank")


def zonal_fractions(pixels: DataFrame, zone: Sequence[str], code: str, groups: Mapping[str, Sequence[int]], nodata: Sequence[int] = (0,), digits: int = 4) -> DataFrame:
    """Share of every class group per zone; the total leaves out nodata pixels. Groups may overlap."""
    counts = pixels.where(~F.col(code).isin(*nodata)).groupBy(*zone, code).agg(F.count("*").alias("c"))
    share = lambda codes: ratio(F.sum(F.when(F.col(code).isin(*codes), F.col("c")).otherwise(0)), F.sum("c"))
    return counts.groupBy(*zone).agg(F.sum("c").alias("n_pixels"), *[F.round(share(v), digits).alias(f"pct_{k}") for k, v in groups.items()])


def sample_grid(points: DataFrame, cells: DataFrame, origin: tuple[float, float], step: float, on: Sequence[str], nodata: float) -> DataFrame:
    """Value of the grid cell under each point; nodata becomes NULL."""
    keyed = points.withColumns({"cell_x": F.floor((F.col("lon") - origin[0]) / step).cast("long"), "cell_y": F.floor((F.col("lat") - origin[1]) / step).cast("long")})
    return keyed.join(cells.withColumn("v", F.nullif("v", F.lit(nodata))), ["cell_x", "cell_y", *on], "left")


def idw_grid(sites: DataFrame, value: str, origin: tuple[float, float], step: float, shape: tuple[int, int], radius: int) -> DataFrame:
    """Inverse-distance-squared surface on a regular grid, by scattering.

    Every site adds its weight to the grid nodes within ``radius`` steps - a fixed number of rows per
    site - and nodes sum them with map-side combine. A site on a node counts with a tiny distance.
    Every node of the grid is in the result; those beyond all sites have a NULL value.
    """
    ix, iy = F.rint((F.col("lon") - origin[0]) / step).cast("long"), F.rint((F.col("lat") - origin[1]) / step).cast("long")
    offsets = F.sequence(F.lit(-radius).cast("long"), F.lit(radius).cast("long"))
    s = sites.where(F.col(value).isNotNull()).select("lat", "lon", F.col(value).alias("v"), ix.alias("ix"), iy.alias("iy"), F.explode(offsets).alias("dx"))
    s = s.withColumn("dy", F.explode(offsets)).select("lat", "lon", "v", (F.col("ix") + F.col("dx")).alias("gx"), (F.col("iy") + F.col("dy")).alias("gy"))
    grid = sites.sparkSession.range(shape[0] * shape[1]).select((F.col("id") % shape[0]).alias("gx"), F.expr(f"id div {shape[0]}").alias("gy"))
    s = s.where(F.col("gx").between(0, shape[0] - 1) & F.col("gy").between(0, shape[1] - 1))
    d2 = F.pow(F.col("lon") - (origin[0] + F.col("gx") * step), F.lit(2.0)) + F.pow(F.col("lat") - (origin[1] + F.col("gy") * step), F.lit(2.0))
    w = 1.0 / F.greatest(d2, F.lit(1e-9))
    near = s.groupBy("gx", "gy").agg(F.count("*").alias("n_sites"), (F.sum(w * F.col("v")) / F.sum(w)).alias("value"))
    return grid.join(near, ["gx", "gy"], "left").withColumn("n_sites", F.coalesce("n_sites", F.lit(0).cast("long")))


def display_range(surface: DataFrame, value: str = "value", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """The surface with its values clipped to the given quantiles, so that a few extremes don't set the colour scale."""
    q = ordering.exact_quantiles(surface, value, {"_low": low, "_high": high}).select("_low", "_high").first()
    if q is None:
        return surface
    return surface.withColumn(value, F.when(F.col(value).isNotNull(), F.greatest(F.least(F.col(value), F.lit(q["_high"])), F.lit(q["_low"]))))
