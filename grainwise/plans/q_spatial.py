"""Queries for spatial joins and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.operators import nearest, ordering, polygons, spatial
from grainwise.plans.registry import query
from grainwise.sources import views
from grainwise.sources.tables import table

HAV = "2 * 6371.0088 * asin(sqrt(least(power(sin(radians(g.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - s.lon) / 2), 2), 1)))"


def _nearest_sql(dist: str, tgt: str = "v_gauge", tid: str = "gauge", extra: str = "") -> str:
    return f"""SELECT station, {tid}_id AS nearest, round(d, 5) AS distance FROM (SELECT s.station, g.{tid} AS {tid}_id, {dist} AS d,
      row_number() OVER (PARTITION BY s.station ORDER BY round({dist}, 9), g.{tid}) AS rn FROM v_station s JOIN {tgt} g ON true {extra}) WHERE rn = 1"""


def _shape(df, target):
    return df.select("station", F.col(target).alias("nearest"), F.round("distance", 5).alias("distance"))


@query("nearest_neighbor", _nearest_sql(HAV))
def nearest_neighbor(spark, sf):
    return _shape(spatial.nearest_neighbor(views.station(spark, sf), views.gauge(spark, sf), "station", "gauge"), "gauge")


@query("nearest_radian_euclidean", _nearest_sql("2 * 6371.0 * asin(least(sqrt(power(radians(g.lat - s.lat), 2) + power(radians(g.lon - s.lon), 2)) / 2, 1))"))
def nearest_radian_euclidean(spark, sf):
    return _shape(spatial.nearest_neighbor(views.station(spark, sf), views.gauge(spark, sf), "station", "gauge", metric="radian_euclidean"), "gauge")


@query("nearest_planar", _nearest_sql("sqrt(power(g.lat - s.lat, 2) + power(g.lon - s.lon, 2))"))
def nearest_planar(spark, sf):
    return _shape(spatial.nearest_neighbor(views.station(spark, sf), views.gauge(spark, sf), "station", "gauge", metric="planar"), "gauge")


@query(
    "nearest_three",
    f"""SELECT station, gauge_id AS nearest, round(d, 5) AS distance, rn AS rank FROM (SELECT s.station, g.gauge AS gauge_id, {HAV} AS d,
      row_number() OVER (PARTITION BY s.station ORDER BY round({HAV}, 9), g.gauge) AS rn FROM v_station s JOIN v_gauge g ON true) WHERE rn <= 3""",
)
def nearest_three(spark, sf):
    out = nearest.k_nearest(views.station(spark, sf), views.gauge(spark, sf), "station", "gauge", 3)
    return out.select("station", F.col("gauge").alias("nearest"), F.round("distance", 5).alias("distance"), "rank")


@query(
    "neighbour_distance",
    f"""SELECT count(*) AS n, round(median(d), 5) AS median_km, round(quantile_cont(d, 0.25), 5) AS p25_km, round(quantile_cont(d, 0.75), 5) AS p75_km FROM
        (SELECT s.station, min({HAV}) AS d FROM v_station s JOIN v_station g ON s.station <> g.station GROUP BY 1)""",
)
def neighbour_distance(spark, sf):
    st = views.station(spark, sf).select("station", "lat", "lon")
    nn = spatial.nearest_neighbor(st, st.withColumnRenamed("station", "other"), "station", "other", exclude_self=True)
    q = ordering.exact_quantiles(nn, "distance", {"median_km": 0.5, "p25_km": 0.25, "p75_km": 0.75})
    return q.select("n", *[F.round(c, 5).alias(c) for c in ("median_km", "p25_km", "p75_km")])


@query(
    "point_in_polygon",
    """SELECT station, CAST(min(zone) AS DOUBLE) AS zone FROM (SELECT s.station, h.zone FROM v_station s LEFT JOIN (SELECT p.station, e.zone FROM v_station p JOIN v_zone_edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
         AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1) h ON s.station = h.station) GROUP BY 1""",
)
def point_in_polygon(spark, sf):
    out = polygons.point_in_polygon(views.station(spark, sf), views.zones(spark, sf), "station", "zone")
    return out.select("station", F.col("zone").cast("double"))


_M = f"{polygons.METRES!r}::DOUBLE"


@query(
    "nearest_polygon_fallback",
    f"""WITH h AS (SELECT p.station, e.zone FROM v_station p JOIN v_zone_edges e ON (e.y1 > p.lat) <> (e.y2 > p.lat)
           AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1),
         w AS (SELECT s.station, lat, lon, min(h.zone) AS zone FROM v_station s LEFT JOIN h ON h.station = s.station GROUP BY 1, 2, 3),
         c AS (SELECT w.station, e.zone, (x1 - lon) * cos(radians(lat)) * {_M} AS ax, (y1 - lat) * {_M} AS ay, (x2 - lon) * cos(radians(lat)) * {_M} AS bx, (y2 - lat) * {_M} AS by_
               FROM w, v_zone_edges e WHERE w.zone IS NULL),
         t AS (SELECT *, greatest(0, least(1, -(ax * (bx - ax) + ay * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM c),
         d AS (SELECT station, zone, round(sqrt(power(ax + t * (bx - ax), 2) + power(ay + t * (by_ - ay), 2)), 6) AS d FROM t),
         b AS (SELECT station, min(d) AS d, arg_min(zone, (d, zone)) AS zone FROM d WHERE d <= 500 GROUP BY 1)
       SELECT w.station, CAST(coalesce(w.zone, b.zone) AS DOUBLE) AS zone, CASE WHEN w.zone IS NOT NULL THEN 'within' WHEN b.zone IS NOT NULL THEN 'nearest' ELSE 'none' END AS match_method,
              CASE WHEN w.zone IS NOT NULL THEN 0 ELSE round(b.d, 3) END AS dist_m FROM w LEFT JOIN b ON b.station = w.station""",
)
def nearest_polygon_fallback(spark, sf):
    out = polygons.nearest_polygon_fallback(views.station(spark, sf).select("station", "lat", "lon"), views.zones(spark, sf), "station", "zone", 500.0)
    return out.select("station", F.col("zone").cast("double"), "match_method", F.round("dist_m", 3).alias("dist_m"))


# Overlapping class groups of the demonstration raster.
CLASS_GROUPS = {"corn": [1], "soybean": [5], "row_crops": [1, 5], "pasture": [7, 8], "other": [8, 9, 10]}
_ZF = ", ".join(f"round(count(*) FILTER (WHERE code IN ({', '.join(map(str, v))})) / count(*), 4) AS pct_{k}" for k, v in CLASS_GROUPS.items())


@query("zonal_fractions", f"SELECT zone, year, count(*) AS n_pixels, {_ZF} FROM v_pixels WHERE code <> 0 GROUP BY 1, 2")
def zonal_fractions(spark, sf):
    return spatial.zonal_fractions(views.pixels(spark, sf), ["zone", "year"], "code", CLASS_GROUPS)


@query(
    "sample_grid",
    """WITH c AS (SELECT s_suppkey % 13 AS cell_x, s_suppkey % 7 AS cell_y, max(s_acctbal) AS v FROM supplier GROUP BY 1, 2)
       SELECT station, CASE WHEN v <> -1 THEN v END AS v FROM v_station LEFT JOIN c ON CAST(floor((lon + 96.6::DOUBLE) / 0.5::DOUBLE) AS BIGINT) = cell_x AND CAST(floor((lat - 40.4::DOUBLE) / 0.5::DOUBLE) AS BIGINT) = cell_y""",
)
def sample_grid(spark, sf):
    cells = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 13).alias("cell_x"), (F.col("s_suppkey") % 7).alias("cell_y")).agg(F.max("s_acctbal").alias("v"))
    return spatial.sample_grid(views.station(spark, sf), cells, (-96.6, 40.4), 0.5, [], -1.0).select("station", "v")


@query(
    "idw_grid",
    """WITH s AS (SELECT lat, lon, balance AS v, CAST(round_even((lon + 96.6::DOUBLE) / 0.2::DOUBLE, 0) AS BIGINT) AS ix, CAST(round_even((lat - 40.4::DOUBLE) / 0.2::DOUBLE, 0) AS BIGINT) AS iy FROM v_station),
       o AS (SELECT unnest(range(-2, 3)) AS d), g AS (SELECT lat, lon, v, ix + a.d AS gx, iy + b.d AS gy FROM s, o a, o b),
       w AS (SELECT *, 1 / greatest(power(lon - (-96.6::DOUBLE + gx * 0.2::DOUBLE), 2) + power(lat - (40.4::DOUBLE + gy * 0.2::DOUBLE), 2), 1e-9) AS w FROM g WHERE gx BETWEEN 0 AND 32 AND gy BETWEEN 0 AND 16),
       n AS (SELECT gx, gy, count(*) AS n_sites, sum(w * v) / sum(w) AS value FROM w GROUP BY 1, 2), q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM n),
       f AS (SELECT x.gx, y.gy FROM (SELECT unnest(range(0, 33)) AS gx) x, (SELECT unnest(range(0, 17)) AS gy) y)
       SELECT f.gx, f.gy, coalesce(n_sites, 0) AS n_sites, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END, 4) AS value FROM f LEFT JOIN n ON f.gx = n.gx AND f.gy = n.gy, q""",
)
def idw_grid(spark, sf):
    out = spatial.idw_grid(views.station(spark, sf), "balance", (-96.6, 40.4), 0.2, (33, 17), 2)
    return spatial.display_range(out).withColumn("value", F.round("value", 4))
