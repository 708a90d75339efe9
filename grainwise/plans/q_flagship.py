"""Flagship: long raw measurements to a wide, station-enriched daily sample table."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions import cleaning as c
from grainwise.operators import cleaning as ops
from grainwise.operators import contracts, reshape
from grainwise.plans.q_cleaning import UNIT_FACTORS
from grainwise.plans.q_joins import WIDE_UNITS
from grainwise.plans.registry import query
from grainwise.sources import views

BOUNDS = {p: (0.001, 400.0) for p in views.PARAMETERS}


def wide_samples(spark, sf):
    """Numbers only, compatible units, plausible values, replicates collapsed, one column pair per parameter."""
    m = views.measure(spark, sf).withColumn("value", c.to_number("raw")).where("value IS NOT NULL")
    m = ops.range_drop(ops.standardize_units(m, UNIT_FACTORS), BOUNDS, "parameter", "value")
    m = m.select("station", F.date_format("ts", "yyyy-MM-dd").alias("day"), "parameter", "value")
    med = reshape.replicate_median(m, ["station", "day", "parameter"], "value")
    return reshape.pivot_with_units(med, ["station", "day"], "parameter", "value", WIDE_UNITS)


_COLS = ", ".join(f"round(max(v) FILTER (WHERE parameter = '{p}'), 6) AS {p}_value" for p in WIDE_UNITS)


@query(
    "flagship",
    f"""WITH s AS (SELECT station, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, parameter,
         TRY_CAST(trim(raw) AS DOUBLE) * CASE unit WHEN 'mg/L' THEN 1.0 WHEN 'ug/L' THEN 0.001 WHEN 'g/m2' THEN 0.5 END AS value FROM v_measure WHERE unit IN ('mg/L', 'ug/L', 'g/m2')),
       w AS (SELECT station, day, {_COLS} FROM (SELECT station, day, parameter, median(value) AS v FROM s WHERE value BETWEEN 0.001 AND 400 GROUP BY 1, 2, 3) GROUP BY 1, 2)
       SELECT w.*, site_type, region, round(lat, 6) AS lat, round(lon, 6) AS lon FROM w LEFT JOIN v_station USING (station)""",
)
def flagship(spark, sf):
    wide = wide_samples(spark, sf).select("station", "day", *[F.round(f"{p}_value", 6).alias(f"{p}_value") for p in WIDE_UNITS])
    st = views.station(spark, sf).select("station", "site_type", "region", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return contracts.grain_safe_join(wide, st, ["station"])
