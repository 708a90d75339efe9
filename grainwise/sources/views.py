"""Monitoring-style views over the given tables (their SQL twins are in plans/sqlviews.py).

The given tables carry no units, codes, coordinates or gaps, so each view derives them from
row keys with integer arithmetic. Every view covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.sources.tables import table

PARAMETERS = ["click", "error", "purchase", "signup", "view"]
UNITS = ["mg/L", "ug/L", "deg F", "", "g/m2"]
PANEL_YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
BASE_YEARS = [1995, 1997, 2000]
BOX = {"lat": (40.4, 43.7), "lon": (-96.6, -90.2)}

# name -> (value expression over lineitem, presence condition)
CHEMISTRY = {
    "dissolved_oxygen": ("2 + l_quantity * 0.16", "(l_partkey + l_suppkey) % 5 < 4"),
    "ph": ("5 + l_quantity * 0.12", "(l_partkey * 3 + l_suppkey) % 7 < 5"),
    "e_coli": ("1 + l_extendedprice * 0.03", "(l_partkey * 5 + l_suppkey) % 3 < 1"),
    "nitrate": ("l_quantity * 0.6", "(l_partkey + l_suppkey * 3) % 4 < 2"),
    "nitrate_nitrite": ("l_quantity * 0.5", "(l_partkey * 7 + l_suppkey) % 6 < 2"),
    "nitrite": ("l_tax * 30", "(l_partkey + l_suppkey * 5) % 8 < 1"),
    "ammonia": ("l_discount * 60", "(l_partkey + l_suppkey * 7) % 9 < 3"),
    "kjeldahl": ("l_quantity * 0.13", "(l_partkey * 11 + l_suppkey) % 10 < 2"),
    "total_phosphorus": ("l_tax * 5", "(l_partkey + l_suppkey * 2) % 5 < 2"),
    "orthophosphate": ("l_discount * 3", "(l_partkey * 2 + l_suppkey) % 6 < 1"),
    "phosphate": ("l_tax * 6", "(l_partkey * 4 + l_suppkey) % 7 < 1"),
    "chloride": ("l_quantity * 10", "(l_partkey + l_suppkey * 4) % 3 < 1"),
    "sulfate": ("l_quantity * 12", "(l_partkey * 6 + l_suppkey) % 8 < 1"),
    "tds": ("l_extendedprice * 0.02", "(l_partkey * 8 + l_suppkey) % 9 < 1"),
    "conductance": ("l_extendedprice * 0.03", "(l_partkey + l_suppkey * 6) % 4 < 1"),
    "turbidity": ("l_quantity * 2.5", "(l_partkey * 9 + l_suppkey) % 5 < 2"),
    "tss": ("l_quantity * 3", "(l_partkey + l_suppkey * 8) % 6 < 2"),
    "chlorophyll": ("l_quantity * 1.1", "(l_partkey * 10 + l_suppkey) % 7 < 1"),
    "microcystin": ("l_discount * 180", "(l_partkey + l_suppkey * 9) % 8 < 1"),
    "atrazine": ("l_tax * 150", "(l_partkey * 12 + l_suppkey) % 9 < 2"),
    "water_temp": ("10 + l_quantity * 0.5", "(l_partkey + l_suppkey * 10) % 4 < 3"),
}


def measure(spark: SparkSession, sf: str) -> DataFrame:
    """Long measurement table: one row per event, with unit, raw text and gappy value."""
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "user_id AS station",
        "ts",
        "event_type AS parameter",
        "CASE event_id % 5 WHEN 0 THEN 'mg/L' WHEN 1 THEN 'ug/L' WHEN 2 THEN 'deg F' WHEN 3 THEN '' ELSE 'g/m2' END AS unit",
        "CASE WHEN event_id % 23 = 0 THEN 'sunny' WHEN event_id % 17 = 0 THEN '(D)' ELSE CAST(value AS STRING) END AS raw",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS val",
    )


def _site(df: DataFrame, key: str, lat_mul: int, lon_mul: int, *extra: str) -> DataFrame:
    return df.selectExpr(
        f"{key}",
        *extra,
        f"CAST(40.4 AS DOUBLE) + CAST({key} * {lat_mul} % 3300 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat",
        f"CAST(-96.6 AS DOUBLE) + CAST({key} * {lon_mul} % 6400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon",
    )


def station(spark: SparkSession, sf: str) -> DataFrame:
    """Station dimension: one row per customer, with coordinates and a 12-digit region code."""
    df = _site(
        table(spark, sf, "customer"), "c_custkey", 7919, 104729,
        "c_name AS station_name", "c_mktsegment AS site_type", "CAST(c_nationkey AS BIGINT) AS region",
        "c_acctbal AS balance",
    )
    return df.withColumnRenamed("c_custkey", "station").withColumn(
        "code12", F.expr("lpad(CAST(station * 10007 AS STRING), 12, '0')")
    )


def gauge(spark: SparkSession, sf: str) -> DataFrame:
    """Gauge dimension: one row per supplier, with coordinates."""
    df = _site(
        table(spark, sf, "supplier"), "s_suppkey", 6007, 15013,
        "s_name AS gauge_name", "CAST(s_nationkey AS BIGINT) AS region",
    )
    return df.withColumnRenamed("s_suppkey", "gauge")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Long region-year panel: quantity by return flag and line status."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("year")
    )
    su = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("region"))
    per_supplier = li.groupBy("l_suppkey", "year", "l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("c")
    )
    return (
        per_supplier.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("region", "year", F.col("l_returnflag").alias("commodity"), F.col("l_linestatus").alias("statistic"))
        .agg(F.sum("q").alias("value"), F.sum("c").alias("n"))
    )


def panel_year(spark: SparkSession, sf: str) -> DataFrame:
    """Region-year totals by commodity, wide: kg_a, kg_n, kg_r."""
    return panel(spark, sf).groupBy("region", "year").agg(
        *[F.sum(F.when(F.col("commodity") == c, F.col("value"))).alias(f"kg_{c.lower()}") for c in "ANR"]
    )


def discharge_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Permit monitoring reports: one row per line item."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS permit",
        "CAST(year(l_shipdate) AS BIGINT) AS fiscal_year",
        "CAST(l_linenumber AS BIGINT) AS outfall",
        "l_partkey AS parameter",
        "CASE WHEN l_discount > 0.05 THEN l_discount END AS exceed_pct",
        "CASE WHEN l_tax > 0 THEN l_tax * 100 END AS days_late",
        "l_returnflag AS violation",
        "l_shipdate AS period_end",
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Categorical raster as a pixel table: zone, class code, year."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS zone", "l_partkey % 20 AS code", "CAST(year(l_shipdate) AS BIGINT) AS year"
    )


def chemistry(spark: SparkSession, sf: str) -> DataFrame:
    """Wide sample table with twenty gappy water-quality parameters and a temperature."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS station", "l_orderkey AS sample_id", "CAST(l_linenumber AS BIGINT) AS replicate",
        "l_shipdate AS ts", "l_extendedprice AS covariate",
        *[f"CASE WHEN {present} THEN {expr} END AS {name}" for name, (expr, present) in CHEMISTRY.items()],
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Modelling rows: two targets, five features, the cluster they repeat in."""
    li = table(spark, sf, "lineitem")
    pa = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    od = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return (
        li.join(pa, F.col("l_partkey") == F.col("p_partkey"))
        .join(od, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "o_custkey AS cluster", "l_orderkey", "CAST(l_linenumber AS BIGINT) AS l_linenumber", "l_shipdate AS ts",
            "l_extendedprice AS price", "l_discount AS disc", "l_quantity AS qty", "CAST(p_size AS DOUBLE) AS psize",
            "p_retailprice AS retail", "o_totalprice AS total", "CAST(dayofyear(l_shipdate) AS DOUBLE) AS doy",
            "p_type", "o_orderpriority",
        )
    )


TARGETS = ["price", "disc"]
FEATURES = ["qty", "psize", "retail", "total", "doy"]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Long (target, feature) pairs of the modelling rows: y, x and the cluster."""
    cells = [
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(t).alias("y"), F.col(f).alias("x"))
        for t in TARGETS
        for f in FEATURES
    ]
    return features(spark, sf).select("cluster", F.inline(F.array(*cells)))


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """A 5 x 5 tiling of the station box: even zones are rectangles, odd zones triangles."""
    n = table(spark, sf, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS zone",
        "CAST(-96.6 AS DOUBLE) + (n_nationkey % 5) * CAST(1.28 AS DOUBLE) AS x0",
        "CAST(40.4 AS DOUBLE) + (n_nationkey DIV 5) * CAST(0.66 AS DOUBLE) AS y0",
    )
    corner = lambda dx, dy: f"named_struct('lon', x0 + {dx}, 'lat', y0 + {dy})"
    rect = ", ".join([corner("0D", "0D"), corner("1.28D", "0D"), corner("1.28D", "0.66D"), corner("0D", "0.66D")])
    tri = ", ".join([corner("0D", "0D"), corner("1.28D", "0D"), corner("0D", "0.66D")])
    return n.selectExpr("zone", f"CASE WHEN zone % 2 = 0 THEN array({rect}) ELSE array({tri}) END AS ring")
