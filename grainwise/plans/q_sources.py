"""Queries for scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.plans.registry import query
from grainwise.session import scratch_path
from grainwise.sources import scans, sinks, views
from grainwise.sources.tables import table

LINEITEM_SUBSET = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)


@query(
    "scan_project",
    """SELECT l_returnflag, year(l_shipdate) AS year, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty
       FROM lineitem GROUP BY 1, 2""",
)
def scan_project(spark, sf):
    df = scans.scan_typed(spark, f"{sf}/lineitem.parquet", LINEITEM_SUBSET, ["l_returnflag", "l_shipdate", "l_quantity"])
    return df.groupBy("l_returnflag", F.year("l_shipdate").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty")
    )


@query(
    "scan_file_tag",
    """SELECT year(o_orderdate) AS fiscal_year, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY 1""",
)
def scan_file_tag(spark, sf):
    """Write one CSV folder file set per year, read them back as one table tagged by file name."""
    path = scratch_path(spark, "yearly")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    orders.write.partitionBy("y").csv(path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    tagged = scans.scan_files_with_key(spark, path + "/y=*", r"/y=(\d{4})/", "fiscal_year", schema)
    return tagged.groupBy("fiscal_year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("scan_filter_region", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def scan_filter_region(spark, sf):
    return (
        table(spark, sf, "customer").where((F.col("c_nationkey") == 7) & (F.col("c_acctbal") > 0))
        .select("c_custkey", "c_name", "c_acctbal")
    )


@query(
    "scan_semi_keys",
    """SELECT o_orderpriority, count(*) AS n FROM orders
       WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
)
def scan_semi_keys(spark, sf):
    keys = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return (
        scans.scan_semi(table(spark, sf, "orders"), keys, ["o_custkey"])
        .groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    )


@query(
    "locate_block",
    """SELECT event_id, parameter, TRY_CAST(trim(raw) AS DOUBLE) AS number FROM v_measure
       WHERE parameter LIKE '%k' AND TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL""",
)
def locate_block(spark, sf):
    return scans.locate_block(views.measure(spark, sf), "parameter", "k", "raw").select(
        "event_id", "parameter", F.trim("raw").try_cast("double").alias("number")
    )


@query(
    "sink_roundtrip",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty
       FROM lineitem GROUP BY 1, 2""",
)
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "roundtrip")
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_quantity", F.year("l_shipdate").cast("long").alias("year")
    )
    sinks.write_table(df, path, partition_by=["year"], sort_by=["l_orderkey"])
    return spark.read.parquet(path).groupBy(F.col("year").cast("long").alias("year"), "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty")
    )


@query(
    "resume_anti",
    """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM orders
       WHERE CAST(o_orderdate AS DATE) NOT IN
         (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) GROUP BY 1""",
)
def resume_anti(spark, sf):
    done = (
        table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_quantity > 48")
        .select(F.to_date("l_shipdate").alias("day"))
    )
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return (
        sinks.missing_rows(orders, done, ["day"]).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "replace_slice",
    """SELECT commodity, count(*) AS n, CAST(sum(CASE WHEN commodity = 'R' THEN 2 * value ELSE value END) AS BIGINT) AS total
       FROM v_panel GROUP BY 1""",
)
def replace_slice(spark, sf):
    """Publish all slices, then replace one slice with new values."""
    path = scratch_path(spark, "slices")
    panel = views.panel(spark, sf)
    sinks.replace_slice(panel, path, "commodity")
    changed = panel.where("commodity = 'R'").withColumn("value", F.col("value") * 2)
    sinks.replace_slice(changed, path, "commodity")
    return sinks.read_slices(spark, path).groupBy("commodity").agg(
        F.count("*").alias("n"), F.sum("value").cast("long").alias("total")
    )


@query(
    "verified_overwrite",
    """SELECT o_orderkey, o_orderstatus, round(o_totalprice / 1000, 2) AS index_value FROM orders""",
)
def verified_overwrite(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") / 1000, 2).alias("index_value"), "o_orderstatus"
    )
    path = sinks.verified_overwrite(spark, orders, ["index_value"], ["o_orderkey"])
    return spark.read.parquet(path)


@query(
    "format_fixed",
    """SELECT c_custkey, printf('%.2f', c_acctbal) AS balance_text,
         CASE WHEN c_custkey % 4 = 0 THEN '' ELSE printf('%.3f', c_acctbal / 7) END AS coverage_text FROM customer""",
)
def format_fixed(spark, sf):
    cu = table(spark, sf, "customer")
    gappy = F.expr("CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 7 END")
    return cu.select(
        "c_custkey", scans.fixed_text(F.col("c_acctbal"), 2).alias("balance_text"),
        scans.fixed_text(gappy, 3).alias("coverage_text"),
    )
