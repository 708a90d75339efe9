"""Streaming queries over the events table, each run to completion and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.plans.registry import query
from grainwise.session import scratch_path
from grainwise.sources.tables import table
from grainwise.streaming import events as st


SLICES = 4


def _arrivals(spark, sf, path, repeats: bool):
    """Append the events to a folder slice by slice in time order; yields after each slice.

    With ``repeats`` a slice also brings a tenth of the rows of the slice before once more.
    """
    ev = table(spark, sf, "events")
    lo, hi = ev.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - lo) * SLICES / F.lit(max(hi - lo, 1))), F.lit(SLICES - 1))
    for k in range(SLICES):
        part = ev.where(at == k)
        if repeats and k:
            part = part.unionByName(ev.where((at == k - 1) & (F.col("event_id") % 10 == 0)))
        part.write.mode("append").parquet(path)
        yield k


def _read(spark, sf, path):
    schema = table(spark, sf, "events").schema
    return st.read_files(spark, path, schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_dedupe(spark, sf):
    """Several files and runs with one checkpoint: each run is a restart, and repeated events come once."""
    path = scratch_path(spark, "dedupe")
    for _ in _arrivals(spark, sf, path + "-in", repeats=True):
        st.run_available(st.dedupe(_read(spark, sf, path + "-in"), "ts", ["event_id"], "40 days"), path, path + "-ck")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "stream_window_mean",
    """SELECT strftime(day, '%Y-%m-%d') AS day, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)
       WHERE day + INTERVAL 1 DAY <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""",
)
def stream_window_mean(spark, sf):
    """Append mode: a day is written once the watermark (one day behind the latest event) has passed its end; younger
    days stay open, and their state is all that is kept."""
    path = scratch_path(spark, "daily")
    for _ in _arrivals(spark, sf, path + "-in", repeats=False):
        st.run_available(st.daily_mean(_read(spark, sf, path + "-in"), "ts", ["event_type"], "value", "1 day"), path, path + "-ck")
    return spark.read.parquet(path).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(
    "stream_latest",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def stream_latest(spark, sf):
    path = scratch_path(spark, "latest")
    for _ in _arrivals(spark, sf, path + "-in", repeats=True):
        st.latest_state(_read(spark, sf, path + "-in"), ["user_id"], ["ts", "event_id"], ["value"], path, path + "-ck")
    return st.read_state(spark, path).select("user_id", "event_id", "value")
