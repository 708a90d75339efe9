"""Structured Streaming forms of batch operators: dedupe, tumbling daily means, latest state.

Late rows beyond the watermark are dropped by design; everything else equals the batch answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainwise.operators.ordering import last_row
from grainwise.sources.files import children, committed, drop


def read_files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def dedupe(stream: DataFrame, ts: str, key: Sequence[str], delay: str) -> DataFrame:
    """First row of every key inside the watermark; state is bounded by the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def daily_mean(stream: DataFrame, ts: str, by: Sequence[str], value: str, delay: str) -> DataFrame:
    """Tumbling one-day means. Sums and counts merge map-side, so hot keys stay small."""
    w = F.window(ts, "1 day")
    out = stream.withWatermark(ts, delay).groupBy(w, *by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("day"), *by, "n", "mean")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all available files once into a Parquet sink and stop."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


#: Names of the partition folders of the state; no column of it may have them.
VERSION, BUCKET = "state_version", "state_bucket"


def latest_state(
    stream: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], path: str, checkpoint: str, buckets: int = 64
) -> StreamingQuery:
    """Keep one latest row per key, in hash buckets; a batch reads and rewrites only the buckets that it touches.

    A manifest per batch names the version of each bucket; writing it commits the batch. A batch that runs again starts
    from the manifest before its own and so changes nothing. Versions that neither of the last two manifests names are
    deleted.
    """
    keep = list(dict.fromkeys([*order, *columns]))

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        arrived = f"{path}/arrived"
        own = F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int").alias(BUCKET)
        last_row(batch, by, order, keep).select(own, *by, *keep).write.mode("overwrite").parquet(arrived)
        new = spark.read.parquet(arrived)
        touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        before = [v for v in committed(spark, f"{path}/manifest") if v < epoch]
        base = _manifest(spark, path, before[-1]) if before else {}
        old = [f"{path}/data/{VERSION}={base[b]}/{BUCKET}={b}" for b in touched if b in base]
        if old:
            new = new.unionByName(spark.read.option("basePath", f"{path}/data").parquet(*old).select(new.columns))
        rows = last_row(new.withColumn(BUCKET, F.col(BUCKET).cast("int")), [BUCKET, *by], order, keep)
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/{VERSION}={epoch}")
        named = base | dict.fromkeys(touched, epoch)
        entries = spark.createDataFrame(sorted(named.items()), "bucket int, version long").coalesce(1)
        entries.write.mode("overwrite").parquet(f"{path}/manifest/v={epoch}")
        for v in before[:-1]:
            drop(spark, f"{path}/manifest/v={v}")
        used = {*base.items(), *named.items()}
        for version in children(spark, f"{path}/data"):
            v = int(version.partition("=")[2])
            stays = [b for b in range(buckets) if (b, v) in used]
            if not stays and v < epoch:
                drop(spark, f"{path}/data/{version}")
            for name in children(spark, f"{path}/data/{version}") if stays else []:
                if name.startswith(BUCKET) and int(name.partition("=")[2]) not in stays:
                    drop(spark, f"{path}/data/{version}/{name}")

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/v={version}").collect()}


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The latest committed rows of :func:`latest_state`."""
    named = _manifest(spark, path, committed(spark, f"{path}/manifest")[-1])
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(named.items())]).drop(VERSION, BUCKET)
