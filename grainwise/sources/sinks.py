"""Writing: partitioned tables, resumable appends, slice replacement, verified write-back."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.operators.contracts import ContractError
from grainwise.session import scratch_path
from grainwise.sources.files import children, committed, drop


def write_table(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
    fmt: str = "parquet", mode: str = "overwrite",
) -> None:
    """Write with rows ordered inside each output file; partitioned tables prune by key."""
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def missing_rows(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of an incremental load whose key is not in the sink yet."""
    return df.join(done.select(*on).distinct(), list(on), "left_anti")


def append_missing(spark: SparkSession, df: DataFrame, path: str, on: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Resume a load: append only the keys the sink lacks. Re-running it adds nothing."""
    done = spark.read.parquet(path)
    write_table(missing_rows(df, done, on), path, partition_by=partition_by, mode="append")


NO_SLICE = "\u0000"


def replace_slice(df: DataFrame, path: str, slice_column: str) -> None:
    """Publish the slices present in ``df``; all other slices of the table stay.

    Rows go to a folder of their own. A manifest maps each slice to its folder; writing the next version of it is the
    switch, so that a reader sees the table before or after, never between. If the columns of ``df`` differ from the
    table's, the older slices are dropped. Folders that neither of the last two manifests names are deleted.
    """
    spark = df.sparkSession
    versions = committed(spark, f"{path}/manifest")
    number = versions[-1] + 1 if versions else 0
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    written = spark.read.parquet(f"{path}/{folder}")
    fields = ",".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in written.schema))
    slices = written.select(F.coalesce(F.col(slice_column).cast("string"), F.lit(NO_SLICE)).alias("slice")).distinct()
    entries = slices.select("slice", F.lit(slice_column).alias("slice_column"), F.lit(folder).alias("folder"), F.lit(fields).alias("fields"))
    if versions:
        old = spark.read.parquet(f"{path}/manifest/v={versions[-1]}")
        entries = old.where(F.col("fields") == fields).join(entries, "slice", "left_anti").unionByName(entries)
    # An existing version makes the second of two writers fail instead of losing the first one's slices.
    entries.coalesce(1).write.parquet(f"{path}/manifest/v={number}")
    for v in versions[:-1]:
        drop(spark, f"{path}/manifest/v={v}")
    named = {r["folder"] for v in [*versions[-1:], number] for r in spark.read.parquet(f"{path}/manifest/v={v}").select("folder").distinct().collect()}
    for name in children(spark, f"{path}/data"):
        if f"data/{name}" not in named:
            drop(spark, f"{path}/data/{name}")


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """The table of :func:`replace_slice` as its latest manifest has it."""
    entries = spark.read.parquet(f"{path}/manifest/v={committed(spark, f'{path}/manifest')[-1]}")
    out = None
    # One folder per publication that still holds a slice.
    for r in entries.select("folder", "slice_column").distinct().orderBy("folder").collect():
        rows = spark.read.parquet(f"{path}/{r['folder']}")
        key = F.coalesce(F.col(r["slice_column"]).cast("string"), F.lit(NO_SLICE))
        mine = entries.where(F.col("folder") == r["folder"]).select(F.col("slice").alias("_slice"))
        part = rows.join(mine, key == F.col("_slice"), "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def verified_overwrite(
    spark: SparkSession, df: DataFrame, added: Sequence[str], key: Sequence[str], tolerance: float = 5e-3,
) -> str:
    """Write ``df`` to a new path, re-read and verify it, and return the path to switch to.

    Verified are the row count, the column order (``added`` last) and a per-column sum of the
    added values; a reader keeps the old path until the new one has passed.
    """
    df = df.select(*[c for c in df.columns if c not in added], *added)
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    back = spark.read.parquet(path)
    if list(back.columns)[-len(added):] != list(added):
        raise ContractError("added columns are not last")
    probe = [F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in added], *[F.sum(c).alias(f"s_{c}") for c in added]]
    want, got = df.agg(*probe).first().asDict(), back.agg(*probe).first().asDict()
    for k, v in want.items():
        same = v == got[k] if not isinstance(v, float) else abs(v - got[k]) <= tolerance * max(1.0, abs(v))
        if not same:
            raise ContractError(f"write-back differs in {k}: {v} vs {got[k]}")
    if back.groupBy(*key).count().where("count > 1").take(1):
        raise ContractError("write-back broke the key")
    return path
