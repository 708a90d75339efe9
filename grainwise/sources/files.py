"""Folders of versions in whatever store Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it isn't there."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders ``v=<number>`` whose job has committed, ascending."""
    found = [int(c[2:]) for c in children(spark, path) if c.startswith("v=")]
    return sorted(v for v in found if "_SUCCESS" in children(spark, f"{path}/v={v}"))
