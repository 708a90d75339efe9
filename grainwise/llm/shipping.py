"""Runs Arrow functions on executors that may not have this package installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors once per application, as a zip file served by Spark."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="grainwise-"), "grainwise.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def free_name(taken: Iterable[str], stem: str) -> str:
    """``stem``, with underscores added until no name of ``taken`` equals it in any case."""
    low = {c.lower() for c in taken}
    while stem.lower() in low:
        stem += "_"
    return stem


def map_arrow(df: DataFrame, fn: Callable, schema: T.StructType | str, owner: str = "") -> DataFrame:
    """``mapInArrow`` whose function may import this package; ``owner`` names what its worker may keep between tasks."""
    ship(df.sparkSession)

    def task(batches):
        from grainwise.llm import caches

        caches.claim(owner)
        yield from fn(batches)

    return df.mapInArrow(task, schema)
