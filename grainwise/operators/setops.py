"""Ordering by category lists, tagged unions, priority dedupe, key overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.operators.ordering import first_per_key


def position_in(column: str, categories: Sequence[str]):
    return F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column))


def sort_custom_order(df: DataFrame, column: str, categories: Sequence[str], out: str = "position") -> DataFrame:
    """Order by an explicit category list (1-based position; unlisted categories are 0)."""
    return df.withColumn(out, position_in(column, categories).cast("long")).orderBy(out, column)


def union_tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames by column name, with a provenance column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(k)) for k, df in frames.items()])


def dedupe_priority(df: DataFrame, key: Sequence[str], source: str, preferred: Sequence[str]) -> DataFrame:
    """On a key collision keep the row of the most preferred source."""
    rest = [c for c in df.columns if c not in key]
    return first_per_key(df, key, [position_in(source, preferred)], rest).select(*df.columns)


def key_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of distinct keys only left, only right and in both: one shuffle of tagged keys."""
    tagged = left.select("*", F.lit(1).alias("_side")).unionByName(right.select("*", F.lit(2).alias("_side")))
    sides = tagged.groupBy(*left.columns).agg(F.bit_or("_side").alias("_side"))
    counts = sides.agg(*[F.count_if(F.col("_side") == i).alias(f"c{i}") for i in (1, 2, 3)])
    labels = {1: "left only", 2: "right only", 3: "both"}
    return counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("side"), F.col(f"c{i}").alias("n")) for i, t in labels.items()])))
