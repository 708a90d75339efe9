"""Cleaning steps on whole tables, built from the expressions in functions/cleaning.py."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cleaning as c

Bounds = tuple[float | None, float | None]


def nondetect_report(df: DataFrame, raw: str, flagged: Column, by: Sequence[str]) -> DataFrame:
    """How many values are not numbers, and how many of those carry a detection condition."""
    is_text = c.to_number(raw).isNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(is_text).alias("n_text"),
        F.count_if(is_text & F.coalesce(flagged, F.lit(False))).alias("n_text_flagged"),
    )


def _lookup(keys: Column, table: Mapping[str, float]) -> Column:
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), keys)


def standardize_units(
    df: DataFrame, factors: Mapping[tuple[str, str], float], parameter: str = "parameter", unit: str = "unit", value: str = "value",
) -> DataFrame:
    """Multiply by the factor of (parameter, unit); a unit without a factor is incompatible: drop.

    The factor table is configuration, so it becomes a literal map: no join, no shuffle.
    """
    key = F.concat_ws("\u0001", F.col(parameter), F.col(unit))
    factor = _lookup(key, {f"{p}\u0001{u}": float(f) for (p, u), f in factors.items()})
    return (
        df.withColumn("_factor", factor).where("_factor IS NOT NULL")
        .withColumn(value, F.col(value) * F.col("_factor")).drop("_factor")
    )


def bounds_test(bounds: Mapping[str, Bounds], parameter: str, value: str) -> Column:
    """Inside the inclusive bounds of the row's parameter; unlisted parameters fail."""
    out = F.lit(False)
    for name, (lo, hi) in bounds.items():
        out = F.when(F.col(parameter) == name, c.in_range(value, lo, hi)).otherwise(out)
    return out


def range_drop(df: DataFrame, bounds: Mapping[str, Bounds], parameter: str, value: str) -> DataFrame:
    return df.where(bounds_test(bounds, parameter, value))


def range_null(df: DataFrame, bounds: Mapping[str, Bounds]) -> DataFrame:
    return df.withColumns({k: c.null_outside(k, *b) for k, b in bounds.items()})


def bbox_null(df: DataFrame, lat: str, lon: str, box: Mapping[str, tuple[float, float]]) -> DataFrame:
    inside = c.inside_box(lat, lon, box)
    return df.withColumns({lat: F.when(inside, F.col(lat)), lon: F.when(inside, F.col(lon))})


def censor_substitute(df: DataFrame, columns: Sequence[str], lod: float) -> DataFrame:
    """Flag exact zeros first, then substitute; both from the original value."""
    new = {}
    for k in columns:
        new[k], new[f"{k}_censored"] = c.censor_substitute(k, lod)
    return df.withColumns(new)


def count_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(k).isNotNull().cast("long") for k in columns])


def any_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in columns])
