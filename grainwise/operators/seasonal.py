"""Seasonal residuals and lag correlation without visit pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.operators.multivariate import least_squares, linear_value

YEAR_DAYS = 365.25


def harmonics(ts: Column, order: int = 2) -> dict[str, Column]:
    angle = F.dayofyear(ts) * F.lit(2 * math.pi / YEAR_DAYS)
    out = {}
    for k in range(1, order + 1):
        out[f"_sin{k}"], out[f"_cos{k}"] = F.sin(angle * k), F.cos(angle * k)
    return out


def deseasonalise(df: DataFrame, ts: str, value: str, out: str = "residual", order: int = 2) -> DataFrame:
    """Residual of ``value`` after a least-squares fit of yearly harmonics; rows without value or time get NULL."""
    waves = harmonics(F.col(ts), order)
    rows = df.withColumns(waves)
    fit = least_squares(rows, value, list(waves))
    return rows.withColumn(out, F.col(value) - linear_value(*fit)).drop(*waves)


def temporal_autocorr(df: DataFrame, station: str, ts: str, value: str, edges: Sequence[int], min_pairs: int = 150) -> DataFrame:
    """Symmetrised correlation of all visit pairs of a station, by gap in days: bins (edges[i], edges[i+1]].

    Pairs are never formed. Visits collapse to (station, day) sums; a range frame over the days ahead gives, per bin, the
    number, sum and sum of squares of the partners, from which the sums over all pairs follow. A frame holds at most as
    many rows as a station has days in its bin. The first bin starts at the gap edges[0] + 1.
    """
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01"))
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & F.col(station).isNotNull() & F.col(ts).isNotNull())
    days = rows.groupBy(station, day.alias("day")).agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    parts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        ahead = W.partitionBy(station).orderBy("day").rangeBetween(lo + 1, hi)
        m, s, q = (F.coalesce(F.sum(c).over(ahead), F.lit(0.0)) for c in ("n", "s", "q"))
        parts.append(F.struct(F.lit(i).cast("long").alias("bin"), (F.col("n") * m).alias("pairs"), (F.col("s") * m + F.col("n") * s).alias("sum"), (F.col("q") * m + F.col("n") * q).alias("squares"), (F.col("s") * s).alias("products")))
    # One projection per bin: each frame is its own window over the same partitioning, so there is a single shuffle.
    flat = days.select(*[p.alias(f"_b{i}") for i, p in enumerate(parts)]).select(F.inline(F.array(*[F.col(f"_b{i}") for i in range(len(parts))])))
    t = flat.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("pairs", "sum", "squares", "products")])
    # Every pair counts in both directions: 2 n values, mean sum / 2n, variance squares / 2n - mean^2.
    mean = F.col("sum") / (2 * F.col("pairs"))
    var = F.col("squares") / (2 * F.col("pairs")) - mean * mean
    r = F.try_divide(F.col("products") / F.col("pairs") - mean * mean, var)
    gaps = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for lo, hi in zip(edges, edges[1:], strict=False)])
    gap = F.get(gaps, F.col("bin").cast("int"))
    return t.where(F.col("pairs") >= min_pairs).select("bin", gap["lo"].alias("gap_over"), gap["hi"].alias("gap_to"), F.col("pairs").cast("long").alias("pairs"), r.alias("correlation"))
