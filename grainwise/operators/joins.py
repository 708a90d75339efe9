"""Joins between grains: key-date, panels, scaffolds, hierarchy, as-of and ratio refresh."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_on_key_date(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """Left join on (id, calendar day) with different names on each side; right keys are dropped."""
    (lk, lt), (rk, rd) = left_on, right_on
    r = right.withColumnsRenamed({rk: "_rk", rd: "_rd"})
    cond = (F.col(lk) == F.col("_rk")) & (F.to_date(F.col(lt)) == F.col("_rd"))
    return left.join(r, cond, "left").drop("_rk", "_rd")


def outer_merge(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Full-outer fold of panels on one key. All share the key, so they share one partitioning."""
    return reduce(lambda a, b: a.join(b, list(key), "full_outer"), frames)


def grid_scaffold(entities: DataFrame, key: Sequence[str], year: str, first: int, last: int) -> DataFrame:
    """Every entity in every year of a fixed range: an explode of the range, not a join."""
    return entities.select(*key).distinct().withColumn(year, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def rollup_broadcast_join(children: DataFrame, parents: DataFrame, code: str, parent: str, digits: int, extra: Sequence[str] = ()) -> DataFrame:
    """Repeat parent-level values on every child whose code starts with the parent's code."""
    keyed = children.withColumn(parent, F.substring(code, 1, digits))
    return keyed.join(parents, [parent, *extra], "left")


def join_year_only(df: DataFrame, by_year: DataFrame, ts: str, year: str = "year") -> DataFrame:
    """State-wide values onto every row of their year."""
    return df.withColumn(year, F.year(ts).cast("long")).join(by_year, year, "left")


def asof_backward(
    left: DataFrame, right: DataFrame, by: Sequence[str], t: str, payload: Sequence[str],
    cap: float | None = None, chunk: Column | None = None, base_name: str = "base_t",
) -> DataFrame:
    """For every left row, the latest right row at or before ``min(t, cap)``, plus its staleness.

    Both sides are stacked and the right payload is carried forward in time order. History is cut
    into chunks of ``t``: the carry inside a chunk is a window over (key, chunk), the carry from
    earlier chunks comes from a table of one row per (key, chunk). A hot key is thus spread over
    its chunks, and nothing is collected. Of right rows at one time, the one with the largest payload counts.
    """
    at = F.col(t) if cap is None else F.least(F.col(t), F.lit(cap))
    chunk = chunk if chunk is not None else F.floor(F.col("_at") / 10)
    base = F.struct(F.col(t).alias("t"), *payload)
    l = left.select(F.struct(*left.columns).alias("_row"), *by, at.alias("_at"), F.lit(1).alias("_side"))
    r = right.select(F.lit(None).alias("_row"), *by, F.col(t).alias("_at"), F.lit(0).alias("_side"), base.alias("_base"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_chunk", chunk)
    inside = W.partitionBy(*by, "_chunk").orderBy("_at", "_side", "_base").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_near", F.last("_base", ignorenulls=True).over(inside))
    ends = r.withColumn("_chunk", chunk).groupBy(*by, "_chunk").agg(F.max_by("_base", F.struct("_at", "_base")).alias("_end"))
    chunks = both.select(*by, "_chunk").distinct().join(ends, [*by, "_chunk"], "left")
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(*by, "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_far"))
    hit = F.coalesce("_near", "_far")
    joined = both.where("_side = 1").join(chunks, [*by, "_chunk"], "left").withColumn("_hit", hit)
    return joined.select(
        "_row.*", F.col("_hit.t").alias(base_name), *[F.col(f"_hit.{p}").alias(p) for p in payload],
        (F.col("_row")[t] - F.col("_hit.t")).alias("staleness"),
    )


def ratio_refresh(
    carried: DataFrame, head: DataFrame, by: Sequence[str], year: str, base_year: str, value: str, head_value: str,
) -> DataFrame:
    """Scale a carried-forward value by head(year) / head(base year); without both, by 1.

    Adds ``ratio``, ``refreshed`` and the scaled ``<value>_refreshed``. The head table is joined
    twice on its own key (region, year): equi-joins, no matrix on the driver.
    """
    now = head.select(*by, F.col(year), F.col(head_value).alias("_now"))
    then = head.select(*by, F.col(year).alias(base_year), F.col(head_value).alias("_then"))
    out = carried.join(now, [*by, year], "left").join(then, [*by, base_year], "left")
    ratio = F.try_divide(F.col("_now"), F.col("_then"))
    usable = ratio.isNotNull() & (F.col(base_year) != F.col(year))
    return (
        out.withColumn("ratio", F.when(usable, ratio).otherwise(F.lit(1.0)))
        .withColumn("refreshed", usable)
        .withColumn(f"{value}_refreshed", F.col(value) * F.col("ratio")).drop("_now", "_then")
    )


def pair_totals_by_group(df: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """Totals over all unordered pairs of visits within a group, without forming any pair.

    From the sums of each group: number of pairs, sum of products, sum of values of both ends, and
    the sum of squared time gaps. Exact for every pair, and a map-side combined aggregation.
    """
    t, v = F.col(time).cast("double"), F.col(value)
    agg = df.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(t).alias("st"), F.sum(t * t).alias("qt")
    )
    n = F.col("n")
    return agg.where("n >= 2").select(
        *by, n.alias("n_visits"), (n * (n - 1) / 2).cast("long").alias("n_pairs"),
        ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("sum_product"),
        ((n - 1) * F.col("s")).alias("sum_both"),
        (n * F.col("qt") - F.col("st") * F.col("st")).alias("sum_sq_gap"),
    )
