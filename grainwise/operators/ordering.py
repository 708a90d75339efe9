"""Order-dependent operators that never put one key, or one whole column, into a single task.

Ranks, exact quantiles and global order are all read off one structure: the *ordered counts* of
a column. Rows are first collapsed to distinct (group, value) counts, then cut into value
buckets whose edges come from an approximate-quantile sketch, so that no bucket holds more than
about 1/buckets of the input even when all rows share one group. Running counts are taken inside
the buckets and shifted by the (tiny) per-bucket totals. The sketch only balances the work; the
counts are exact whatever the edges are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.functions.numeric import HASH_SPAN, key_hash, normal_quantile, whole_days
from grainwise.session import scratch_path, stored

def value_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Strictly increasing inner edges that cut the rows of ``df`` into about equal shares, one per shuffle partition."""
    if buckets is None:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(value).cast("double").alias("v")).stat.approxQuantile("v", probs, 0.25 / buckets)
    return sorted({float(x) for x in found})


def with_bucket(df: DataFrame, value: str, edges: Sequence[float], out: str = "_bucket") -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *edges, float("inf")]
    cast = df.withColumn("_v", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol="_d", handleInvalid="keep").transform(cast)
    return cut.withColumn(out, F.col("_d").cast("int")).drop("_v", "_d")


def ordered_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None, edges: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct (by, value): ``cnt``, ``cum_before`` (rows below it) and group size ``n``.

    NULL values and NULL group keys are left out, as in the statistics built on this. The counts are
    stored once in the shared folder: edges, running counts and totals read that table, so the input
    itself is read a single time. Edges balance distinct values, which is what the work grows with.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    count = F.count("*") if weight is None else F.sum(weight)
    path = scratch_path(df.sparkSession, "counts")
    rows.groupBy(*by, value).agg(count.alias("cnt")).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    if edges is None:
        edges = value_edges(stored, value)
    hist = with_bucket(stored, value, edges)
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    hist = hist.withColumn("_in", F.sum("cnt").over(inside) - F.col("cnt"))
    totals = hist.groupBy(*by, "_bucket").agg(F.sum("cnt").alias("_t"))
    up = W.partitionBy(*by).orderBy("_bucket")
    totals = totals.select(
        *by, "_bucket", (F.sum("_t").over(up) - F.col("_t")).alias("_below"), F.sum("_t").over(W.partitionBy(*by)).alias("n")
    )
    return hist.join(totals, [*by, "_bucket"]).select(
        *by, value, "cnt", (F.col("_below") + F.col("_in")).alias("cum_before"), "n"
    )


def quantiles_from_counts(counts: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """Linear-interpolated quantiles of each group of an ordered-counts table; ``more`` are further named aggregates."""
    covers = lambda k: (F.col("cum_before") <= k) & (k < F.col("cum_before") + F.col("cnt"))
    aggs, outs = [], []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        v = F.col(value).cast("double")
        aggs += [F.max(F.when(covers(F.floor(pos)), v)).alias(f"_lo_{name}"), F.max(F.when(covers(F.ceil(pos)), v)).alias(f"_hi_{name}")]
        frac = pos - F.floor(pos)
        outs.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * frac).alias(name))
    table = counts.groupBy(*by).agg(F.max("n").alias("n"), *aggs, *more)
    kept = [c for c in table.columns if c not in (*by, "n") and not c.startswith(("_lo_", "_hi_"))]
    return table.select(*by, "n", *outs, *kept)


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), edges: Sequence[float] | None = None, keep: bool = True,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, plus the group size ``n``.

    Rows are counted by value bucket; only the buckets that hold a wanted rank are opened into values, so most rows are
    neither shuffled nor sorted. The rows are read three times: ``keep`` stores group and value first, for input that is
    not cheap to read.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, value)
    for k in by:
        rows = rows.where(F.col(k).isNotNull())
    if keep:
        rows = stored(rows, "values")
    rows = with_bucket(rows, value, value_edges(rows, value) if edges is None else edges)
    up = W.partitionBy(*by).orderBy("_bucket")
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_t"))
    sizes = sizes.select(*by, "_bucket", "_t", (F.sum("_t").over(up) - F.col("_t")).alias("_below"), F.sum("_t").over(W.partitionBy(*by)).alias("n"))
    wanted = F.lit(False)
    for p in probs.values():
        pos = (F.col("n") - 1) * F.lit(float(p))
        for k in (F.floor(pos), F.ceil(pos)):
            wanted = wanted | ((F.col("_below") <= k) & (k < F.col("_below") + F.col("_t")))
    opened = stored(sizes.where(wanted).drop("_t"), "opened")
    values = rows.join(opened, [*by, "_bucket"]).groupBy(*by, "_bucket", value).agg(F.count("*").alias("cnt"), F.max("_below").alias("_below"), F.max("n").alias("n"))
    inside = W.partitionBy(*by, "_bucket").orderBy(value)
    counts = values.select(*by, value, "cnt", (F.col("_below") + F.sum("cnt").over(inside) - F.col("cnt")).alias("cum_before"), "n")
    return quantiles_from_counts(counts, value, probs, by)


def median_by(df: DataFrame, value: str, by: Sequence[str], out: str | None = None) -> DataFrame:
    """Exact medians of *small* groups (replicates of one sample) in one aggregation.

    Its state holds a group's distinct values; use ``exact_quantiles`` where groups grow with the data.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias(out or value))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Rank table, one row per distinct (by, value): average-tie rank, percentile rank and n."""
    rank = F.col("cum_before") + (F.col("cnt") + 1) / 2
    return ordered_counts(df, value, by).select(
        *by, value, "cnt", "n", rank.alias(out), (rank / F.col("n")).alias(f"{out}_pct")
    )


def rank_average(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Attach average-tie ranks. Hot values sit on the row side only, where AQE splits skew."""
    ranks = average_ranks(df, value, by, out).drop("cnt")
    return df.join(ranks, [*by, value], "left")


def normal_scores(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "z") -> DataFrame:
    """Normal quantile of (rank - 0.5) / n, joined back on the value."""
    ranks = average_ranks(df, value, by, "_r")
    table = ranks.select(*by, value, normal_quantile((F.col("_r") - 0.5) / F.col("n")).alias(out))
    return df.join(table, [*by, value], "left")


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of each group; Spark limits each group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cap_sample(df: DataFrame, n: int, by: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """Sampling operator: at most n rows per group, picked by a seeded hash of a row key."""
    return top_k_per_group(df, by, [key_hash(F.col(key), seed), F.col(key)], n).drop("rank")


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Representative row of each key: the first by ``order``. One map-side combined aggregation."""
    rep = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*key).agg(rep.alias("_rep")).select(*key, "_rep.*")


def last_non_null(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, the latest non-null value of every column (values may stem from several rows)."""
    at = F.struct(*order)
    return df.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def last_row(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key, the actual last record."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(*by, "_last.*")


def previous_visit(
    df: DataFrame, by: Sequence[str], ts: str, tie: str, value: str, chunk: str = "day",
) -> DataFrame:
    """Previous value and whole-day gap per key.

    Each key's history is cut into calendar chunks, so a key with a third of all rows is spread
    over many tasks; only the first row of a chunk looks at the chunk before, through a table
    with one row per (key, chunk).
    """
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts).cast("timestamp")))
    here = F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    inside = W.partitionBy(*by, "_chunk").orderBy(ts, tie)
    rows = rows.withColumn("_prev", F.lag(here).over(inside))
    ends = rows.groupBy(*by, "_chunk").agg(F.max_by(here, F.struct(ts, tie)).alias("_end"))
    carried = ends.select(*by, "_chunk", F.lag("_end").over(W.partitionBy(*by).orderBy("_chunk")).alias("_carry"))
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return (
        rows.join(carried, [*by, "_chunk"], "left")
        .withColumns({"prev_value": prev["value"], "gap_days": whole_days(F.col(ts), prev["ts"])})
        .drop("_chunk", "_prev", "_carry")
    )


def group_ranks(df: DataFrame, group: str, seed: int = 0, by_size: bool = False) -> DataFrame:
    """Distinct groups in a seeded random order: 0-based ``rank`` and the group count ``n``.

    Keys may have any type; ranks are unique, as equal hashes are ordered by the key itself.
    """
    h = key_hash(F.col(group), seed)
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size"))
    # Larger groups first: the size in front of the hash, as one exact decimal.
    order = h.cast("decimal(38,0)") - F.col("_size").cast("decimal(18,0)") * F.lit(HASH_SPAN).cast("decimal(19,0)") if by_size else h
    return unique_ranks(groups.select(group, order.alias("_order")), group, "_order")


def unique_ranks(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, 0-based unique ``rank`` by (order, key), and the row count ``n``."""
    counts = ordered_counts(rows, order).select(order, "cum_before", "n")
    tie = F.row_number().over(W.partitionBy(order).orderBy(key)) - 1
    return rows.join(counts, order).select(key, (F.col("cum_before") + tie).cast("long").alias("rank"), "n")


def group_split(df: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """Tag rows ``is_test`` so that a fraction of the *groups* is held out whole."""
    picked = group_ranks(df, group, seed).select(
        group, (F.col("rank") < F.ceil(F.col("n") * F.lit(float(fraction)))).alias("is_test")
    )
    return df.join(picked, group)


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 0, balanced: bool = False) -> DataFrame:
    """Tag rows with a fold 0..k-1; all rows of a group share a fold.

    ``balanced`` orders groups by size and deals them out in snake order.
    """
    ranks = group_ranks(df, group, seed, by_size=balanced)
    pos = F.pmod("rank", F.lit(k))
    if balanced:
        pos = F.when(F.floor(F.col("rank") / k) % 2 == 0, pos).otherwise(k - 1 - pos)
    return df.join(ranks.select(group, pos.cast("long").alias("fold")), group)


def bh_fdr(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values over a result table.

    The reverse running minimum follows the order of distinct p-values, bucketed like every other
    global order here: minimum inside the bucket, then the minimum over all later buckets.
    """
    counts = ordered_counts(df, p)
    adj = counts.withColumn("_raw", F.col(p) * F.col("n") / (F.col("cum_before") + F.col("cnt")))
    adj = with_bucket(adj, p, value_edges(df.where(F.col(p).isNotNull()), p))
    down = W.partitionBy("_bucket").orderBy(p).rowsBetween(W.currentRow, W.unboundedFollowing)
    adj = adj.withColumn("_in", F.min("_raw").over(down))
    lows = adj.groupBy("_bucket").agg(F.min("_raw").alias("_low"))
    later = W.orderBy("_bucket").rowsBetween(1, W.unboundedFollowing)
    lows = lows.select("_bucket", F.min("_low").over(later).alias("_later"))
    q = F.greatest(F.least(F.col("_in"), F.col("_later"), F.lit(1.0)), F.lit(0.0))
    table = adj.join(lows, "_bucket").select(p, q.alias(out))
    return df.join(table, p, "left")
