"""Profiling reports. Each is a few aggregations whose results are small tables.

Wide tables are unpivoted to (variable, value) and pre-aggregated to distinct values before any
shuffle by variable, so a column of a very long table never becomes one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.functions.numeric import HASH_SPAN, cut, key_hash, season, smape_term
from grainwise.operators import ordering
from grainwise.operators.reshape import long_form
from grainwise.session import scratch_path


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def value_counts(df: DataFrame, column: str, normalize: bool = True) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    total = df.agg(F.count(column)).scalar()
    return counts.withColumn("share", ratio(F.col("n"), total))


def crosstab_share(df: DataFrame, a: str, b: str, top: int | None = None) -> DataFrame:
    """Contingency counts with row shares; optionally only the ``top`` most frequent levels of ``a``."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("_row"))
    if top is not None:
        rows = rows.orderBy(F.desc("_row"), a).limit(top)
    return cells.join(rows, a).select(a, b, "n", ratio(F.col("n"), F.col("_row")).alias("row_share"))


#: Presence bits of one long.
MASK_BITS = 62


def co_measurement(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where both columns of a pair are present, and their Jaccard similarity.

    A row becomes a mask of presence bits and masks are counted; pairs are then summed over the masks that hold both,
    so that the work per row doesn't grow with the number of pairs.
    """
    columns = list(columns)
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i % MASK_BITS).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(columns)]
    words = [sum(bits[k + 1 : k + MASK_BITS], bits[k]) for k in range(0, len(bits), MASK_BITS)]
    names = [f"m{k}" for k in range(len(words))]
    masks = df.select(*[w.alias(n) for w, n in zip(words, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n"))

    def held_in(k: int, name: str) -> Column:
        """Numbers of the columns whose bit is set in a word."""
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i - k * MASK_BITS).cast("int"))
        numbers = F.sequence(F.lit(k * MASK_BITS), F.lit(min(len(columns), (k + 1) * MASK_BITS) - 1))
        return F.filter(numbers, lambda i: F.col(name).bitwiseAND(bit(i)) != 0)

    held = F.concat(*[held_in(k, n) for k, n in enumerate(names)])
    # The outer forms keep Spark from inferring a filter on the list, which it would compute on every row before counting.
    present = masks.select("n", held.alias("held")).select("n", "held", F.explode_outer("held").alias("a"))
    both = present.select("n", "a", F.explode_outer(F.filter("held", lambda i: i >= F.col("a"))).alias("b"))
    # Every pair is there, if only with no row; what follows has one row per pair of columns.
    every = [(0, i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    both = both.unionByName(df.sparkSession.createDataFrame(every, "n long, a int, b int")).where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = F.when(F.col("a") == F.col("b"), F.col("n"))
    table = both.select("*", F.max(own).over(W.partitionBy("a")).alias("n_a"), F.max(own).over(W.partitionBy("b")).alias("n_b")).where("a < b")
    name = lambda i: F.element_at(F.array(*map(F.lit, columns)), F.col(i) + 1).alias(i)
    return table.select(name("a"), name("b"), F.col("n").alias("n_both"), ratio(F.col("n"), F.col("n_a") + F.col("n_b") - F.col("n")).alias("jaccard"))


def dataset_overview(df: DataFrame, entity: str, ts: str, key: Sequence[str]) -> DataFrame:
    keys = df.groupBy(*key).agg(F.count("*").alias("c"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    per_entity = keys.groupBy(entity).agg(
        F.sum("c").alias("c"), F.sum(F.col("c") - 1).alias("dup"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum(F.when(null_key, F.col("c")).otherwise(0)).alias("nulls"),
    )
    return per_entity.agg(
        F.sum("c").alias("n_rows"), F.count(entity).alias("n_entities"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        F.sum("dup").alias("n_duplicates"), F.sum("nulls").alias("n_null_keys"),
    )


def rows_per_key_hist(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows_per_key")).groupBy("rows_per_key").agg(F.count("*").alias("n_keys"))


BANDS = ((-1.0, 0.0, "empty"), (0.0, 5.0, "<=5%"), (5.0, 50.0, "5-50%"), (50.0, 99.9999, "50-100%"), (99.9999, 100.0, "complete"))


def column_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: type, present rows, share, exact distinct values and a completeness band."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]
    values = df.select(F.inline(F.array(*cells))).groupBy("column_name", "v").agg(F.count("*").alias("c"))
    per = values.groupBy("column_name").agg(
        F.sum("c").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("n_present"),
        F.count("v").alias("n_unique"),
    )
    pct = 100 * ratio(F.col("n_present"), F.col("n_rows"))
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    band = cut("pct_present", [b[0] for b in BANDS] + [BANDS[-1][1]], [b[2] for b in BANDS])
    return per.withColumns({"dtype": dtype[F.col("column_name")], "pct_present": pct}).withColumn("band", band)


def domain_rollup(completeness: DataFrame, domains: Mapping[str, Sequence[str]], other: str = "other") -> DataFrame:
    """Columns grouped by source domain through name prefixes."""
    domain = F.lit(other)
    for name, prefixes in reversed(domains.items()):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("column_name").startswith(p)
        domain = F.when(hit, F.lit(name)).otherwise(domain)
    return completeness.groupBy(domain.alias("domain")).agg(
        F.count("*").alias("n_columns"), F.avg("pct_present").alias("mean_pct"), F.min("pct_present").alias("min_pct"), F.max("pct_present").alias("max_pct")
    )


QUANTILES = {"p1": 0.01, "q1": 0.25, "med": 0.5, "q3": 0.75, "p99": 0.99}


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full numeric description of each column, from one stored table of ordered distinct values.

    The input is read once, and the number of its rows is observed on the way. Moments are sums around the mean, weighted
    by the counts. Skewness and kurtosis are the bias-corrected sample versions.
    """
    spark = df.sparkSession
    rows = Observation()
    long = long_form(df.observe(rows, F.count(F.lit(1)).alias("n")), columns)
    path = scratch_path(spark, "ordered")
    ordering.ordered_counts(long, "value", ["variable"]).write.parquet(path)
    counts = spark.read.parquet(path)
    v, cnt = F.col("value").cast("double"), F.col("cnt")
    when = lambda cond: F.sum(F.when(cond, cnt).otherwise(0))
    more = [
        ratio(F.sum(v * cnt), F.sum(cnt)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), when(v == 0).alias("n_zero"),
        when(v < 0).alias("n_negative"), F.count("*").alias("n_unique"),
    ]
    q = ordering.quantiles_from_counts(counts, "value", QUANTILES, ["variable"], more).withColumn("iqr", F.col("q3") - F.col("q1"))
    # One row per described column: small, whatever the input.
    centre = q.select("variable", "mean", (F.col("q1") - 1.5 * F.col("iqr")).alias("_lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("_hi"))
    d = v - F.col("mean")
    second = counts.join(F.broadcast(centre), "variable").groupBy("variable").agg(
        when((v < F.col("_lo")) | (v > F.col("_hi"))).alias("n_outlier"), *[F.sum(cnt * F.pow(d, F.lit(float(k)))).alias(f"_m{k}") for k in (2, 3, 4)]
    )
    n, m2, m3, m4 = F.col("n").cast("double"), F.col("_m2"), F.col("_m3"), F.col("_m4")
    spread = F.nullif(m2, F.lit(0.0))
    g1, g2 = F.sqrt(n) * m3 / F.pow(spread, F.lit(1.5)), n * m4 / (spread * spread) - 3
    out = q.join(second, "variable").withColumn("sd", F.sqrt(F.try_divide(m2, n - 1)))
    return out.withColumns(
        {
            "pct_present": 100 * ratio(F.col("n"), F.lit(rows.get["n"])),
            "cv": F.try_divide(F.col("sd"), F.abs("mean")),
            "skew": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))),
            "kurt": F.when(n > 3, ((n + 1) * g2 + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))),
        }
    ).drop("_m2", "_m3", "_m4")


def value_pileups(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The k most frequent values of each column, their share, and whether they are an extreme."""
    counts = long_form(df, columns).groupBy("variable", "value").agg(F.count("*").alias("cnt"))
    per = counts.groupBy("variable").agg(F.sum("cnt").alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    top = ordering.top_k_per_group(counts, ["variable"], [F.desc("cnt"), F.col("value")], k)
    return top.join(per, "variable").select(
        "variable", "rank", "value", "cnt", ratio(F.col("cnt"), F.col("n")).alias("share"),
        (F.col("value") == F.col("_lo")).alias("is_min"), (F.col("value") == F.col("_hi")).alias("is_max"),
    )


def zero_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    v = F.col("value")
    return long_form(df, columns).groupBy("variable").agg(
        F.count("*").alias("n"), F.avg((v == 0).cast("double")).alias("zero_share"), F.avg((v < 0).cast("double")).alias("negative_share"),
        F.avg((v <= 0).cast("double")).alias("nonpositive_share"),
    )


def reporting_precision(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of values with at most 0, 1, 2 decimals, and distinct values per 1000 rows."""
    counts = long_form(df, columns).groupBy("variable", "value").agg(F.count("*").alias("cnt"))
    fits = lambda d: F.abs(F.col("value") * 10**d - F.rint(F.col("value") * 10**d)) < 1e-6
    share = lambda d: ratio(F.sum(F.when(fits(d), F.col("cnt")).otherwise(0)), F.sum("cnt"))
    return counts.groupBy("variable").agg(
        F.sum("cnt").alias("n"), share(0).alias("integer_share"), share(1).alias("one_decimal_share"), share(2).alias("two_decimal_share"),
        (1000 * ratio(F.count("*"), F.sum("cnt"))).alias("unique_per_1000"),
    )


def tail_report(df: DataFrame, columns: Sequence[str], ceilings: Mapping[str, float], top: int = 5) -> DataFrame:
    counts = ordering.ordered_counts(long_form(df, columns), "value", ["variable"])
    q = ordering.quantiles_from_counts(counts, "value", {"p99": 0.99, "p999": 0.999}, ["variable"])
    ceiling = F.create_map(*[x for k, v in ceilings.items() for x in (F.lit(k), F.lit(float(v)))])
    above = counts.groupBy("variable").agg(
        F.max("value").alias("max"),
        F.sum(F.when(F.col("value") > F.try_element_at(ceiling, F.col("variable")), F.col("cnt")).otherwise(0)).alias("n_above"),
    )
    best = ordering.top_k_per_group(counts, ["variable"], [F.desc("value")], top)
    listed = best.groupBy("variable").agg(F.reverse(F.array_sort(F.collect_list("value"))).alias("_top"))
    out = q.join(above, "variable").join(listed, "variable")
    return out.select(
        "variable", "n", "p99", "p999", "max", F.try_divide("max", "p99").alias("max_over_p99"), "n_above",
        F.get("_top", F.lit(0)).alias("top_1"), F.get("_top", F.lit(top - 1)).alias(f"top_{top}"),
    )


def plausibility_report(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Per column: rows below and above the plausible range (one pass, no unpivot)."""
    aggs, rows = [], []
    for c, (lo, hi) in bounds.items():
        below = F.lit(False) if lo is None else F.col(c) < lo
        over = F.lit(False) if hi is None else F.col(c) > hi
        aggs += [F.count(c).alias(f"n_{c}"), F.count_if(below).alias(f"b_{c}"), F.count_if(over).alias(f"a_{c}")]
        bad = F.col(f"b_{c}") + F.col(f"a_{c}")
        rows.append(
            F.struct(
                F.lit(c).alias("variable"), F.col(f"n_{c}").alias("n"), F.col(f"b_{c}").alias("n_below"), F.col(f"a_{c}").alias("n_above"),
                (100 * ratio(bad, F.col(f"n_{c}"))).alias("pct_implausible"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def unit_consistency(df: DataFrame, parameter: str, unit: str, value: str, top: int = 20) -> DataFrame:
    """Per parameter: values, distinct units, a "unit (n)" listing and values without a unit.

    The listing holds the ``top`` most frequent spellings, and how many more there are.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(parameter, F.nullif(F.trim(unit), F.lit("")).alias("u")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(parameter).agg(
        F.sum("c").alias("n"), F.count("u").alias("n_units"), F.sum(F.when(F.col("u").isNull(), F.col("c")).otherwise(0)).alias("n_without_unit")
    )
    frequent = ordering.top_k_per_group(counts.where("u IS NOT NULL"), [parameter], [F.desc("c"), F.col("u")], top)
    label = F.concat(F.col("u"), F.lit(" ("), F.col("c").cast("string"), F.lit(")"))
    listing = frequent.groupBy(parameter).agg(F.array_sort(F.collect_list(label)).alias("units"))
    rest = F.when(F.col("n_units") > top, F.array(F.concat(F.lit("+"), (F.col("n_units") - top).cast("string"), F.lit(" more")))).otherwise(F.array())
    units = F.array_join(F.concat(F.coalesce("units", F.array()), rest), "; ")
    return totals.join(listing, parameter, "left").select(parameter, "n", "n_units", units.alias("units"), "n_without_unit")


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct levels, share present, the mode (smallest on a tie) and its share."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]
    counts = df.select(F.inline(F.array(*cells))).groupBy("column_name", "v").agg(F.count("*").alias("c"))
    present = F.when(F.col("v").isNotNull(), F.col("c"))
    mode = F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("c"), F.col("v"))))
    return counts.groupBy("column_name").agg(
        F.count("v").alias("n_unique"), (100 * ratio(F.sum(present), F.sum("c"))).alias("pct_present"), mode.alias("mode"),
        ratio(F.max(present), F.sum(present)).alias("modal_share"),
    )


def degenerate_screen(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: distinct values, modal value and share, share of zeros, standard deviation."""
    counts = long_form(df, columns).groupBy("variable", "value").agg(F.count("*").alias("c"))
    c, v = F.col("c").cast("double"), F.col("value")
    per = counts.groupBy("variable").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_unique"), F.min_by("value", F.struct(-F.col("c"), F.col("value"))).alias("modal_value"),
        ratio(F.max("c"), F.sum("c")).alias("modal_share"), ratio(F.sum(F.when(v == 0, F.col("c")).otherwise(0)), F.sum("c")).alias("zero_share"),
        F.sum(c * v).alias("_s"), F.sum(c * v * v).alias("_q"),
    )
    n = F.col("n").cast("double")
    var = (F.col("_q") - F.col("_s") * F.col("_s") / n) / F.nullif(n - 1, F.lit(0.0))
    return per.withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0)))).drop("_s", "_q")


def quality_flags(df: DataFrame, columns: Sequence[str], skew_limit: float = 10.0, pile_limit: float = 0.5, sparse_pct: float = 5.0) -> DataFrame:
    """One row per (column, flag): all null, constant, nearly empty, extreme skew, value pile-up."""
    agg = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in columns])
    present = agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n_present"), F.col("_rows").alias("_rows")) for c in columns])))
    present = present.withColumn("pct", 100 * ratio(F.col("n_present"), F.col("_rows"))).drop("_rows")
    screen = degenerate_screen(df, columns)
    skew = long_form(df, columns).groupBy("variable").agg(F.skewness("value").alias("_g1"), F.count("*").cast("double").alias("_n"))
    n = F.col("_n")
    g = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    table = present.join(screen, "variable", "left").join(skew, "variable", "left").withColumn("skew", g)
    rules = {
        "all null": F.col("n_present") == 0,
        "constant": F.col("n_unique") == 1,
        "nearly empty": (F.col("n_present") > 0) & (F.col("pct") < sparse_pct),
        "extreme skew": F.abs("skew") > skew_limit,
        "value pile-up": (F.col("n") > 100) & (F.col("modal_share") > pile_limit) & (F.col("n_unique") > 1),
    }
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return table.select("variable", F.explode(flags).alias("flag"))


def temporal_coverage(df: DataFrame, ts: str) -> DataFrame:
    """Rows by year, by month (all twelve, zero-filled), by weekday and by season, with shares."""
    day = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("c"))
    part = lambda kind, e: F.struct(F.lit(kind).alias("kind"), e.cast("string").alias("level"), F.col("c"))
    seen = day.select(
        F.inline(F.array(part("year", F.year("d")), part("month", F.month("d")), part("season", season("d")), part("weekday", F.weekday("d"))))
    ).groupBy("kind", "level").agg(F.sum("c").alias("n"))
    total = df.agg(F.count(ts)).scalar()
    # the calendar rows ride along with a zero count, so absent months appear without a join
    zero = df.sparkSession.range(1, 13).select(F.lit("month").alias("kind"), F.col("id").cast("string").alias("level"), F.lit(0).cast("long").alias("n"))
    return seen.unionByName(zero).groupBy("kind", "level").agg(F.sum("n").alias("n")).withColumn("share", ratio(F.col("n"), total))


def observation_rate(df: DataFrame, period: Column, columns: Sequence[str]) -> DataFrame:
    """Share of rows where each column is present, by period, with the spread over periods."""
    by = df.groupBy(period.alias("period")).agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rate = by.select("period", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), (100 * ratio(F.col(c), F.col("_n"))).alias("pct")) for c in columns])))
    spread = rate.groupBy("variable").agg((F.max("pct") - F.min("pct")).alias("spread"))
    return rate.join(spread, "variable")


def sensor_classification(df: DataFrame, station: str, value: str, trace: float) -> DataFrame:
    """Stations by how they report: never, zeros only, trace amounts only, or real values."""
    per = df.groupBy(station).agg(F.count(value).alias("n"), F.max(value).alias("hi"))
    kind = F.when(F.col("n") == 0, "never").when(F.col("hi") == 0, "zero only").when(F.col("hi") <= trace, "trace only").otherwise("reports")
    return per.withColumn("sensor_class", kind).groupBy("sensor_class").agg(F.count("*").alias("n_stations"), F.sum("n").alias("n_values"))


def variance_decomposition(df: DataFrame, group: str, columns: Sequence[str], static_share: float = 0.95) -> DataFrame:
    """Between-group share of each column's variance, from per-group sums.

    The wide rows go to their group before they become long: a row and its cells nearly all differ, so that combining them
    ahead of the shuffle holds much and saves nothing.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(group).isNotNull()).select(group, *columns).repartition(parts, group)
    cell = long_form(rows, columns, [group]).groupBy("variable", group, "value").agg(F.count("*").alias("c"))
    c, v = F.col("c").cast("double"), F.col("value")
    per = cell.groupBy("variable", group).agg(F.sum("c").alias("n"), F.sum(c * v).alias("s"), F.sum(c * v * v).alias("q"), F.count("*").alias("u"))
    out = per.groupBy("variable").agg(
        F.sum("n").cast("double").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"),
        F.count("*").alias("n_groups"), F.avg("u").alias("unique_per_group"),
    )
    mean2 = F.col("S") * F.col("S") / F.col("N")
    share = F.try_divide(F.col("B") - mean2, F.col("Q") - mean2)
    kind = F.when(F.col("between_share") >= static_share, "static").when(F.col("between_share") >= 0.5, "mostly spatial").otherwise("varies within")
    return out.withColumn("between_share", share).select("variable", "n_groups", "unique_per_group", "between_share", kind.alias("kind"))


def split_leakage(df: DataFrame, group: str, row_key: str, fraction: float, seed: int) -> DataFrame:
    """Share of randomly held-out rows whose group also has training rows: no self-join needed."""
    test = key_hash(F.col(row_key), seed) < F.lit(int(fraction * HASH_SPAN))
    per = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_if(test).alias("t"), F.count_if(~test).alias("r"))
    return per.agg(
        F.sum("t").alias("n_test"), F.count_if(F.col("t") > 0).alias("n_test_groups"), F.count("*").alias("n_groups"),
        (100 * ratio(F.sum(F.when(F.col("r") > 0, F.col("t")).otherwise(0)), F.sum("t"))).alias("pct_leaked"),
    )


def staleness_report(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str], as_of: str) -> DataFrame:
    """Per entity: age of the last record, its month, and whether "last value" mixes several visits."""
    at = F.struct(*order)
    last = df.groupBy(by).agg(
        F.max(order[0]).alias("last_ts"), F.max_by(F.struct(*columns), at).alias("_row"),
        F.struct(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns]).alias("_mix"),
    )
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"_row.{c}").eqNullSafe(F.col(f"_mix.{c}"))
    return last.select(
        by, F.date_diff(F.lit(as_of).cast("date"), F.to_date("last_ts")).cast("long").alias("age_days"),
        F.month("last_ts").cast("long").alias("frozen_month"), (~same).alias("is_composite"),
    )


def smape_floor(df: DataFrame, truth: str, predicted: Mapping[str, Column]) -> DataFrame:
    """Reported symmetric error against the floor set by zeros in the truth alone (2 x share)."""
    zero = 100 * F.avg((F.col(truth) == 0).cast("double"))
    wide = df.withColumns({f"_p_{k}": e for k, e in predicted.items()})
    agg = wide.agg(zero.alias("z"), *[F.avg(smape_term(truth, f"_p_{k}")).alias(k) for k in predicted])
    rows = [
        F.struct(F.lit(k).alias("model"), F.col("z").alias("pct_zero"), F.col(k).alias("error_rate"), (2 * F.col("z")).alias("floor"), (F.col(k) - 2 * F.col("z")).alias("above_floor"))
        for k in predicted
    ]
    return agg.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int = 40, log: bool = False, clip: float | None = None) -> DataFrame:
    """Bin counts over the column's range; log axes use positive values, ``clip`` cuts the top tail
    at an exact quantile. The median of the kept values is attached."""
    rows = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    if log:
        rows = rows.where("x > 0").select("x", F.log10("x").alias("a"))
    else:
        rows = rows.select("x", F.col("x").alias("a"))
    counts = ordering.ordered_counts(rows, "a")
    if clip is not None:
        top = ordering.quantiles_from_counts(counts, "a", {"top": clip}).select("top").scalar()
        counts = counts.where(F.col("a") <= top)
    # the counts below a value do not change when the tail above it is cut, only n does
    span = counts.agg(
        F.struct(F.min("a").alias("lo"), F.max("a").alias("hi"), F.max(F.col("cum_before") + F.col("cnt")).alias("n"))
    ).scalar()
    med = ordering.quantiles_from_counts(counts.withColumn("n", span["n"]), "a", {"median": 0.5}).select("median").scalar()
    lo, width = span["lo"], (span["hi"] - span["lo"]) / bins
    idx = F.when(width > 0, F.least(F.floor((F.col("a") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    out = counts.select(idx.cast("long").alias("bin"), "cnt", lo.alias("_lo"), width.alias("_w")).groupBy("bin").agg(
        F.sum("cnt").alias("n"), F.max("_lo").alias("_lo"), F.max("_w").alias("_w")
    )
    return out.select(
        "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"), "n", med.alias("median")
    )


def density_2d(df: DataFrame, x: str, y: str, grid: int = 40, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Joint bin counts on a square grid over the ranges of x and y."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for c, log in (("x", log_x), ("y", log_y)):
        if log:
            rows = rows.where(F.col(c) > 0).withColumn(c, F.log10(c))
    span = rows.agg(F.struct(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    binned = [
        F.least(F.floor((F.col(c) - span[f"lo{c}"]) / F.nullif((span[f"hi{c}"] - span[f"lo{c}"]) / grid, F.lit(0.0))), F.lit(grid - 1)).cast("long").alias(f"bin_{c}")
        for c in "xy"
    ]
    return rows.select(*binned).groupBy("bin_x", "bin_y").agg(F.count("*").alias("n"))


def presence_combinations(df: DataFrame, columns: Mapping[str, Column], k: int = 10) -> DataFrame:
    """The k most common combinations of present columns, by name."""
    label = F.concat_ws(" + ", *[F.when(present, F.lit(name)) for name, present in columns.items()])
    return (
        df.select(F.when(label == "", F.lit("(none)")).otherwise(label).alias("combination")).groupBy("combination")
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(k)
    )
