"""Composite quality index: sub-indices, worst-of-group, eligibility, blends, sensitivity, bands.

0 is pristine, 50 sits on the criterion, 100 is severe. Everything per row is a column expression;
summaries pre-aggregate before they look at order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grainwise.functions.numeric import curve_axis, cut, interpolate, piecewise
from grainwise.operators import ordering, wide_ranks
from grainwise.operators.association import spearman
from grainwise.operators.profile import ratio
from grainwise.operators.reshape import long_form
from grainwise.session import cut_lineage, stored

# Parameter -> (scale, anchors of value -> sub-index).
CURVES: dict[str, tuple[str, list[tuple[float, float]]]] = {
    "dissolved_oxygen": ("linear", [(2, 100), (3, 80), (5, 50), (7, 20), (9, 0)]),
    "ph": ("linear", [(5.0, 100), (6.0, 75), (6.5, 50), (7.0, 0), (8.5, 0), (9.0, 50), (10.0, 75), (11.0, 100)]),
    "e_coli": ("log", [(10, 0), (126, 35), (235, 50), (2420, 100)]),
    "nitrate": ("linear", [(0, 0), (2.18, 25), (10, 50), (30, 100)]),
    "nitrate_nitrite": ("linear", [(0, 0), (2.18, 25), (10, 50), (30, 100)]),
    "nitrite": ("linear", [(0, 0), (1, 50), (3, 100)]),
    "ammonia": ("linear", [(0, 0), (1.9, 50), (6, 100)]),
    "kjeldahl": ("linear", [(0, 0), (2.18, 50), (6.5, 100)]),
    "total_phosphorus": ("linear", [(0, 0), (0.0763, 25), (0.10, 50), (0.50, 100)]),
    "orthophosphate": ("linear", [(0, 0), (0.0763, 25), (0.10, 50), (0.50, 100)]),
    "phosphate": ("linear", [(0, 0), (0.0763, 25), (0.10, 50), (0.50, 100)]),
    "chloride": ("linear", [(0, 0), (250, 50), (600, 100)]),
    "sulfate": ("linear", [(0, 0), (250, 50), (750, 100)]),
    "tds": ("linear", [(0, 0), (500, 50), (1500, 100)]),
    "conductance": ("linear", [(0, 0), (800, 50), (2400, 100)]),
    "turbidity": ("log", [(1, 0), (6.36, 25), (25, 50), (150, 100)]),
    "tss": ("log", [(1, 0), (30, 50), (200, 100)]),
    "chlorophyll": ("log", [(1, 0), (7.3, 50), (56, 100)]),
    "microcystin": ("linear", [(0, 0), (8, 50), (20, 100)]),
    "atrazine": ("linear", [(0, 0), (3, 50), (15, 100)]),
}
# Optional thermal component.
THERMAL_CURVE = ("linear", [(20, 0), (29, 25), (32, 50), (35, 100)])
THERMAL_WEIGHT = 0.05
# Pollution groups and their weights (weights sum to 1).
GROUPS: dict[str, list[str]] = {
    "pathogen": ["e_coli"],
    "oxygen": ["dissolved_oxygen"],
    "nitrogen": ["nitrate", "nitrate_nitrite", "nitrite", "ammonia", "kjeldahl"],
    "phosphorus": ["total_phosphorus", "orthophosphate", "phosphate"],
    "clarity": ["turbidity", "tss"],
    "algal_toxics": ["chlorophyll", "microcystin", "atrazine"],
    "acidity": ["ph"],
    "salinity": ["chloride", "sulfate", "tds", "conductance"],
}
WEIGHTS: dict[str, float] = {
    "pathogen": 0.20, "oxygen": 0.18, "nitrogen": 0.15, "phosphorus": 0.12,
    "clarity": 0.10, "algal_toxics": 0.10, "acidity": 0.10, "salinity": 0.05,
}
# Eligibility rule, blend and bands.
MIN_GROUPS, MIN_WEIGHT = 3, 0.50
BLEND = 0.40
CRITERION = 50.0
BAND_EDGES = [0.0, 25.0, 50.0, 75.0, 100.0]
BAND_LABELS = ["clean", "within standards", "impaired", "severely impaired"]
# An alternative weight scheme heavy on oxygen and pathogens.
NAMED_SCHEMES: dict[str, dict[str, float]] = {
    "equal": dict.fromkeys(WEIGHTS, 0.125),
    "oxygen and pathogen heavy": {
        "oxygen": 0.24, "pathogen": 0.22, "acidity": 0.15, "clarity": 0.11,
        "nitrogen": 0.10, "phosphorus": 0.08, "salinity": 0.06, "algal_toxics": 0.04,
    },
}


def _apart(x: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(x), lambda v: fn(v))[0]


def subindex_all(df: DataFrame, curves: Mapping = CURVES) -> DataFrame:
    """Add ``q_<parameter>`` for every curve.

    The axis of each curve is its own projection: it is computed once, and the curve itself runs on
    non-null doubles. The curve is a lambda over that axis: twenty curves and what a report adds to them,
    fused into one generated method, pass the size up to which the JVM compiles a method.
    """
    axes = df.withColumns({f"_x_{p}": curve_axis(p, scale == "log") for p, (scale, _) in curves.items()})
    q = {f"q_{p}": F.when(F.col(p).isNotNull(), _apart(F.col(f"_x_{p}"), lambda x, a=anchors, log=scale == "log": piecewise(x, a, log))) for p, (scale, anchors) in curves.items()}
    return axes.withColumns(q).drop(*[f"_x_{p}" for p in curves])


def subindex_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per sub-index: n, median, 90th percentile, share over the criterion."""
    counts = ordering.ordered_counts(long_form(df, columns), "value", ["variable"])
    q = ordering.quantiles_from_counts(counts, "value", {"median_q": 0.5, "p90_q": 0.9}, ["variable"])
    over = counts.groupBy("variable").agg((100 * ratio(F.sum(F.when(F.col("value") > CRITERION, F.col("cnt")).otherwise(0)), F.sum("cnt"))).alias("pct_over"))
    return q.join(over, "variable")


def _greatest(cols: Sequence[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def group_max(df: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """Add ``g_<group>``: the worst present member (NULL only when none is present)."""
    return df.withColumns({f"g_{g}": _greatest([F.col(f"q_{p}") for p in members]) for g, members in groups.items()})


def with_presence(df: DataFrame, groups: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """Add ``has_<group>``: whether any member was measured.

    Read from the raw parameters where the frame has them, so that a filter on eligibility is a
    null test on scan columns instead of a replay of every curve.
    """
    raw = all(p in df.columns for members in groups.values() for p in members)
    present = {g: F.coalesce(*[F.col(p) for p in m]) if raw else F.col(f"g_{g}") for g, m in groups.items()}
    return df.withColumns({f"has_{g}": c.isNotNull() for g, c in present.items()})


def _present(g: str) -> Column:
    return F.col(f"has_{g}")


def n_groups(groups: Sequence[str] = tuple(GROUPS)) -> Column:
    return sum((_present(g).cast("long") for g in groups), F.lit(0).cast("long"))


def weight_coverage(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Sum of the weights present, in hundredths of a weight unit to keep the threshold test exact."""
    total = sum((F.when(_present(g), F.lit(round(w * 10000))).otherwise(0) for g, w in weights.items()), F.lit(0))
    return total / F.lit(10000.0)


def eligibility(df: DataFrame, min_groups: int = MIN_GROUPS, min_weight: float = MIN_WEIGHT) -> DataFrame:
    df = with_presence(df).withColumns({"n_groups": n_groups(), "weight_coverage": weight_coverage()})
    return df.withColumn("eligible", (F.col("n_groups") >= min_groups) & (F.col("weight_coverage") >= min_weight))


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Mean over the groups present, with their weights renormalised."""
    num = sum((F.coalesce(F.col(f"g_{g}"), F.lit(0.0)) * F.lit(float(w)) for g, w in weights.items()), F.lit(0.0))
    den = sum((F.when(_present(g), F.lit(float(w))).otherwise(0.0) for g, w in weights.items()), F.lit(0.0))
    return num / F.nullif(den, F.lit(0.0))


def worst_group(groups: Sequence[str] = tuple(GROUPS)) -> Column:
    return F.greatest(*[F.col(f"g_{g}") for g in groups])


def blend(mean: Column, worst: Column, lam: float | Column = BLEND) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return (F.lit(1.0) - lam) * mean + lam * worst


def _harmonic(weights: Mapping[str, float]) -> Column:
    """100 - sqrt(sum w / sum(w / si^2)) over the groups present, si = max(100 - g, 1)."""
    num = sum((F.when(_present(g), F.lit(float(w))).otherwise(0.0) for g, w in weights.items()), F.lit(0.0))
    clean = {g: F.greatest(F.lit(100.0) - F.coalesce(F.col(f"g_{g}"), F.lit(0.0)), F.lit(1.0)) for g in weights}
    terms = [F.when(_present(g), F.lit(float(w)) / (clean[g] * clean[g])).otherwise(0.0) for g, w in weights.items()]
    return F.lit(100.0) - F.sqrt(num / F.nullif(sum(terms, F.lit(0.0)), F.lit(0.0)))


def aggregate_index(df: DataFrame, weights: Mapping[str, float] = WEIGHTS, lam: float = BLEND) -> DataFrame:
    """Add the four candidate aggregations; NULL on rows that are not eligible."""
    ok = F.col("eligible")
    mean, worst = weighted_mean(weights), worst_group(list(weights))
    return df.withColumns(
        {
            "weighted_mean": F.when(ok, mean), "mean_max_blend": F.when(ok, blend(mean, worst, lam)),
            "harmonic": F.when(ok, _harmonic(dict.fromkeys(weights, 1.0))), "weighted_harmonic": F.when(ok, _harmonic(weights)),
            "worst": F.when(ok, worst),
        }
    )


def score(df: DataFrame) -> DataFrame:
    """Raw parameters to the adopted index: projections only, no shuffle.

    The projections are wide: a session that scores many rows should set ``spark.sql.codegen.hugeMethodLimit`` to 8000, as
    :func:`grainwise.session.local_session` does, so that no generated method exceeds what the JVM compiles.
    """
    return aggregate_index(eligibility(group_max(subindex_all(df))))


def rule_scan(df: DataFrame, station: str, min_groups: Sequence[int], min_weights: Sequence[float]) -> DataFrame:
    """Rows and stations kept by each eligibility rule.

    Rows collapse to (station, groups, coverage) counts first; the rule grid multiplies only that.
    """
    base = df.groupBy(station, "n_groups", "weight_coverage").agg(F.count("*").alias("c"))
    rules = F.array(*[F.struct(F.lit(g).cast("long").alias("min_groups"), F.lit(float(w)).alias("min_weight")) for g in min_groups for w in min_weights])
    kept = base.select("*", F.inline(rules)).withColumn("ok", (F.col("n_groups") >= F.col("min_groups")) & (F.col("weight_coverage") >= F.col("min_weight")))
    per = kept.groupBy("min_groups", "min_weight", station).agg(F.sum(F.when(F.col("ok"), F.col("c")).otherwise(0)).alias("c"), F.sum("c").alias("every"))
    rules = per.groupBy("min_groups", "min_weight").agg(F.sum("c").alias("rows"), F.count_if(F.col("c") > 0).alias("stations"), F.sum("every").alias("every"))
    return rules.withColumn("rows_pct", 100 * ratio(F.col("rows"), F.col("every"))).drop("every")


def compare_schemes(long: DataFrame, label: str) -> DataFrame:
    """Median, share over the criterion, rank correlation with the baseline and median absolute
    change, for several scorings of the same rows given as (label, v, b = baseline)."""
    long = cut_lineage(long.where("v IS NOT NULL").groupBy(label, "v", "b").agg(F.count("*").alias("c")))
    med = ordering.quantiles_from_counts(ordering.ordered_counts(long, "v", [label], weight="c"), "v", {"median": 0.5}, [label])
    over = long.groupBy(label).agg((100 * ratio(F.sum(F.when(F.col("v") > CRITERION, F.col("c")).otherwise(0)), F.sum("c"))).alias("pct_over"))
    moved = long.select(label, F.abs(F.col("v") - F.col("b")).alias("d"), "c").groupBy(label, "d").agg(F.sum("c").alias("c"))
    shift = ordering.quantiles_from_counts(ordering.ordered_counts(moved, "d", [label], weight="c"), "d", {"median_abs_change": 0.5}, [label]).drop("n")
    rho = spearman(long, "v", "b", [label], weight="c").select(label, "rho")
    return med.join(over, label).join(shift, label).join(rho, label)


def config_rows(rows: Sequence[Mapping[str, object]]) -> Column:
    """Small configuration table as a generator: its rows multiply the input without a join."""
    return F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]))


def lambda_scan(df: DataFrame, lambdas: Sequence[float]) -> DataFrame:
    """The blend at several weights of the worst group, against the adopted one."""
    grid = config_rows([{"lambda": f"{lam:.1f}", "_lam": float(lam)} for lam in lambdas])
    rows = df.where("eligible").select("weighted_mean", "worst", F.col("mean_max_blend").alias("b"), grid)
    return compare_schemes(rows.select("lambda", blend(F.col("weighted_mean"), F.col("worst"), F.col("_lam")).alias("v"), "b"), "lambda")


def jittered_schemes(n: int, seed: int, spread: float = 0.5) -> dict[str, dict[str, float]]:
    """n weight schemes, each weight moved by up to +-spread with a hash in place of a generator."""
    out = {}
    for i in range(n):
        raw = {}
        for j, (g, w) in enumerate(WEIGHTS.items()):
            u = (((i * len(WEIGHTS) + j + 1) * 2654435761 + seed) % 4294967296) / 4294967296
            raw[g] = w * (1 + spread * (2 * u - 1))
        total = sum(raw.values())
        out[f"jitter {i:02d}"] = {g: w / total for g, w in raw.items()}
    return out


def _blends(weights: Sequence[Sequence[float]], groups: Sequence[str], lam: float) -> Callable:
    """The blend of a batch of rows under the i-th scheme: the steps of ``weighted_mean`` and ``blend``, on arrays."""

    def blended(t, i):
        num, den = 0.0, 0.0
        for g, w in zip(groups, weights[i]):
            num, den = num + t[f"v_{g}"] * w, den + t[f"p_{g}"] * w
        return (1.0 - lam) * (num / den) + lam * t["worst"]

    return blended


def weight_sensitivity(df: DataFrame, schemes: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The blend under other weight schemes, against the adopted one.

    Rows are stored once with the rank of the adopted blend; a scheme's blend is computed where it is read.
    """
    spark = df.sparkSession
    value = [F.coalesce(F.col(f"g_{g}"), F.lit(0.0)).alias(f"v_{g}") for g in WEIGHTS]
    base = [*value, *[f"has_{g}" for g in WEIGHTS], "worst", F.col("mean_max_blend").alias("b")]
    rows = df.where(F.col("eligible") & F.col("worst").isNotNull() & F.col("mean_max_blend").isNotNull()).select(*base)
    counts = ordering.ordered_counts(rows, "b")
    rank = F.col("cum_before") + (F.col("cnt") + 1) / 2 - (F.col("n") + 1) / 2
    ranks = stored(counts.select("b", rank.alias("_rank"), "cnt"), "ranks")
    own = ranks.agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("_rank") * F.col("_rank")).alias("squares")).first()
    n = own["n"] or 0
    if not n:
        return spark.createDataFrame([], "scheme string, n long, median double, pct_over double, median_abs_change double, rho double")
    edges = ordering.value_edges(ranks, "b")
    rows = stored(rows.join(ranks.drop("cnt"), "b"), "ranked")
    rows = rows.select("b", "_rank", "worst", *[f"v_{g}" for g in WEIGHTS], *[F.col(f"has_{g}").cast("double").alias(f"p_{g}") for g in WEIGHTS])
    wide_ranks.free_shuffles(spark)
    series = _blends([[float(w[g]) for g in WEIGHTS] for w in schemes.values()], list(WEIGHTS), BLEND)
    middle = wide_ranks.medians(rows, series, len(schemes), "b", n)
    out = []
    for i, (name, (over, squares, crossed)) in enumerate(zip(schemes, wide_ranks.rank_sums(rows, series, len(schemes), "_rank", n, edges, CRITERION))):
        rho = crossed / math.sqrt(squares * own["squares"]) if squares > 0 and own["squares"] > 0 else None
        out.append((name, n, middle[i], 100 * over / n, middle[len(schemes) + i], rho))
    return spark.createDataFrame(out, "scheme string, n long, median double, pct_over double, median_abs_change double, rho double")


def add_component(df: DataFrame, name: str, parameter: str, curve: tuple, weight: float) -> DataFrame:
    """Re-score with one more group; all weights are renormalised. Adds ``with_<name>``."""
    scale, anchors = curve
    total = sum(WEIGHTS.values()) + weight
    weights = {g: w / total for g, w in {**WEIGHTS, name: weight}.items()}
    out = df.withColumns({f"g_{name}": interpolate(parameter, anchors, log=scale == "log"), f"has_{name}": F.col(parameter).isNotNull()})
    scored = blend(weighted_mean(weights), worst_group(list(weights)))
    return out.withColumns({f"with_{name}": F.when(F.col("eligible"), scored), "driver": worst_group_name(list(weights))})


def ccme_index(df: DataFrame, by: str, columns: Sequence[str], min_variables: int = 4, min_rows: int = 4) -> DataFrame:
    """Scope / frequency / amplitude index per station (100 = best), in closed form from sums."""
    g = {c: F.col(c) for c in columns}
    aggs = [F.count("*").alias("n")]
    for c in columns:
        over = g[c] > CRITERION
        aggs += [F.count(c).alias(f"t_{c}"), F.count_if(over).alias(f"f_{c}"), F.sum(F.when(over, g[c] / CRITERION - 1).otherwise(0.0)).alias(f"e_{c}")]
    per = df.groupBy(by).agg(*aggs)
    add = lambda f: sum((f(c) for c in columns), F.lit(0))
    per = per.select(
        by, "n", add(lambda c: (F.col(f"t_{c}") > 0).cast("int")).alias("n_variables"), add(lambda c: F.col(f"t_{c}")).alias("tests"),
        add(lambda c: (F.col(f"f_{c}") > 0).cast("int")).alias("failed_variables"), add(lambda c: F.col(f"f_{c}")).alias("failed"),
        add(lambda c: F.col(f"e_{c}")).alias("excess"),
    )
    f1 = 100 * ratio(F.col("failed_variables"), F.col("n_variables"))
    f2 = 100 * ratio(F.col("failed"), F.col("tests"))
    nse = ratio(F.col("excess"), F.col("tests"))
    f3 = nse / (0.01 * nse + 0.01)
    value = 100 - F.sqrt(f1 * f1 + f2 * f2 + f3 * f3) / 1.732
    enough = (F.col("n_variables") >= min_variables) & (F.col("n") >= min_rows)
    return per.select(by, "n", F.when(enough, value).alias("ccme"))


def index_benchmark(station_index: DataFrame, ccme: DataFrame, by: str, index: str, n: str, gates: Sequence[int]) -> DataFrame:
    """Rank agreement of the station median index with the flipped CCME, by minimum sample size."""
    both = station_index.join(ccme.select(by, "ccme"), by).where(F.col(index).isNotNull() & F.col("ccme").isNotNull())
    gated = both.withColumn("min_n", F.explode(F.array(*[F.lit(g).cast("long") for g in gates]))).where(F.col(n) >= F.col("min_n"))
    return spearman(gated.withColumn("flipped", 100 - F.col("ccme")), index, "flipped", ["min_n"])


def profile_by(df: DataFrame, bin_column: str, value: str) -> DataFrame:
    """Median and quartiles of the index in each bin."""
    return ordering.exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [bin_column])


def worst_group_name(groups: Sequence[str] = tuple(GROUPS)) -> Column:
    """Name of the group that is the row's maximum; the first one wins a tie."""
    worst = worst_group(groups)
    out = None
    for g in groups:
        hit = F.col(f"g_{g}") == worst
        out = F.when(hit, F.lit(g)) if out is None else out.when(hit, F.lit(g))
    return out


def index_driver(df: DataFrame, groups: Sequence[str] = tuple(GROUPS)) -> DataFrame:
    """How often each group is measured, how often it is the worst one, and the rate of the two."""
    rows = df.withColumn("_driver", worst_group_name(groups))
    agg = rows.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("_driver") == g).alias(f"d_{g}") for g in groups], *[F.count(f"g_{g}").alias(f"p_{g}") for g in groups]
    )
    out = [
        F.struct(
            F.lit(g).alias("group_name"), (100 * ratio(F.col(f"d_{g}"), F.col("n"))).alias("drives_pct"),
            (100 * ratio(F.col(f"p_{g}"), F.col("n"))).alias("measured_pct"), ratio(F.col(f"d_{g}"), F.col(f"p_{g}")).alias("drive_rate"),
        )
        for g in groups
    ]
    return agg.select(F.inline(F.array(*out)))


def index_bands(df: DataFrame, value: str) -> DataFrame:
    band = cut(value, BAND_EDGES, BAND_LABELS, include_lowest=True)
    counts = df.where(F.col(value).isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("samples"))
    # One row per band: the window over all of them is small.
    return counts.withColumn("pct", 100 * ratio(F.col("samples"), F.sum("samples").over(W.partitionBy(F.lit(0)))))
