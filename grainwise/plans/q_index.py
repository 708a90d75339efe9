"""Queries for scalar functions and the composite index."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions import display
from grainwise.functions import numeric as num
from grainwise.operators import association as assoc
from grainwise.operators import composite as ci
from grainwise.operators import ordering
from grainwise.plans.q_profile import rounded
from grainwise.plans.registry import query
from grainwise.plans.sqlviews import weighted_mean_sql
from grainwise.session import stored
from grainwise.sources import views
from grainwise.sources.tables import table


def scored(spark, sf, *only):
    """The scored samples, stored once as Parquet in the shared folder: all columns, or ``only`` those a report uses.

    A report that inlined the curves would compile them again in each of its stages, which takes longer than the store.
    """
    cols = ["station", "sample_id", "replicate", "ts", "covariate", "water_temp", "n_groups", "weight_coverage", "eligible", *FOUR, "worst"]
    return stored(ci.score(views.chemistry(spark, sf)).select(*(only or (*cols, *GROUP_COLUMNS))), "index")


GROUP_COLUMNS = [f"{k}_{g}" for k in ("g", "has") for g in ci.GROUPS]
FOUR = ["weighted_mean", "mean_max_blend", "harmonic", "weighted_harmonic"]


QS = list(ci.CURVES)


@query("subindex", "SELECT sample_id, replicate, station, " + ", ".join(f"round(q_{p}, 9) AS q_{p}" for p in QS) + " FROM v_subindex")
def subindex(spark, sf):
    out = ci.subindex_all(views.chemistry(spark, sf), {p: ci.CURVES[p] for p in QS})
    return rounded(out, 9, *[f"q_{p}" for p in QS]).select("sample_id", "replicate", "station", *[f"q_{p}" for p in QS])


@query(
    "subindex_summary",
    " UNION ALL ".join(
        f"SELECT 'q_{p}' AS variable, count(q_{p}) AS n, round(median(q_{p}), 6) AS median_q, round(quantile_cont(q_{p}, 0.9), 6) AS p90_q, "
        f"round(100 * count(*) FILTER (WHERE q_{p} > 50) / count(q_{p}), 6) AS pct_over FROM v_subindex"
        for p in QS
    ),
)
def subindex_summary(spark, sf):
    q = ci.subindex_all(views.chemistry(spark, sf), {p: ci.CURVES[p] for p in QS})
    return rounded(ci.subindex_summary(q, [f"q_{p}" for p in QS]), 6, "median_q", "p90_q", "pct_over")


# linear curves give terminating decimals that tie at six digits, log curves do not
LINEAR_GROUPS = {"oxygen", "nitrogen", "phosphorus", "acidity", "salinity"}


@query(
    "group_max",
    "SELECT sample_id, replicate, station, " + ", ".join(f"round(g_{g}, {9 if g in LINEAR_GROUPS else 6}) AS g_{g}" for g in ci.GROUPS) + " FROM v_groups",
)
def group_max(spark, sf):
    g = ci.group_max(ci.subindex_all(views.chemistry(spark, sf)))
    cols = [f"g_{x}" for x in ci.GROUPS]
    out = rounded(rounded(g, 6, *[c for c in cols if c[2:] not in LINEAR_GROUPS]), 9, *[c for c in cols if c[2:] in LINEAR_GROUPS])
    return out.select("sample_id", "replicate", "station", *cols)


@query(
    "index_eligibility",
    "SELECT station, count(*) AS n, count(*) FILTER (WHERE eligible) AS n_eligible, CAST(sum(n_groups) AS BIGINT) AS groups, round(avg(weight_coverage), 6) AS mean_coverage FROM v_index GROUP BY 1",
)
def index_eligibility(spark, sf):
    e = ci.eligibility(ci.group_max(ci.subindex_all(views.chemistry(spark, sf))))
    return e.groupBy("station").agg(
        F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.sum("n_groups").alias("groups"), F.round(F.avg("weight_coverage"), 6).alias("mean_coverage")
    )


@query(
    "rule_scan",
    """SELECT g.min_groups, w.min_weight, count(*) FILTER (WHERE ok) AS rows, count(DISTINCT station) FILTER (WHERE ok) AS stations, round(100 * count(*) FILTER (WHERE ok) / count(*), 6) AS rows_pct
       FROM (SELECT station, g.min_groups, w.min_weight, n_groups >= g.min_groups AND weight_coverage >= w.min_weight AS ok FROM v_eligible,
         (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS min_groups) g, (SELECT unnest([0.0, 0.3, 0.5, 0.7])::DOUBLE AS min_weight) w) t
       JOIN (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS min_groups) g ON t.min_groups = g.min_groups JOIN (SELECT unnest([0.0, 0.3, 0.5, 0.7])::DOUBLE AS min_weight) w ON t.min_weight = w.min_weight
       GROUP BY 1, 2""",
)
def rule_scan(spark, sf):
    e = ci.eligibility(ci.group_max(ci.subindex_all(views.chemistry(spark, sf)))).select("station", "n_groups", "weight_coverage")
    return rounded(ci.rule_scan(e, "station", (1, 2, 3, 4, 5), (0.0, 0.3, 0.5, 0.7)), 6, "rows_pct")


@query(
    "composite_index",
    "SELECT sample_id, replicate, station, " + ", ".join(f"round({c} + 1e-11, 9) AS {c}" for c in FOUR[:2]) + ", " + ", ".join(f"round({c}, 5) AS {c}" for c in FOUR[2:])
    + ", CASE WHEN eligible THEN n_groups::DOUBLE END AS index_groups, CASE WHEN eligible THEN round(weight_coverage, 3) END AS index_coverage FROM v_index",
)
def composite_index(spark, sf):
    s = ci.score(views.chemistry(spark, sf))
    # the weighted sums end in terminating decimals; the offset keeps them off rounding ties
    s = rounded(s.withColumns({c: F.round(F.col(c) + 1e-11, 9) for c in FOUR[:2]}), 5, *FOUR[2:])
    return s.select(
        "sample_id", "replicate", "station", *FOUR, F.when(F.col("eligible"), F.col("n_groups").cast("double")).alias("index_groups"),
        F.when(F.col("eligible"), F.round("weight_coverage", 3)).alias("index_coverage"),
    )


def scheme_sql(label: str, variants: dict[str, str]) -> str:
    """Oracle of compare_schemes: ``variants`` are SQL expressions over v_index rows."""
    long = " UNION ALL ".join(f"SELECT '{k}' AS {label}, {e} AS v, mean_max_blend AS b FROM v_index WHERE eligible" for k, e in variants.items())
    return f"""WITH long AS ({long}), r AS (SELECT {label}, v, b, rank() OVER (PARTITION BY {label} ORDER BY v) + (count(*) OVER (PARTITION BY {label}, v) - 1) / 2.0::DOUBLE AS rv,
      rank() OVER (PARTITION BY {label} ORDER BY b) + (count(*) OVER (PARTITION BY {label}, b) - 1) / 2.0::DOUBLE AS rb FROM long)
    SELECT {label}, count(*) AS n, round(median(v), 5) AS median, round(100 * count(*) FILTER (WHERE v > 50) / count(*), 4) AS pct_over, round(median(abs(v - b)), 5) AS median_abs_change,
      round(corr(rv, rb), 5) AS rho FROM r GROUP BY 1"""


LAMBDAS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@query("lambda_scan", scheme_sql('"lambda"', {f"{x:.1f}": f"({1.0 - x!r}::DOUBLE * weighted_mean + {x!r}::DOUBLE * worst)" for x in LAMBDAS}))
def lambda_scan(spark, sf):
    out = ci.lambda_scan(scored(spark, sf, "eligible", "weighted_mean", "worst", "mean_max_blend"), LAMBDAS)
    return rounded(rounded(out, 5, "median", "median_abs_change", "rho"), 4, "pct_over")


SCHEMES = {**ci.NAMED_SCHEMES, **ci.jittered_schemes(30, seed=5)}


@query("weight_sensitivity", scheme_sql("scheme", {k: f"(0.6 * {weighted_mean_sql(w)} + 0.4 * worst)" for k, w in SCHEMES.items()}))
def weight_sensitivity(spark, sf):
    out = ci.weight_sensitivity(scored(spark, sf, "eligible", "worst", "mean_max_blend", *GROUP_COLUMNS), SCHEMES)
    return rounded(rounded(out, 5, "median", "median_abs_change", "rho"), 4, "pct_over")


_THERMAL_W = {g: w / (1 + ci.THERMAL_WEIGHT) for g, w in {**ci.WEIGHTS, "thermal": ci.THERMAL_WEIGHT}.items()}


@query(
    "add_component",
    f"""SELECT station, count(*) AS n, round(median(with_thermal), 4) AS median_with, round(median(mean_max_blend), 4) AS median_without, count(*) FILTER (WHERE g_thermal = w2 AND g_thermal > coalesce(worst_all, -1)) AS n_thermal_worst
        FROM (SELECT *, 0.6 * {weighted_mean_sql(_THERMAL_W)} + 0.4 * greatest(worst_all, g_thermal) AS with_thermal, greatest(worst_all, g_thermal) AS w2 FROM
          (SELECT *, CASE WHEN water_temp <= 20 THEN 0.0::DOUBLE WHEN water_temp <= 29 THEN (water_temp - 20) * (25::DOUBLE / 9) WHEN water_temp <= 32 THEN 25 + (water_temp - 29) * (25::DOUBLE / 3)
             WHEN water_temp <= 35 THEN 50 + (water_temp - 32) * (50::DOUBLE / 3) ELSE CASE WHEN water_temp IS NOT NULL THEN 100.0::DOUBLE END END AS g_thermal FROM v_index WHERE eligible)) GROUP BY 1""",
)
def add_component(spark, sf):
    out = ci.add_component(scored(spark, sf), "thermal", "water_temp", ci.THERMAL_CURVE, ci.THERMAL_WEIGHT).where("eligible")
    a = ordering.exact_quantiles(out, "with_thermal", {"median_with": 0.5}, ["station"])
    b = ordering.exact_quantiles(out, "mean_max_blend", {"median_without": 0.5}, ["station"]).drop("n")
    c = out.groupBy("station").agg(F.count_if(F.col("driver") == "thermal").alias("n_thermal_worst"))
    return rounded(a.join(b, "station").join(c, "station"), 4, "median_with", "median_without")


_CCME = """c AS (SELECT station, count(*) AS n, """ + ", ".join(
    f"count(g_{g}) AS t_{g}, count(*) FILTER (WHERE g_{g} > 50) AS f_{g}, coalesce(sum(g_{g} / 50 - 1) FILTER (WHERE g_{g} > 50), 0) AS e_{g}" for g in ci.GROUPS
) + """ FROM v_index WHERE eligible GROUP BY 1), s AS (SELECT station, n, """ + " + ".join(f"(t_{g} > 0)::INT" for g in ci.GROUPS) + " AS nv, " + " + ".join(
    f"t_{g}" for g in ci.GROUPS
) + " AS t, " + " + ".join(f"(f_{g} > 0)::INT" for g in ci.GROUPS) + " AS fv, " + " + ".join(f"f_{g}" for g in ci.GROUPS) + " AS f, " + " + ".join(
    f"e_{g}" for g in ci.GROUPS
) + """ AS e FROM c), ccme AS (SELECT station, n, CASE WHEN nv >= 4 AND n >= 4 THEN 100 - sqrt(power(100 * fv / nv, 2) + power(100 * f / t, 2) + power((e / t) / (0.01 * (e / t) + 0.01), 2)) / 1.732 END AS ccme FROM s)"""


@query("ccme_index", f"WITH {_CCME} SELECT station, n, round(ccme, 6) AS ccme FROM ccme")
def ccme_index(spark, sf):
    rows = scored(spark, sf).where("eligible")
    return rounded(ci.ccme_index(rows, "station", [f"g_{g}" for g in ci.GROUPS]), 6, "ccme")


GATES = [4, 10, 20, 40]


@query(
    "index_benchmark",
    f"""WITH {_CCME}, st AS (SELECT station, median(mean_max_blend) AS m, count(mean_max_blend) AS n FROM v_index WHERE eligible GROUP BY 1),
        b AS (SELECT k.min_n, m, 100 - ccme AS f FROM st JOIN ccme ON st.station = ccme.station, (SELECT unnest([4, 10, 20, 40])::BIGINT AS min_n) k WHERE ccme IS NOT NULL AND st.n >= k.min_n),
        r AS (SELECT min_n, rank() OVER (PARTITION BY min_n ORDER BY m) + (count(*) OVER (PARTITION BY min_n, m) - 1) / 2.0::DOUBLE AS a,
          rank() OVER (PARTITION BY min_n ORDER BY f) + (count(*) OVER (PARTITION BY min_n, f) - 1) / 2.0::DOUBLE AS c FROM b)
        SELECT min_n, count(*) AS n, round(corr(a, c), 6) AS rho FROM r GROUP BY 1""",
)
def index_benchmark(spark, sf):
    rows = scored(spark, sf, "eligible", "station", "mean_max_blend", *[f"g_{g}" for g in ci.GROUPS]).where("eligible")
    station = ordering.exact_quantiles(rows, "mean_max_blend", {"index": 0.5}, ["station"])
    ccme = ci.ccme_index(rows, "station", [f"g_{g}" for g in ci.GROUPS])
    return rounded(ci.index_benchmark(station, ccme, "station", "index", "n", GATES), 6, "rho")


@query(
    "decile_profile",
    """WITH t AS (SELECT covariate AS x, mean_max_blend AS v FROM v_index WHERE eligible),
       e AS (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM t)
       SELECT bin, count(*) AS n, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3
       FROM (SELECT greatest(len(list_filter(q, lambda z: z < x)) - 1, 0) AS bin, v FROM t, e) GROUP BY 1""",
)
def decile_profile(spark, sf):
    """Index by decile of a covariate that lies in the sample's own row."""
    rows = scored(spark, sf, "eligible", "covariate", "mean_max_blend").where("eligible").select(F.col("covariate").alias("x"), "mean_max_blend")
    edges = ordering.exact_quantiles(rows, "x", {f"e{i}": i / 10 for i in range(11)}).select(F.array_distinct(F.array(*[f"e{i}" for i in range(11)]))).first()[0]
    binned = rows.withColumn("bin", assoc.right_closed_bin(F.col("x"), F.lit(edges)))
    return rounded(ci.profile_by(binned, "bin", "mean_max_blend"), 5, "q1", "median", "q3")


@query(
    "fortnight_profile",
    """SELECT CAST(ceil(dayofyear(ts) / 14.0) AS BIGINT) AS fortnight, count(*) AS n, round(quantile_cont(mean_max_blend, 0.25), 5) AS q1, round(median(mean_max_blend), 5) AS median,
         round(quantile_cont(mean_max_blend, 0.75), 5) AS q3 FROM v_index WHERE eligible GROUP BY 1""",
)
def fortnight_profile(spark, sf):
    rows = scored(spark, sf, "eligible", "ts", "mean_max_blend").where("eligible").select(num.fortnight("ts").alias("fortnight"), "mean_max_blend")
    return rounded(ci.profile_by(rows, "fortnight", "mean_max_blend"), 5, "q1", "median", "q3")


@query(
    "station_summary",
    """SELECT g.gauge AS station, round(lat, 4) AS lat, round(lon, 4) AS lon, round(m, 5) AS index_median, i.n FROM v_gauge g JOIN
         (SELECT station, median(mean_max_blend) AS m, count(*) AS n FROM v_index WHERE eligible GROUP BY 1 HAVING count(*) >= 5) i ON g.gauge = i.station""",
)
def station_summary(spark, sf):
    rows = scored(spark, sf).where("eligible")
    med = ordering.exact_quantiles(rows, "mean_max_blend", {"index_median": 0.5}, ["station"]).where("n >= 5")
    st = views.gauge(spark, sf).select(F.col("gauge").alias("station"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    return rounded(st.join(med, "station"), 5, "index_median")


_DRIVER = "CASE " + " ".join(f"WHEN g_{g} = worst THEN '{g}'" for g in ci.GROUPS) + " END"


@query(
    "index_driver",
    " UNION ALL ".join(
        f"SELECT '{g}' AS group_name, round(100 * count(*) FILTER (WHERE d = '{g}') / count(*), 6) AS drives_pct, round(100 * count(g_{g}) / count(*), 6) AS measured_pct, "
        f"round(count(*) FILTER (WHERE d = '{g}') / count(g_{g}), 6) AS drive_rate FROM (SELECT *, {_DRIVER} AS d FROM v_index WHERE eligible)"
        for g in ci.GROUPS
    ),
)
def index_driver(spark, sf):
    return rounded(ci.index_driver(scored(spark, sf).where("eligible")), 6, "drives_pct", "measured_pct", "drive_rate")


@query(
    "index_bands",
    """SELECT CASE WHEN v <= 25 THEN 'clean' WHEN v <= 50 THEN 'within standards' WHEN v <= 75 THEN 'impaired' ELSE 'severely impaired' END AS band, count(*) AS samples,
         round(100 * count(*) / (SELECT count(mean_max_blend) FROM v_index), 6) AS pct FROM (SELECT mean_max_blend AS v FROM v_index WHERE eligible) GROUP BY 1""",
)
def index_bands(spark, sf):
    return rounded(ci.index_bands(scored(spark, sf), "mean_max_blend"), 6, "pct")


@query(
    "temporal_features",
    """SELECT event_id, dayofyear(ts) AS doy, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos, year(ts) AS year FROM events""",
)
def temporal_features(spark, sf):
    t = num.cyclical("ts")
    return table(spark, sf, "events").select(
        "event_id", t["doy"].cast("long").alias("doy"), F.round(t["doy_sin"], 6).alias("doy_sin"), F.round(t["doy_cos"], 6).alias("doy_cos"), t["year"].cast("long").alias("year")
    )


@query(
    "haversine",
    """SELECT s.station, round(2 * 6371.0088 * asin(sqrt(least(power(sin(radians(g.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(g.lat)) * power(sin(radians(g.lon - s.lon) / 2), 2), 1))), 5) AS km
       FROM v_station s, (SELECT 42.03::DOUBLE AS lat, -93.58::DOUBLE AS lon) g""",
)
def haversine(spark, sf):
    """Distance of every station from a fixed point."""
    return views.station(spark, sf).select("station", F.round(num.haversine_km(F.col("lat"), F.col("lon"), F.lit(42.03), F.lit(-93.58)), 5).alias("km"))


@query(
    "log_transform",
    """WITH c AS (SELECT event_type, 0.01 * median(value) AS c FROM events WHERE value > 0 GROUP BY 1), r AS (SELECT e.event_id, e.event_type, c.c, log10(value + c) AS z, avg(log10(value + c)) OVER (PARTITION BY e.event_type) AS m
         FROM events e JOIN c ON e.event_type = c.event_type), s AS (SELECT event_type, avg(power(10, z - m)) AS smear FROM r GROUP BY 1)
       SELECT event_id, round(c, 6) AS offset_c, round(z, 6) AS z, round(smear, 6) AS smear, round(greatest(power(10, m) * smear - c, 0), 6) AS back FROM r JOIN s ON r.event_type = s.event_type""",
)
def log_transform(spark, sf):
    """Offset, log fit (a per-type mean as the model), smearing factor and back-transform."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    c = ordering.exact_quantiles(ev.where("value > 0"), "value", {"m": 0.5}, ["event_type"]).select("event_type", (0.01 * F.col("m")).alias("offset_c"))
    z = ev.join(c, "event_type").withColumn("z", num.log_offset("value", F.col("offset_c")))
    fit = z.groupBy("event_type").agg(F.avg("z").alias("m"))
    r = z.join(fit, "event_type")
    smear = r.groupBy("event_type").agg(F.avg(F.pow(F.lit(10.0), F.col("z") - F.col("m"))).alias("smear"))
    out = r.join(smear, "event_type").withColumn("back", num.undo_log_offset("m", F.col("offset_c"), F.col("smear")))
    return rounded(out, 6, "offset_c", "z", "smear", "back").select("event_id", "offset_c", "z", "smear", "back")


@query(
    "cut_bands",
    """SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN NULL WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 250000 THEN 'mid' WHEN o_totalprice <= 600000 THEN 'high' END AS band,
         CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring' WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season FROM orders""",
)
def cut_bands(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", num.cut("o_totalprice", [1000.0, 50000.0, 250000.0, 600000.0], ["low", "mid", "high"]).alias("band"), num.season("o_orderdate").alias("season")
    )


@query(
    "quantile_bins",
    """WITH e AS (SELECT list_distinct(list_sort(quantile_cont(l_quantity, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM lineitem), s AS (SELECT list_sort(q) AS q FROM e)
       SELECT least(greatest(len(list_filter(q, lambda z: z <= l_quantity)) - 1, 0), len(q) - 2) AS left_closed, greatest(len(list_filter(q, lambda z: z < l_quantity)) - 1, 0) AS right_closed,
         count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem, s GROUP BY 1, 2""",
)
def quantile_bins(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity")
    edges = F.lit(assoc.quantile_edges(li, "l_quantity", [], 10).first()[0])
    x = F.col("l_quantity")
    return li.select(assoc.left_closed_bin(x, edges).alias("left_closed"), assoc.right_closed_bin(x, edges).alias("right_closed"), x).groupBy("left_closed", "right_closed").agg(
        F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )


# Every rule set in turn, then a target without rules.
RULED = [*display.LABEL_RULES, "Alkalinity"]


def label_sql(target, value):
    out = f"CASE WHEN {value} IS NULL THEN 'Unknown'"
    for name, (limits, beyond) in display.LABEL_RULES.items():
        out += "".join(f" WHEN {target} = '{name}' AND {value} {'<=' if inclusive else '<'} {limit} THEN '{label}'" for limit, inclusive, label in limits) + f" WHEN {target} = '{name}' THEN '{beyond}'"
    return out + " ELSE 'Measured' END"


@query(
    "classify_value",
    f"""SELECT event_id, {label_sql('target', 'value')} AS label FROM (SELECT event_id, list_extract({RULED!r}, CAST(event_id % {len(RULED)} + 1 AS INT)) AS target,
       CASE WHEN event_id % 11 <> 0 THEN value / (1 + event_id % 9) END AS value FROM events)""",
)
def classify_value(spark, sf):
    target = F.get(F.array(*[F.lit(x) for x in RULED]), (F.col("event_id") % len(RULED)).cast("int"))
    ev = table(spark, sf, "events").select("event_id", target.alias("target"), F.expr("CASE WHEN event_id % 11 <> 0 THEN value / (1 + event_id % 9) END").alias("value"))
    return ev.select("event_id", display.classify_value("target", "value").alias("label"))


@query(
    "calendar_levels",
    """WITH d AS (SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
       s AS (SELECT *, min(v) OVER (PARTITION BY event_type) AS lo, max(v) OVER (PARTITION BY event_type) AS hi FROM d)
       SELECT event_type, day, v, CASE WHEN hi <= lo THEN 2 WHEN (v - lo) / (hi - lo) < 0.2 THEN 0 WHEN (v - lo) / (hi - lo) < 0.4 THEN 1 WHEN (v - lo) / (hi - lo) < 0.6 THEN 2 WHEN (v - lo) / (hi - lo) < 0.8 THEN 3 ELSE 4 END AS level FROM s""",
)
def calendar_levels(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return display.calendar_levels(d, ["event_type"], "v")


@query(
    "regression_metrics",
    """WITH t AS (SELECT l_returnflag AS model, l_extendedprice AS y, 25000 + l_quantity * 500 AS p FROM lineitem)
       SELECT model, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
         round(avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(y - p) / (abs(y) + abs(p)) END), 6) AS smape FROM t GROUP BY 1""",
)
def regression_metrics(spark, sf):
    from grainwise.operators.evaluation import regression_metrics as metrics

    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("y"), (25000 + F.col("l_quantity") * 500).alias("p"))
    return rounded(rounded(metrics(t, "y", "p", ["model"]), 6, "r2", "smape"), 4, "rmse", "mae")


@query(
    "json_features",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(user_id AS DOUBLE) AS lon, value AS lat FROM events""",
)
def json_features(spark, sf):
    """Feature-collection text to rows: properties and point coordinates of every feature."""
    from grainwise.sources.features import explode_features

    doc = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":'), F.col("props"),
        F.lit(',"geometry":{"type":"Point","coordinates":['), F.col("user_id").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit("]}}]}"),
    )
    ev = table(spark, sf, "events").select("event_id", doc.alias("doc"))
    return explode_features(ev, "doc", "k BIGINT").select("event_id", F.col("properties.k").alias("k"), "lon", "lat")
