"""Queries for association and spatio-temporal statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions.numeric import key_hash_sql, two_sided_p_sql
from grainwise.operators import association as a
from grainwise.operators import ordering
from grainwise.plans.q_profile import rounded
from grainwise.plans.registry import query
from grainwise.session import cut_lineage, stored
from grainwise.sources import views
from grainwise.sources.tables import table

BY = ["target", "feature"]
RANKED = """WITH r AS (SELECT cluster, target, feature, x, y, rank() OVER (PARTITION BY target, feature ORDER BY x) + (count(*) OVER (PARTITION BY target, feature, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY target, feature ORDER BY y) + (count(*) OVER (PARTITION BY target, feature, y) - 1) / 2.0::DOUBLE AS ry FROM v_pairs)"""


@query("pairwise_pearson", "SELECT target, feature, count(*) AS n, round(corr(x, y), 6) AS pearson FROM v_pairs GROUP BY 1, 2 HAVING count(*) >= 200")
def pairwise_pearson(spark, sf):
    return rounded(a.pairwise_pearson(views.pairs(spark, sf), BY), 6, "pearson")


def stored_pairs(spark, sf):
    """The pairs of views.pairs over the wide rows, written once: the rank statistics read them several times."""
    rows = stored(views.features(spark, sf).select("cluster", *views.TARGETS, *views.FEATURES), "features")
    return a.ColumnPairs(rows, tuple(BY), {(t, f): (f, t) for t in views.TARGETS for f in views.FEATURES})


@query("pairwise_spearman", RANKED + " SELECT target, feature, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2")
def pairwise_spearman(spark, sf):
    return rounded(a.spearman(stored_pairs(spark, sf), "x", "y", BY), 6, "rho")


@query(
    "cluster_robust_rho",
    RANKED + """, s AS (SELECT *, (rx - avg(rx) OVER w) / stddev_pop(rx) OVER w AS xs, (ry - avg(ry) OVER w) / stddev_pop(ry) OVER w AS ys FROM r WINDOW w AS (PARTITION BY target, feature)),
      m AS (SELECT target, feature, count(*) AS n, avg(xs * ys) AS rho FROM s GROUP BY 1, 2),
      p AS (SELECT s.target, s.feature, s.cluster, m.n, m.rho, sum(xs * ys - 0.5 * m.rho * (xs * xs + ys * ys)) AS c, sum(power(xs * ys - 0.5 * m.rho * (xs * xs + ys * ys), 2)) AS i
        FROM s JOIN m ON s.target = m.target AND s.feature = m.feature GROUP BY 1, 2, 3, 4, 5)
      SELECT target, feature, n, count(*) AS n_clusters, round(rho, 6) AS rho, round(sqrt(sum(i)) / n, 6) AS se_iid, round(sqrt(sum(c * c)) / n, 6) AS se_cluster, round(sum(c * c) / sum(i), 4) AS design_effect,
        round(n / (sum(c * c) / sum(i)), 1) AS n_eff, round(rho - 1.96 * sqrt(sum(c * c)) / n, 6) AS ci_lo, round(rho + 1.96 * sqrt(sum(c * c)) / n, 6) AS ci_hi, round("""
    + two_sided_p_sql("(rho * n / sqrt(sum(i)))") + ", 5) AS p_iid, round(" + two_sided_p_sql("(rho * n / sqrt(sum(c * c)))") + """, 5) AS p_cluster
      FROM p GROUP BY target, feature, n, rho""",
)
def cluster_robust_rho(spark, sf):
    out = a.cluster_robust_rho(stored_pairs(spark, sf), BY, "cluster", "x", "y")
    out = rounded(rounded(out, 6, "rho", "se_iid", "se_cluster", "ci_lo", "ci_hi"), 4, "design_effect")
    return rounded(rounded(out, 1, "n_eff"), 5, "p_iid", "p_cluster").select(*BY, "n", "n_clusters", "rho", "se_iid", "se_cluster", "design_effect", "n_eff", "ci_lo", "ci_hi", "p_iid", "p_cluster")


@query(
    "between_within_corr",
    RANKED.replace("FROM v_pairs", "FROM (SELECT * FROM v_pairs QUALIFY count(*) OVER (PARTITION BY target, feature, cluster) >= 5)") + """,
      g AS (SELECT *, avg(rx) OVER w AS mx, avg(ry) OVER w AS my FROM r WINDOW w AS (PARTITION BY target, feature, cluster)),
      b AS (SELECT target, feature, count(*) AS n_clusters, corr(mx, my) AS between_rho FROM (SELECT DISTINCT target, feature, cluster, mx, my FROM g) GROUP BY 1, 2)
      SELECT g.target, g.feature, count(*) AS n, any_value(n_clusters) AS n_clusters, round(corr(rx, ry), 6) AS overall, round(any_value(between_rho), 6) AS "between", round(corr(rx - mx, ry - my), 6) AS within, false AS cluster_invariant,
        sign(any_value(between_rho)) <> sign(corr(rx - mx, ry - my)) AND abs(any_value(between_rho)) > 0.1 AND abs(corr(rx - mx, ry - my)) > 0.1 AS sign_flip
      FROM g JOIN b ON g.target = b.target AND g.feature = b.feature GROUP BY 1, 2""",
)
def between_within_corr(spark, sf):
    out = a.between_within_corr(stored_pairs(spark, sf), BY, "cluster", "x", "y")
    return rounded(out, 6, "overall", "between", "within").select(*BY, "n", "n_clusters", "overall", "between", "within", "cluster_invariant", "sign_flip")


FEATURE_BLOCKS = {"qty": "order", "total": "order", "psize": "part", "retail": "part", "doy": "season"}
_BLOCK = "CASE feature " + " ".join(f"WHEN '{f}' THEN '{b}'" for f, b in FEATURE_BLOCKS.items()) + " END"


@query(
    "block_strength",
    RANKED.replace("FROM v_pairs", "FROM (SELECT * FROM v_pairs QUALIFY count(*) OVER (PARTITION BY target, feature, cluster) >= 5)") + f""",
      g AS (SELECT *, avg(rx) OVER w AS mx, avg(ry) OVER w AS my FROM r WINDOW w AS (PARTITION BY target, feature, cluster)),
      b AS (SELECT target, feature, corr(mx, my) AS between_rho FROM (SELECT DISTINCT target, feature, cluster, mx, my FROM g) GROUP BY 1, 2),
      d AS (SELECT target, feature, corr(rx, ry) AS overall, corr(rx - mx, ry - my) AS within FROM g GROUP BY 1, 2)
      SELECT {_BLOCK} AS block, round(avg(abs(overall)), 6) AS overall, round(avg(abs(between_rho)), 6) AS "between", round(avg(abs(within)), 6) AS within FROM d JOIN b USING (target, feature) GROUP BY 1""",
)
def block_strength(spark, sf):
    """How strongly the features of each block go with the targets, between and within clusters."""
    out = a.block_strength(a.between_within_corr(stored_pairs(spark, sf), BY, "cluster", "x", "y"), FEATURE_BLOCKS)
    return rounded(out, 6, "overall", "between", "within")


CATS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber")]


def _cramers_sql(x, y):
    return f"""SELECT '{x}' AS a, '{y}' AS b, n, round(sqrt(greatest(0, s - 1 - (k - 1) * (r - 1) / (n - 1)) / least(k - (k - 1) * (k - 1) / (n - 1) - 1, r - (r - 1) * (r - 1) / (n - 1) - 1)), 6) AS cramers_v
      FROM (SELECT CAST(sum(o) AS BIGINT) AS n, sum(o * o / (ru * cv)) AS s, count(DISTINCT u)::DOUBLE AS r, count(DISTINCT v)::DOUBLE AS k FROM (SELECT u, v, o, sum(o) OVER (PARTITION BY u) AS ru, sum(o) OVER (PARTITION BY v) AS cv
        FROM (SELECT {x} AS u, {y} AS v, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1, 2)))"""


@query("cramers_v", " UNION ALL ".join(_cramers_sql(x, y) for x, y in CATS))
def cramers_v(spark, sf):
    return rounded(a.cramers_v(table(spark, sf, "lineitem"), CATS), 6, "cramers_v")


@query(
    "kruskal_epsilon",
    """WITH t AS (SELECT 'value' AS target, event_type AS category, value, user_id FROM events), r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r, count(*) OVER () AS n FROM t),
      tie AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY value)), g AS (SELECT category, count(*) AS g, sum(r) AS s, any_value(n)::DOUBLE AS n FROM r GROUP BY 1),
      h AS (SELECT count(*) AS k_groups, any_value(n) AS n, (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / g) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (power(any_value(n), 3) - any_value(n))) AS h FROM g, tie)
      SELECT 'value' AS target, k_groups, CAST(n AS BIGINT) AS n, round(h, 5) AS h, round(greatest((h - k_groups + 1) / (n - k_groups), 0), 6) AS epsilon_sq,
        (SELECT round(100 * avg((c = 1)::INT), 6) FROM (SELECT count(DISTINCT category) AS c FROM t GROUP BY user_id)) AS pct_single_category FROM h""",
)
def kruskal_epsilon(spark, sf):
    t = table(spark, sf, "events").select(F.lit("value").alias("target"), F.col("event_type").alias("category"), "value", "user_id")
    out = a.kruskal_epsilon(t, ["target"], "category", "value", "user_id").drop("p")
    return rounded(rounded(out, 5, "h"), 6, "epsilon_sq", "pct_single_category")


@query(
    "missingness_bias",
    """WITH t AS (SELECT event_type, value, event_id % 7 <> 0 AS p FROM events), r AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS r FROM t),
      s AS (SELECT event_type, count(*) FILTER (WHERE p) AS na, count(*) FILTER (WHERE NOT p) AS nb, sum(r) FILTER (WHERE p) AS ra, median(value) FILTER (WHERE p) AS mp, median(value) FILTER (WHERE NOT p) AS ma FROM r GROUP BY 1)
      SELECT event_type, na AS n_present, nb AS n_absent, round(mp, 6) AS median_present, round(ma, 6) AS median_absent, round(2 * (ra - na * (na + 1) / 2) / (na * nb) - 1, 6) AS rank_biserial FROM s WHERE na >= 100 AND nb >= 100""",
)
def missingness_bias(spark, sf):
    t = table(spark, sf, "events").select("event_type", "value", (F.col("event_id") % 7 != 0).alias("p"))
    return rounded(a.missingness_bias(t, ["event_type"], "value", "p").drop("p"), 6, "median_present", "median_absent", "rank_biserial")


COLS = ["qty", "psize", "retail", "total", "doy", "price"]


@query(
    "strong_pairs",
    "WITH l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {x} AS x, {y} AS y FROM v_features" for i, x in enumerate(COLS) for y in COLS[i + 1:]) + """),
      r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM l)
      SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho, (a IN ('psize', 'retail')) = (b IN ('psize', 'retail')) AS same_block FROM r GROUP BY 1, 2 HAVING abs(corr(rx, ry)) >= 0.005""",
)
def strong_pairs(spark, sf):
    blocks = {c: "part" if c in ("psize", "retail") else "order" for c in COLS}
    return rounded(a.strong_pairs(stored(views.features(spark, sf).select(*COLS), "features"), COLS, blocks, 0.005), 6, "rho")


@query(
    "persistence_baseline",
    """WITH t AS (SELECT event_type, value AS y, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events), k AS (SELECT * FROM t WHERE p IS NOT NULL)
      SELECT event_type, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_samp(y) * (count(*) - 1)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse FROM k GROUP BY 1""",
)
def persistence_baseline(spark, sf):
    from grainwise.operators.evaluation import regression_metrics

    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    prev = ordering.previous_visit(ev, ["user_id", "event_type"], "ts", "event_id", "value")
    return rounded(rounded(regression_metrics(prev, "value", "prev_value", ["event_type"]), 6, "r2"), 5, "rmse").select("event_type", "n", "r2", "rmse")


@query(
    "loo_influence",
    """WITH k AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM k),
      d AS (SELECT ((sxy - x * y) - (sx - x) * (sy - y) / (n - 1)) / sqrt(((sxx - x * x) - power(sx - x, 2) / (n - 1)) * ((syy - y * y) - power(sy - y, 2) / (n - 1))) AS wo,
        (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r, n, l_orderkey, l_linenumber FROM k, s)
      SELECT 'qty' AS pair, CAST(any_value(n) AS BIGINT) AS n, round(any_value(r), 6) AS pearson, round(arg_max(wo, abs(wo - r)), 6) AS pearson_without, round(max(abs(wo - r)), 8) AS max_abs_delta,
        arg_max(l_orderkey, (round(abs(wo - r), 12), -l_orderkey, -l_linenumber)) AS l_orderkey, arg_max(l_linenumber, (round(abs(wo - r), 12), -l_orderkey, -l_linenumber)) AS l_linenumber FROM d""",
)
def loo_influence(spark, sf):
    t = table(spark, sf, "lineitem").select(F.lit("qty").alias("pair"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), "l_orderkey", "l_linenumber")
    out = a.loo_influence(t, ["pair"], "x", "y", ["l_orderkey", "l_linenumber"])
    return rounded(rounded(out, 6, "pearson", "pearson_without"), 8, "max_abs_delta")


@query(
    "binned_profile",
    """WITH t AS (SELECT l_returnflag AS grp, l_extendedprice AS x, l_quantity AS y FROM lineitem), e AS (SELECT grp, quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM t GROUP BY 1),
      b AS (SELECT t.grp, x, y, least(greatest(len(list_filter(q, lambda z: z <= x)) - 1, 0), len(q) - 2) AS bin FROM t JOIN e ON t.grp = e.grp)
      SELECT grp, bin, count(*) AS n, round(median(x), 5) AS x_mid, round(quantile_cont(y, 0.25), 5) AS q1, round(median(y), 5) AS med, round(quantile_cont(y, 0.75), 5) AS q3, round(stddev_samp(y), 5) AS sd,
        round(1.2533 * stddev_samp(y) / sqrt(count(*)), 5) AS se_med FROM b GROUP BY 1, 2 HAVING count(*) >= 20""",
)
def binned_profile(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(a.binned_profile(t, ["grp"], "x", "y"), 5, "x_mid", "q1", "med", "q3", "sd", "se_med")


# The binned profile of the query above, unrounded.
PROFILE_SQL = """t AS (SELECT l_returnflag AS grp, l_extendedprice AS x, l_quantity AS y FROM lineitem), e AS (SELECT grp, quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM t GROUP BY 1),
      b AS (SELECT t.grp, x, y, least(greatest(len(list_filter(q, lambda z: z <= x)) - 1, 0), len(q) - 2) AS bin FROM t JOIN e ON t.grp = e.grp),
      pr AS (SELECT grp, bin, count(*) AS n, quantile_cont(y, 0.25) AS q1, median(y) AS med, quantile_cont(y, 0.75) AS q3, 1.2533 * stddev_samp(y) / sqrt(count(*)) AS se_med FROM b GROUP BY 1, 2 HAVING count(*) >= 20)"""


def bin_trend_sql(value):
    """Rank correlation of the bin order with a per-bin value."""
    return f"""SELECT grp, corr(k, r) AS trend FROM (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY bin) AS k,
        rank() OVER (PARTITION BY grp ORDER BY {value}) + (count(*) OVER (PARTITION BY grp, {value}) - 1) / 2.0::DOUBLE AS r FROM pr) GROUP BY 1"""


@query(
    "classify_shape",
    f"""WITH {PROFILE_SQL}, st AS (SELECT *, abs(med - lag(med) OVER (PARTITION BY grp ORDER BY bin)) AS step FROM pr), tr AS ({bin_trend_sql('med')}),
      sc AS (SELECT grp, CASE WHEN quantile_cont(y, 0.75) > quantile_cont(y, 0.25) THEN quantile_cont(y, 0.75) - quantile_cont(y, 0.25) WHEN quantile_cont(y, 0.9) > quantile_cont(y, 0.1) THEN quantile_cont(y, 0.9) - quantile_cont(y, 0.1)
        ELSE nullif(stddev_samp(y), 0) END AS scale FROM t GROUP BY 1),
      ag AS (SELECT grp, count(*) AS levels, max(med) AS hi, min(med) AS lo, arg_min(med, bin) AS f, arg_max(med, bin) AS l, min(bin) AS b0, max(bin) AS b1, arg_max(bin, (med, -bin)) AS b_hi, arg_min(bin, (med, bin)) AS b_lo,
        max(step) AS ms, sum(step) AS ss, 2 * median(se_med) AS noise FROM st GROUP BY 1)
      SELECT grp, levels, CASE WHEN levels < {a.MIN_LEVELS} OR scale IS NULL OR scale <= 0 THEN 'too few levels' WHEN (hi - lo) / scale < {a.FLAT_SHARE} OR hi - lo < noise THEN 'flat'
          WHEN b_hi > b0 AND b_hi < b1 AND hi - greatest(f, l) >= greatest({a.ARM_SHARE} * (hi - lo), noise) THEN 'hump' WHEN b_lo > b0 AND b_lo < b1 AND least(f, l) - lo >= greatest({a.ARM_SHARE} * (hi - lo), noise) THEN 'valley'
          WHEN abs(trend) >= {a.MONOTONE_RHO} AND ms >= {a.STEP_SHARE} * ss THEN 'threshold' WHEN trend >= {a.MONOTONE_RHO} THEN 'monotone up' WHEN trend <= -{a.MONOTONE_RHO} THEN 'monotone down' ELSE 'irregular' END AS shape,
        round((hi - lo) / scale, 6) AS median_range_over_scale
      FROM ag JOIN tr USING (grp) JOIN sc USING (grp)""",
)
def classify_shape(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    profile = cut_lineage(a.binned_profile(t, ["grp"], "x", "y"))
    return rounded(a.classify_shape(profile, a.robust_scale(t, "y", ["grp"]), ["grp"], ["grp"]), 6, "median_range_over_scale")


@query(
    "effect_size_rank",
    f"""WITH {PROFILE_SQL}, sc AS (SELECT grp, CASE WHEN quantile_cont(y, 0.75) > quantile_cont(y, 0.25) THEN quantile_cont(y, 0.75) - quantile_cont(y, 0.25) WHEN quantile_cont(y, 0.9) > quantile_cont(y, 0.1) THEN quantile_cont(y, 0.9) - quantile_cont(y, 0.1)
         ELSE nullif(stddev_samp(y), 0) END AS scale FROM t GROUP BY 1), ef AS (SELECT grp, (max(med) - min(med)) / any_value(scale) AS effect FROM pr JOIN sc USING (grp) GROUP BY 1),
       rk AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0::DOUBLE AS ry FROM t),
       rho AS (SELECT grp, abs(corr(rx, ry)) AS abs_rho FROM rk GROUP BY 1)
       SELECT grp, round(effect, 6) AS median_range_over_scale, round(abs_rho, 6) AS abs_rho, round(percent_rank() OVER (ORDER BY effect), 6) AS effect_pct, round(percent_rank() OVER (ORDER BY abs_rho), 6) AS rho_pct,
         round(percent_rank() OVER (ORDER BY effect) - percent_rank() OVER (ORDER BY abs_rho), 6) AS rank_gap FROM ef JOIN rho USING (grp)""",
)
def effect_size_rank(spark, sf):
    """Magnitude and consistency of the response in each group, ranked side by side."""
    t = table(spark, sf, "lineitem").select(F.lit("all").alias("target"), F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    profile = cut_lineage(a.binned_profile(t, ["grp"], "x", "y"))
    shapes = a.classify_shape(profile, a.robust_scale(t, "y", ["grp"]), ["grp"], ["grp"]).withColumn("target", F.lit("all"))
    out = a.effect_size_rank(shapes, a.spearman(t, "x", "y", ["grp"]), ["grp"], ["target"])
    return rounded(out, 6, "median_range_over_scale", "abs_rho", "effect_pct", "rho_pct", "rank_gap").select("grp", "median_range_over_scale", "abs_rho", "effect_pct", "rho_pct", "rank_gap")


@query(
    "conditional_spread",
    f"""WITH {PROFILE_SQL.replace("pr AS (SELECT", "pr0 AS (SELECT")}, pr AS (SELECT *, q3 - q1 AS iqr FROM pr0), tr AS ({bin_trend_sql('iqr')})
      SELECT grp, n_bins, round(hi / lo, 6) AS iqr_ratio, round(trend, 6) AS iqr_trend FROM (SELECT grp, count(*) AS n_bins, max(iqr) AS hi, min(iqr) AS lo FROM pr GROUP BY 1) JOIN tr USING (grp) WHERE n_bins >= 6 AND lo > 0""",
)
def conditional_spread(spark, sf):
    t = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(a.conditional_spread(cut_lineage(a.binned_profile(t, ["grp"], "x", "y")), ["grp"]), 6, "iqr_ratio", "iqr_trend")


@query(
    "robust_scale",
    """SELECT event_type, round(CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25) THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END, 6) AS scale, 'IQR' AS kind FROM events GROUP BY 1""",
)
def robust_scale(spark, sf):
    return rounded(a.robust_scale(table(spark, sf, "events"), "value", ["event_type"]), 6, "scale")


@query(
    "binned_mi",
    """WITH t AS (SELECT 'p' AS pair, l_extendedprice AS x, l_quantity AS y FROM lineitem), e AS (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS qx, quantile_cont(y, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS qy FROM t),
      b AS (SELECT least(greatest(len(list_filter(qx, lambda z: z <= x)) - 1, 0), len(qx) - 2) AS bx, least(greatest(len(list_filter(qy, lambda z: z <= y)) - 1, 0), len(qy) - 2) AS bb FROM t, e),
      o AS (SELECT bx, bb, count(*)::DOUBLE AS o FROM b GROUP BY 1, 2), m AS (SELECT *, sum(o) OVER (PARTITION BY bx) AS px, sum(o) OVER (PARTITION BY bb) AS py, sum(o) OVER () AS n FROM o)
      SELECT 'p' AS pair, CAST(any_value(n) AS BIGINT) AS n, round(sum(o / n * ln(o * n / (px * py))), 6) AS mi_raw, round((count(DISTINCT bx) - 1) * (count(DISTINCT bb) - 1) / (2 * any_value(n)), 6) AS mi_null,
        round(greatest(sum(o / n * ln(o * n / (px * py))) - (count(DISTINCT bx) - 1) * (count(DISTINCT bb) - 1) / (2 * any_value(n)), 0), 6) AS mi FROM m""",
)
def binned_mi(spark, sf):
    t = table(spark, sf, "lineitem").select(F.lit("p").alias("pair"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    return rounded(a.binned_mi(t, ["pair"], "x", "y"), 6, "mi_raw", "mi_null", "mi").select("pair", "n", "mi_raw", "mi_null", "mi")


REPLICATES = 400


@query(
    "cluster_bootstrap",
    f"""WITH r AS (SELECT l_suppkey AS cluster, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE - (count(*) OVER () + 1) / 2.0::DOUBLE AS dx,
        rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE - (count(*) OVER () + 1) / 2.0::DOUBLE AS dy FROM lineitem),
      c AS (SELECT cluster, count(*)::DOUBLE AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dy * dy) AS syy, sum(dx * dy) AS sxy FROM r GROUP BY 1),
      u AS (SELECT c.*, b, {key_hash_sql("cluster || '#' || b", 7)} AS u FROM c, (SELECT unnest(range(0, {REPLICATES})) AS b)),
      w AS (SELECT *, ({" + ".join(f"(u >= {p})::INT" for p in a.POISSON)})::DOUBLE AS w FROM u),
      s AS (SELECT b, sum(w * n) AS n, sum(w * sx) AS sx, sum(w * sy) AS sy, sum(w * sxx) AS sxx, sum(w * syy) AS syy, sum(w * sxy) AS sxy FROM w WHERE w > 0 GROUP BY 1),
      q AS (SELECT (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) AS r FROM s)
      SELECT 'p' AS pair, count(*) AS replicates, round(quantile_cont(r, 0.025), 6) AS ci_lo, round(quantile_cont(r, 0.975), 6) AS ci_hi, round(stddev_samp(r), 6) AS se_bootstrap FROM q""",
)
def cluster_bootstrap(spark, sf):
    t = table(spark, sf, "lineitem").select(F.lit("p").alias("pair"), F.col("l_suppkey").alias("cluster"), F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"))
    out = a.cluster_bootstrap(t, ["pair"], "cluster", "x", "y", replicates=REPLICATES)
    return rounded(out, 6, "ci_lo", "ci_hi", "se_bootstrap")


@query(
    "feature_blocks",
    "WITH RECURSIVE l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, {x} AS x, {y} AS y FROM v_features" for i, x in enumerate(COLS) for y in COLS[i + 1:]) + """),
      r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0::DOUBLE AS ry FROM l),
      s AS (SELECT a, b FROM r GROUP BY 1, 2 HAVING abs(corr(rx, ry)) >= 0.35), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s), n AS (SELECT DISTINCT a AS f FROM l UNION SELECT DISTINCT b FROM l),
      c AS (SELECT f AS feature, f AS other FROM n UNION SELECT c.feature, e.b FROM c JOIN e ON c.other = e.a) SELECT feature, min(other) AS block FROM c GROUP BY 1""",
)
def feature_blocks(spark, sf):
    rho = cut_lineage(a.spearman(a.column_pairs(stored(views.features(spark, sf).select(*COLS), "features"), COLS), "x", "y", ["a", "b"]))
    nodes = rho.select(F.col("a").alias("feature")).unionByName(rho.select(F.col("b").alias("feature"))).distinct()
    return a.feature_blocks(rho.where(F.abs("rho") >= 0.35), nodes)
