"""Queries for profiling reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.operators import profile as p
from grainwise.functions.numeric import HASH_SPAN
from grainwise.plans.q_ordering import hash_sql
from grainwise.plans.registry import query
from grainwise.sources import views
from grainwise.sources.tables import table


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


CHEM_COLS = list(views.CHEMISTRY)
CHEM_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM v_chemistry WHERE {c} IS NOT NULL" for c in CHEM_COLS) + ")"
LINE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LONG = "(" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM lineitem" for c in LINE_COLS) + ")"


@query(
    "crosstab_share",
    """SELECT p_type, o_orderpriority, n, round(n / sum(n) OVER (PARTITION BY p_type), 6) AS row_share FROM (
       SELECT p_type, o_orderpriority, count(*) AS n FROM v_features GROUP BY 1, 2)
       WHERE p_type IN (SELECT p_type FROM v_features GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 4)""",
)
def crosstab_share(spark, sf):
    return rounded(p.crosstab_share(views.features(spark, sf), "p_type", "o_orderpriority", top=4), 6, "row_share")


@query("value_counts", "SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(event_type) FROM events), 6) AS share FROM events GROUP BY 1")
def value_counts(spark, sf):
    return rounded(p.value_counts(table(spark, sf, "events"), "event_type"), 6, "share")


_CO = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_both, "
    f"round(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) / count(*) FILTER (WHERE {a} IS NOT NULL OR {b} IS NOT NULL), 6) AS jaccard FROM v_chemistry"
    for i, a in enumerate(CHEM_COLS) for b in CHEM_COLS[i + 1:]
)


@query("co_measurement", _CO)
def co_measurement(spark, sf):
    return rounded(p.co_measurement(views.chemistry(spark, sf), CHEM_COLS), 6, "jaccard")


@query(
    "dataset_overview",
    """SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(DISTINCT l_orderkey) AS n_entities, strftime(min(lo), '%Y-%m-%d') AS first_ts, strftime(max(hi), '%Y-%m-%d') AS last_ts,
         CAST(sum(c - 1) AS BIGINT) AS n_duplicates, CAST(0 AS BIGINT) AS n_null_keys
       FROM (SELECT l_orderkey, l_linenumber, count(*) AS c, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY 1, 2)""",
)
def dataset_overview(spark, sf):
    out = p.dataset_overview(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate", ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_ts", "last_ts")})


@query("rows_per_key_hist", "SELECT c AS rows_per_key, count(*) AS n_keys FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) GROUP BY 1")
def rows_per_key_hist(spark, sf):
    return p.rows_per_key_hist(table(spark, sf, "lineitem"), ["l_orderkey"])


def _completeness_sql(c):
    t = "bigint" if c == "station" else "double"
    return f"""SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS n_rows, count({c}) AS n_present, count(DISTINCT {c}) AS n_unique,
      round(100 * count({c}) / count(*), 6) AS pct_present FROM v_chemistry"""


COMPLETE_COLS = ["station", *CHEM_COLS]
_COMPLETE = "(" + " UNION ALL ".join(_completeness_sql(c) for c in COMPLETE_COLS) + ")"


@query(
    "column_completeness",
    f"""SELECT *, CASE WHEN pct_present <= 0 THEN 'empty' WHEN pct_present <= 5 THEN '<=5%' WHEN pct_present <= 50 THEN '5-50%' WHEN pct_present <= 99.9999 THEN '50-100%'
        ELSE 'complete' END AS band FROM {_COMPLETE}""",
)
def column_completeness(spark, sf):
    return rounded(p.column_completeness(views.chemistry(spark, sf), COMPLETE_COLS), 6, "pct_present")


DOMAINS = {"nutrients": ["nit", "total_ph"], "health": ["e_coli", "dissolved"]}


@query(
    "domain_rollup",
    f"""SELECT CASE WHEN column_name LIKE 'nit%' OR column_name LIKE 'total_ph%' THEN 'nutrients' WHEN column_name LIKE 'e_coli%' OR column_name LIKE 'dissolved%' THEN 'health' ELSE 'other' END AS domain,
        count(*) AS n_columns, round(avg(pct_present), 4) AS mean_pct, round(min(pct_present), 4) AS min_pct, round(max(pct_present), 4) AS max_pct FROM {_COMPLETE} GROUP BY 1""",
)
def domain_rollup(spark, sf):
    complete = p.column_completeness(views.chemistry(spark, sf), COMPLETE_COLS)
    return rounded(p.domain_rollup(complete, DOMAINS), 4, "mean_pct", "min_pct", "max_pct")


_DESC = "mean sd min max p1 q1 med q3 p99 iqr pct_present cv skew kurt".split()


@query(
    "describe_numeric",
    f"""WITH long AS {CHEM_LONG}, q AS (SELECT variable, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS min, max(value) AS max,
         quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99,
         skewness(value) AS skew, kurtosis(value) AS kurt, count(*) FILTER (WHERE value = 0) AS n_zero, count(*) FILTER (WHERE value < 0) AS n_negative,
         count(DISTINCT value) AS n_unique FROM long GROUP BY 1)
       SELECT q.variable, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(min, 4) AS min, round(max, 4) AS max, round(p1, 4) AS p1, round(q1, 4) AS q1, round(med, 4) AS med,
         round(q3, 4) AS q3, round(p99, 4) AS p99, round(q3 - q1, 4) AS iqr, round(100 * n / (SELECT count(*) FROM lineitem), 4) AS pct_present, round(sd / abs(mean), 4) AS cv,
         round(skew, 4) AS skew, round(kurt, 4) AS kurt, n_zero, n_negative, n_unique, n_outlier
       FROM q JOIN (SELECT l.variable, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outlier FROM long l JOIN q ON l.variable = q.variable GROUP BY 1) t
       ON q.variable = t.variable""",
)
def describe_numeric(spark, sf):
    return rounded(p.describe_numeric(views.chemistry(spark, sf), CHEM_COLS), 4, *_DESC)


@query(
    "value_pileups",
    f"""WITH c AS (SELECT variable, value, count(*) AS cnt FROM {CHEM_LONG} GROUP BY 1, 2)
       SELECT variable, rank, value, cnt, round(cnt / n, 6) AS share, value = lo AS is_min, value = hi AS is_max FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY cnt DESC, value) AS rank,
         sum(cnt) OVER (PARTITION BY variable) AS n, min(value) OVER (PARTITION BY variable) AS lo, max(value) OVER (PARTITION BY variable) AS hi FROM c) WHERE rank <= 3""",
)
def value_pileups(spark, sf):
    return rounded(p.value_pileups(views.chemistry(spark, sf), CHEM_COLS), 6, "share")


@query(
    "zero_share",
    f"""SELECT variable, count(*) AS n, round(avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share, round(avg(CASE WHEN value < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_share,
         round(avg(CASE WHEN value <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS nonpositive_share FROM {LINE_LONG} GROUP BY 1""",
)
def zero_share(spark, sf):
    return rounded(p.zero_share(table(spark, sf, "lineitem"), LINE_COLS), 6, "zero_share", "negative_share", "nonpositive_share")


@query(
    "reporting_precision",
    f"""SELECT variable, count(*) AS n, """
    + ", ".join(
        f"round(count(*) FILTER (WHERE abs(value * {10**d} - round_even(value * {10**d}, 0)) < 1e-6) / count(*), 6) AS {name}"
        for d, name in enumerate(["integer_share", "one_decimal_share", "two_decimal_share"])
    )
    + f", round(1000 * count(DISTINCT value) / count(*), 6) AS unique_per_1000 FROM {LINE_LONG} GROUP BY 1",
)
def reporting_precision(spark, sf):
    out = p.reporting_precision(table(spark, sf, "lineitem"), LINE_COLS)
    return rounded(out, 6, "integer_share", "one_decimal_share", "two_decimal_share", "unique_per_1000")


@query(
    "tail_report",
    f"""WITH long AS {LINE_LONG}, top AS (SELECT variable, max(value) FILTER (WHERE rn = 1) AS t1, max(value) FILTER (WHERE rn = 5) AS t5 FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value DESC) AS rn FROM (SELECT DISTINCT variable, value FROM long)) GROUP BY 1)
       SELECT long.variable, count(*) AS n, round(quantile_cont(value, 0.99), 4) AS p99, round(quantile_cont(value, 0.999), 4) AS p999, max(value) AS max,
         round(max(value) / quantile_cont(value, 0.99), 6) AS max_over_p99, count(*) FILTER (WHERE (long.variable = 'l_quantity' AND value > 45) OR (long.variable = 'l_extendedprice' AND value > 90000)) AS n_above,
         any_value(t1) AS top_1, any_value(t5) AS top_5 FROM long JOIN top ON long.variable = top.variable GROUP BY 1""",
)
def tail_report(spark, sf):
    out = p.tail_report(table(spark, sf, "lineitem"), LINE_COLS, {"l_quantity": 45, "l_extendedprice": 90000})
    return rounded(rounded(out, 4, "p99", "p999"), 6, "max_over_p99")


PLAUSIBLE = {"dissolved_oxygen": (0.5, 9.9), "e_coli": (None, 2420.0), "nitrite": (0.1, 2.0), "total_phosphorus": (0.0, 0.35)}


@query(
    "plausibility_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS n, count(*) FILTER (WHERE {c} < {lo if lo is not None else -1e300}) AS n_below, count(*) FILTER (WHERE {c} > {hi}) AS n_above, "
        f"round(100 * count(*) FILTER (WHERE {c} < {lo if lo is not None else -1e300} OR {c} > {hi}) / count({c}), 6) AS pct_implausible FROM v_chemistry"
        for c, (lo, hi) in PLAUSIBLE.items()
    ),
)
def plausibility_report(spark, sf):
    return rounded(p.plausibility_report(views.chemistry(spark, sf), PLAUSIBLE), 6, "pct_implausible")


@query(
    "unit_consistency",
    """SELECT parameter, CAST(sum(c) AS BIGINT) AS n, count(u) AS n_units, string_agg(u || ' (' || c || ')', '; ' ORDER BY u || ' (' || c || ')') FILTER (WHERE u IS NOT NULL) AS units,
         CAST(coalesce(sum(c) FILTER (WHERE u IS NULL), 0) AS BIGINT) AS n_without_unit
       FROM (SELECT parameter, nullif(trim(unit), '') AS u, count(*) AS c FROM v_measure WHERE val IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
def unit_consistency(spark, sf):
    return p.unit_consistency(views.measure(spark, sf), "parameter", "unit", "val")


CAT_COLS = ["unit", "parameter", "raw"]


@query(
    "categorical_summary",
    """WITH long AS (SELECT 'unit' AS column_name, nullif(unit, '') AS v FROM v_measure UNION ALL SELECT 'parameter', parameter FROM v_measure UNION ALL SELECT 'raw', CASE WHEN raw IN ('(D)', 'sunny') THEN raw END FROM v_measure),
       c AS (SELECT column_name, v, count(*) AS c FROM long GROUP BY 1, 2)
       SELECT column_name, count(v) AS n_unique, round(100 * sum(c) FILTER (WHERE v IS NOT NULL) / sum(c), 6) AS pct_present,
         arg_min(v, (-c, v)) FILTER (WHERE v IS NOT NULL) AS mode, round(max(c) FILTER (WHERE v IS NOT NULL) / sum(c) FILTER (WHERE v IS NOT NULL), 6) AS modal_share FROM c GROUP BY 1""",
)
def categorical_summary(spark, sf):
    m = views.measure(spark, sf).select(F.nullif("unit", F.lit("")).alias("unit"), "parameter", F.when(F.col("raw").isin("(D)", "sunny"), F.col("raw")).alias("raw"))
    return rounded(p.categorical_summary(m, CAT_COLS), 6, "pct_present", "modal_share")


_SCREEN_SQL = f"""WITH c AS (SELECT variable, value, count(*) AS c FROM {LINE_LONG} GROUP BY 1, 2),
    m AS (SELECT variable, stddev_samp(value) AS sd FROM {LINE_LONG} GROUP BY 1)
    SELECT c.variable, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_unique, arg_min(value, (-c, value)) AS modal_value, round(max(c) / sum(c), 6) AS modal_share,
      round(coalesce(sum(c) FILTER (WHERE value = 0), 0) / sum(c), 6) AS zero_share, round(any_value(sd), 4) AS sd FROM c JOIN m ON c.variable = m.variable GROUP BY 1"""


@query("degenerate_screen", _SCREEN_SQL)
def degenerate_screen(spark, sf):
    out = p.degenerate_screen(table(spark, sf, "lineitem"), LINE_COLS)
    return rounded(rounded(out, 6, "modal_share", "zero_share"), 4, "sd")


FLAG_EXPRS = {
    "empty": "CASE WHEN l_quantity < 0 THEN 1D END", "constant": "CAST(1 AS DOUBLE)", "rare": "CASE WHEN l_quantity >= 49 THEN l_tax END",
    "spiky": "CASE WHEN l_quantity = 50 AND l_tax = 0 AND l_discount = 0 THEN 1000D ELSE l_tax END", "piled": "CASE WHEN l_quantity < 40 THEN 0D ELSE l_quantity END", "plain": "l_extendedprice",
}


@query(
    "quality_flags",
    """WITH t AS (SELECT CASE WHEN l_quantity < 0 THEN 1.0::DOUBLE END AS empty, 1.0::DOUBLE AS constant, CASE WHEN l_quantity >= 49 THEN l_tax END AS rare,
         CASE WHEN l_quantity = 50 AND l_tax = 0 AND l_discount = 0 THEN 1000.0::DOUBLE ELSE l_tax END AS spiky, CASE WHEN l_quantity < 40 THEN 0.0::DOUBLE ELSE l_quantity END AS piled, l_extendedprice AS plain FROM lineitem),
       long AS (SELECT 'empty' AS variable, empty AS value FROM t UNION ALL SELECT 'constant', constant FROM t UNION ALL SELECT 'rare', rare FROM t
         UNION ALL SELECT 'spiky', spiky FROM t UNION ALL SELECT 'piled', piled FROM t UNION ALL SELECT 'plain', plain FROM t),
       s AS (SELECT variable, count(value) AS n, count(*) AS rows, count(DISTINCT value) AS u, CASE WHEN count(DISTINCT value) > 1 THEN skewness(value) END AS skew FROM long GROUP BY 1),
       m AS (SELECT variable, max(c) AS top FROM (SELECT variable, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
       SELECT variable, 'all null' AS flag FROM s WHERE n = 0 UNION ALL SELECT variable, 'constant' FROM s WHERE u = 1
       UNION ALL SELECT variable, 'nearly empty' FROM s WHERE n > 0 AND 100 * n / rows < 5 UNION ALL SELECT variable, 'extreme skew' FROM s WHERE abs(skew) > 10
       UNION ALL SELECT s.variable, 'value pile-up' FROM s JOIN m ON s.variable = m.variable WHERE n > 100 AND top / n > 0.5 AND u > 1""",
)
def quality_flags(spark, sf):
    t = table(spark, sf, "lineitem").select(*[F.expr(e).alias(k) for k, e in FLAG_EXPRS.items()])
    return p.quality_flags(t, list(FLAG_EXPRS))


@query(
    "temporal_coverage",
    """WITH k AS (SELECT 'year' AS kind, CAST(year(ts) AS VARCHAR) AS level FROM events UNION ALL SELECT 'month', CAST(month(ts) AS VARCHAR) FROM events
         UNION ALL SELECT 'weekday', CAST((dayofweek(ts) + 6) % 7 AS VARCHAR) FROM events
         UNION ALL SELECT 'season', CASE WHEN month(ts) IN (12, 1, 2) THEN 'Winter' WHEN month(ts) <= 5 THEN 'Spring' WHEN month(ts) <= 8 THEN 'Summer' ELSE 'Autumn' END FROM events),
       z AS (SELECT 'month' AS kind, CAST(unnest(range(1, 13)) AS VARCHAR) AS level), c AS (SELECT kind, level, count(*) AS n FROM k GROUP BY 1, 2)
       SELECT kind, level, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events), 6) AS share FROM (SELECT kind, level FROM c UNION SELECT kind, level FROM z) LEFT JOIN c USING (kind, level)""",
)
def temporal_coverage(spark, sf):
    return rounded(p.temporal_coverage(table(spark, sf, "events"), "ts"), 6, "share")


@query(
    "observation_rate",
    f"""WITH r AS (SELECT variable, period, 100 * count(v) / count(*) AS pct FROM ({' UNION ALL '.join(f"SELECT '{c}' AS variable, month(ts) AS period, {c} AS v FROM v_chemistry" for c in CHEM_COLS)}) GROUP BY 1, 2)
       SELECT variable, period, round(pct, 6) AS pct, round(max(pct) OVER (PARTITION BY variable) - min(pct) OVER (PARTITION BY variable), 6) AS spread FROM r""",
)
def observation_rate(spark, sf):
    return rounded(p.observation_rate(views.chemistry(spark, sf), F.month("ts").cast("long"), CHEM_COLS), 6, "pct", "spread")


@query(
    "missingness_seasonality",
    """WITH r AS (SELECT parameter AS variable, day(ts) AS period, 100 * count(val) / count(*) AS pct FROM v_measure GROUP BY 1, 2)
       SELECT variable, count(*) AS n_periods, round(100 - max(pct), 6) AS min_null_pct, round(100 - min(pct), 6) AS max_null_pct, round(max(pct) - min(pct), 6) AS spread FROM r GROUP BY 1""",
)
def missingness_seasonality(spark, sf):
    m = views.measure(spark, sf)
    wide = m.select("ts", "parameter", "val")
    rate = wide.groupBy(F.col("parameter").alias("variable"), F.day("ts").alias("period")).agg((100 * F.count("val") / F.count("*")).alias("pct"))
    out = rate.groupBy("variable").agg(
        F.count("*").alias("n_periods"), (100 - F.max("pct")).alias("min_null_pct"), (100 - F.min("pct")).alias("max_null_pct"), (F.max("pct") - F.min("pct")).alias("spread")
    )
    return rounded(out, 6, "min_null_pct", "max_null_pct", "spread")


_SNOW = "CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN 0 WHEN l_suppkey % 5 = 0 THEN l_tax / 100 ELSE l_discount END"


@query(
    "sensor_classification",
    f"""SELECT CASE WHEN n = 0 THEN 'never' WHEN hi = 0 THEN 'zero only' WHEN hi <= 0.001 THEN 'trace only' ELSE 'reports' END AS sensor_class, count(*) AS n_stations, CAST(sum(n) AS BIGINT) AS n_values
       FROM (SELECT l_suppkey, count({_SNOW}) AS n, max({_SNOW}) AS hi FROM lineitem GROUP BY 1) GROUP BY 1""",
)
def sensor_classification(spark, sf):
    snow = table(spark, sf, "lineitem").select("l_suppkey", F.expr(_SNOW).alias("snow"))
    return p.sensor_classification(snow, "l_suppkey", "snow", trace=0.001)


VAR_COLS = ["total", "qty", "psize", "price"]


@query(
    "variance_decomposition",
    f"""WITH long AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, l_orderkey AS g, {c} AS v FROM v_features" for c in VAR_COLS)}),
       m AS (SELECT variable, v, avg(v) OVER (PARTITION BY variable, g) AS gm FROM long),
       u AS (SELECT variable, count(*) AS n_groups, avg(c) AS u FROM (SELECT variable, g, count(DISTINCT v) AS c FROM long GROUP BY 1, 2) GROUP BY 1)
       SELECT m.variable, any_value(n_groups) AS n_groups, round(any_value(u), 6) AS unique_per_group, round(var_samp(gm) / var_samp(v), 6) AS between_share,
         CASE WHEN var_samp(gm) / var_samp(v) >= 0.95 THEN 'static' WHEN var_samp(gm) / var_samp(v) >= 0.5 THEN 'mostly spatial' ELSE 'varies within' END AS kind
       FROM m JOIN u ON m.variable = u.variable GROUP BY 1""",
)
def variance_decomposition(spark, sf):
    return rounded(p.variance_decomposition(views.features(spark, sf), "l_orderkey", VAR_COLS), 6, "unique_per_group", "between_share")


@query(
    "split_leakage",
    f"""WITH t AS (SELECT o_custkey, {hash_sql('o_orderkey', 42)} < {int(0.2 * HASH_SPAN)} AS test FROM orders), g AS (SELECT o_custkey, count(*) FILTER (WHERE test) AS t, count(*) FILTER (WHERE NOT test) AS r FROM t GROUP BY 1)
       SELECT CAST(sum(t) AS BIGINT) AS n_test, count(*) FILTER (WHERE t > 0) AS n_test_groups, count(*) AS n_groups, round(100 * sum(t) FILTER (WHERE r > 0) / sum(t), 6) AS pct_leaked FROM g""",
)
def split_leakage(spark, sf):
    return rounded(p.split_leakage(table(spark, sf, "orders"), "o_custkey", "o_orderkey", 0.2, 42), 6, "pct_leaked")


@query(
    "staleness_report",
    """WITH t AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'click' THEN value END AS click, CASE WHEN event_id % 3 = 0 THEN value END AS third FROM events),
       a AS (SELECT user_id, max(ts) AS last_ts, arg_max(click, (ts, event_id)) FILTER (WHERE click IS NOT NULL) AS mc, arg_max(third, (ts, event_id)) FILTER (WHERE third IS NOT NULL) AS mt FROM t GROUP BY 1),
       r AS (SELECT user_id, click, third FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM t) WHERE rn = 1)
       SELECT a.user_id, date_diff('day', CAST(last_ts AS DATE), DATE '2024-03-01') AS age_days, month(last_ts) AS frozen_month,
         NOT (click IS NOT DISTINCT FROM mc AND third IS NOT DISTINCT FROM mt) AS is_composite FROM a JOIN r ON a.user_id = r.user_id""",
)
def staleness_report(spark, sf):
    t = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.expr("CASE WHEN event_type = 'click' THEN value END").alias("click"), F.expr("CASE WHEN event_id % 3 = 0 THEN value END").alias("third")
    )
    return p.staleness_report(t, "user_id", ["ts", "event_id"], ["click", "third"], "2024-03-01")


@query(
    "smape_floor",
    """WITH t AS (SELECT l_discount AS y, 0.05::DOUBLE AS a, l_tax AS b FROM lineitem), s AS (SELECT 100 * avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS z,
         avg(CASE WHEN abs(y) + abs(a) = 0 THEN 0 ELSE 200 * abs(y - a) / (abs(y) + abs(a)) END) AS ea, avg(CASE WHEN abs(y) + abs(b) = 0 THEN 0 ELSE 200 * abs(y - b) / (abs(y) + abs(b)) END) AS eb FROM t)
       SELECT 'constant' AS model, round(z, 6) AS pct_zero, round(ea, 6) AS error_rate, round(2 * z, 6) AS floor, round(ea - 2 * z, 6) AS above_floor FROM s
       UNION ALL SELECT 'tax', round(z, 6), round(eb, 6), round(2 * z, 6), round(eb - 2 * z, 6) FROM s""",
)
def smape_floor(spark, sf):
    out = p.smape_floor(table(spark, sf, "lineitem"), "l_discount", {"constant": F.lit(0.05), "tax": F.col("l_tax")})
    return rounded(out, 6, "pct_zero", "error_rate", "floor", "above_floor")


@query(
    "histogram",
    """WITH a AS (SELECT log10(value) AS a FROM events WHERE value > 0), k AS (SELECT a FROM a WHERE a <= (SELECT quantile_cont(a, 0.99) FROM a)),
       s AS (SELECT min(a) AS lo, (max(a) - min(a)) / 40 AS w, median(a) AS med FROM k)
       SELECT CAST(bin AS BIGINT) AS bin, round(lo + bin * w, 6) AS "left", round(lo + (bin + 1) * w, 6) AS "right", n, round(med, 6) AS median FROM
         (SELECT least(floor((a - lo) / w), 39) AS bin, count(*) AS n, any_value(lo) AS lo, any_value(w) AS w, any_value(med) AS med FROM k, s GROUP BY 1)""",
)
def histogram(spark, sf):
    return rounded(p.histogram(table(spark, sf, "events"), "value", 40, log=True, clip=0.99), 6, "left", "right", "median")


@query(
    "density_2d",
    """WITH t AS (SELECT l_quantity AS x, log10(l_extendedprice) AS y FROM lineitem), s AS (SELECT min(x) AS lox, (max(x) - min(x)) / 20 AS wx, min(y) AS loy, (max(y) - min(y)) / 20 AS wy FROM t)
       SELECT CAST(least(floor((x - lox) / wx), 19) AS BIGINT) AS bin_x, CAST(least(floor((y - loy) / wy), 19) AS BIGINT) AS bin_y, count(*) AS n FROM t, s GROUP BY 1, 2""",
)
def density_2d(spark, sf):
    return p.density_2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", grid=20, log_y=True)


@query(
    "presence_combinations",
    """SELECT coalesce(nullif(concat_ws(' + ', CASE WHEN dissolved_oxygen IS NOT NULL THEN 'oxygen' END, CASE WHEN e_coli IS NOT NULL THEN 'pathogen' END, CASE WHEN ph IS NOT NULL THEN 'acidity' END), ''), '(none)') AS combination,
         count(*) AS n FROM v_chemistry GROUP BY 1 ORDER BY n DESC, combination LIMIT 5""",
)
def presence_combinations(spark, sf):
    present = {k: F.col(c).isNotNull() for k, c in (("oxygen", "dissolved_oxygen"), ("pathogen", "e_coli"), ("acidity", "ph"))}
    return p.presence_combinations(views.chemistry(spark, sf), present, 5)
