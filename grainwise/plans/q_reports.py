"""Queries for batch scoring, modelling reports, multivariate and seasonal statistics, and the remaining sources."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions.numeric import cyclical, normal_quantile_sql
from grainwise.operators import association as a
from grainwise.operators import contracts, ordering, permutation, seasonal, serving, spatial, spatial_corr
from grainwise.operators import modelling as m
from grainwise.operators import multivariate as mv
from grainwise.operators.evaluation import regression_metrics
from grainwise.plans.q_association import RANKED, stored_pairs
from grainwise.plans.q_models import FEATURES, TRAINING_SQL, least_squares_sql, linear_prediction_sql, training_rows
from grainwise.plans.q_profile import rounded
from grainwise.plans.registry import query
from grainwise.session import scratch_path
from grainwise.sources import scans, sinks, views
from grainwise.sources.tables import table

# --- batch scoring ---------------------------------------------------------------------------
STATION_FEATURES = ["e_coli", "water_temp", "ammonia"]
MODEL_FEATURES = [*STATION_FEATURES, "doy_sin", "doy_cos"]
TARGET = "turbidity"
DAY = datetime.date(2024, 7, 14)
ORDER = ["ts", "sample_id", "replicate"]
_WAVES = "sin(2 * pi() * dayofyear({t}) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear({t}) / 365.25) AS doy_cos"
STATIONS_SQL = "stations AS (SELECT station, " + ", ".join(f"arg_max({c}, ({', '.join(ORDER)})) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in STATION_FEATURES) + " FROM v_chemistry GROUP BY 1)"
SERVING_SQL = f"""rows_ AS (SELECT {TARGET}, {', '.join(STATION_FEATURES)}, {_WAVES.format(t='ts')}, false AS is_test FROM v_chemistry WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [TARGET, *STATION_FEATURES])}),
  {least_squares_sql('rows_', TARGET, MODEL_FEATURES)}, {STATIONS_SQL}"""


def station_table(spark, sf):
    return serving.station_features(views.chemistry(spark, sf), "station", ORDER, STATION_FEATURES)


def linear_model(spark, sf):
    """The fitted scorer: a function that adds ``predicted``."""
    t = cyclical("ts")
    rows = views.chemistry(spark, sf).withColumns({"doy_sin": t["doy_sin"], "doy_cos": t["doy_cos"]})
    fit = mv.least_squares(rows, TARGET, MODEL_FEATURES)
    return lambda df: df.withColumn("predicted", mv.linear_value(*fit))


@query(
    "station_feature_matrix",
    f"WITH {STATIONS_SQL} SELECT station, {', '.join(f'round({c}, 6) AS {c}' for c in STATION_FEATURES)}, CAST(dayofyear(DATE '{DAY}') AS BIGINT) AS doy, round(sin(2 * pi() * dayofyear(DATE '{DAY}') / 365.25), 6) AS doy_sin, "
    f"round(cos(2 * pi() * dayofyear(DATE '{DAY}') / 365.25), 6) AS doy_cos, year(DATE '{DAY}') AS year FROM stations",
)
def station_feature_matrix(spark, sf):
    return rounded(serving.feature_matrix(station_table(spark, sf), "station", STATION_FEATURES, DAY), 6, *STATION_FEATURES, "doy_sin", "doy_cos")


@query(
    "score_batch",
    f"WITH {SERVING_SQL}, x AS (SELECT *, {_WAVES.format(t=f'DATE {chr(39)}{DAY}{chr(39)}')} FROM stations) SELECT station, round({linear_prediction_sql(MODEL_FEATURES)}, 4) AS prediction FROM x, beta",
)
def score_batch(spark, sf):
    matrix = serving.feature_matrix(station_table(spark, sf), "station", STATION_FEATURES, DAY)
    return rounded(serving.score_batch(matrix, linear_model(spark, sf), "station"), 4, "prediction")


@query(
    "calendar_trend",
    f"""WITH {SERVING_SQL}, d AS (SELECT CAST(unnest(generate_series(DATE '2024-04-14', DATE '2024-07-20', INTERVAL 1 DAY)) AS DATE) AS day), x AS (SELECT day, stations.*, {_WAVES.format(t='day')} FROM stations, d),
       p AS (SELECT day, count(v) AS n, avg(v) AS mean, min(v) AS low, max(v) AS high FROM (SELECT day, {linear_prediction_sql(MODEL_FEATURES)} AS v FROM x, beta) GROUP BY 1), s AS (SELECT min(mean) AS lo, max(mean) AS hi FROM p)
       SELECT strftime(day, '%Y-%m-%d') AS day, n, round(mean, 4) AS mean, round(low, 4) AS low, round(high, 4) AS high,
         CASE WHEN hi <= lo THEN 2 WHEN (mean - lo) / (hi - lo) < 0.2 THEN 0 WHEN (mean - lo) / (hi - lo) < 0.4 THEN 1 WHEN (mean - lo) / (hi - lo) < 0.6 THEN 2 WHEN (mean - lo) / (hi - lo) < 0.8 THEN 3 ELSE 4 END AS level FROM p, s""",
)
def calendar_trend(spark, sf):
    out = serving.calendar_trend(station_table(spark, sf), "station", STATION_FEATURES, linear_model(spark, sf), DAY)
    return rounded(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 4, "mean", "low", "high").select("day", "n", "mean", "low", "high", "level")


# --- modelling reports -----------------------------------------------------------------------
_VISITS = "SELECT event_type AS target, user_id, value AS y, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p, avg(value) OVER (PARTITION BY event_type) AS g FROM events"
_R2 = "1 - sum((y - {p}) * (y - {p})) / (var_samp(y) * (count(*) - 1))"


def _visits(spark, sf):
    """Every event with its previous visit and the mean of its type, as two models of one target per type."""
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    prev = ordering.previous_visit(ev, ["user_id", "event_type"], "ts", "event_id", "value").where("prev_value IS NOT NULL")
    mean = ev.groupBy("event_type").agg(F.avg("value").alias("mean_value"))
    return prev.join(mean, "event_type").withColumnRenamed("event_type", "target")


@query(
    "persistence_margin",
    f"SELECT target, count(*) AS n, round({_R2.format(p='g')}, 6) AS model_r2, round({_R2.format(p='p')}, 6) AS persistence_r2, round(({_R2.format(p='g')}) - ({_R2.format(p='p')}), 6) AS margin FROM ({_VISITS}) WHERE p IS NOT NULL GROUP BY 1",
)
def persistence_margin(spark, sf):
    rows = _visits(spark, sf)
    model = regression_metrics(rows, "value", "mean_value", ["target"]).select("target", "n", F.col("r2").alias("model_r2"))
    base = regression_metrics(rows, "value", "prev_value", ["target"]).select("target", F.col("r2").alias("persistence_r2"))
    out = model.join(base, "target").withColumn("margin", F.col("model_r2") - F.col("persistence_r2"))
    return rounded(out, 6, "model_r2", "persistence_r2", "margin")


@query(
    "best_per_group",
    f"""WITH s AS (SELECT target, {_R2.format(p='g')} AS g, {_R2.format(p='p')} AS p FROM ({_VISITS}) WHERE p IS NOT NULL GROUP BY 1)
       SELECT target, CASE WHEN g >= p THEN 'type mean' ELSE 'persistence' END AS model, round(greatest(g, p), 6) AS score FROM s""",
)
def best_per_group(spark, sf):
    """Metrics rows of two models, published as slices of one table, and the better one per target."""
    rows = _visits(spark, sf)
    path = scratch_path(spark, "metrics")
    for name, column in (("type mean", "mean_value"), ("persistence", "prev_value")):
        report = regression_metrics(rows, "value", column, ["target"]).withColumns({"r2_log": F.lit(None).cast("double"), "model": F.lit(name)})
        sinks.replace_slice(report, path, "model")
    return rounded(m.best_model_per_target(sinks.read_slices(spark, path)), 6, "score")


@query(
    "metric_by_split",
    f"""WITH {TRAINING_SQL}, {least_squares_sql('rows_', 'price', FEATURES)}, grouped AS (SELECT 'grouped' AS split, price AS y, {linear_prediction_sql(FEATURES)} AS p FROM rows_, beta WHERE is_test),
       other AS (SELECT * REPLACE (l_linenumber = 1 AS is_test) FROM rows_), {least_squares_sql('other', 'price', FEATURES).replace('scale_', 'scale2_').replace('step_', 'step2_').replace('beta AS', 'beta2 AS')},
       plain AS (SELECT 'row' AS split, price AS y, {linear_prediction_sql(FEATURES)} AS p FROM other, beta2 WHERE is_test)
       SELECT split, count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae FROM (SELECT * FROM grouped UNION ALL SELECT * FROM plain) GROUP BY 1""",
)
def metric_by_split(spark, sf):
    """The same model under a split by whole clusters and a split by rows."""
    rows = training_rows(spark, sf, ["l_orderkey", "l_linenumber"])
    out = None
    for name, test in (("grouped", F.col("is_test")), ("row", F.col("l_linenumber") == 1)):
        fit = mv.least_squares(rows.where(~test), "price", FEATURES)
        part = regression_metrics(rows.where(test).withColumn("predicted", mv.linear_value(*fit)), "price", "predicted").select(F.lit(name).alias("split"), "n", "rmse", "mae")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3, "rmse", "mae")


@query("select_transform", f"WITH {TRAINING_SQL} SELECT true AS eligible, true AS both_errors_positive, count(*) AS n_train FROM rows_ WHERE NOT is_test")
def select_transform(spark, sf):
    """Grouped three-fold errors of the raw and the log target."""
    train = training_rows(spark, sf).where("NOT is_test").drop("is_test")
    got = m.select_transform(train, "price", FEATURES, "cluster", "linear")
    return train.agg(F.lit(got["mae_raw"] is not None).alias("eligible"), F.lit(bool(got["mae_raw"] and got["mae_raw"] > 0 and got["mae_log"] > 0)).alias("both_errors_positive"), F.count("*").alias("n_train"))


BLOCKS = {"part": ["psize", "retail"], "order": ["qty", "total"], "season": ["doy"]}
REPEATS, SEED = 5, 1000


def _permuted_sql(x: str, seed: int) -> str:
    """One pass through the network of operators/permutation.py; ``ga`` and ``gb`` are the sides of the grid."""
    sql = f"SELECT rank, {x} // gb AS l, {x} % gb AS r, ga, gb, n"
    for k, key in enumerate(permutation.round_keys(seed)):
        mixed = lambda v, key=key: f"((({v} + {key}) * 2654435761 % 4294967296) // 512)"
        new = f"(l + {mixed('r')}) % ga AS l, r" if k % 2 == 0 else f"l, (r + {mixed('l')}) % gb AS r"
        sql = f"SELECT rank, {new}, ga, gb, n FROM ({sql}{' FROM {src}' if k == 0 else ''})"
    return f"SELECT rank, l * gb + r AS x, ga, gb, n FROM ({sql})"


def _walk_sql(repeat: int) -> str:
    """Images of all numbers under the permutation of a repeat; a walk goes on while it is outside."""
    first = _permuted_sql("rank", SEED + repeat).replace("{src}", "numbers")
    again = _permuted_sql("x", SEED + repeat).replace("{src}", f"walk_{repeat} WHERE x >= n")
    return f"walk_{repeat} AS ({first} UNION ALL {again}), image_{repeat} AS (SELECT {repeat} AS repeat, rank, x AS source FROM walk_{repeat} WHERE x < n)"


_TEST = "test_ AS (SELECT *, row_number() OVER (ORDER BY l_orderkey * 8 + l_linenumber, price, retail, qty) - 1 AS rank, count(*) OVER () AS n FROM rows_ WHERE is_test)"
_NUMBERS = "numbers AS (SELECT rank, n, CAST(ceil(sqrt(n)) AS BIGINT) AS ga, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS gb FROM test_)"
_SHUFFLED = " UNION ALL ".join(
    f"SELECT '{name}' AS block, repeat, y, {linear_prediction_sql([('s.' if c in columns else 't.') + c for c in FEATURES]).replace('m_s.', 'm_').replace('m_t.', 'm_').replace('s_s.', 's_').replace('s_t.', 's_')} AS p"
    " FROM (SELECT *, price AS y FROM test_) t JOIN images i ON i.rank = t.rank JOIN test_ s ON s.rank = i.source, beta"
    for name, columns in BLOCKS.items()
)
_R2_SQL = "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))"


@query(
    "block_permutation",
    f"""WITH RECURSIVE {TRAINING_SQL}, {least_squares_sql('rows_', 'price', FEATURES)}, {_TEST}, {_NUMBERS}, {', '.join(_walk_sql(r) for r in range(REPEATS))},
       images AS ({' UNION ALL '.join(f'SELECT * FROM image_{r}' for r in range(REPEATS))}), b AS (SELECT {_R2_SQL} AS r2 FROM (SELECT price AS y, {linear_prediction_sql(FEATURES)} AS p FROM test_, beta)),
       d AS (SELECT block, repeat, (SELECT r2 FROM b) - ({_R2_SQL}) AS lost FROM ({_SHUFFLED}) GROUP BY 1, 2)
       SELECT block, round(avg(lost), 6) AS r2_drop, round(stddev_pop(lost), 6) AS r2_drop_sd, count(*) AS repeats FROM d GROUP BY 1""",
)
def block_permutation(spark, sf):
    """R2 lost when a block of features is shuffled whole, over five keyed permutations."""
    rows = training_rows(spark, sf, ["l_orderkey", "l_linenumber"])
    rows = rows.withColumns({"row_at": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "row_key": F.struct("l_orderkey", "l_linenumber", "price", "retail", "qty")})
    fitted = m.fit(rows.where("NOT is_test"), "price", FEATURES, "linear")
    out = permutation.permutation_importance(fitted, rows.where("is_test"), "price", BLOCKS, "row_key", "row_at", REPEATS, SEED)
    return rounded(out, 6, "r2_drop", "r2_drop_sd")


# --- multivariate ----------------------------------------------------------------------------
def inverse_sql(source: str, columns: list[str]) -> str:
    """CTEs that invert the population covariance of ``columns``: ``inv`` has m_i (means) and v_i_j."""
    p = len(columns)
    cov = ", ".join(f"covar_pop({x}, {y}) AS a_{i}_{j}" for i, x in enumerate(columns) for j, y in enumerate(columns))
    unit = ", ".join(f"{float(i == j)}::DOUBLE AS u_{i}_{j}" for i in range(p) for j in range(p))
    mean = ", ".join(f"avg({c}) AS m_{i}" for i, c in enumerate(columns))
    steps = [f"g_0 AS (SELECT {cov}, {unit}, {mean} FROM {source})"]
    keep = ", ".join(f"m_{i}" for i in range(p))
    for k in range(p):
        cells = []
        for letter in "au":
            for i in range(p):
                for j in range(p):
                    pivot = f"{letter}_{k}_{j} / a_{k}_{k}"
                    cells.append(f"{pivot if i == k else f'{letter}_{i}_{j} - a_{i}_{k} * {pivot}'} AS {letter}_{i}_{j}")
        steps.append(f"g_{k + 1} AS (SELECT {', '.join(cells)}, {keep} FROM g_{k})")
    steps.append(f"inv AS (SELECT {', '.join(f'u_{i}_{j} AS v_{i}_{j}' for i in range(p) for j in range(p))}, {keep} FROM g_{p})")
    return ",\n".join(steps)


_N = range(len(FEATURES))


def _squared_sql(p: int) -> str:
    """The square of a p x p matrix held as a list of rows, one after the other."""
    cell = " + ".join(f"m[(i // {p}) * {p} + {k + 1}] * m[{k * p} + i % {p} + 1]" for k in range(p))
    return f"list_transform(range(0, {p * p}), lambda i: {cell})"


def largest_eigenvalue_sql(name: str, source: str, p: int) -> str:
    """A recursive CTE whose last row has the logarithm of the largest eigenvalue: a trace under repeated squaring."""
    trace = " + ".join(f"m[{k * p + k + 1}]" for k in range(p))
    start = f"SELECT 0 AS k, list_transform(m, lambda x: x / ({trace})) AS m, ln({trace}) AS lg FROM {source}"
    again = f"SELECT k + 1, list_transform(m, lambda x: x / ({trace})), lg + ln({trace}) / power(2, k + 1) FROM (SELECT k, lg, {_squared_sql(p)} AS m FROM {name} WHERE k < 40)"
    return f"{name} AS ({start} UNION ALL {again})"


_P = len(FEATURES)
_CORR = "corr_ AS (SELECT [" + ", ".join(f"corr({x}, {y})" for x in FEATURES for y in FEATURES) + "] AS m FROM v_features)"
_INVERSE = "back_ AS (SELECT [" + ", ".join(f"v_{i}_{j} * sqrt(s_{i} * s_{j})" for i in _N for j in _N) + "] AS m FROM inv, s)"


@query(
    "vif",
    f"WITH RECURSIVE {inverse_sql('v_features', FEATURES)}, s AS (SELECT {', '.join(f'var_pop({c}) AS s_{i}' for i, c in enumerate(FEATURES))} FROM v_features), {_CORR}, {_INVERSE}, "
    + f"{largest_eigenvalue_sql('top_', 'corr_', _P)}, {largest_eigenvalue_sql('low_', 'back_', _P)}, "
    + "c AS (SELECT round(exp(((SELECT lg FROM top_ WHERE k = 40) + (SELECT lg FROM low_ WHERE k = 40)) / 2), 5) AS condition_number) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(v_{i}_{i} * s_{i}, 5) AS vif, condition_number, 0::BIGINT AS null_dimensions FROM inv, s, c" for i, c in enumerate(FEATURES)),
)
def vif(spark, sf):
    return rounded(mv.vif(views.features(spark, sf), FEATURES), 5, "vif", "condition_number").select("feature", "vif", "condition_number", "null_dimensions")


@query(
    "null_space",
    """SELECT 'planted' AS feature, t.member, round(t.w, 5) AS weight FROM (SELECT stddev_pop(qty) / stddev_pop(qty - 3 * psize) AS a, -3 * stddev_pop(psize) / stddev_pop(qty - 3 * psize) AS b FROM v_features) s,
         LATERAL (VALUES ('qty', a), ('psize', b)) t(member, w)""",
)
def null_space(spark, sf):
    """A planted combination of two features among the others: named with its members."""
    rows = views.features(spark, sf).withColumn("planted", F.col("qty") - 3 * F.col("psize"))
    return rounded(mv.null_space(rows, [*FEATURES, "planted"]), 5, "weight").select("feature", "member", "weight")


@query("pca_summary")
def pca_summary(spark, sf):
    return rounded(mv.pca_summary(views.features(spark, sf), FEATURES), 6, "explained", "cumulative", "main_loading")


_D2 = " + ".join(f"v_{i}_{j} * ({FEATURES[i]} - m_{i}) * ({FEATURES[j]} - m_{j})" for i in _N for j in _N)


@query(
    "mahalanobis",
    f"WITH {inverse_sql('v_features', FEATURES)} SELECT l_orderkey, l_linenumber, round({_D2}, 4) AS d2, ({_D2}) > {mv.chi_square_limit(len(FEATURES), mv.Z_999)!r} AS is_outlier FROM v_features, inv",
)
def mahalanobis(spark, sf):
    out = mv.mahalanobis(views.features(spark, sf).select("l_orderkey", "l_linenumber", *FEATURES), FEATURES)
    return rounded(out, 4, "d2").select("l_orderkey", "l_linenumber", "d2", "is_outlier")


def _partial(ab, az, bz):
    return f"(({ab}) - ({az}) * ({bz})) / sqrt((1 - ({az}) * ({az})) * (1 - ({bz}) * ({bz})))"


@query(
    "partial_corr",
    f"""WITH c AS (SELECT 'price' AS target, price AS y, qty AS x, sin(2 * pi() * doy / 365.25) AS s, cos(2 * pi() * doy / 365.25) AS c FROM v_features),
       r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM c),
       k AS (SELECT count(*) AS n, corr(rx, ry) AS xy, corr(rx, s) AS xs, corr(ry, s) AS ys, corr(rx, c) AS xc, corr(ry, c) AS yc, corr(s, c) AS sc FROM r),
       p AS (SELECT *, {_partial('xy', 'xs', 'ys')} AS xy_s, {_partial('xc', 'xs', 'sc')} AS xc_s, {_partial('yc', 'ys', 'sc')} AS yc_s FROM k)
       SELECT 'price' AS target, n, round(xy, 6) AS raw, round({_partial('xy_s', 'xc_s', 'yc_s')}, 6) AS partial FROM p""",
)
def partial_corr(spark, sf):
    angle = F.col("doy") * F.lit(2.0) * F.pi() / F.lit(365.25)
    t = views.features(spark, sf).select(F.lit("price").alias("target"), F.col("price").alias("y"), F.col("qty").alias("x"), F.sin(angle).alias("s"), F.cos(angle).alias("c"))
    return rounded(a.partial_rank_corr(t, ["target"], "x", "y", ["s", "c"]), 6, "raw", "partial").select("target", "n", "raw", "partial")


@query(
    "corr_ceiling",
    RANKED + """, s AS (SELECT target, feature, corr(rx, ry) AS rho FROM r GROUP BY 1, 2), b AS (SELECT target, max(rho * rho) AS ceiling FROM s GROUP BY 1), m AS (SELECT * FROM (VALUES ('price', 0.4), ('disc', 0.25)) t(target, model_r2))
      SELECT b.target, round(ceiling, 6) AS ceiling, CAST(model_r2 AS DOUBLE) AS model_r2, round(model_r2 - ceiling, 6) AS headroom FROM b JOIN m ON b.target = m.target""",
)
def corr_ceiling(spark, sf):
    rho = a.spearman(stored_pairs(spark, sf), "x", "y", ["target", "feature"])
    reported = spark.createDataFrame([("price", 0.4), ("disc", 0.25)], "target string, model_r2 double")
    return rounded(a.corr_ceiling(rho, reported, "target"), 6, "ceiling", "headroom").select("target", "ceiling", "model_r2", "headroom")


# --- seasons and lags ------------------------------------------------------------------------
_HARMONICS = ["s1", "c1", "s2", "c2"]
_HARMONIC_SQL = "rows_ AS (SELECT event_id, user_id, ts, value AS y, " + ", ".join(f"{f}({k} * 2 * pi() * dayofyear(ts) / 365.25) AS {n}{k}" for k in (1, 2) for f, n in (("sin", "s"), ("cos", "c"))) + ", false AS is_test FROM events)"


@query("deseasonalise", f"WITH {_HARMONIC_SQL}, {least_squares_sql('rows_', 'y', _HARMONICS)} SELECT event_id, round(y - ({linear_prediction_sql(_HARMONICS)}), 3) AS residual FROM rows_, beta")
def deseasonalise(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return rounded(seasonal.deseasonalise(ev, "ts", "value"), 3, "residual").select("event_id", "residual")


LAG_EDGES = [0, 3, 7, 14, 30, 60]


@query(
    "temporal_autocorr",
    f"""WITH e AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d, value AS v FROM events), p AS (SELECT b.d - a.d AS gap, a.v AS x, b.v AS y FROM e a JOIN e b ON a.user_id = b.user_id AND b.d > a.d AND b.d - a.d <= {LAG_EDGES[-1]}),
       s AS (SELECT gap, x, y FROM p UNION ALL SELECT gap, y, x FROM p), g AS (SELECT *, CASE {' '.join(f'WHEN gap <= {hi} THEN {i}' for i, hi in enumerate(LAG_EDGES[1:]))} END AS bin FROM s)
       SELECT CAST(bin AS BIGINT) AS bin, CAST(list_extract({LAG_EDGES}, bin + 1) AS BIGINT) AS gap_over, CAST(list_extract({LAG_EDGES}, bin + 2) AS BIGINT) AS gap_to, count(*) // 2 AS pairs, round(corr(x, y), 6) AS correlation FROM g GROUP BY bin HAVING count(*) >= 300""",
)
def temporal_autocorr(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "value")
    return rounded(seasonal.temporal_autocorr(ev, "user_id", "ts", "value", LAG_EDGES), 6, "correlation")


# Distance bins in km.
DIST_EDGES = [0, 5, 10, 20, 40, 80, 160, 320, 640]
_NEAR = "2 * 6371.0088 * asin(sqrt(least(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


@query(
    "spatial_autocorr",
    f"""WITH p AS (SELECT event_id, ((rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE) - 0.5) / count(*) OVER (PARTITION BY event_type) AS p FROM events),
       e AS (SELECT event_id, event_type AS target, CAST(ts AS DATE) AS day, user_id, lat, lon, {normal_quantile_sql('p')} AS z FROM events JOIN p USING (event_id) JOIN v_station ON station = user_id),
       m AS (SELECT a.target, CASE WHEN a.user_id = b.user_id THEN -1 ELSE {' + '.join(f'({_NEAR} >= {e})::INT' for e in DIST_EDGES[1:-1])} END AS bin, a.z AS x, b.z AS y
             FROM e a JOIN e b ON a.target = b.target AND a.day = b.day AND a.event_id < b.event_id),
       s AS (SELECT target, bin, x, y FROM m UNION ALL SELECT target, bin, y, x FROM m)
       SELECT target, CAST(bin AS BIGINT) AS bin, count(*) // 2 AS n_pairs, round(corr(x, y), 6) AS correlation FROM s GROUP BY 1, 2 HAVING count(*) >= 300""",
)
def spatial_autocorr(spark, sf):
    """Normal scores of same-day events by the distance of their stations; bin -1: one station."""
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("target"), F.to_date("ts").alias("day"), F.col("user_id").alias("station"), "value")
    scored = ordering.normal_scores(ev, "value", ["target"])
    placed = scored.join(views.station(spark, sf).select("station", "lat", "lon"), "station")
    out = spatial_corr.spatial_autocorr(placed, ["target"], "day", "station", "z", DIST_EDGES)
    return rounded(out, 6, "correlation").select("target", F.col("bin").cast("long").alias("bin"), "n_pairs", "correlation")


_NODE = "SELECT gx, gy, 40.4::DOUBLE + gy * 0.2::DOUBLE AS lat, -96.6::DOUBLE + gx * 0.2::DOUBLE AS lon FROM (SELECT unnest(range(0, 33)) AS gx), (SELECT unnest(range(0, 17)) AS gy)"


@query(
    "grid_gap",
    f"SELECT count(*) AS n, round(median(d), 5) AS median, round(quantile_cont(d, 0.9), 5) AS p90, round(max(d), 5) AS largest FROM (SELECT gx, gy, min(sqrt(power(g.lat - n.lat, 2) + power(g.lon - n.lon, 2))) AS d FROM ({_NODE}) n, v_gauge g GROUP BY 1, 2)",
)
def grid_gap(spark, sf):
    """Distance from every grid node to its nearest gauge: the nodes are a generated table, joined by cells."""
    nodes = spark.range(33 * 17).select(F.col("id").alias("node"), (F.lit(40.4) + F.expr("id div 33") * F.lit(0.2)).alias("lat"), (F.lit(-96.6) + (F.col("id") % 33) * F.lit(0.2)).alias("lon"))
    near = spatial.nearest_neighbor(nodes, views.gauge(spark, sf), "node", "gauge", metric="planar")
    q = ordering.exact_quantiles(near, "distance", {"median": 0.5, "p90": 0.9, "largest": 1.0})
    return rounded(q, 5, "median", "p90", "largest").select("n", "median", "p90", "largest")


# --- remaining sources and contracts ---------------------------------------------------------
@query("append_missing", "SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def append_missing(spark, sf):
    """A load that stopped half-way, resumed twice: the second resume adds nothing."""
    path = scratch_path(spark, "resumed")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sinks.write_table(orders.where("o_orderkey % 3 = 0"), path)
    for _ in range(2):
        sinks.append_missing(spark, orders, path, ["o_orderkey"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("header_map", "SELECT c_mktsegment AS kind, CAST(n AS BIGINT) AS year, count(*) AS customers FROM customer, (VALUES (2010), (2020)) t(n) WHERE c_nationkey % 2 = CASE WHEN n = 2010 THEN 0 ELSE 1 END GROUP BY 1, 2")
def header_map(spark, sf):
    """A report sheet with two header rows (year over kind), rebuilt from customers and read back as long rows."""
    segments = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    cells = [(y, s) for y in (2010, 2020) for s in segments]
    counts = table(spark, sf, "customer").agg(*[F.count_if((F.col("c_mktsegment") == s) & (F.col("c_nationkey") % 2 == (0 if y == 2010 else 1))).cast("string").alias(f"c{i}") for i, (y, s) in enumerate(cells)])
    top = [str(y) if s == segments[0] else None for y, s in cells]
    header = spark.createDataFrame([(0, *top), (1, *[s for _, s in cells])], "line int, " + ", ".join(f"c{i} string" for i in range(len(cells))))
    names = scans.header_map(header, "line")
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(int(year)).cast("long").alias("year"), F.col(c).cast("long").alias("customers")) for c, (year, kind) in names.items()])
    return counts.select(F.inline(rows)).where("customers > 0")


@query("scan_text_verbatim", "SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE printf('%.2f', c_acctbal) END AS balance FROM customer")
def scan_text_verbatim(spark, sf):
    """Written as text, read as text: trailing zeros and empty cells survive."""
    path = scratch_path(spark, "verbatim")
    cu = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.format_string("%.2f", "c_acctbal")).alias("balance"))
    cu.write.option("header", "true").option("emptyValue", "").csv(path)
    return scans.scan_text_verbatim(spark, path, ["key", "balance"]).select("key", F.coalesce("balance", F.lit("")).alias("balance"))


@query("scan_latin1", "SELECT c_custkey AS id, 'Café ' || c_custkey AS name FROM customer")
def scan_latin1(spark, sf):
    """A Latin-1 file whose header names are quoted."""
    path = scratch_path(spark, "latin1")
    cu = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Café "), F.col("c_custkey").cast("string")).alias("name"))
    cu.write.option("header", "true").option("encoding", "ISO-8859-1").option("quoteAll", "true").csv(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return scans.scan_csv_latin1(spark, path, schema)


@query("drop_sparse", "SELECT count(*) AS n, 'l_orderkey,often' AS kept FROM lineitem")
def drop_sparse(spark, sf):
    """Columns emptier than the limit go; a column that must be constant is checked and dropped."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.expr("CASE WHEN l_linenumber <> 1 THEN l_tax END AS often"), F.expr("CASE WHEN l_orderkey % 20 = 0 THEN l_tax END AS rare"), F.lit("x").alias("unit"))
    kept = contracts.drop_sparse(contracts.assert_constant(li, {"unit": "x"}), 0.9)
    return kept.agg(F.count("*").alias("n"), F.lit(",".join(kept.columns)).alias("kept"))
