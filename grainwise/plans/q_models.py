"""Queries for modelling and batch scoring. Fits have no SQL twin; their preparation has."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainwise.functions.numeric import cyclical, key_hash_sql
from grainwise.operators import modelling as m
from grainwise.operators import ordering
from grainwise.operators.contracts import ContractError
from grainwise.operators.evaluation import regression_metrics
from grainwise.plans.q_profile import rounded
from grainwise.plans.registry import query
from grainwise.session import cut_lineage, scratch_path, stored
from grainwise.sources import views
from grainwise.sources.tables import table

FEATURES = ["qty", "psize", "retail", "total", "doy"]


def training_rows(spark, sf, extra=()):
    rows = m.prepare_frame(views.features(spark, sf), "price", (0.0, 1e7), FEATURES, "cluster", extra)
    return stored(ordering.group_split(stored(rows, "rows"), "cluster", 0.2, seed=42), "split")


def _fit_report(spark, sf, family, **params):
    rows = training_rows(spark, sf)
    fitted = m.fit(rows.where("NOT is_test"), "price", FEATURES, family, **params)
    return regression_metrics(fitted.transform(rows.where("is_test")), "price", "predicted").withColumn("model", F.lit(family))


@query(
    "prepare_frame",
    "SELECT cluster, count(*) AS n, round(sum(price), 2) AS total FROM v_features WHERE price BETWEEN 5000 AND 90000 GROUP BY 1",
)
def prepare_frame(spark, sf):
    rows = m.prepare_frame(views.features(spark, sf), "price", (5000.0, 90000.0), FEATURES, "cluster")
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query(
    "median_impute",
    f"""WITH m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in views.CHEMISTRY)} FROM v_chemistry)
       SELECT sample_id, replicate, station, {', '.join(f'round(coalesce({c}, m_{c}), 6) AS {c}, ({c} IS NULL)::INT AS {c}_missing' for c in views.CHEMISTRY)} FROM v_chemistry, m""",
)
def median_impute(spark, sf):
    columns = list(views.CHEMISTRY)
    df = views.chemistry(spark, sf).select("sample_id", "replicate", "station", *columns)
    return rounded(m.median_impute(df, df, columns, flags=True), 6, *columns)


@query(
    "standardize",
    "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value_z FROM events",
)
def standardize(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    return rounded(m.standardize(ev, ev, ["value"]), 6, "value_z").select("event_id", "value_z")


@query(
    "log_eligibility",
    """SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_tax < 0) AS n_negative, round(avg((l_tax = 0)::INT), 6) AS zero_share, avg((l_tax = 0)::INT) < 0.2 AS eligible FROM lineitem GROUP BY 1""",
)
def log_eligibility(spark, sf):
    return rounded(m.log_eligibility(table(spark, sf, "lineitem"), "l_tax", ["l_returnflag"]), 6, "zero_share")


#: The rows of training_rows in SQL, with the group split.
TRAINING_SQL = f"""rows_ AS (SELECT f.*, g.rn <= ceil(g.n * 0.2) AS is_test FROM v_features f JOIN (SELECT k, row_number() OVER (ORDER BY {key_hash_sql('k', 42)}, k) AS rn, count(*) OVER () AS n
         FROM (SELECT DISTINCT cluster AS k FROM v_features WHERE price BETWEEN 0 AND 1e7)) g ON f.cluster = g.k WHERE price BETWEEN 0 AND 1e7)"""


def least_squares_sql(rows: str, target: str, features: list[str]) -> str:
    """CTEs that solve the normal equations of ``rows`` by Gauss-Jordan steps; the last one, ``beta``, has b_0 (constant) to b_p.

    Features are centred and scaled first, as the cross-products of raw ones cancel badly.
    """
    p = len(features)
    names = ["one_", *features, target]
    scale = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in features)
    z = lambda i: "1.0::DOUBLE" if i == 0 else (f"(({names[i]} - m_{names[i]}) / s_{names[i]})" if i <= p else f"{names[i]}")
    steps = [f"scale_ AS (SELECT {scale} FROM {rows} WHERE NOT is_test)"]
    cells = [f"sum({z(i)} * {z(j)}) AS a_{i}_{j}" for i in range(p + 1) for j in range(p + 2)]
    steps.append(f"step_0 AS (SELECT {', '.join(cells)} FROM {rows}, scale_ WHERE NOT is_test)")
    for k in range(p + 1):
        out = []
        for i in range(p + 1):
            for j in range(p + 2):
                pivot = f"a_{k}_{j} / a_{k}_{k}"
                out.append(f"{pivot if i == k else f'a_{i}_{j} - a_{i}_{k} * {pivot}'} AS a_{i}_{j}")
        steps.append(f"step_{k + 1} AS (SELECT {', '.join(out)} FROM step_{k})")
    steps.append(f"beta AS (SELECT {', '.join(f'a_{i}_{p + 1} AS b_{i}' for i in range(p + 1))}, scale_.* FROM step_{p + 1}, scale_)")
    return ",\n".join(steps)


def linear_prediction_sql(features: list[str]) -> str:
    return "b_0 + " + " + ".join(f"b_{i} * (({f}) - m_{f}) / s_{f}" for i, f in enumerate(features, 1))


METRICS_SQL = """count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae"""


@query(
    "fit_linear",
    f"""WITH {TRAINING_SQL}, {least_squares_sql('rows_', 'price', FEATURES)}
       SELECT 'linear' AS model, {METRICS_SQL} FROM (SELECT price AS y, {linear_prediction_sql(FEATURES)} AS p FROM rows_, beta WHERE is_test)""",
)
def fit_linear(spark, sf):
    out = _fit_report(spark, sf, "linear")
    return rounded(rounded(out, 5, "r2"), 3, "rmse", "mae").select("model", "n", "r2", "rmse", "mae")


def _tree_facts(spark, sf, family, **params):
    """Rows scored on held-out groups, whether the error is no worse than the mean's, and the impurity importances."""
    rows = training_rows(spark, sf)
    train, test = rows.where("NOT is_test"), rows.where("is_test")
    if family == "boosted":
        # A tenth of the training groups stops the boosting.
        held = ordering.group_split(train.drop("is_test"), "cluster", 0.1, seed=7).withColumnRenamed("is_test", "is_held")
        fitted = m.fit(cut_lineage(held), "price", FEATURES, family, validation="is_held", **params)
    else:
        fitted = m.fit(train, "price", FEATURES, family, **params)
    report = regression_metrics(fitted.transform(test), "price", "predicted")
    weights = dict(fitted.importances())
    sane = (F.col("r2") > -0.25) & (F.col("rmse") > 0)  # the given prices follow no feature: a fit can't do better than the mean
    return report.select(F.lit(family).alias("model"), "n", sane.alias("near_mean_or_better"), F.lit(len(weights)).cast("long").alias("features"), F.lit(round(sum(weights.values()), 6)).alias("importance_total"))


def _facts_sql(family):
    return f"WITH {TRAINING_SQL} SELECT '{family}' AS model, count(*) AS n, true AS near_mean_or_better, CAST({len(FEATURES)} AS BIGINT) AS features, 1.0::DOUBLE AS importance_total FROM rows_ WHERE is_test"


@query("fit_forest", _facts_sql("forest"))
def fit_forest(spark, sf):
    return _tree_facts(spark, sf, "forest")


@query("fit_boosted", _facts_sql("boosted"))
def fit_boosted(spark, sf):
    return _tree_facts(spark, sf, "boosted")


@query("artifact_contract", f"WITH {TRAINING_SQL} SELECT count(*) AS n, 0.0::DOUBLE AS largest_change, true AS other_contract_refused FROM rows_ WHERE is_test")
def artifact_contract(spark, sf):
    """Save a fitted model with its feature list, load it under the contract and compare predictions; another contract is refused."""
    rows = training_rows(spark, sf)
    path = scratch_path(spark, "artifact")
    fitted = m.fit(rows.where("NOT is_test"), "price", FEATURES, "linear")
    fitted.save(path)
    back = m.Fitted.load(spark, path, FEATURES)
    try:
        m.Fitted.load(spark, path, FEATURES[::-1])
        refused = False
    except ContractError:
        refused = True
    both = back.transform(fitted.transform(rows.where("is_test")).withColumnRenamed("predicted", "before"))
    return both.agg(F.count("predicted").alias("n"), F.round(F.max(F.abs(F.col("predicted") - F.col("before"))), 6).alias("largest_change")).withColumn("other_contract_refused", F.lit(refused))


@query(
    "feature_matrix",
    """SELECT station, round(lat, 6) AS lat, round(lon, 6) AS lon, 196 AS doy, round(sin(2 * pi() * 196 / 365.25), 6) AS doy_sin, round(cos(2 * pi() * 196 / 365.25), 6) AS doy_cos, 2024 AS year FROM v_station""",
)
def feature_matrix(spark, sf):
    t = cyclical(F.to_date(F.lit("2024-07-14")))
    return views.station(spark, sf).select("station", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), t["doy"].alias("doy"), F.round(t["doy_sin"], 6).alias("doy_sin"), F.round(t["doy_cos"], 6).alias("doy_cos"), t["year"].alias("year"))


@query(
    "prediction_summary",
    """SELECT event_type, count(*) AS n, min(value) AS low, round(median(value), 6) AS median, max(value) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.02), 6) AS p2, round(quantile_cont(value, 0.98), 6) AS p98
       FROM events GROUP BY 1""",
)
def prediction_summary(spark, sf):
    ev = table(spark, sf, "events")
    q = ordering.exact_quantiles(ev, "value", {"median": 0.5, "p2": 0.02, "p98": 0.98}, ["event_type"])
    s = ev.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"))
    return rounded(q.join(s, "event_type"), 6, "median", "p2", "p98")
