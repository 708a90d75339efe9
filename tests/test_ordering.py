import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from grainwise.operators import association, joins, ordering


def skewed(spark, n=3000):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n)), "v": np.round(rng.lognormal(1, 1, n), 1)})
    pdf.loc[rng.random(n) < 0.3, "v"] = 2.5
    return pdf, spark.createDataFrame(pdf)


def test_quantiles_match_numpy(spark):
    pdf, df = skewed(spark)
    got = {r.g: r for r in ordering.exact_quantiles(df, "v", {"a": 0.1, "m": 0.5, "z": 0.99}, ["g"]).collect()}
    for g, s in pdf.groupby("g").v:
        np.testing.assert_allclose([got[g].a, got[g].m, got[g].z], np.quantile(s, [0.1, 0.5, 0.99]))


def test_ranks_do_not_depend_on_edges(spark):
    pdf, df = skewed(spark)
    for edges in ([], [2.5], [0.5, 1.0, 2.5, 9.0]):
        counts = ordering.ordered_counts(df, "v", edges=edges).toPandas()
        ranks = counts.set_index("v").apply(lambda r: r.cum_before + (r.cnt + 1) / 2, axis=1)
        np.testing.assert_allclose(pdf.v.map(ranks), pdf.v.rank())


def test_previous_visit_across_chunks(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 2, 1], "t": pd.to_datetime(["2024-01-01 23:00", "2024-01-02 01:00", "2024-01-09 02:00", "2024-01-03 00:00", "2024-01-09 02:00"]), "i": [1, 2, 3, 4, 5], "v": [1.0, 2.0, 3.0, 4.0, 5.0]})
    rows = {r.i: r for r in ordering.previous_visit(spark.createDataFrame(pdf), ["k"], "t", "i", "v").collect()}
    assert [rows[i].prev_value for i in range(1, 6)] == [None, 1.0, 2.0, None, 3.0]
    assert [rows[i].gap_days for i in range(1, 6)] == [None, 0, 7, None, 0]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, 1), (1, 5), (1, 40), (2, 7)], "k INT, t INT")
    right = spark.createDataFrame([(1, 5, "x"), (1, 31, "y")], "k INT, t INT, p STRING")
    rows = {(r.k, r.t): (r.p, r.staleness) for r in joins.asof_backward(left, right, ["k"], "t", ["p"]).collect()}
    assert rows == {(1, 1): (None, None), (1, 5): ("x", 0), (1, 40): ("y", 9), (2, 7): (None, None)}


def test_bh_fdr(spark):
    p = np.array([0.01, 0.04, 0.03, 0.9, 0.04, 0.2])
    got = {r.i: r.q for r in ordering.bh_fdr(spark.createDataFrame(pd.DataFrame({"i": range(6), "p": p})), "p").collect()}
    order = np.argsort(p, kind="stable")
    adj = np.minimum.accumulate((p[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    np.testing.assert_allclose([got[i] for i in order], np.clip(adj, 0, 1))


def test_splits_are_whole_and_disjoint(spark):
    df = spark.range(500).withColumn("g", F.col("id") % 23)
    split = ordering.group_split(df, "g", 0.2, seed=3)
    assert split.count() == 500
    assert split.select("g", "is_test").distinct().count() == 23
    assert split.where("is_test").select("g").distinct().count() == 5
    folds = ordering.group_kfold(df, "g", 4, seed=3, balanced=True)
    assert folds.select("g", "fold").distinct().count() == 23
    assert {r.fold for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}


def test_cluster_rho_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"c": rng.integers(0, 12, 400), "x": np.round(rng.normal(size=400), 1)})
    pdf["y"] = np.round(pdf.x + rng.normal(size=400) + pdf.c / 4, 1)
    xs, ys = (((r := pdf[k].rank()) - r.mean()) / r.std(ddof=0) for k in ("x", "y"))
    rho = (xs * ys).mean()
    psi = xs * ys - 0.5 * rho * (xs**2 + ys**2)
    r = association.cluster_robust_rho(spark.createDataFrame(pdf).withColumn("t", F.lit(1)), ["t"], "c", "x", "y").first()
    np.testing.assert_allclose([r.rho, r.se_iid, r.se_cluster], [rho, np.sqrt((psi**2).sum()) / 400, np.sqrt((psi.groupby(pdf.c).sum() ** 2).sum()) / 400])


def test_feature_blocks(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a STRING, b STRING")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "feature STRING")
    got = {r.feature: r.block for r in association.feature_blocks(pairs, nodes).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
