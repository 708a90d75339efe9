"""Steps behind binned profiles and report quantiles."""

import math

import pytest
from pyspark.sql import functions as F

from grainwise.operators import association as a
from grainwise.operators import ordering


def test_trend_of_equal_spreads_is_no_error(spark):
    """Bins of one spread have no trend: NaN as in SQL, not a division by zero."""
    profile = spark.createDataFrame([("g", b, 1.0 + b, 3.0 + b) for b in range(6)], "grp string, bin long, q1 double, q3 double")
    row = a.conditional_spread(profile, ["grp"]).first()
    assert (row.n_bins, row.iqr_ratio) == (6, 1.0) and math.isnan(row.iqr_trend)


def test_correlation_of_groups(spark):
    rows = [("one", 1.0, 2.0), ("none", None, 1.0), ("up", 1.0, 1.0), ("up", 2.0, 3.0), ("up", 5.0, None), ("flat", 1.0, 2.0), ("flat", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").groupBy("g").agg(a.safe_corr(F.col("x"), F.col("y")).alias("r"))
    got = {r.g: r.r for r in df.collect()}
    assert got["one"] is None and got["none"] is None and got["up"] == pytest.approx(1.0) and math.isnan(got["flat"])


def test_quantiles_open_only_buckets_that_hold_them(spark, monkeypatch):
    """A median of many distinct values opens few of the buckets; the result stays exact."""
    seen = []
    kept = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda df, label: seen.append((label, out := kept(df, label))) or out)
    rows = [("a" if i % 3 else None if i % 9 == 0 else "b", float(i * 7919 % 10007) if i % 50 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ordering.exact_quantiles(df, "v", {"q": 0.25, "m": 0.5}, ["g"]).collect()}
    for g in ("a", "b"):
        values = spark.createDataFrame(rows, "g string, v double").where(F.col("g") == g).toPandas()["v"].dropna()
        assert got[g].n == len(values) and got[g].q == pytest.approx(values.quantile(0.25)) and got[g].m == pytest.approx(values.median())
    opened = dict(seen)["opened"]
    assert 0 < opened.where("g = 'a'").count() <= 2
