"""Weight schemes against the adopted index: the same statistics as over one copy of the rows per scheme, without those copies."""

import math
import os
import random

import numpy as np
import pytest

from grainwise import session
from grainwise.operators import composite as ci
from grainwise.operators import wide_ranks

SCHEMES = {**ci.NAMED_SCHEMES, **ci.jittered_schemes(14, seed=3)}


def scored(spark, n=3000):
    rng = random.Random(7)
    rows = [tuple(rng.choice([None, rng.choice([10.0, 50.0, 90.0]), rng.uniform(0, 100), rng.uniform(0, 100)]) for _ in ci.WEIGHTS) for _ in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"g_{g} DOUBLE" for g in ci.WEIGHTS))
    return ci.aggregate_index(ci.eligibility(df)).cache()


def ranks(x):
    """Average ranks."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def test_no_copy_of_the_rows_for_each_scheme(spark, tmp_path, monkeypatch):
    df = scored(spark)
    rows = df.where("eligible").collect()
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(wide_ranks, "PASS_VALUES", 10_000)
    got = {r["scheme"]: r for r in ci.weight_sensitivity(df, SCHEMES).collect()}
    assert got.keys() == SCHEMES.keys()
    b = np.array([r["mean_max_blend"] for r in rows])
    for k, w in SCHEMES.items():
        present = [{g: r[f"g_{g}"] for g in w if r[f"g_{g}"] is not None} for r in rows]
        v = np.array([(1 - ci.BLEND) * sum(w[g] * x for g, x in p.items()) / sum(w[g] for g in p) + ci.BLEND * max(p.values()) for p in present]).round(10)
        want = {"median": np.median(v), "pct_over": 100 * np.mean(v > 50), "median_abs_change": np.median(abs(v - b)), "rho": np.corrcoef(ranks(v), ranks(b.round(10)))[0, 1]}
        assert got[k]["n"] == len(rows)
        for c, x in want.items():
            assert got[k][c] == pytest.approx(x, abs=1e-5 if c == "rho" else 1e-8), (k, c)
    written = sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    assert written < 16 * len(SCHEMES) * len(rows)  # a value and a base per scheme and row


def test_keys_order_as_spark_orders_doubles():
    v = np.array([-math.inf, -2.5, -0.0, 0.0, 5e-324, 1.0, math.inf, math.nan, -math.nan])
    k = wide_ranks.keys(v)
    assert list(np.argsort(k, kind="stable")) == list(range(9))
    assert k[2] == k[3] and k[7] == k[8] and [wide_ranks.value_of(x) for x in k[:7]] == list(v[:7])


def test_no_eligible_row(spark):
    assert ci.weight_sensitivity(scored(spark, 5).where("false"), SCHEMES).collect() == []
