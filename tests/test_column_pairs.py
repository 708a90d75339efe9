"""Rank statistics of column pairs over wide rows, against the same pairs as long rows."""

import math

from pyspark.sql import functions as F

from grainwise.operators import association as a
from grainwise.plans import q_association

COLUMNS = ["p", "q", "r", "s"]


def wide(spark):
    """Rows with ties, gaps in two columns, missing clusters, one cluster of two rows and a column without values."""
    rows = []
    for i in range(400):
        p, q = float(i * 7 % 31), float(i * i % 53) + 0.25 * (i % 4)
        rows.append((None if i % 97 == 0 else (999 if i < 2 else i % 23), p, None if i % 5 == 0 else q, -0.0 if i % 11 == 0 else float((i * 13) % 17), None))
        rows.append((i % 23, None if i % 9 == 0 else float(i % 3), q, float(i % 2), None))
    return spark.createDataFrame(rows, "cluster long, p double, q double, r double, s double")


def both(spark):
    df = wide(spark)
    pairs = {(x, y): (x, y) for i, x in enumerate(COLUMNS) for y in COLUMNS[i + 1:]}
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in pairs]
    return a.ColumnPairs(df, ("a", "b"), pairs), df.select("cluster", F.inline(F.array(*cells)))


def same(left, right):
    left, right = ({(r.a, r.b): r.asDict() for r in df.collect()} for df in (left, right))
    assert left.keys() == right.keys() and left
    for k in left:
        for c, v in left[k].items():
            w = right[k][c]
            assert v == w or math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9), (k, c, v, w)


def test_wide_pairs_equal_long_pairs(spark):
    pairs, long = both(spark)
    same(a.spearman(pairs, "x", "y", ["a", "b"]), a.spearman(long, "x", "y", ["a", "b"]))
    same(*(a.between_within_corr(df, ["a", "b"], "cluster", "x", "y") for df in (pairs, long)))
    same(*(a.cluster_robust_rho(df, ["a", "b"], "cluster", "x", "y") for df in (pairs, long)))


def test_wide_pairs_against_plain_ranks(spark):
    pairs, _ = both(spark)
    df = wide(spark).toPandas()
    for r in a.spearman(pairs, "x", "y", ["a", "b"]).collect():
        kept = df[[r.a, r.b]].dropna().rank()
        assert r.n == len(kept) and math.isclose(r.rho, kept[r.a].corr(kept[r.b]), abs_tol=1e-9)


def test_rows_are_stored_once_and_not_per_pair(spark, monkeypatch):
    rows = wide(spark).select("cluster", *[F.col(c).alias(n) for n, c in zip([*q_association.views.TARGETS, *q_association.views.FEATURES], ["p", "q", "r", "p", "q", "r", "p"])])
    monkeypatch.setattr(q_association.views, "features", lambda *_: rows)
    kept = q_association.stored_pairs(spark, "")
    assert kept.rows.count() == rows.count() and len(kept.pairs) == 10
