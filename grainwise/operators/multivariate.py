"""Many-column statistics from one row of cross-products; p x p algebra happens on that single row."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.session import stored


@dataclass
class Moments:
    """Row count, means and covariance (population) of complete rows."""

    n: int
    mean: np.ndarray
    cov: np.ndarray

    @property
    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.cov / np.outer(sd, sd)


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Two aggregations with map-side combine: means first, then centred products, which keeps large values exact."""
    columns = list(columns)
    rows = complete(df, columns)
    first = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).first()
    if not first["n"]:
        raise ValueError("no complete rows")
    centred = [F.col(c).cast("double") - F.lit(float(first[c])) for c in columns]
    cells = [F.avg(centred[i] * centred[j]).alias(f"c_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    got = rows.agg(*cells).first()
    cov = np.array([[got[f"c_{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))])
    return Moments(first["n"], np.array([float(first[c]) for c in columns]), cov)


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation per column (diagonal of the inverse correlation), the condition number, and the rank deficit."""
    m = moments(df, columns)
    values = np.linalg.eigvalsh(m.corr)
    inflation = np.diag(np.linalg.pinv(m.corr))
    condition = float(np.sqrt(values.max() / values.min())) if values.min() > 1e-9 else math.inf
    null = int((values < 1e-10 * values.max()).sum())
    rows = [(c, float(v), condition, null) for c, v in zip(columns, inflation, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, condition_number double, null_dimensions long")


def null_space(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """Columns that are sums of others, with the weights of their members on standardised values.

    A rank-revealing factorisation of the correlation matrix in column order: a column whose residual variance, given the
    independent ones before it, is below ``tolerance`` depends on them; members with a smaller weight aren't named.
    Constant columns depend on nothing and are named alone.
    """
    m = moments(df, columns)
    sd = np.sqrt(np.diag(m.cov))
    rows, basis = [], []
    for j, name in enumerate(columns):
        if sd[j] <= tolerance * max(1.0, abs(m.mean[j])):
            rows.append((name, None, None, 0.0))
            continue
        weights = np.linalg.solve(m.corr[np.ix_(basis, basis)], m.corr[basis, j]) if basis else np.zeros(0)
        residual = float(1.0 - m.corr[basis, j] @ weights)
        if residual > tolerance:
            basis.append(j)
            continue
        rows += [(name, columns[i], float(w), max(residual, 0.0)) for i, w in zip(basis, weights, strict=True) if abs(w) > math.sqrt(tolerance)]
    return df.sparkSession.createDataFrame(rows, "feature string, member string, weight double, residual double")


def weakest_directions(df: DataFrame, columns: Sequence[str], k: int = 3, least: float = 0.05) -> DataFrame:
    """The ``k`` smallest eigenvalues of the correlation matrix and the loadings of their vectors above ``least``.

    Vectors have the sign that makes their largest loading positive.
    """
    values, vectors = np.linalg.eigh(moments(df, columns).corr)
    rows = []
    for d in range(min(k, len(columns))):
        v = vectors[:, d] * np.sign(vectors[np.abs(vectors[:, d]).argmax(), d])
        rows += [(d + 1, float(values[d]), c, float(x)) for c, x in zip(columns, v, strict=True) if abs(x) > least]
    return df.sparkSession.createDataFrame(rows, "direction long, eigenvalue double, feature string, loading double")


def pca_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per component of the correlation matrix: explained share, running share, and the column with the largest loading."""
    m = moments(df, columns)
    values, vectors = np.linalg.eigh(m.corr)
    order = np.argsort(-values, kind="stable")
    share = values[order] / values.sum()
    rows = []
    for k, i in enumerate(order):
        top = int(np.abs(vectors[:, i]).argmax())
        rows.append((k + 1, float(share[k]), float(share[: k + 1].sum()), columns[top], float(abs(vectors[top, i]))))
    return df.sparkSession.createDataFrame(rows, "component long, explained double, cumulative double, main_feature string, main_loading double")


def chi_square_limit(degrees: int, z: float) -> float:
    """Quantile of chi-square by Wilson-Hilferty, for the normal quantile ``z``."""
    h = 2 / (9 * degrees)
    return degrees * (1 - h + z * math.sqrt(h)) ** 3


#: Standard normal quantile of 0.999.
Z_999 = 3.090232306167813


def mahalanobis(df: DataFrame, columns: Sequence[str], z: float = Z_999) -> DataFrame:
    """Adds ``d2`` (squared distance to the mean; NULL for incomplete rows) and ``is_outlier``."""
    df = stored(df, "rows")  # read by both aggregations of the moments and once more for the result
    m = moments(df, columns)
    inverse = np.linalg.pinv(m.cov)
    centred = [F.col(c).cast("double") - F.lit(float(mu)) for c, mu in zip(columns, m.mean, strict=True)]
    d2: Column = F.lit(0.0)
    for i in range(len(columns)):
        for j in range(len(columns)):
            d2 = d2 + F.lit(float(inverse[i, j])) * centred[i] * centred[j]
    return df.withColumn("d2", d2).withColumn("is_outlier", F.col("d2") > F.lit(chi_square_limit(len(columns), z)))


def least_squares(df: DataFrame, target: str, columns: Sequence[str]) -> tuple[float, dict[str, float]]:
    """(intercept, coefficients) of the least-squares fit on complete rows; collinear columns share the minimum-norm solution."""
    m = moments(df, [*columns, target])
    p = len(columns)
    beta = np.linalg.lstsq(m.cov[:p, :p], m.cov[:p, p], rcond=None)[0]
    return float(m.mean[p] - m.mean[:p] @ beta), dict(zip(columns, beta.tolist(), strict=True))


def linear_value(intercept: float, coefficients: dict[str, float]) -> Column:
    out = F.lit(intercept)
    for c, b in coefficients.items():
        out = out + F.lit(b) * F.col(c)
    return out
