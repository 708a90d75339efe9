"""Numeric expressions: interpolation, distances, transforms, binning, normal scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainwise.functions.cleaning import col

EARTH_KM = 6371.0088
PARITY_EARTH_KM = 6371.0


def curve_axis(c: str | Column, log: bool = False) -> Column:
    """Non-null x axis of a curve: log10 with a floor of 1e-6, or the value itself."""
    x = F.coalesce(col(c).cast("double"), F.lit(1.0))
    return F.log10(F.greatest(x, F.lit(1e-6))) if log else x


def piecewise(x: Column, anchors: Sequence[tuple[float, float]], log: bool = False) -> Column:
    """Piecewise-linear value on a prepared axis; exact at every anchor, clamped at both ends."""
    xs = [math.log10(a) if log else float(a) for a, _ in anchors]
    ys = [float(q) for _, q in anchors]
    out = F.when(x < xs[0], F.lit(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x < x1, F.lit((y1 - y0) / (x1 - x0)) * (x - x0) + F.lit(y0))
    return out.otherwise(F.lit(ys[-1]))


def interpolate(c: str | Column, anchors: Sequence[tuple[float, float]], log: bool = False) -> Column:
    """Piecewise-linear map through ``anchors``; NULL stays NULL."""
    return F.when(col(c).isNotNull(), piecewise(curve_axis(c, log), anchors, log))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def radian_euclidean_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Chord of plain (lat, lon) radians through the great-circle formula: the parity metric."""
    d = F.sqrt(F.pow(F.radians(lat2 - lat1), 2) + F.pow(F.radians(lon2 - lon1), 2))
    return F.lit(2 * PARITY_EARTH_KM) * F.asin(F.least(d / 2, F.lit(1.0)))


def planar_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def cyclical(ts: str | Column) -> dict[str, Column]:
    """Day of year, its sine and cosine over 365.25 days, and the year."""
    doy = F.dayofyear(col(ts))
    angle = F.lit(2 * math.pi) * doy / F.lit(365.25)
    return {"doy": doy, "doy_sin": F.sin(angle), "doy_cos": F.cos(angle), "year": F.year(col(ts))}


def log_offset(y: str | Column, offset: Column | float) -> Column:
    c = offset if isinstance(offset, Column) else F.lit(float(offset))
    return F.log10(col(y) + c)


def undo_log_offset(z: str | Column, offset: Column | float, smear: Column | float = 1.0) -> Column:
    """Back-transform with a smearing factor; results are clipped at 0."""
    c = offset if isinstance(offset, Column) else F.lit(float(offset))
    s = smear if isinstance(smear, Column) else F.lit(float(smear))
    return F.greatest(F.pow(F.lit(10.0), col(z)) * s - c, F.lit(0.0))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence, right: bool = True, include_lowest: bool = False) -> Column:
    """Interval labels; outside every interval (or NULL) is NULL."""
    x = col(c)
    out = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        if right:
            test = ((x >= lo) if include_lowest and i == 0 else (x > lo)) & (x <= hi)
        else:
            test = (x >= lo) & (x < hi)
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


# Season names by month.
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer", 9: "Autumn", 10: "Autumn", 11: "Autumn"}


def season(ts: str | Column) -> Column:
    m = F.month(col(ts))
    return (
        F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Autumn")
    )


def fortnight(ts: str | Column) -> Column:
    """1-based 14-day bin of the year (bin k covers days 14k-13 .. 14k)."""
    return F.ceil(F.dayofyear(col(ts)) / F.lit(14.0)).cast("long")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days (floor), not calendar-date difference."""
    seconds = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(seconds / F.lit(86400000000.0)).cast("long")


def smape_term(y: str | Column, p: str | Column) -> Column:
    """Symmetric percentage error of one row; 0/0 counts as 0."""
    den = F.abs(col(y)) + F.abs(col(p))
    return F.when(den == 0, F.lit(0.0)).otherwise(200.0 * F.abs(col(y) - col(p)) / den)


#: ``key_hash`` lies in [0, HASH_SPAN).
HASH_SPAN = 1 << 60


def key_hash(key: Column, seed: int = 0) -> Column:
    """Seeded 60-bit hash of a key of any type, by its text: the same integers in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def key_hash_sql(key: str, seed: int = 0) -> str:
    return f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 15) AS BIGINT)"


# Acklam's rational approximation of the standard normal quantile.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _poly(x: Column, coef: Sequence[float], tail: float | None = None) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out if tail is None else out * x + F.lit(tail)


def normal_quantile(p: Column) -> Column:
    q = p - F.lit(0.5)
    r = q * q
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    centre = _poly(r, ACKLAM_A) * q / _poly(r, ACKLAM_B, 1.0)
    return (
        F.when(p < ACKLAM_LOW, _poly(low, ACKLAM_C) / _poly(low, ACKLAM_D, 1.0))
        .when(p > 1 - ACKLAM_LOW, -_poly(high, ACKLAM_C) / _poly(high, ACKLAM_D, 1.0))
        .otherwise(centre)
    )


def normal_quantile_sql(p: str) -> str:
    """The same approximation as SQL text over the expression ``p``."""

    def poly(x: str, coef: Sequence[float], tail: float | None = None) -> str:
        out = f"CAST({coef[0]!r} AS DOUBLE)"
        for c in coef[1:]:
            out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
        return out if tail is None else f"({out} * {x} + CAST({tail!r} AS DOUBLE))"

    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"({q} * {q})"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return (
        f"CASE WHEN {p} < {ACKLAM_LOW} THEN {poly(low, ACKLAM_C)} / {poly(low, ACKLAM_D, 1.0)} "
        f"WHEN {p} > {1 - ACKLAM_LOW} THEN -{poly(high, ACKLAM_C)} / {poly(high, ACKLAM_D, 1.0)} "
        f"ELSE {poly(r, ACKLAM_A)} * {q} / {poly(r, ACKLAM_B, 1.0)} END"
    )


# Abramowitz and Stegun 7.1.26 coefficients of the complementary error function.
ERFC_P = 0.3275911
ERFC_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value 2*(1-Phi(|z|)) = erfc(|z|/sqrt 2)."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_P) * x)
    poly = F.lit(ERFC_A[4])
    for a in ERFC_A[3::-1]:
        poly = poly * t + F.lit(a)
    return poly * t * F.exp(-x * x)


def two_sided_p_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
    t = f"(1.0 / (1.0 + {ERFC_P} * {x}))"
    poly = f"CAST({ERFC_A[4]} AS DOUBLE)"
    for a in ERFC_A[3::-1]:
        poly = f"({poly} * {t} + CAST({a} AS DOUBLE))"
    return f"({poly} * {t} * exp(-({x} * {x})))"
