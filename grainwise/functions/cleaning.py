"""Column expressions for cleaning contracts. All are built-in expressions: no Python UDF."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN is a value in Spark; the cleaning contracts treat it as missing."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: str | Column) -> Column:
    """Text to DOUBLE; unparseable text and NaN become NULL."""
    return nan_to_null(F.trim(col(c)).try_cast("double"))


# Statistical-agency codes for suppressed or unavailable cells.
SUPPRESSION_CODES = ("(D)", "(Z)", "(X)", "(NA)", "(H)", "(L)", "(S)")


def parse_suppressed(c: str | Column) -> tuple[Column, Column]:
    """``(value, was_suppressed)`` of a cell that may hold thousands commas or a suppression code."""
    text = F.trim(col(c))
    flag = F.coalesce(text.isin(*SUPPRESSION_CODES), F.lit(False))
    return F.when(~flag, to_number(F.regexp_replace(text, ",", ""))), flag


def fahrenheit_to_celsius(c: str | Column, where: Column | None = None) -> Column:
    c = col(c)
    converted = (c - 32.0) * 5.0 / 9.0
    return converted if where is None else F.when(where, converted).otherwise(c)


def in_range(c: str | Column, lo: float | None, hi: float | None) -> Column:
    """Inclusive range test; an open side is None."""
    c = col(c)
    ok = c.isNotNull()
    if lo is not None:
        ok = ok & (c >= lo)
    if hi is not None:
        ok = ok & (c <= hi)
    return ok


def null_outside(c: str | Column, lo: float | None, hi: float | None) -> Column:
    return F.when(in_range(c, lo, hi), col(c))


def null_sentinels(c: str | Column, sentinels: Iterable[float]) -> Column:
    return F.when(~col(c).isin(*sentinels), col(c))


def consistent_pair(lo: str, hi: str) -> tuple[Column, Column]:
    """NULL on both sides of a (min, max) pair that contradicts itself."""
    bad = F.coalesce(F.col(lo) > F.col(hi), F.lit(False))
    return F.when(~bad, F.col(lo)), F.when(~bad, F.col(hi))


def floor_at_zero(c: str | Column) -> Column:
    """Negative readings become 0, and -0.0 becomes 0.0."""
    c = col(c)
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def west_longitude(c: str | Column) -> Column:
    """Longitudes of a western region recorded without their sign."""
    return -F.abs(col(c))


def inside_box(lat: str | Column, lon: str | Column, box: Mapping[str, tuple[float, float]]) -> Column:
    return in_range(lat, *box["lat"]) & in_range(lon, *box["lon"])


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def strip_all(df: DataFrame) -> DataFrame:
    """Trim every string column; empty strings become NULL."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[blank_to_null(c).alias(c) if c in text else F.col(c) for c in df.columns])


def censor_substitute(c: str | Column, lod: float) -> tuple[Column, Column]:
    """``(value, censored)``: an exact 0 means below detection and becomes half the limit."""
    c = col(c)
    flag = F.coalesce(c == 0, F.lit(False))
    return F.when(flag, F.lit(lod / 2.0)).otherwise(c), flag


def pad_code(c: str | Column, width: int) -> Column:
    """Restore leading zeros of a numeric code read as a number; longer codes stay whole."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def parent_code(c: str | Column, digits: int = 8) -> Column:
    """Hierarchical codes lose a leading zero when their length is odd; keep the first digits."""
    c = col(c)
    even = F.when(F.length(c) % 2 == 1, F.concat(F.lit("0"), c)).otherwise(c)
    return F.substring(even, 1, digits)


def null_if_matches(c: str | Column, pattern: str) -> Column:
    c = col(c)
    return F.when(~c.rlike(pattern), c)


def county_code(state: str | Column, county: str | Column) -> Column:
    """Five-digit code, only when both parts are present."""
    return F.concat(pad_code(state, 2), pad_code(county, 3))


def collapse_spaces(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def clean_zip(c: str | Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(col(c)), "-", ""), 1, 5)


def parse_timestamp(date: Column, time: Column | None, formats: Iterable[str]) -> Column:
    """Date text plus an optional time; the first format that fits wins, else NULL."""
    text = date if time is None else F.concat_ws(" ", date, time)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def yes_no(c: str | Column) -> Column:
    return F.when(col(c) == "Y", True).when(col(c) == "N", False)


def slug(c: str | Column) -> Column:
    """Lower snake case, usable in a column name."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_list(c: str | Column, sep: str, out: str | None = None) -> Column:
    """Split, trim, drop empty items and rejoin; an empty list becomes NULL."""
    items = F.filter(
        F.transform(F.split(col(c), "[" + sep.strip() + "]"), lambda x: F.trim(x)), lambda x: F.length(x) > 0
    )
    return F.when(F.size(items) > 0, F.array_join(items, out if out is not None else sep))


def map_values(c: str | Column, mapping: Mapping[str, str]) -> Column:
    """Literal map lookup; unmapped values become NULL (see contracts.unmapped)."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))
