"""Reshaping: collapses, guarded pivots, unpivots, stacks and total rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.operators.ordering import median_by


def slug_name(text: str) -> str:
    """Python twin of functions.cleaning.slug, for column names."""
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def replicate_median(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Collapse replicate measurements by exact median; all-null groups vanish."""
    return median_by(df, value, key)


def collapse_mean(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.avg(c).alias(c) for c in columns])


def collapse_max_first(df: DataFrame, key: Sequence[str], value: str, first: str) -> DataFrame:
    """Drop exact duplicates, then the maximum value and the first name; null keys are kept."""
    return df.distinct().groupBy(*key).agg(F.max(value).alias(value), F.min(first).alias(first))


def pivot_wide(
    df: DataFrame, key: Sequence[str], columns: Mapping[str, Sequence[str]], value: str, prefix: str, suffix: str = "",
    drop_all_null: bool = False,
) -> DataFrame:
    """Long to wide with names ``prefix__a__b_suffix``.

    The values of each pivot column are given, so the plan is one conditional aggregation: no
    extra job to discover values, and the output schema does not depend on the data. Each cell must
    hold at most one row; a cell with more fails.
    """
    (c1, v1), (c2, v2) = list(columns.items())
    cells = [(a, b) for a in v1 for b in v2]
    name = lambda a, b: f"{prefix}__{slug_name(a)}__{slug_name(b)}{suffix}"
    once = F.when(F.count("*") <= 1, F.max(value)).otherwise(F.raise_error(F.lit(f"pivot key of {prefix} is not unique")).cast("double"))
    single = df.groupBy(*key, c1, c2).agg(once.alias(value))
    out = single.groupBy(*key).agg(
        *[F.max(F.when((F.col(c1) == a) & (F.col(c2) == b), F.col(value))).alias(name(a, b)) for a, b in cells]
    )
    if drop_all_null:
        out = out.where(F.coalesce(*[F.col(name(a, b)) for a, b in cells]).isNotNull())
    return out


def pivot_with_units(df: DataFrame, key: Sequence[str], parameter: str, value: str, units: Mapping[str, str]) -> DataFrame:
    """Long to wide: ``<p>_value`` and, only where a value is present, its constant ``<p>_unit``."""
    wide = df.groupBy(*key).agg(
        *[F.max(F.when(F.col(parameter) == p, F.col(value))).alias(f"{slug_name(p)}_value") for p in units]
    )
    ordered: list[Column] = []
    for p, unit in units.items():
        v = F.col(f"{slug_name(p)}_value")
        ordered += [v, F.when(v.isNotNull(), F.lit(unit)).alias(f"{slug_name(p)}_unit")]
    return wide.select(*key, *ordered)


def unpivot_regex(df: DataFrame, key: Sequence[str], pattern: str, groups: Mapping[str, str], value: str) -> DataFrame:
    """Wide columns whose names match ``pattern`` to long rows, with header groups as columns.

    ``groups`` maps output names to types, in the order of the pattern's groups. Headers are
    parsed once from the schema; rows are exploded, not shuffled.
    """
    rx = re.compile(pattern)
    cells = []
    for c in df.columns:
        m = rx.match(c)
        if m:
            parts = [F.lit(g).cast(t).alias(n) for (n, t), g in zip(groups.items(), m.groups())]
            cells.append(F.struct(*parts, F.col(f"`{c}`").alias(value)))
    if not cells:
        raise ValueError(f"no column matches {pattern}")
    return df.select(*key, F.inline(F.array(*cells)))


def null_aware_total(columns: Sequence[str], min_count: int = 1) -> Column:
    """Sum ignoring NULLs; NULL when fewer than ``min_count`` parts are present."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return F.when(present >= min_count, total)


def add_total_rows(df: DataFrame, key: Sequence[str], category: str, value: str, label: str = "Total") -> DataFrame:
    """Drop stale total rows, recompute them over the categories and append."""
    parts = df.where(F.col(category) != label).select(*key, category, value)
    totals = parts.groupBy(*key).agg(F.sum(value).alias(value)).withColumn(category, F.lit(label))
    return parts.unionByName(totals)


def stack_pairs(df: DataFrame, key: Sequence[str], pairs: Mapping[str, tuple[str, str]], label: str, names: tuple[str, str]) -> DataFrame:
    """Several (a, b) column pairs to one long table with the pair's label."""
    cells = [F.struct(F.lit(k).alias(label), F.col(a).alias(names[0]), F.col(b).alias(names[1])) for k, (a, b) in pairs.items()]
    return df.select(*key, F.inline(F.array(*cells)))


def long_form(df: DataFrame, columns: Sequence[str], key: Sequence[str] = (), variable: str = "variable", value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (key, variable, value); NULL cells are dropped."""
    cells = [F.struct(F.lit(c).alias(variable), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*key, F.inline(F.array(*cells))).where(F.col(value).isNotNull())
