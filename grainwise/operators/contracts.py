"""Grain contracts: key uniqueness, fan-out, vocabularies, audits and reconciliation reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A data contract does not hold."""


def duplicate_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Fail unless ``key`` identifies rows; reads at most one offending key back."""
    bad = duplicate_report(df, key).take(1)
    if bad:
        raise ContractError(f"key {list(key)} is not unique, e.g. {bad[0].asDict()}")
    return df


def grain_safe_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    check: bool = True,
    null_safe: bool = False,
) -> DataFrame:
    """Join a unique-keyed dimension without changing the left grain.

    A unique right key is exactly what keeps a left join from fanning out, so one check of the
    right side covers both contracts and the left side is never counted. Spark chooses between
    broadcast and shuffle by the size it measures; nothing is forced here.
    """
    if check:
        assert_unique(right, on)
    if null_safe:
        tagged = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
        cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
        return left.join(tagged, cond, how).drop(*[f"_r_{c}" for c in on])
    return left.join(right, list(on), how)


def join_drop_overlap(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join after dropping from the right every non-key column the left already has."""
    keep = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*keep), list(on), how)


def filter_audit(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Apply filters in order; return ``(kept rows, audit)`` with rows in, out and dropped per step.

    The audit is one aggregation over the unfiltered input, not one pass per step.
    """
    passed: list[Column] = []
    running = F.lit(True)
    for _, cond in steps:
        running = running & F.coalesce(cond, F.lit(False))
        passed.append(running)
    counts = df.agg(
        F.count("*").alias("_c0"), *[F.count_if(c).alias(f"_c{i}") for i, c in enumerate(passed, 1)]
    )
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("step"), F.lit(label).alias("label"),
            F.col(f"_c{i - 1}").alias("rows_in"), F.col(f"_c{i}").alias("rows_out"),
            (F.col(f"_c{i - 1}") - F.col(f"_c{i}")).alias("rows_dropped"),
        )
        for i, (label, _) in enumerate(steps, 1)
    ]
    return df.where(passed[-1]), counts.select(F.inline(F.array(*rows)))


def match_rate(df: DataFrame, probes: Mapping[str, str]) -> DataFrame:
    """Share of rows where each source's probe column is present."""
    agg = df.agg(
        F.count("*").alias("_n"), *[F.count(c).alias(f"_m{i}") for i, c in enumerate(probes.values())]
    )
    rows = [
        F.struct(
            F.lit(label).alias("source"), F.col("_n").alias("n_rows"), F.col(f"_m{i}").alias("n_matched"),
            (F.col(f"_m{i}") / F.nullif(F.col("_n"), F.lit(0))).alias("match_rate"),
        )
        for i, label in enumerate(probes)
    ]
    return agg.select(F.inline(F.array(*rows)))


def token_vocab_check(df: DataFrame, column: str, vocab: Sequence[str], sep: str = ",") -> DataFrame:
    """Tokens of a delimited cell that are not in the vocabulary, with counts."""
    tokens = F.explode(F.transform(F.split(column, sep), lambda x: F.trim(x)))
    return (
        df.select(tokens.alias("token")).groupBy("token").agg(F.count("*").alias("n"))
        .where((F.col("token") != "") & ~F.col("token").isin(*vocab))
    )


def unmapped(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Values the mapping does not cover, with counts."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*mapping))
        .groupBy(column).agg(F.count("*").alias("n"))
    )


def closure_check(df: DataFrame, total: Column, parts: Sequence[Column]) -> DataFrame:
    """Residual of ``total`` against the sum of its parts, and the range of the row sums."""
    row_sum = reduce(lambda a, b: a + b, parts)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.max(F.abs(total - row_sum)).alias("max_residual"),
        F.min(row_sum).alias("min_sum"), F.max(row_sum).alias("max_sum"), F.avg(row_sum).alias("mean_sum"),
    )


def presence_iff(df: DataFrame, column: str, flag: Column) -> DataFrame:
    """Rows where "column is present" and ``flag`` disagree, by direction."""
    present = F.col(column).isNotNull()
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(present & ~flag).alias("present_without_flag"),
        F.count_if(~present & flag).alias("flag_without_value"),
    )


def functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Determinant values that map to more than one dependent value (empty when it holds)."""
    return (
        df.select(determinant, dependent).distinct()
        .groupBy(determinant).agg(F.count(dependent).alias("n_values")).where("n_values > 1")
    )


def sparse_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, non-null rows, null share, and whether it holds one value only."""
    columns = list(columns or df.columns)
    agg = df.agg(
        F.count("*").alias("_n"),
        *[F.count(c).alias(f"_c{i}") for i, c in enumerate(columns)],
        *[(F.min(c).eqNullSafe(F.max(c))).alias(f"_k{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(f"_c{i}").alias("n_present"),
            (1 - F.col(f"_c{i}") / F.nullif(F.col("_n"), F.lit(0))).alias("null_share"),
            (F.col(f"_c{i}") == 0).alias("all_null"),
            ((F.col(f"_c{i}") > 0) & F.col(f"_k{i}")).alias("constant"),
        )
        for i, c in enumerate(columns)
    ]
    return agg.select(F.inline(F.array(*rows)))


def drop_sparse(df: DataFrame, max_null_share: float = 0.9) -> DataFrame:
    """Drop columns that are emptier than the threshold (one pass, one small row read back)."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns]).first()
    n = row["_n"]
    return df.drop(*[c for c in df.columns if n and 1 - row[c] / n > max_null_share])


def assert_constant(df: DataFrame, expected: Mapping[str, object]) -> DataFrame:
    """Fail unless each column holds one value (None: the column must be empty)."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in expected], *[F.max(c).alias(f"hi_{c}") for c in expected]).first()
    for c, want in expected.items():
        if row[f"lo_{c}"] != want or row[f"hi_{c}"] != want:
            raise ContractError(f"column {c} is not constantly {want!r}")
    return df.drop(*expected)


def assert_columns(df: DataFrame, columns: Sequence[str], ordered: bool = True) -> DataFrame:
    got, want = list(df.columns), list(columns)
    if (got != want) if ordered else (set(got) != set(want)):
        raise ContractError(f"columns differ: missing {set(want) - set(got)}, extra {set(got) - set(want)}")
    return df


def reconcile(df: DataFrame, derived: str, recorded: str) -> DataFrame:
    """Agreement of a derived code with the recorded one, null-safe."""
    same = F.col(derived).eqNullSafe(F.col(recorded))
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(same).alias("n_match"), F.count_if(~same).alias("n_mismatch"),
        F.count_if(F.col(derived).isNull()).alias("n_underived"),
    )
