"""Keyed permutations of row numbers, and importances by shuffled blocks of columns.

Rows are numbered once. A repeat is a permutation of 0 .. n-1 computed from the number alone: a Feistel network over a
grid of a x b cells that just holds n, walked on while it leads outside. A row takes its partner's values by one join on
numbers; no repeat ranks or sorts anything.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions.numeric import key_hash
from grainwise.operators import ordering
from grainwise.operators.evaluation import regression_metrics
from grainwise.operators.modelling import Fitted
from grainwise.session import cut_lineage

ROUNDS = 6
#: Steps after which a walk that is still outside has failed; fewer than a ** 0.5 of the a * b cells lie outside.
WALK = 32
_FACTOR, _WORD, _SHIFT = 2654435761, 1 << 32, 1 << 9


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[int]:
    """Round keys below 2^30 of a seed."""
    x, out = seed & 0x3FFFFFFF, []
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) % (1 << 30)
        out.append(x)
    return out


def permuted_number(number: Column, n: int, seed: int) -> Column:
    """The image of ``number`` (0 .. n-1) under the seed's permutation of 0 .. n-1."""
    a, b = grid(n)

    def mixed(v: Column, key: int) -> Column:
        return F.call_function("div", (v + key) * F.lit(_FACTOR) % F.lit(_WORD), F.lit(_SHIFT).cast("long"))

    def left(key: int):
        return lambda p: F.struct(((p["l"] + mixed(p["r"], key)) % a).alias("l"), p["r"].alias("r"))

    def right(key: int):
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + mixed(p["l"], key)) % b).alias("r"))

    def step(x: Column) -> Column:
        # Each round is a one-element transform, so that a value is computed once.
        pair = F.array(F.struct(F.call_function("div", x, F.lit(b).cast("long")).alias("l"), (x % b).alias("r")))
        for k, key in enumerate(round_keys(seed)):
            pair = F.transform(pair, left(key) if k % 2 == 0 else right(key))
        return F.element_at(F.transform(pair, lambda p: p["l"] * b + p["r"]), 1)

    x = number.cast("long")
    walk = F.sequence(F.lit(2), F.lit(WALK))
    return F.aggregate(walk, step(x), lambda acc, _: F.when(acc < n, acc).otherwise(step(acc)))


def permuted(df: DataFrame, row: str, columns: Sequence[str], seed: int) -> DataFrame:
    """Shuffle ``columns`` together by the seed's permutation; ``row`` is a unique key, numbered in the order of its hash."""
    ranks = ordering.unique_ranks(df.select(row, key_hash(F.col(row), 0).alias("_h")), row, "_h")
    numbered = cut_lineage(df.join(ranks.select(row, F.col("rank").alias("_rank")), row))
    n = numbered.count()
    source = numbered.select(F.col("_rank").alias("_from"), *columns)
    placed = numbered.drop(*columns).withColumn("_from", permuted_number(F.col("_rank"), n, seed))
    return placed.join(source, "_from").drop("_from", "_rank")


def permutation_importance(
    model: Fitted, test: DataFrame, target: str, blocks: Mapping[str, Sequence[str]], row: str, order: str, repeats: int = 5, seed: int = 1000
) -> DataFrame:
    """Mean and spread over ``repeats`` of the R2 lost when each block of columns is shuffled whole.

    Rows are numbered by ``order`` (a number), ties by ``row`` (a unique key). Each repeat has one permutation, which all blocks share, and one
    join serves all repeats; a joined row is scored once per block.
    """
    ranks = ordering.unique_ranks(test.select(row, F.col(order).alias("_at")), row, "_at").select(row, "rank")
    numbered = cut_lineage(test.join(ranks, row))
    n = numbered.count()
    base = regression_metrics(model.transform(numbered), target, "predicted").select("r2").first()[0]
    every = sorted({c for columns in blocks.values() for c in columns})
    image = F.array(*[F.struct(F.lit(r).alias("repeat"), permuted_number(F.col("rank"), n, seed + r).alias("source")) for r in range(repeats)])
    pairs = numbered.select("*", F.inline(image))
    source = numbered.select(F.col("rank").alias("source"), F.struct(*every).alias("_from"))
    own = [c for c in test.columns if c not in every]
    variants = F.array(*[
        F.struct(F.lit(name).alias("block"), *[(F.col("_from")[c] if c in columns else F.col(c)).alias(c) for c in every]) for name, columns in blocks.items()
    ])
    shuffled = pairs.join(source, "source").select("repeat", *own, F.inline(variants))
    lost = regression_metrics(model.transform(shuffled), target, "predicted", ["block", "repeat"]).withColumn("drop", F.lit(base) - F.col("r2"))
    return lost.groupBy("block").agg(F.avg("drop").alias("r2_drop"), F.stddev_pop("drop").alias("r2_drop_sd"), F.count("*").alias("repeats"))
