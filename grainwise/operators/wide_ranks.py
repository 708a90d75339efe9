"""Rank statistics of many series against one, over rows that are not multiplied by the series.

A series is a function of a row, computed where the rows are read. A rank correlation needs the sum of one rank times the other. The
base's rank goes to the rows by one join; a series' rank is only known in the order of its values, where the base ranks of equal
values are summed already. So a series costs one shuffle of (value, count, sum of base ranks), a few series at a time, freed before
the next ones. Medians come from counts of 16 bits of the values at a time, and no value is moved for them.
"""

from __future__ import annotations

import gc
import math
import sys
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors may not have this package: they get these functions themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The arrays of a batch's columns and the number of a series to its values.
Series = Callable[[Mapping[str, np.ndarray], int], np.ndarray]
# Values that a task puts in order at once, and values that may be shuffled at once.
PIECE_ROWS, PASS_VALUES = 1 << 18, 1 << 26
SUMS = ("n", "over", "base", "local", "local2", "crossed")


def keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of Spark's doubles: zeros are equal, all NaN are one and the largest."""
    v = values + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    key = np.uint64(key)
    bits = key & np.uint64((1 << 63) - 1) if key >> np.uint64(63) else ~key
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _collapsed(key: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the others over equal keys."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(s[order], first) for s in sums)


def _pieces(batches: Iterable[pa.RecordBatch], size: int):
    as_arrays = lambda held: {c: pa.Table.from_batches(held).column(c).to_numpy() for c in held[0].schema.names}
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= size:
            yield as_arrays(held)
            held, n = [], 0
    if n:
        yield as_arrays(held)


def _dealt(series: Series, some: Sequence[int], base: str, edges: np.ndarray):
    """Rows to the distinct values of each (series, bucket), with their counts and sums of base ranks."""

    def deal(batches):
        for t in _pieces(batches, PIECE_ROWS):
            out = {c: [] for c in ("series", "bucket", "key", "cnt", "base")}
            for i in some:
                key, cnt, s = _collapsed(keys(series(t, i)), np.ones(len(t[base]), np.int64), t[base])
                cuts = [0, *np.searchsorted(key, edges, side="right"), len(key)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        for c, x in zip(out, (i, k, key[a:b].tobytes(), cnt[a:b].astype(np.uint32).tobytes(), s[a:b].tobytes())):
                            out[c].append(x)
            yield pa.RecordBatch.from_pydict({c: pa.array(x, ty) for (c, x), ty in zip(out.items(), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

    return deal


def _bucket_sums(limit: int):
    """Sums of one (series, bucket), with ranks counted from its own first value."""

    def sums(key, table):
        cells = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("key", np.uint64), ("cnt", np.uint32), ("base", np.float64)))
        value, cnt, base = _collapsed(*(x.astype(np.int64) if x.dtype == np.uint32 else x for x in cells))
        local = np.cumsum(cnt) - (cnt - 1) / 2
        got = (cnt.sum(), cnt[value > np.uint64(limit)].sum(), base.sum(), (cnt * local).sum(), (cnt * local * local).sum(), (base * local).sum())
        return pa.table({"series": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()), **{c: pa.array([float(x)], pa.float64()) for c, x in zip(SUMS, got)}})

    return sums


def _digits(series: Series, away: str, prefixes: Mapping[int, Sequence[int]], shift: int):
    """Rows to counts of the 16 bits of each value above ``shift``, of the values that begin with a wanted prefix.

    The second half of the numbers stands for the distances of the series from the column ``away``.
    """
    half = len(prefixes) // 2

    def count(batches):
        found = {(i, k): np.zeros(65536, np.int64) for i, some in prefixes.items() for k in range(len(some))}
        for t in _pieces(batches, PIECE_ROWS):
            for j in range(half):
                v = series(t, j)
                for i, x in ((j, v), (half + j, np.abs(v - t[away]))):
                    key = keys(x)
                    for k, prefix in enumerate(prefixes[i]):
                        at = key if shift == 48 else key[(key >> np.uint64(shift + 16)) == np.uint64(prefix)]
                        found[i, k] += np.bincount(((at >> np.uint64(shift)) & np.uint64(65535)).astype(np.int64), minlength=65536)
        for (i, k), c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"series": pa.array([i], pa.int32()), "prefix": pa.array([k], pa.int32()), "digit": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "cnt": pa.array([c[at].tobytes()], pa.binary())})

    return count


def _picked(wanted: Mapping[tuple[int, int], Sequence[int]]):
    """The digit that holds each wanted rank, and how many values of the prefix lie before it."""

    def pick(key, table):
        i, k = (x.as_py() for x in key)
        total = np.zeros(65536, np.int64)
        for d, c in zip(table.column("digit").to_pylist(), table.column("cnt").to_pylist()):
            total[np.frombuffer(d, np.uint16)] += np.frombuffer(c, np.int64)
        upto = np.cumsum(total)
        ranks = list(wanted[i, k])
        digit = np.searchsorted(upto, ranks, side="right")
        return pa.table({"series": pa.array([i] * len(ranks), pa.int32()), "prefix": pa.array([k] * len(ranks), pa.int32()), "rank": pa.array(ranks, pa.int64()), "digit": pa.array(digit, pa.int32()), "below": pa.array(upto[digit] - total[digit], pa.int64())})

    return pick


def free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished frames once the driver's JVM has collected those frames."""
    gc.collect()
    spark._jvm.System.gc()


def medians(rows: DataFrame, series: Series, count: int, away: str, n: int) -> list[float]:
    """Exact medians of each series, then of its distance from the column ``away``, over the ``n`` rows without NULL.

    These are the values of the two middle ranks, found 16 bits at a time.
    """
    every = range(2 * count)
    middle = sorted({(n - 1) // 2, n // 2})
    # (series, rank) -> prefix found so far, and the rank among the values with it.
    state = {(i, r): (0, r) for i in every for r in middle}
    for shift in (48, 32, 16, 0):
        prefixes = {i: sorted({state[i, r][0] for r in middle}) for i in every}
        wanted: dict[tuple[int, int], list[int]] = {}
        for (i, _), (prefix, rank) in state.items():
            some = wanted.setdefault((i, prefixes[i].index(prefix)), [])
            some += [rank] if rank not in some else []
        counts = rows.mapInArrow(_digits(series, away, prefixes, shift), "series int, prefix int, digit binary, cnt binary")
        found = counts.groupBy("series", "prefix").applyInArrow(_picked(wanted), "series int, prefix int, rank long, digit int, below long").collect()
        at = {(r["series"], r["prefix"], r["rank"]): (r["digit"], r["below"]) for r in found}
        for (i, r), (prefix, rank) in state.items():
            digit, below = at[i, prefixes[i].index(prefix), rank]
            state[i, r] = (prefix << 16 | digit, rank - below)
    out = []
    for i in every:
        low, high = value_of(state[i, middle[0]][0]), value_of(state[i, middle[-1]][0])
        out.append(low + (high - low) * ((n - 1) / 2 - (n - 1) // 2) if low != high else low)
    return out


def rank_sums(rows: DataFrame, series: Series, count: int, base: str, n: int, edges: Sequence[float], limit: float) -> list[tuple[int, float, float]]:
    """Per series, over the ``n`` rows: values over ``limit``, the sum of squares of its centred ranks, and of their products with ``base``."""
    spark, out = rows.sparkSession, []
    cuts, top = keys(np.array(edges, np.float64)), int(keys(np.array([limit], np.float64))[0])
    width = max(1, PASS_VALUES // max(n, 1))
    for a in range(0, count, width):
        some = list(range(a, min(a + width, count)))
        dealt = rows.mapInArrow(_dealt(series, some, base, cuts), "series int, bucket int, key binary, cnt binary, base binary")
        schema = "series int, bucket int, " + ", ".join(f"{c} double" for c in SUMS)
        found = dealt.groupBy("series", "bucket").applyInArrow(_bucket_sums(top), schema).collect()
        del dealt
        free_shuffles(spark)
        for i in some:
            over, below, squares, crossed = 0.0, 0, [], []
            for r in sorted((r for r in found if r["series"] == i), key=lambda r: r["bucket"]):
                shift = below - (n + 1) / 2
                squares.append(r["local2"] + 2 * shift * r["local"] + shift * shift * r["n"])
                crossed.append(r["crossed"] + shift * r["base"])
                over, below = over + r["over"], below + int(r["n"])
            out.append((int(over), math.fsum(squares), math.fsum(crossed)))
    return out
