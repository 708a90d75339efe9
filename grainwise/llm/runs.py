"""Periodic runs of words: Lyndon roots extended by suffix-tree common extensions (operator 11).

A run is a stretch of words with smallest period q, at least ``max(least, exponent * q)`` long, that no neighbouring word
extends with this period. Every run has a root that is the longest Lyndon word at its position, under the order of the
words or the reversed one; so for each position and both orders the distance to the next smaller suffix is a candidate
period, and the run is what the common extensions of the two positions to the left (tree of the reversal) and to the
right (tree of the document) give.

Trees are built where runs can be. In a run all word triples but those of its first q words occurred q words before, so a
stretch of at least ``exponent * q - q - 2`` triples that occurred so shortly before is needed; pieces are such stretches
with the words a run could have before and after, plus one. This leaves out no run, whatever the text.

Defined cases: null and blank texts have no words and no runs; repeated rows are examined each; further columns may have
any names. A text is worked on as a whole: about 60 bytes a byte of text in the worker, and about 900 bytes a word of its
largest piece for the trees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import free_name, map_arrow
from grainwise.llm.suffix_trees import SuffixTree

#: Least length of a run, in words, and least length in periods.
LEAST, EXPONENT = 6, 4
SPACES = r"[\x20\x09-\x0D]+"

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the start of the next smaller one: the end of the longest Lyndon word there."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out)


def runs_in(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, length, period) rows of all runs of a sequence of numbers."""
    n = len(words)
    symbols = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for rank in (forward.rank, forward.reversed_rank()):
        i = np.arange(n)
        j = np.minimum(_next_smaller(rank.tolist())[:n], n)
        i, j = i[(j - i) * exponent <= n], j[(j - i) * exponent <= n]
        if not len(i):
            continue
        left = np.where(i > 0, backward.common(n - np.maximum(i, 1), n - j), 0)
        start, end, period = i - left, j + forward.common(i, j), j - i
        keep = end - start >= np.maximum(least, exponent * period)
        found.append(np.stack([start, end - start, period], axis=1)[keep])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _pieces(ids: np.ndarray, owner: np.ndarray, exponent: int) -> list[tuple[int, int]]:
    """Word ranges outside of which no run has a word; ranges don't cross texts and don't overlap."""
    n = len(ids)
    if n < 3:
        return []
    base = int(ids.max()) + 1
    pair = ids[:-1] * base + ids[1:]
    if base >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * base + ids[2:]
    order = np.argsort(triple, kind="stable")
    a, b = order[:-1], order[1:]
    again = (triple[a] == triple[b]) & (owner[a] == owner[b])
    gap = np.full(n, n, np.int64)
    gap[b[again]] = (b - a)[again]
    gap[np.flatnonzero(owner[:-2] != owner[2:])] = n
    marked = gap < n
    part = exponent - 1
    while True:
        starts, ends, _ = tb.segments(marked, _offsets(owner))
        size = ends - starts
        # A run of period q marks at least part * q - 2 words, so q is at most this.
        most = np.where(size >= max(1, part - 2), (size + 2) // part, 0)
        kept = np.zeros(n, bool)
        where = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        kept[where] = gap[where] <= np.repeat(most, size)
        if (kept == marked).all():
            break
        marked = kept
    out: list[tuple[int, int]] = []
    edges = _offsets(owner)
    text = np.searchsorted(edges, starts, "right") - 1
    low, high = np.maximum(starts - most - 1, edges[text]), np.minimum(ends + 3, edges[text + 1])
    for lo, hi in zip(low.tolist(), high.tolist(), strict=True):
        # A piece may start inside the one before, never before it where that text ended.
        while out and lo < out[-1][1]:
            p = out.pop()
            lo, hi = min(lo, p[0]), max(hi, p[1])
        out.append((lo, hi))
    return out


def _offsets(owner: np.ndarray) -> np.ndarray:
    """Where the words of each text that has any begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), [len(owner)]])


def found_in(text: pa.Array, least: int = LEAST, exponent: int = EXPONENT) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text, by start and period, and its words without later repetitions, joined by blanks."""
    data, offsets = tb.flat(text)
    n = len(offsets) - 1
    starts, ends, owner = tb.words(data, offsets)
    if not len(starts):
        return [np.zeros((0, 3), np.int64)] * n, [b""] * n
    ids, _ = tb.numbered(data, starts, ends)
    count = tb.per_text(owner, n)
    first = np.cumsum(count) - count
    runs: list[list[np.ndarray]] = [[] for _ in range(n)]
    change = np.zeros(len(ids) + 1, np.int64)
    for lo, hi in _pieces(ids, owner, exponent):
        got = runs_in(ids[lo:hi], least, exponent)
        if len(got):
            np.add.at(change, lo + got[:, 0] + got[:, 2], 1)
            np.add.at(change, lo + got[:, 0] + got[:, 1], -1)
            got[:, 0] += lo - first[owner[lo]]
            runs[owner[lo]].append(got)
    kept = np.cumsum(change)[:-1] == 0
    starts, ends, left = starts[kept], ends[kept], tb.per_text(owner[kept], n)
    # All kept words of the slice, single blanks between them.
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(at[-1] + size[-1]) + 1, 32, np.uint8)
    into = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
    joined[into] = data[np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    raw = joined.tobytes()
    cut = np.concatenate([[0], np.cumsum(left)])
    at = np.concatenate([at, [len(raw)]])
    whole = [raw[at[a] : at[b] - 1] if b > a else b"" for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    none = np.zeros((0, 3), np.int64)
    ordered = [r[np.lexsort((r[:, 2], r[:, 0]))] for r in (np.concatenate(x) if x else none for x in runs)]
    return ordered, whole


def detected(docs: DataFrame, columns: list[str], text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``columns`` of every row, its ``runs`` (start, length, period; by start, then period) and the ``collapsed`` text.

    A word is collapsed away if a run holds it after that run's first period.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col(text).cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            runs, texts = found_in(part.column(held), least, exponent)
            flat = np.concatenate(runs)
            fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, [f.name for f in RUN]))
            out = pa.RecordBatch.from_arrays([*part.columns[: len(columns)], listed, pa.array(texts, pa.binary()).cast(pa.string())], names=arrow.names)
            yield out.cast(arrow)

    return map_arrow(narrow, run, schema)


def planted(text: Column, key: Column) -> Column:
    """``text`` with a periodic tail where ten divides the CRC-32 of the decimal key (null: the empty text)."""
    h = F.crc32(F.coalesce(key.cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        later = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda i: F.element_at(words, (a + 1 + F.pmod(i, p)).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), later), " ")

    # One element, so that the words are split once.
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit(""))), 1)
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)
