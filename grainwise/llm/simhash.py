"""SimHash near-duplicates over a Gray-order hierarchical index (operator 3).

1. Fingerprints: words are lower-cased (A-Z), 3-word shingles hashed by XXH64 (seed 42); a bit is 1 if more than half of
   the hashes have it.
2. Distinct fingerprints are dealt by blocks: two that differ in at most ``k`` of 64 bits agree on one of ``k + 1``
   blocks, so each is sent to ``k + 1`` (block, value) groups. Groups above ``hot_group`` members are dealt again by
   blocks of the remaining bits, level by level, until they fit or bits run out.
3. Inside a group fingerprints are sorted by Gray rank; runs of neighbours form nodes, runs of nodes form upper nodes. A
   node stores the bits that all its members share (mask, pattern). Node pairs whose masked patterns differ in more
   than ``k`` bits are dropped as a whole; pairs of nodes inside one component are dropped as well, since only
   connectivity is asked for. A group emits a spanning forest, never all its pairs.
4. Components: minimum labels over the links with pointer jumping; tables, not driver memory, hold them.

Defined cases: null or blank text has fingerprint 0 and is linked like any other; repeated rows share their fingerprint
and so their component; null doc_id never becomes a component id unless all of a component are null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import free_name, map_arrow
from grainwise.session import scratch_path

BITS = 64
#: Hashes turned into bits at once.
BIT_ROWS = 200_000
#: Children of a node.
FANOUT = 8
#: Node pairs looked at together.
PAIR_ROWS = 1 << 20


def fingerprints_of(text: pa.Array, shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    data, offsets = tb.flat(text)
    n = len(offsets) - 1
    data = tb.LOWER[data]
    starts, ends, owner = tb.words(data, offsets)
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    keep = ~tb.IS_SPACE[data]
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)  # of each word once single blanks separate them
    joined = np.full(int(at[-1] + size[-1]), 32, np.uint8)
    solid = np.flatnonzero(keep)
    joined[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(len(solid))] = data[solid]
    count = tb.per_text(owner, n)
    first = np.cumsum(count) - count
    m = np.maximum(count - shingle + 1, np.minimum(count, 1))  # shingles per text
    which = np.repeat(np.arange(n), m)
    head = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(len(which))
    tail = np.minimum(head + shingle, np.repeat(first + count, m)) - 1
    a, b = at[head], at[tail] + size[tail]
    raw = joined.tobytes()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((n, BITS), np.int64)
    for lo in range(0, len(which), BIT_ROWS):
        hi = min(lo + BIT_ROWS, len(which))
        h = np.array([digest(raw[s:e], 42) for s, e in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)], np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = which[lo:hi]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ones[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    major = (2 * ones > m[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").reshape(n).astype(np.uint64)


def fingerprints(docs: DataFrame, columns: list[str], name: str = "fp", shingle: int = 3) -> DataFrame:
    """``columns`` of every row plus its fingerprint as a signed long."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(name, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            fp = fingerprints_of(part.column(held), shingle)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(fp.view(np.int64))], schema=arrow)

    return map_arrow(narrow, run, schema)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def roots(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum labels after joining the components of ``a`` and ``b``."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (nxt := labels[labels] != labels).any():
            labels = np.where(nxt, labels[labels], labels)


def index_links(group: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each group; ``group`` and Gray rank order the rows already."""
    n = len(codes)
    labels = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal labels
        x, y = labels[a], labels[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        _, one = np.unique(lo * n + hi, return_index=True)
        one = one[lo[one] != hi[one]]
        if len(one):
            found.append((a[one], b[one]))
            labels = roots(labels, a[one], b[one])

    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(codes[1:] ^ codes[:-1]) <= k))
    link(near, near + 1)

    # Levels of nodes, leaves first: (first row, group, mask, pattern); nodes never cross groups.
    levels = [(np.arange(n), group, np.full(n, ~np.uint64(0)), codes)]
    while True:
        first, g, mask, pattern = levels[-1]
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        place = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
        cut = np.flatnonzero(place % FANOUT == 0)
        if len(cut) == len(g):
            break
        ones = np.bitwise_and.reduceat(pattern, cut)
        some = np.bitwise_or.reduceat(pattern, cut)
        shared = np.bitwise_and.reduceat(mask, cut) & ~(ones ^ some)
        levels.append((first[cut], g[cut], shared, ones & shared))

    def span(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label below each node."""
        first = levels[level][0]
        return np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)

    def descend(level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Look at pairs of nodes (a <= b) of one level; a pair of a node with itself stands for the pairs inside."""
        for lo in range(0, len(a), PAIR_ROWS):
            x, y = a[lo : lo + PAIR_ROWS], b[lo : lo + PAIR_ROWS]
            _, _, mask, pattern = levels[level]
            far = np.bitwise_count((pattern[x] ^ pattern[y]) & mask[x] & mask[y])
            low, high = span(level)
            joined = (low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y])
            keep = (far <= k) & ~joined
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if level == 0:
                link(x[x != y], y[x != y])
                continue
            starts = np.searchsorted(levels[level - 1][0], levels[level][0])
            sizes = np.diff(np.append(starts, len(levels[level - 1][0])))
            each = sizes[x] * sizes[y]
            for cut in _cuts(each):
                p, q, e = x[cut], y[cut], each[cut]
                within = np.arange(int(e.sum())) - np.repeat(np.cumsum(e) - e, e)
                width = np.repeat(sizes[q], e)
                i, j = np.repeat(starts[p], e) + within // width, np.repeat(starts[q], e) + within % width
                once = i <= j
                descend(level - 1, i[once], j[once])

    top = len(levels) - 1
    every = np.arange(len(levels[top][0]))
    descend(top, every, every)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _cuts(each: np.ndarray) -> Iterator[slice]:
    ends = np.cumsum(each)
    start = 0
    while start < len(each):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIR_ROWS, "right")))
        yield slice(start, stop)
        start = stop


def _blocks(bits: list[int], k: int) -> list[list[int]]:
    size, extra = divmod(len(bits), k + 1)
    out, at = [], 0
    for i in range(k + 1):
        step = size + (i < extra)
        out.append(bits[at : at + step])
        at += step
    return [b for b in out if b]


def _dealt(rows: DataFrame, path: tuple[int, ...], bits: list[int], k: int) -> tuple[DataFrame, list[tuple[tuple[int, ...], list[int]]]]:
    """Rows (fp, grp) with one copy per block of ``bits``; grp = the former grp, the block and its value."""
    blocks = _blocks(bits, k)
    masks = [sum(1 << b for b in block) for block in blocks]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = [F.concat_ws(":", "grp", F.lit(str(i)), F.hex(F.col("fp").bitwiseAND(F.lit(m)))) for i, m in enumerate(signed)]
    return rows.select("fp", F.explode(F.array(*keys)).alias("grp")), [((*path, i), [b for b in bits if b not in set(block)]) for i, block in enumerate(blocks)]


def links(distinct: DataFrame, k: int = 3, hot_group: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a spanning forest of every index group."""
    spark = distinct.sparkSession
    out = None
    todo: list[tuple[DataFrame, list[int]]] = [(distinct.select("fp", F.lit("").alias("grp")), list(range(BITS)))]
    while todo:
        rows, bits = todo.pop()
        dealt, below = _dealt(rows, (), bits, k)
        path = scratch_path(spark, "simhash-groups")
        dealt.write.parquet(path)
        dealt = spark.read.parquet(path)
        hot = dealt.groupBy("grp").count().filter(F.col("count") > hot_group).select("grp")
        some_hot = not hot.isEmpty()
        fit = dealt
        if some_hot:
            hot_path = scratch_path(spark, "simhash-hot")
            hot.write.parquet(hot_path)
            hot = spark.read.parquet(hot_path)
            fit = dealt.join(hot, "grp", "left_anti")
            for i, (_, rest) in enumerate(below):
                mine = dealt.join(hot, "grp", "left_semi").filter(F.element_at(F.split("grp", ":"), -2) == str(i))
                if len(rest) > k:
                    todo.append((mine.select("fp", "grp"), rest))
                else:
                    fit = fit.unionByName(mine.select(*fit.columns))
        ordered = fit.repartition("grp").sortWithinPartitions("grp")
        part = map_arrow(ordered, _link_partition(k), "a long, b long")
        out = part if out is None else out.unionByName(part)
    return out


def _link_partition(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[str]]] = []
        rows = 0

        def flush(parts: list[tuple[np.ndarray, list[str]]]) -> pa.RecordBatch:
            codes = np.concatenate([c for c, _ in parts])
            names = np.array([g for _, gs in parts for g in gs], dtype=object)
            group = np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]).astype(np.int64))
            order = np.lexsort((gray_rank(codes), group))
            codes, group = codes[order], group[order]
            a, b = index_links(group, codes, k)
            return pa.RecordBatch.from_arrays([pa.array(codes[a].view(np.int64)), pa.array(codes[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            held.append((codes, batch.column("grp").to_pylist()))
            rows += len(codes)
            if rows >= 100_000:  # work on the whole groups so far, keep the one that may go on
                codes = np.concatenate([c for c, _ in held])
                names = [g for _, gs in held for g in gs]
                cut = len(names) - 1
                while cut and names[cut - 1] == names[-1]:
                    cut -= 1
                if cut:
                    yield flush([(codes[:cut], names[:cut])])
                held, rows = [(codes[cut:], names[cut:])], len(names) - cut
        if rows:
            yield flush(held)

    return run


def components(edges: DataFrame, max_doublings: int | None = None) -> DataFrame:
    """(fp, root) for every fingerprint that has a link; root is the smallest unsigned code reachable.

    Large-star and small-star steps over links written to the shared folder; each round at least halves the depth of
    the trees, so rounds grow with the logarithm of the longest path. Stops when a round changes nothing.
    """
    spark = edges.sparkSession
    flip = -(1 << 63)  # orders signed longs as unsigned codes

    def stored(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "simhash-links")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def star(df: DataFrame, large: bool) -> DataFrame:
        """u > v in every row. Large star: link each larger neighbour to the smallest; small star: each smaller one and oneself."""
        both = df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else df
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()

    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(flip))
    now = edges.select(F.greatest(unsigned("a"), unsigned("b")).alias("u"), F.least(unsigned("a"), unsigned("b")).alias("v")).filter("u <> v").distinct()
    now = stored(now)
    before = None
    while True:
        now = stored(star(star(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(unsigned("u").alias("fp"), unsigned("v").alias("root")).distinct()


def near_duplicates(prints: DataFrame, k: int = 3, hot_group: int = 20_000) -> DataFrame:
    """(fp, component_id): for every distinct fingerprint of ``prints`` (doc_id, fp), the smallest doc_id reachable."""
    spark = prints.sparkSession
    path = scratch_path(spark, "simhash-distinct")
    prints.groupBy("fp").agg(F.min("doc_id").alias("least")).write.parquet(path)
    distinct = spark.read.parquet(path)
    roots_of = components(links(distinct.select("fp"), k, hot_group))
    rooted = distinct.join(roots_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "component_id")


def grouped(docs: DataFrame, k: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash-prints")
    fingerprints(docs, ["doc_id"], shingle=shingle).write.parquet(path)
    prints = spark.read.parquet(path)
    return prints.join(near_duplicates(prints, k), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, k: int = 3, shingle: int = 3) -> DataFrame:
    """One row of each group: that with the smallest doc_id, of equal ones any; columns as in ``docs``."""
    spark = docs.sparkSession
    mark = "__near_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    path = scratch_path(spark, "simhash-rows")
    uid, fp = mark + "row", mark + "fp"
    fingerprints(docs.withColumn(uid, F.monotonically_increasing_id()), [*docs.columns, uid], fp).write.parquet(path)
    rows = spark.read.parquet(path)
    prints = rows.select("doc_id", F.col(uid).alias("row"), F.col(fp).alias("fp"))
    group = near_duplicates(prints.select("doc_id", "fp"), k).withColumnRenamed("component_id", "component")
    # One candidate per fingerprint first, so that large groups of copies meet as one row per task.
    best = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"))
    kept = best.join(group, "fp").groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("lone")).agg(F.min("best").alias("best"))
    return rows.join(kept.select(F.col("best.row").alias(uid)), uid, "left_semi").select(*docs.columns)
