"""Removal of repeated byte strings by a suffix order (operator 12).

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a row with a smaller key, or earlier in
the same row. Strings lie inside one text; what is a repeat is judged on the input.

1. Anchors. Of the 32-byte pieces inside a string of ``length`` bytes the one with the least hash (the first, of equal ones)
   is its anchor. Equal strings have equal anchors, so strings that start in a row one after the other with the same anchor
   travel as one context: the bytes from the first start to the last end.
2. Contexts are sorted by anchor and digest. All but one of equal contexts are repeats as a whole; a context whose anchor
   has no other context holds no repeat; what remains is open. A task's slice is settled in the same way before it is sent.
3. Open contexts get their bytes, meet by anchor, and the suffixes of each bounded slice of anchors are ordered by a
   difference cover: sampled triples sorted and named, names ordered by recursion, the other suffixes merged
   (:mod:`suffix_order`). Neighbours that agree in ``length`` bytes are repeats of the one that starts first.
4. Anchors with more than ``hot_contexts`` open contexts don't go to one task: their strings are grouped by digest with
   partial aggregation, and all but the least of a group are repeats: a context is split at those.

Anchors that many rows share are dealt with a salt. Where an equal context may lie in another task or batch, the context
stays open, so that dealing changes no result. Digests of contexts are keyed BLAKE2b values of 64 bits beside the
64-bit anchor, those of strings have 128 bits.

Defined cases: null text counts as empty; a null key is smallest; rows of equal key count in the order in which they are
read (of repeated rows one keeps its text); texts shorter than ``length`` stay; an empty table gives no rows; further
columns may have any names. A text of any length is scanned in blocks; beside a block the worker holds the text twice.
``docs`` is read several times: it should be a stored table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import map_arrow
from grainwise.llm.suffix_order import repeats
from grainwise.session import scratch_path

GRAM = 32
#: String starts looked at together.
BLOCK = 1 << 18
#: Bytes of open contexts whose suffixes are ordered together; one anchor may need more, up to ``hot_contexts`` of them.
ORDER_BYTES = 1 << 19
#: One row in so many is looked at for anchors that many rows share; this only balances the work.
SAMPLE = 64
SALTS = 32

_KEY = b"grainwise"
LONG = T.LongType()


def _mixed_pairs(h: np.ndarray, step: int) -> np.ndarray:
    return tb.mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:])


def _anchors(block: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``length`` bytes in ``block`` the position of its anchor; and the hash of each piece."""
    h = tb.mix(block.astype(np.uint64) + np.uint64(7))
    step = 1
    while step < GRAM:
        h = _mixed_pairs(h, step)
        step *= 2
    width = length - GRAM + 1
    low = np.uint64((1 << 20) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return (least & low).astype(np.int64), h


def contexts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, anchor) of each context; starts and ends are positions in ``data``."""
    out = []
    long = np.flatnonzero(np.diff(offsets) >= length)
    first, stop = offsets[:-1][long], offsets[1:][long] - length + 1  # where strings start
    lo = int(first[0]) if len(long) else 0
    while len(long) and lo < stop[-1]:
        hi = min(lo + BLOCK, int(stop[-1]))
        place, h = _anchors(data[lo : hi + length - 1], length)
        a, b = np.searchsorted(stop, lo, "right"), np.searchsorted(first, hi, "left")
        change = np.zeros(hi - lo + 1, np.int64)
        np.add.at(change, np.maximum(first[a:b], lo) - lo, 1)
        np.add.at(change, np.minimum(stop[a:b], hi) - lo, -1)
        valid = np.cumsum(change)[:-1] > 0
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        starts = np.flatnonzero(head)
        tail = valid.copy()
        tail[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
        ends = np.flatnonzero(tail) + length
        out.append((starts + lo, ends + lo, h[place[starts]].view(np.int64)))
        lo = hi
    if not out:
        return (np.zeros(0, np.int64),) * 4
    starts, ends, anchor = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, anchor


def _digests(raw: bytes | memoryview, starts: np.ndarray, ends: np.ndarray, size: int = 8) -> bytes:
    return b"".join([hashlib.blake2b(raw[s:e], digest_size=size, key=_KEY).digest() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])


def merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the spans of each row, as spans that don't touch, in order."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    fresh = np.concatenate([[True], row[1:] != row[:-1]])
    lift = (np.cumsum(fresh) - 1) * (int(hi.max()) + 1)  # rows apart, so that one running maximum serves all
    reach = np.maximum.accumulate(hi + lift)
    head = fresh.copy()
    head[1:] |= lo[1:] + lift[1:] > reach[:-1]
    last = np.concatenate([np.flatnonzero(head)[1:] - 1, [len(row) - 1]])
    return row[head], lo[head], reach[last] - lift[last]


def _order_of(key: pa.Array, *more: np.ndarray) -> np.ndarray:
    """The place of each entry in the order of the key and what follows it."""
    table = pa.table({"key": key, **{str(k): x for k, x in enumerate(more)}})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _numbered_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _anchored(rows: DataFrame, length: int, shared: frozenset[int]) -> DataFrame:
    """anchor, digest, salt, key, row, start, end, open: contexts to be compared, and (not open) spans settled in a slice."""
    schema = T.StructType([T.StructField("anchor", LONG), T.StructField("digest", LONG), T.StructField("salt", T.IntegerType()), T.StructField("key", rows.schema["key"].dataType), *(T.StructField(c, LONG) for c in ("row", "start", "end")), T.StructField("open", T.BooleanType())])
    arrow = _arrow(schema)
    common = np.array(sorted(shared), np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            data, offsets = tb.flat(part.column("text"))
            text, start, end, anchor = contexts(data, offsets, length)
            if not len(text):
                continue
            digest = np.frombuffer(_digests(memoryview(data), start, end), np.int64)
            ids = part.column("row").to_numpy()
            place = _order_of(part.column("key"), ids)[text]
            order = np.lexsort((start, place, digest, anchor))
            again = np.zeros(len(order), bool)
            a, d = anchor[order], digest[order]
            again[order[1:]] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
            new = np.flatnonzero(~again)
            settled = merged(text[again], start[again], end[again])
            row = ids[text[new]]
            salt = np.where(np.isin(anchor[new], common), tb.mix(row.astype(np.uint64)) % np.uint64(SALTS), -1).astype(np.int64)
            done = ids[settled[0]]
            columns = [
                np.concatenate([anchor[new], tb.mix(done.astype(np.uint64)).view(np.int64)]),
                np.concatenate([digest[new], np.zeros(len(done), np.int64)]),
                np.concatenate([salt, np.full(len(done), -2)]).astype(np.int32),
                part.column("key").take(pa.array(np.concatenate([text[new], settled[0]]))),
                np.concatenate([row, done]),
                np.concatenate([start[new] - offsets[text[new]], settled[1] - offsets[settled[0]]]),
                np.concatenate([end[new] - offsets[text[new]], settled[2] - offsets[settled[0]]]),
                np.concatenate([np.ones(len(new), bool), np.zeros(len(done), bool)]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=arrow.names).cast(arrow)

    return map_arrow(rows, run, schema)


def _settled(found: DataFrame) -> DataFrame:
    """row, start, end and anchor: spans that are repeats (anchor null) and contexts that stay open."""
    schema = T.StructType([T.StructField(c, LONG) for c in ("row", "start", "end", "anchor")])
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            anchor, digest, salt, row, start, end = (part.column(c).to_numpy() for c in ("anchor", "digest", "salt", "row", "start", "end"))
            if not len(anchor):
                continue
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(fresh) - 1
            new = fresh.copy()  # first of its digest in this batch
            new[1:] |= digest[1:] != digest[:-1]
            # Open: other contexts in the group; or the group may go on in another batch or, where salted, another task.
            several = np.bincount(group, weights=new) > 1
            several[[0, -1]] = True
            stays = new & (several[group] | (salt >= 0)) & (salt != -2)
            gone = ~new | (salt == -2)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([c[gone], c[stays]])) for c in (row, start, end)), pa.array(np.concatenate([anchor[gone], anchor[stays]]), mask=np.arange(gone.sum() + stays.sum()) < gone.sum())],
                schema=arrow,
            )

    order = ["anchor", "salt", "digest", "key", "row", "start"]
    return map_arrow(found.repartition("anchor", "salt").sortWithinPartitions(*order), run, schema)


def _cut(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The open contexts with their bytes; those of hot anchors string by string, with a digest instead of an anchor."""
    schema = T.StructType([T.StructField("anchor", LONG), T.StructField("name", T.BinaryType()), T.StructField("key", rows.schema["key"].dataType), T.StructField("row", LONG), T.StructField("start", LONG), T.StructField("context", LONG), T.StructField("bytes", T.BinaryType())])
    arrow = _arrow(schema)
    per_row = places.groupBy("row").agg(F.collect_list(F.struct("anchor", "start", "end", "hot")).alias("places"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            listed = part.column("places")
            which = pc.list_parent_indices(listed).to_numpy()
            anchor, start, end, hot = (x.to_numpy(zero_copy_only=False) for x in listed.flatten().flatten())
            data, offsets = tb.flat(part.column("text"))
            raw, ids = memoryview(data), part.column("row").to_numpy()
            base = offsets[which]
            cold = np.flatnonzero(~hot)
            pieces = [bytes(raw[s:e]) for s, e in zip((base + start)[cold].tolist(), (base + end)[cold].tolist(), strict=True)]
            key = part.column("key")
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[cold]), pa.nulls(len(cold), pa.binary()), key.take(pa.array(which[cold])), pa.array(ids[which[cold]]), pa.array(start[cold]), pa.array(start[cold]), pa.array(pieces, pa.binary())], names=arrow.names
            ).cast(arrow)
            warm = np.flatnonzero(hot)
            for some in np.array_split(warm, len(warm) // 4096 + 1):
                count = (end - start)[some] - length + 1
                of = np.repeat(some, count)
                at = start[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                names = np.frombuffer(_digests(raw, base[of] + at, base[of] + at + length, 16), "S16") if len(of) else []
                digests = pa.array([bytes(x).ljust(16, b"\0") for x in names], pa.binary())
                none = pa.nulls(len(of))
                yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), digests, key.take(pa.array(which[of])), pa.array(ids[which[of]]), pa.array(at), pa.array(start[of]), none.cast(pa.binary())], names=arrow.names).cast(arrow)

    return map_arrow(rows.join(per_row, "row"), run, schema)


def _ordered(open_: DataFrame, length: int) -> DataFrame:
    """row, start, end of the repeats among open contexts, by the order of their suffixes."""
    schema = T.StructType([T.StructField(c, LONG) for c in ("row", "start", "end")])
    arrow = _arrow(schema)

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        data, offsets = tb.flat(table.column("bytes"))
        row, begin = table.column("row").to_numpy(), table.column("start").to_numpy()
        n = len(offsets) - 1
        context = np.repeat(np.arange(n), np.diff(offsets))
        inside = np.arange(len(data)) - offsets[context]
        at = np.flatnonzero(inside + length <= np.diff(offsets)[context])
        name = repeats(data, at, length)
        of = context[at]
        place = _order_of(table.column("key").combine_chunks(), row, begin)[of]
        start = begin[of] + inside[at]
        order = np.lexsort((start, place, name))
        later = order[1:][name[order[1:]] == name[order[:-1]]]
        spans = merged(row[of[later]], start[later], start[later] + length)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in spans], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in batches:
            held.append(part)
            size += part.column("bytes").nbytes
            if size < ORDER_BYTES:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
            lo = 0
            while lo < cut:
                bytes_ = np.cumsum(pc.binary_length(table.column("bytes").slice(lo, cut - lo)).to_numpy())
                stop = lo + int(np.searchsorted(bytes_, ORDER_BYTES, "right"))
                if stop < cut:
                    stop = int(np.searchsorted(anchor, anchor[stop], "left"))
                    if stop <= lo:
                        stop = int(np.searchsorted(anchor, anchor[lo], "right"))
                yield settle(table.slice(lo, stop - lo))
                lo = stop
            held = table.slice(cut).to_batches()
            size = sum(b.column("bytes").nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return map_arrow(open_.repartition("anchor").sortWithinPartitions("anchor"), run, schema)


def repeated_spans(rows: DataFrame, length: int = 100, hot_contexts: int = 2000) -> DataFrame:
    """row, start, end: bytes covered by a string of ``length`` bytes that also starts earlier; spans may overlap."""
    if length < 2 * GRAM:
        raise ValueError(f"strings need {2 * GRAM} bytes or more")
    spark = rows.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"suffix-{label}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    counts = _anchored(some, length, frozenset()).filter("open").groupBy("anchor").count().filter(f"count >= {max(8, hot_contexts // SAMPLE)}")
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = frozenset(r["anchor"] for r in counts.orderBy(F.desc("count"), "anchor").limit(parts).collect())
    found = stored(_settled(_anchored(rows, length, shared)), "contexts")
    open_ = found.filter("anchor is not null")
    hot = stored(open_.groupBy("anchor").count().filter(f"count > {hot_contexts}").select("anchor", F.lit(True).alias("hot")), "hot")
    places = open_.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = stored(_cut(rows, places, length), "open")
    ordered = _ordered(cut.filter("anchor is not null"), length)
    # Of the strings of hot anchors only the first of each digest starts no repeat; a context is split at these.
    strings = cut.filter("anchor is null")
    least = strings.groupBy("name").agg(F.min(F.struct("key", "row", "start", "context")).alias("least"))
    firsts = least.groupBy(F.col("least.row").alias("row"), F.col("least.context").alias("start")).agg(F.collect_list("least.start").alias("firsts"))
    split = places.filter("hot").join(firsts, ["row", "start"], "left")
    bounds = F.concat(F.array(F.col("start") - 1), F.sort_array(F.coalesce("firsts", F.array().cast("array<long>"))), F.array(F.col("end") - length + 1))
    gaps = F.transform(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.struct((F.element_at("bounds", k) + 1).alias("start"), (F.element_at("bounds", k + 1) + (length - 1)).alias("end")))
    later = split.select("row", bounds.alias("bounds")).select("row", F.inline(F.filter(gaps, lambda g: g["end"] - g["start"] >= length)))
    return found.filter("anchor is null").select("row", "start", "end").unionByName(ordered).unionByName(later)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, hot_contexts: int = 2000, with_text: bool = False) -> DataFrame:
    """``key`` of every row, n_bytes, n_removed, n_spans, kept_sha256, the removed ``spans`` (byte offsets), and the kept text if asked for.

    What is kept of a text need not be valid UTF-8: it is binary.
    """
    rows = _numbered_rows(docs, key, text)
    spans = repeated_spans(rows, length, hot_contexts).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, "row", "left").select("key", "text", F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
    pair = T.StructType([T.StructField("start", LONG), T.StructField("end", LONG)])
    fields = [T.StructField(key, rows.schema["key"].dataType), *(T.StructField(c, LONG) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(pair))]
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if with_text else []))
    arrow = _arrow(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            listed = part.column("spans")
            n = len(listed)
            data, offsets = tb.flat(part.column("text"))
            lo, hi = (x.to_numpy() for x in listed.flatten().flatten())
            row, lo, hi = merged(pc.list_parent_indices(listed).to_numpy(), lo, hi)
            per = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]) if len(row) else np.zeros(n + 1, np.int64)
            raw, digests, kept = memoryview(data), [], []
            for i in range(n):
                h, at, pieces = hashlib.sha256(), int(offsets[i]), []
                for s, e in [*zip(lo[per[i] : per[i + 1]].tolist(), hi[per[i] : per[i + 1]].tolist(), strict=True), (None, None)]:
                    piece = raw[at : int(offsets[i + 1]) if s is None else int(offsets[i]) + s]
                    h.update(piece)
                    if with_text:
                        pieces.append(bytes(piece))
                    at = int(offsets[i]) + (e or 0)
                digests.append(h.hexdigest())
                kept.append(b"".join(pieces))
            gone = tb.per_text(row, n, (hi - lo).astype(np.float64))
            listed = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
            columns = [part.column("key"), pa.array(np.diff(offsets)), pa.array(gone), pa.array(np.diff(per)), pa.array(digests, pa.string()), listed]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_text else []), names=arrow.names).cast(arrow)

    return map_arrow(joined, run, schema)
