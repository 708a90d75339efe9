"""Quality rules by distribution divergence (operator 4).

Every text gets the base counts of the contract, and two histograms: character classes, and the common words of its
language. Both are compared with the language's reference, gathered over all texts, by Jensen-Shannon distance
(base 2, 0 to 1). A text is rejected when it fails the base rules or when a distance exceeds its limit; histograms of
texts below the minimum lengths aren't compared.

References: every language with at least ``min_reference_chars`` characters in all its texts has its own, however small
its share of the rows; texts without a language count as one. A language with less text isn't compared, and its texts keep
the base verdict: a reference of other languages would reject every text in another script. A reference is a kilobyte;
one per language reaches the driver.

Defined cases: null text counts as no words (it fails ``n_words``); empty tables give empty results; repeated rows are
judged each; other columns are neither read nor touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import free_name, map_arrow
from grainwise.session import scratch_path

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 quote or bracket, 7 dash or slash,
#: 8 symbol, 9 lead byte of a non-ASCII character, 10 control, 11 continuation byte (not counted).
CLASSES = 11
CLASS_OF = np.full(256, 10, np.int64)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[9, 32]], CLASS_OF[[10, 13]] = 3, 4
CLASS_OF[[ord(c) for c in ".,;:!?"]] = 5
CLASS_OF[[ord(c) for c in "\"'`()[]{}"]] = 6
CLASS_OF[[ord(c) for c in "-_/\\"]] = 7
CLASS_OF[[ord(c) for c in "#*$%&|<>@^~+="]] = 8
CLASS_OF[0xC0:], CLASS_OF[0x80:0xC0] = 9, 11

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: Words up to this many bytes can be common words: their bytes are the key, so that no hash is involved.
COMMON_BYTES = 5
#: A task hands its counts on when it holds this many keys.
FLUSH_KEYS = 200_000

COUNTS = T.StructType([T.StructField("ref_lang", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("item", T.LongType()), T.StructField("n", T.LongType())])


@dataclass(frozen=True)
class Limits:
    """Thresholds; the lengths guard histograms that are too short to compare."""

    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars: int = 300
    min_letters_words: int = 60
    common_words: int = 48
    min_reference_chars: int = 20_000
    max_class_distance: float = 0.30
    max_word_distance: float = 0.45


@dataclass
class References:
    classes: dict[str, np.ndarray] = field(default_factory=dict)
    words: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The exact counts of the contract, per text."""
    n = len(offsets) - 1
    starts, ends, text = tb.words(data, offsets)
    solid = ~tb.IS_SPACE[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    code_points = solid & ((data & 0xC0) != 0x80)
    out = {
        "n_words": tb.per_text(text, n),
        "word_chars": tb.per_text(owner[code_points], n),
        "n_symbols": tb.per_text(owner[IS_SYMBOL[data]], n),
    }
    ls, le, lt = tb.lines(data, offsets)
    solid_before = np.concatenate([[0], np.cumsum(solid)])
    full = solid_before[le] > solid_before[ls]
    ls, le, lt = ls[full], le[full], lt[full]
    out["n_dup_lines"] = tb.per_text(lt[_repeats(tb.numbered(data, ls, le)[0], lt)], n)
    out["n_repeat_words"] = tb.per_text(text[in_repeated_windows(tb.numbered(data, starts, ends)[0], text)], n)
    return out


def _repeats(names: np.ndarray, text: np.ndarray, first_too: bool = False) -> np.ndarray:
    """Which entries equal an earlier one of their text, or with ``first_too`` any other one; names are small numbers."""
    key = text * (int(names.max(initial=0)) + 1) + names
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flag = np.zeros(len(key), bool)
    flag[order[1:][same]] = True
    if first_too:
        flag[order[:-1][same]] = True
    return flag


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Small numbers for pairs of small numbers; equal numbers mean equal pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def in_repeated_windows(names: np.ndarray, text: np.ndarray, size: int = 5) -> np.ndarray:
    """Which words lie in a ``size``-word window that its text has twice or more, the first one included.

    ``names`` are small numbers, equal for equal words.
    """
    m = len(names) - size + 1
    if m <= 0:
        return np.zeros(len(names), bool)
    # Names of windows of 1, 2, 4, ... words; two that overlap name one of any size between.
    window, width = names, 1
    while width < size:
        more = min(width, size - width)
        window = _named(window[: len(window) - more], window[more:])
        width += more
    inside = np.flatnonzero(text[:m] == text[size - 1 :])
    found = inside[_repeats(window[inside], text[inside], first_too=True)]
    step = np.zeros(len(names) + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + size, -1)
    return np.cumsum(step)[:-1] > 0


def class_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n) * (CLASSES + 1), np.diff(offsets)) + CLASS_OF[data]
    return np.bincount(cell, minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def short_word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs: (key of its lowered bytes or -1 if longer than COMMON_BYTES, text index, words per text)."""
    cls = CLASS_OF[data]
    starts, ends, text = tb.segments((cls <= 1) | (cls == 9) | (cls == 11), offsets)
    size = ends - starts
    low = tb.LOWER[data]
    key = np.zeros(len(starts), np.int64)
    for k in range(COMMON_BYTES):
        at = np.minimum(starts + k, len(data) - 1) if len(data) else starts
        key = key * 256 + np.where(k < size, low[at], 0)
    return np.where(size <= COMMON_BYTES, key, -1), text, tb.per_text(text, len(offsets) - 1)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows, class counts and short-word counts by language."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["ref_lang", "kind", "item", "n"],
        )
        seen.clear()
        return batch

    for part in tb.slices(batches):
        data, offsets = tb.flat(part.column("text"))
        langs, codes = np.unique(np.array([x or "" for x in part.column("ref_lang").to_pylist()], dtype=object), return_inverse=True)
        keys, text, _ = short_word_keys(data, offsets)
        classes = class_histograms(data, offsets)
        for c, lang in enumerate(langs):
            seen[(lang, 0, 0)] += int((codes == c).sum())
            for item, n in enumerate(classes[codes == c].sum(axis=0)):
                seen[(lang, 1, item)] += int(n)
            mine = keys[codes[text] == c]
            for item, n in zip(*(x.tolist() for x in np.unique(mine, return_counts=True)), strict=True):
                seen[(lang, 2, item)] += n
        if len(seen) > FLUSH_KEYS:
            yield out()
    if seen:
        yield out()


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """Language references over all rows, of the languages with at least ``min_reference_chars`` characters."""
    narrow = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("ref_lang"), F.col("text").cast("string").alias("text"))
    path = scratch_path(docs.sparkSession, "language-counts")
    map_arrow(narrow, _count, COUNTS).groupBy("ref_lang", "kind", "item").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    chars = counts.filter("kind = 1").groupBy("ref_lang").agg(F.sum("n").alias("chars"))
    large = chars.filter(F.col("chars") >= limits.min_reference_chars).select("ref_lang")
    wanted = counts.filter("kind > 0").join(large, "ref_lang", "left_semi")
    rank = F.row_number().over(Window.partitionBy("ref_lang", "kind").orderBy((F.col("item") < 0).desc(), F.desc("n"), "item"))
    top = wanted.withColumn("place", rank).filter(F.col("place") <= limits.common_words + 1)
    all_words = wanted.filter("kind = 2").groupBy("ref_lang").agg(F.sum("n").alias("n"))
    found = References()
    words_of: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("ref_lang", "kind", "item", "n").collect():
        if r.kind == 1:
            found.classes.setdefault(r.ref_lang, np.zeros(CLASSES))[r.item] = r.n
        elif r.item >= 0:
            words_of.setdefault(r.ref_lang, []).append((r.item, r.n))
    totals = {r.ref_lang: r.n for r in all_words.collect()}
    for lang, pairs in words_of.items():
        pairs = sorted(pairs, key=lambda p: (-p[1], p[0]))[: limits.common_words]
        keys = np.array(sorted(k for k, _ in pairs), np.int64)
        n = dict(pairs)
        share = np.array([n[k] for k in keys.tolist()], float)
        found.words[lang] = keys, np.append(share, max(0, totals[lang] - share.sum()))
    return found


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``; counts are normalized, empty rows have distance 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)
        d = (kl(p) + kl(np.broadcast_to(q, p.shape))) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(d, 0, 1)), 0.0)


def divergences(data: np.ndarray, offsets: np.ndarray, langs: list[str | None], refs: References, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, word distance) per text; 0 where a guard or a missing reference forbids the comparison."""
    n = len(offsets) - 1
    by_class, by_word = np.zeros(n), np.zeros(n)
    classes = class_histograms(data, offsets)
    keys, text, n_words = short_word_keys(data, offsets)
    own = np.array([x if x in refs.classes else None for x in (y or "" for y in langs)], dtype=object)
    for lang in set(own.tolist()):
        if lang not in refs.classes:
            continue
        here = np.array([x == lang for x in own.tolist()])
        far = js_distance(classes[here].astype(float), refs.classes[lang])
        by_class[here] = np.where(classes[here].sum(axis=1) >= limits.min_chars, far, 0.0)
        if lang not in refs.words:
            continue
        common, share = refs.words[lang]
        inside = here[text]
        at = np.minimum(np.searchsorted(common, keys[inside]), len(common) - 1)
        column = np.where(common[at] == keys[inside], at, len(common))
        row = np.cumsum(here) - 1
        table = np.bincount(row[text[inside]] * (len(common) + 1) + column, minlength=int(here.sum()) * (len(common) + 1)).reshape(-1, len(common) + 1)
        by_word[here] = np.where(n_words[here] >= limits.min_letters_words, js_distance(table.astype(float), share), 0.0)
    return by_class, by_word


VERDICT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())]
)


def verdicts(text: pa.Array, langs: list[str | None], refs: References, limits: Limits) -> dict[str, np.ndarray]:
    data, offsets = tb.flat(text)
    out = base_counts(data, offsets)
    out["base_failed"] = (out["n_words"] < limits.min_words) | (100 * out["n_repeat_words"] > limits.max_repeat_percent * out["n_words"])
    out["class_distance"], out["word_distance"] = divergences(data, offsets, langs, refs, limits)
    out["kept"] = ~out["base_failed"] & (out["class_distance"] <= limits.max_class_distance) & (out["word_distance"] <= limits.max_word_distance)
    return out


def judge(docs: DataFrame, refs: References, columns: list[str], limits: Limits = Limits(), prefix: str = "") -> DataFrame:
    """``columns`` of every row of ``docs`` plus the verdict columns, named with ``prefix``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f.name for f in VERDICT]
    held, spoken = free_name(columns, "text"), free_name(columns, "lang")
    narrow = docs.select(*columns, F.col("lang").alias(spoken), F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in VERDICT)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            got = verdicts(part.column(held), part.column(spoken).to_pylist(), refs, limits)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(got[c]) for c in names)], schema=arrow)

    return map_arrow(narrow, run, schema)


def reject(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly the columns of ``docs``."""
    mark = "__quality_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    judged = judge(docs, references(docs, limits), docs.columns, limits, mark)
    return judged.filter(F.col(mark + "kept")).select(*docs.columns)
