"""Quality classifier by a factorisation machine (operator 9).

Features: hashed words (lower-cased, each distinct one with weight 1 / sqrt(distinct words)), structure statistics and
metadata (lengths), standardized and in bins. The machine adds low-rank interactions of all feature pairs; a row is
scored in time linear in its features by the identity
sum over pairs <v_i, v_j> x_i x_j = 1/2 sum over factors ((sum v x)^2 - sum (v x)^2).
Trained on the driver from a bounded sample of labelled rows by AdaGrad on the logistic loss.

Defined cases: null or empty text has statistics 0 and no words, and gets the score these give; repeated rows get equal
scores; without labels, or with one class only, the score is that class's share. Never inputs: labels, lang, source,
doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import quality_rules as qr
from grainwise.llm import textblocks as tb
from grainwise.llm.labelled import sample
from grainwise.llm.shipping import free_name, map_arrow

WORD_BITS = 16
BINS = 8
#: Bytes of a training slice.
TRAIN_BYTES = 1 << 20


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # statistics x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Structure statistics and lengths, one row per text."""
    base = {k: v.astype(float) for k, v in qr.base_counts(data, offsets).items()}
    classes = qr.class_histograms(data, offsets).astype(float)
    chars = np.maximum(classes.sum(axis=1), 1)
    words = np.maximum(base["n_words"], 1)
    starts, ends, text = tb.words(data, offsets)
    n = len(offsets) - 1
    hashes = tb.hash_segments(tb.LOWER[data], starts, ends)
    distinct = tb.per_text((np.unique(np.stack([text.astype(np.uint64), hashes]), axis=1)[0]).astype(np.int64), n) if len(starts) else np.zeros(n)
    twin = np.zeros(len(starts), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    lone = (ends - starts == 1) & ~((data[starts] >= 48) & (data[starts] <= 57)) if len(starts) else twin
    _, _, lt = tb.lines(data, offsets)
    n_lines = np.maximum(tb.per_text(lt, n), 1)
    return np.stack(
        [
            np.log1p(base["n_words"]),
            np.log1p(chars),
            base["word_chars"] / words,
            base["n_symbols"] / words,
            base["n_dup_lines"] / n_lines,
            base["n_repeat_words"] / words,
            tb.per_text(text[twin], n) / words,
            tb.per_text(text[lone], n) / words,
            distinct / np.sqrt(words),
            np.log1p(words / n_lines),
            *(classes[:, k] / chars for k in range(qr.CLASSES)),
        ],
        axis=1,
    )


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word bucket), each pair once, ordered by text."""
    starts, ends, text = tb.words(data, offsets)
    bucket = (tb.hash_segments(tb.LOWER[data], starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key = np.unique((text << WORD_BITS) | bucket)
    return key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)


def rows_of(data: np.ndarray, offsets: np.ndarray, m: Machine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (text index ascending, feature, value)."""
    n = len(offsets) - 1
    stats = np.clip((statistics(data, offsets) - m.mean) / m.scale, -4, 4)
    k = stats.shape[1]
    binned = (stats[:, :, None] > m.edges[None]).sum(axis=2) + np.arange(k) * BINS
    text, bucket = word_features(data, offsets)
    size = np.maximum(tb.per_text(text, n), 1)
    who = np.concatenate([np.repeat(np.arange(n), k), np.repeat(np.arange(n), k), text])
    what = np.concatenate([np.tile(np.arange(k), n), k + binned.ravel(), k + k * BINS + bucket])
    value = np.concatenate([stats.ravel() / np.sqrt(k), np.full(n * k, 1 / np.sqrt(k)), 1 / np.sqrt(size[text])])
    order = np.argsort(who, kind="stable")
    return who[order], what[order], value[order]


def raw_scores(who: np.ndarray, what: np.ndarray, value: np.ndarray, m: Machine) -> tuple[np.ndarray, np.ndarray]:
    """(logit per text, factor sums per text); every text has at least its statistics, so no text is without rows."""
    cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    vx = m.factors[what] * value[:, None]
    sums = np.add.reduceat(vx, cut, axis=0)
    squares = np.add.reduceat(vx * vx, cut, axis=0)
    linear = np.add.reduceat(m.linear[what] * value, cut)
    return m.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def train(texts: pa.Array, label: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-4, batch: int = 256, seed: int = 11) -> Machine:
    n = len(label)
    share = float(label.mean()) if n else 0.0
    # In slices, so that the driver holds the working arrays of one at a time.
    batches = [pa.RecordBatch.from_arrays([b], names=["text"]) for b in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])]
    parts = [part.column(0) for part in tb.slices(batches, max_bytes=TRAIN_BYTES)]
    stats = np.concatenate([statistics(*tb.flat(p)) for p in parts]) if n else statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64))
    k = stats.shape[1]
    m = Machine(stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6), np.zeros((k, BINS - 1)), float(np.log((share + 1e-4) / (1 - share + 1e-4))), np.zeros(k + k * BINS + (1 << WORD_BITS)), np.zeros((k + k * BINS + (1 << WORD_BITS), rank)))
    m.edges = np.quantile((stats - m.mean) / m.scale, np.arange(1, BINS) / BINS, axis=0).T
    if share in (0.0, 1.0):
        return m
    rng = np.random.default_rng(seed)
    m.factors = rng.normal(0, 0.05, m.factors.shape)
    rows, before = [], 0
    for p in parts:
        who, what, value = rows_of(*tb.flat(p), m)
        rows.append(((who + before).astype(np.int32), what.astype(np.int32), value.astype(np.float32)))
        before += len(p)
    who, what, value = (np.concatenate([r[i] for r in rows]) for i in range(3))
    ends = np.searchsorted(who, np.arange(n + 1))
    g_lin, g_fac, g_bias = np.full(m.linear.shape, 1e-3), np.full(m.factors.shape, 1e-3), 1e-3
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            picked = order[lo : lo + batch]
            at = np.concatenate([np.arange(ends[r], ends[r + 1]) for r in picked])
            size = ends[picked + 1] - ends[picked]
            doc, f, x = np.repeat(np.arange(len(picked)), size), what[at], value[at].astype(float)
            logit, sums = raw_scores(doc, f, x, m)
            err = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[picked]
            seen, slot = np.unique(f, return_inverse=True)
            gl = np.bincount(slot, weights=err[doc] * x, minlength=len(seen)) + ridge * m.linear[seen]
            each = (err[doc] * x)[:, None] * (sums[doc] - m.factors[f] * x[:, None])
            gf = np.stack([np.bincount(slot, weights=each[:, j], minlength=len(seen)) for j in range(rank)], axis=1) + ridge * m.factors[seen]
            g_lin[seen] += gl * gl
            g_fac[seen] += gf * gf
            g_bias += float(err.sum()) ** 2
            m.linear[seen] -= rate * gl / np.sqrt(g_lin[seen])
            m.factors[seen] -= rate * gf / np.sqrt(g_fac[seen])
            m.bias -= rate * float(err.sum()) / g_bias**0.5
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def score_texts(text: pa.Array, m: Machine) -> np.ndarray:
    data, offsets = tb.flat(text)
    if len(offsets) == 1:
        return np.zeros(0)
    logit, _ = raw_scores(*rows_of(data, offsets, m), m)
    return 1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_rows: int = 6000) -> Machine:
    rows = sample(docs, labels, "quality", folds, held_out, max_rows)
    return train(rows.column("text"), rows.column("label").to_numpy().astype(int))


def scored(docs: DataFrame, machine: Machine, columns: list[str]) -> DataFrame:
    """``columns`` of every row plus score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(score_texts(part.column(held), machine))], schema=arrow)

    return map_arrow(narrow, run, schema)
