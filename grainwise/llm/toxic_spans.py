"""Toxic spans by a linear-chain conditional random field (operator 7).

Training (driver, on a bounded sample of labelled rows): byte prefixes and whole words are hashed to features; those
that stand out in toxic texts, near copies counted once, give the token labels (a token of a toxic text with such a
feature is toxic, tokens of other texts are not). The field has one weight per feature for the toxic state, and transition weights; full-batch
AdaGrad climbs the conditional likelihood, whose gradient comes from forward-backward marginals. Three summaries of a
text's marginals (largest, expected number, share) go through a logistic calibration to the document score.

Scoring (executors): marginals are exact over whole texts. Texts of a slice are laid end to end, with transitions that
forget the state at each text start; the chain is cut into blocks, whose transfer matrices are composed, so that all
blocks advance together.

Defined cases: null or empty text has no tokens and gets the calibrated score of a text without marginals; repeated rows
get equal scores; without labels, or with one class only, the score is that class's share. Never inputs: labels, lang,
source, doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.labelled import sample
from grainwise.llm.shipping import free_name, map_arrow
from grainwise.llm.simhash import roots

#: Feature table size (2 ** BITS weights), byte prefixes used besides the whole word.
BITS = 18
PREFIXES = (4, 5, 6, 8)
#: Bytes of a training slice.
TRAIN_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[48:58] = True
_IS_WORD[0x80:] = True


@dataclass
class Model:
    weights: np.ndarray  # by feature, for the toxic state
    start: np.ndarray  # log weight of each state at a text start
    move: np.ndarray  # log weights of state pairs
    calibration: np.ndarray  # intercept and weights of the summaries


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index, features) of the letter and digit runs."""
    starts, ends, text = tb.segments(_IS_WORD[data], offsets)
    low = tb.LOWER[data]
    # Upper-case Latin-1 letters in UTF-8 (C3 80-9E) are lowered as well.
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    low = np.where(after & (data >= 0x80) & (data <= 0x9E), data + 32, low).astype(np.uint8)
    columns = [tb.hash_segments(low, starts, ends) >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        cut = np.minimum(starts + k, ends)
        columns.append(tb.mix(tb.hash_segments(low, starts, cut) + np.uint64(k)) >> np.uint64(64 - BITS))
    return starts, ends, text, np.stack(columns, axis=1).astype(np.int32)


def marginals(score: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) per token, P(state pair) per token and its predecessor), for chains laid end to end.

    ``score`` is the log weight of the toxic state, ``first`` marks chain starts.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    size = rows * width
    emit = np.ones((size, 2))
    emit[:n, 1] = np.exp(np.clip(score, -30, 30))
    begins = np.zeros(size, bool)
    begins[:n] = first
    begins[n:] = True  # padding forgets as well
    step = np.where(begins[:, None, None], np.exp(start)[None, None, :], np.exp(move)[None]) * emit[:, None, :]
    step = step.reshape(rows, width, 2, 2)
    # Transfer matrix of each block, then the vectors that enter it from either side.
    whole = step[:, 0]
    for t in range(1, width):
        whole = whole @ step[:, t]
        whole = whole / whole.max(axis=(1, 2), keepdims=True)
    ahead, back = np.ones((rows, 2)) / 2, np.ones((rows, 2)) / 2
    for r in range(1, rows):
        v = ahead[r - 1] @ whole[r - 1]
        ahead[r] = v / v.sum()
    for r in range(rows - 2, -1, -1):
        v = whole[r + 1] @ back[r + 1]
        back[r] = v / v.sum()
    forward, backward = np.empty((rows, width, 2)), np.empty((rows, width, 2))
    v = ahead
    for t in range(width):
        v = np.einsum("ri,rij->rj", v, step[:, t])
        v = v / v.sum(axis=1, keepdims=True)
        forward[:, t] = v
    v = back
    for t in range(width - 1, -1, -1):
        backward[:, t] = v
        v = np.einsum("rij,rj->ri", step[:, t], v)
        v = v / v.sum(axis=1, keepdims=True)
    forward, backward = forward.reshape(size, 2), backward.reshape(size, 2)
    both = forward * backward
    toxic = (both[:, 1] / both.sum(axis=1))[:n]
    before = np.vstack([np.full((1, 2), 0.5), forward[:-1]])
    pair = before[:, :, None] * step.reshape(size, 2, 2) * backward[:, None, :]
    pair = pair / pair.sum(axis=(1, 2), keepdims=True)
    return toxic, pair[:n]


def _chain_starts(text: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)


def summaries(toxic: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text: 1, logit of the largest marginal, log expected number of toxic tokens, log of their share."""
    largest = np.zeros(n)
    np.maximum.at(largest, text, toxic)
    expected = np.bincount(text, weights=toxic, minlength=n) if len(text) else np.zeros(n)
    count = tb.per_text(text, n)
    largest = np.clip(largest, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(largest / (1 - largest)) / 4, np.log(expected + 1e-3), np.log((expected + 1e-3) / (count + 10))], axis=1)


@dataclass
class Slice:
    """Tokens of some whole texts: their features, texts, and which of them start a text."""

    features: np.ndarray
    text: np.ndarray
    first: np.ndarray


def _sample_slices(texts: pa.Array) -> list[Slice]:
    """The sample in slices, so that training holds the lattice of one slice at a time."""
    out, before = [], 0
    for part in tb.slices([pa.RecordBatch.from_arrays([b], names=["text"]) for b in (texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts])], max_bytes=TRAIN_BYTES):
        _, _, text, features = tokens(*tb.flat(part.column(0)))
        out.append(Slice(features, text + before, _chain_starts(text)))
        before += part.num_rows
    return out


def one_of_each(parts: list[Slice], n: int, size: int = 5, signatures: int = 3) -> np.ndarray:
    """Marks one text of each group of near copies: texts that share a least hash of their 5-token windows."""
    labels = np.arange(n)
    keys, texts = [], []
    for p in parts:
        word = tb.mix(p.features[:, 0].astype(np.uint64) + np.uint64(1))
        m = len(word) - size + 1
        if m <= 0:
            continue
        rolled = np.zeros(m, np.uint64)
        for k in range(size):
            rolled = tb.mix(rolled * np.uint64(0xFF51AFD7ED558CCD) + word[k : k + m])
        inside = p.text[:m] == p.text[size - 1 :]
        keys.append(rolled[inside])
        texts.append(p.text[:m][inside])
    if not keys:
        return np.ones(n, bool)
    key, text = np.concatenate(keys), np.concatenate(texts)
    for s in range(signatures):
        hashed = tb.mix(key ^ tb.mix(np.array([s + 1], np.uint64)))
        least = np.full(n, ~np.uint64(0))
        np.minimum.at(least, text, hashed)
        order = np.argsort(least, kind="stable")
        same = (least[order][1:] == least[order][:-1]) & (least[order][1:] != ~np.uint64(0))
        labels = roots(labels, order[1:][same], order[:-1][same])
    return labels == np.arange(n)


def telling_features(parts: list[Slice], label: np.ndarray, min_texts: int, min_gain: float, min_lift: float) -> np.ndarray:
    """Features found in clearly more toxic than other texts (log-likelihood ratio and lift); near copies count once."""
    size = 1 << BITS
    counted = one_of_each(parts, len(label))
    a, b = np.zeros(size), np.zeros(size)
    for p in parts:
        key = np.unique(p.text[:, None] * size + p.features)
        doc, feature = key >> BITS, key & (size - 1)
        a += np.bincount(feature[counted[doc] & (label[doc] == 1)], minlength=size)
        b += np.bincount(feature[counted[doc] & (label[doc] == 0)], minlength=size)
    pos, neg = max(1, int((counted & (label == 1)).sum())), max(1, int((counted & (label == 0)).sum()))
    rate = (a + b) / (pos + neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 2 * (np.where(a > 0, a * np.log(a / (pos * rate)), 0) + np.where(b > 0, b * np.log(b / (neg * rate)), 0))
    lift = ((a + 0.5) / pos) / ((b + 0.5) / neg)
    return (a >= min_texts) & (gain >= min_gain) & (lift >= min_lift)


def train(texts: pa.Array, label: np.ndarray, epochs: int = 40, rate: float = 0.5, ridge: float = 1e-3, clean_ratio: int = 3, min_texts: int = 5, min_gain: float = 20.0, min_lift: float = 4.0) -> Model:
    share = float(label.mean()) if len(label) else 0.0
    size = 1 << BITS
    model = Model(np.zeros(size, np.float32), np.zeros(2), np.zeros((2, 2)), np.array([np.log((share + 1e-4) / (1 - share + 1e-4)), 0, 0, 0]))
    if share in (0.0, 1.0):
        return model
    parts = _sample_slices(texts)
    telling = telling_features(parts, label, min_texts, min_gain, min_lift)
    # All toxic texts and ``clean_ratio`` times as many others teach the field; all sampled texts calibrate it.
    others = np.flatnonzero(label == 0)
    taught = np.zeros(len(label), bool)
    taught[label == 1] = True
    taught[others[: clean_ratio * int((label == 1).sum())]] = True
    lessons = []
    for p in parts:
        use = taught[p.text]
        f, text = p.features[use], p.text[use]
        toxic = (telling[f].any(axis=1) & (label[text] == 1)).astype(np.int64)
        first = _chain_starts(text)
        pairs = np.zeros((2, 2))
        inner = np.flatnonzero(~first)
        np.add.at(pairs, (toxic[inner - 1], toxic[inner]), 1)
        lessons.append((f, toxic, first, pairs))
    n_chains = sum(int(first.sum()) for _, _, first, _ in lessons)
    weights, start, move = np.zeros(size), np.array([0.0, -4.0]), np.array([[0.0, -4.0], [-1.0, -2.0]])
    totals = [np.full(size, 1e-8), np.full(2, 1e-8), np.full((2, 2), 1e-8)]
    for _ in range(epochs):
        grads = [-ridge * n_chains**0.5 * weights, np.zeros(2), np.zeros((2, 2))]
        for f, toxic, first, pairs in lessons:
            if not len(first):
                continue
            p, pair = marginals(weights[f].sum(axis=1), first, start, move)
            grads[0] += np.bincount(f.ravel(), weights=np.repeat(toxic - p, f.shape[1]), minlength=size)
            grads[1] += [(p[first] - toxic[first]).sum(), (toxic[first] - p[first]).sum()]
            grads[2] += pairs - pair[~first].sum(axis=0)
        for value, g, total in zip((weights, start, move), grads, totals, strict=True):
            total += g * g
            value += rate * g / np.sqrt(total)
    model.weights, model.start, model.move = weights.astype(np.float32), start, move
    found = np.zeros((len(label), 4))
    for p in parts:
        lo, hi = (int(p.text[0]), int(p.text[-1]) + 1) if len(p.text) else (0, 0)
        toxic, _ = marginals(model.weights[p.features].astype(float).sum(axis=1), p.first, start, move)
        found[lo:hi] = summaries(toxic, p.text - lo, hi - lo)
    blank = found[:, 0] == 0  # texts without tokens
    found[blank] = summaries(np.zeros(0), np.zeros(0, np.int64), 1)
    model.calibration = logistic(found, label)
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w + d
        if np.abs(d).max() < 1e-8:
            break
    return w


def score_texts(text: pa.Array, model: Model, span_limit: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """(score per text, toxic spans per text as code point offsets with the largest marginal inside)."""
    data, offsets = tb.flat(text)
    n = len(offsets) - 1
    starts, ends, owner, features = tokens(data, offsets)
    p, _ = marginals(model.weights[features].astype(float).sum(axis=1), _chain_starts(owner), model.start, model.move) if len(starts) else (np.zeros(0), None)
    score = 1 / (1 + np.exp(-np.clip(summaries(p, owner, n) @ model.calibration, -30, 30)))
    spans: list[list[dict]] = [[] for _ in range(n)]
    hot = np.flatnonzero(p >= span_limit)
    if len(hot):
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(owner[hot]) != 0)]))
        for a, b in zip(hot[cut].tolist(), hot[np.append(cut[1:], len(hot)) - 1].tolist(), strict=True):
            base = points[offsets[owner[a]]]
            spans[owner[a]].append({"start": int(points[starts[a]] - base), "end": int(points[ends[b]] - base), "marginal": float(p[a : b + 1].max())})
    return score, spans


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_rows: int = 8000) -> Model:
    rows = sample(docs, labels, "toxic", folds, held_out, max_rows)
    return train(rows.column("text"), rows.column("label").to_numpy().astype(int))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("marginal", T.DoubleType())]))


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of every row plus score and spans."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            score, spans = score_texts(part.column(held), model)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(score), pa.array(spans, arrow.field("spans").type)], schema=arrow)

    return map_arrow(narrow, run, schema)
