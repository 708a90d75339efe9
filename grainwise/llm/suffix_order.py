"""Order of suffixes to a bounded depth by difference covers modulo three, on arrays."""

from __future__ import annotations

import numpy as np


def _dense(t: np.ndarray) -> np.ndarray:
    """Names 1, 2, ... in the order of the values."""
    return np.unique(t, return_inverse=True)[1].astype(np.int64) + 1


def _pairs(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    return a * base + b


def suffix_ranks(t: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of ``t`` (positive numbers) how many suffixes are smaller, looking at ``depth`` symbols or more.

    Suffixes of equal rank agree in ``depth`` symbols. Triples at positions 1 and 2 modulo 3 are sorted and named; the
    string of names is ordered by recursion; the other suffixes are merged in by a symbol or two and the rank behind.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    if int(t.max()) >= 1 << 20:
        t = _dense(t)
    base = int(t.max()) + 1
    t = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    rank = np.zeros(n + 3, np.int64)
    if len(sample):
        names = np.unique(_pairs(_pairs(t[sample], t[sample + 1], base), t[sample + 2], base), return_inverse=True)[1].astype(np.int64) + 1
        if depth > 3 and int(names.max()) < len(sample):
            # A smallest symbol between the two parts ends the suffixes of the first.
            below = suffix_ranks(np.concatenate([names[: len(one)] + 1, [1], names[len(one) :] + 1]), -(-depth // 3))
            names = _dense(np.concatenate([below[: len(one)], below[len(one) + 1 :]]))
        rank[sample] = names
    top = int(rank.max()) + 1
    zero = np.arange(0, n, 3)
    by_one = lambda i: _pairs(t[i], rank[i + 1], top)
    pair = _pairs(t[:-2], t[1:-1], base)
    if base * base > (1 << 62) // top:
        pair = _dense(pair)
    by_two = lambda i: _pairs(pair[i], rank[i + 2], top)
    less = lambda ordered, keys: np.searchsorted(ordered, keys, "left")
    zero_one, zero_two = np.sort(by_one(zero)), np.sort(by_two(zero))
    out = np.empty(n, np.int64)
    out[zero] = less(zero_one, by_one(zero)) + less(np.sort(by_one(one)), by_one(zero)) + less(np.sort(by_two(two)), by_two(zero))
    smaller = np.sort(rank[sample])
    out[one] = less(smaller, rank[one]) + less(zero_one, by_one(one))
    out[two] = less(smaller, rank[two]) + less(zero_two, by_two(two))
    return out


def repeats(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A number for each position of ``at``: equal numbers mean equal ``length`` bytes there (``data`` is ended by other bytes)."""
    if not len(at):
        return np.zeros(0, np.int64)
    ranks = suffix_ranks(data.astype(np.int64) + 1, length)[at]
    order = np.argsort(ranks, kind="stable")
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    a, b = at[order[:-1]], at[order[1:]]
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = words[a[left] + k] == words[b[left] + k]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~same]))
    return out
