"""Suffix trees of symbol sequences: Ukkonen's construction, leaf ranks, and longest common extensions.

A tree's nodes are visited in an Euler tour; the lowest common ancestor of two leaves is the shallowest node of the tour
between them, found by a range minimum over blocks in constant time. Its depth is the longest common extension.
"""

from __future__ import annotations

import numpy as np

#: Tour entries of a block.
BLOCK = 16


def ukkonen(s: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
    """(edge starts, edge ends, children by node * base + symbol, base) of the suffix tree of ``s``; node 0 is the root.

    ``s`` holds positive symbols and ends with 0, which occurs nowhere else.
    """
    n, base = len(s), max(s) + 1
    start, end, link, child = [0], [0], [0], {}
    node, at, length, open_ = 0, 0, 0, 0
    for i, c in enumerate(s):
        unlinked = 0
        open_ += 1
        while open_:
            if not length:
                at = i
            key = node * base + s[at]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                first = start[below]
                span = end[below] - first
                if length >= span:
                    at += span
                    length -= span
                    node = below
                    continue
                if s[first + length] == c:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                split = len(start)
                child[key] = split
                start += [first, i]
                end += [first + length, n]
                link += [0, 0]
                child[split * base + c] = split + 1
                start[below] = first + length
                child[split * base + s[first + length]] = below
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - open_ + 1
    return start, end, child, base


class SuffixTree:
    """The tree of a sequence of positive symbols (a smallest end mark is added), with constant-time common extensions."""

    def __init__(self, symbols: list[int]):
        s = [*symbols, 0]
        self.n = len(s)
        start, end, child, base = ukkonen(s)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self._below = np.fromiter(child.values(), np.int64, len(child))
        self._parent, self._symbol = np.divmod(keys, base)
        self._nodes = len(start)
        self._length = np.array(end, np.int64) - np.array(start, np.int64)
        del start, end, child
        self._tour(*self._children(self._symbol))

    def _children(self, by: np.ndarray) -> tuple[list[int], list[int]]:
        """Children of all nodes in one list, ordered by ``by``, and where each node's begin."""
        order = np.lexsort((by, self._parent))
        first = np.searchsorted(self._parent[order], np.arange(self._nodes + 1))
        return self._below[order].tolist(), first.tolist()

    def _tour(self, child: list[int], first: list[int]) -> None:
        length, n = self._length.tolist(), self.n
        depth = [0] * self._nodes
        tour, leaves, seen = [0], [], []
        path, todo = [0], [first[0]]
        while path:
            node, k = path[-1], todo[-1]
            if k == first[node + 1]:
                path.pop()
                todo.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            todo[-1] = k + 1
            below = child[k]
            d = depth[below] = depth[node] + length[below]
            if first[below] == first[below + 1]:
                leaves.append(n - d)
                seen.append(len(tour))
                tour += [d, depth[node]]
            else:
                tour.append(d)
                path.append(below)
                todo.append(first[below])
        self._leaves = np.array(leaves)
        self._at = np.empty(n, np.int64)
        self._at[self._leaves] = seen
        self.rank = np.empty(n, np.int64)
        self.rank[self._leaves] = np.arange(n)
        padded = np.full(-(-len(tour) // BLOCK) * BLOCK, n, np.int32)
        padded[: len(tour)] = tour
        blocks = padded.reshape(-1, BLOCK)
        self._flat = padded
        self._ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self._behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self._table = [blocks.min(axis=1)]
        while 1 << len(self._table) <= len(self._table[0]):
            low, half = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(low[:-half], low[half:]))

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes under the reversed order of symbols; the end mark stays the smallest."""
        child, first = self._children(np.where(self._symbol > 0, -self._symbol, np.iinfo(np.int64).min))
        length, n = self._length.tolist(), self.n
        rank, stack, k = [0] * n, [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                rank[n - depth] = k
                k += 1
            else:
                stack += [(b, depth + length[b]) for b in reversed(child[lo:hi])]
        return np.array(rank)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at ``i`` and at ``j`` (positions differ)."""
        a, b = self._at[i], self._at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        u, v = a // BLOCK, b // BLOCK
        out = np.minimum(self._behind[a], self._ahead[b])
        inner = np.flatnonzero(v - u > 1)
        if len(inner):
            lo, count = u[inner] + 1, v[inner] - u[inner] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            best = np.empty(len(inner), np.int32)
            for k in np.unique(level).tolist():
                m = level == k
                best[m] = np.minimum(self._table[k][lo[m]], self._table[k][lo[m] + count[m] - (1 << k)])
            out[inner] = np.minimum(out[inner], best)
        same = np.flatnonzero(u == v)
        if len(same):
            x, best = a[same].copy(), self._flat[a[same]]
            for _ in range(BLOCK):
                x = np.minimum(x + 1, b[same])
                best = np.minimum(best, self._flat[x])
            out[same] = best
        return out.astype(np.int64)
