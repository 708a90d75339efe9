"""Token counts by a compiled finite-state tokenizer (operator 8).

Two transducers in cascade give the count of the tokenizers library for a byte-level BPE file:

* :mod:`grainwise.llm.pretokens` splits the text; chunk state maps are composed by a parallel prefix scan;
* the merge transducer below reads a pre-token byte by byte. Its transitions carry the change in the number of tokens
  of the prefix read so far, so that the weights along a path add up to the token count.

Compilation of the merge transducer: the last token of a prefix is the one suffix token that stands validly after the
last token of the prefix before it, so a state holds the longest suffix that may still grow into a token (a node of an
automaton over all tokens), and the last tokens and relative counts at the positions inside that suffix. Prefixes that
agree in these have the same future and share a state. Transitions are compiled when first needed and kept.

Defined cases: null or empty text has 0 bytes and 0 tokens; special strings inside a text count as one token each, as
the library does by default; long texts are walked in linear time; repeated rows are counted each.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grainwise.llm import caches, pretokens
from grainwise.llm import textblocks as tb
from grainwise.llm.caches import Generations
from grainwise.llm.shipping import free_name, map_arrow

#: Word counts of one generation of a worker's memory; results don't depend on it.
KEPT_WORDS = 200_000
#: Transitions kept by a worker before it compiles afresh; results don't depend on it.
KEPT_TRANSITIONS = 400_000
OWNER = "token_counts"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, as published: printable bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTransducer:
    """Token counts of pre-tokens under the merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path}: not a BPE model")
        self.special = sorted((t["content"].encode() for t in spec.get("added_tokens", [])), key=len, reverse=True)
        back = byte_symbols()
        raw = {i: bytes(back[c] for c in s) for s, i in model["vocab"].items() if all(c in back for c in s)}
        ids = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: merged token by pair, with the rank at which the pair merges
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        made = {i for i, b in raw.items() if len(b) == 1}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged.setdefault((left, right), (rank, whole))
            self.parts.setdefault(whole, (left, right, rank))
            made.add(whole)
        self.token = {raw[i]: i for i in made}
        self.size = {i: len(raw[i]) for i in made}
        # Automaton over all tokens: child by (node, byte), failure links, depth, and the token a node spells.
        self.child: dict[int, int] = {}
        depth, spells = [0], [-1]
        for b, i in self.token.items():
            node = 0
            for c in b:
                key = node << 8 | c
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(depth)
                    depth.append(depth[key >> 8] + 1)
                    spells.append(-1)
            spells[node] = i
        self.depth, self.spells = depth, spells
        self.fail = [0] * len(depth)
        for key, node in sorted(self.child.items(), key=lambda kv: depth[kv[1]]):
            if depth[node] > 1:
                self.fail[node] = self._follow(self.fail[key >> 8], key & 255)
        # The nearest node on the failure path (itself included) that spells a token, and the next such node below it.
        self.leaf = set(range(len(depth))) - {k >> 8 for k in self.child}
        order = sorted(range(len(depth)), key=depth.__getitem__)
        self.hit = [0] * len(depth)
        for node in order[1:]:
            self.hit[node] = node if spells[node] >= 0 else self.hit[self.fail[node]]
        self._reset()

    def _reset(self) -> None:
        # State: (node, last tokens at the positions inside the suffix, their counts relative to the newest position).
        self.states = [(0, (-1,), (0,))]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.counts = Generations(KEPT_WORDS)

    def _restart(self, state: int) -> int:
        """Forget all compiled transitions; the number of ``state`` afterwards."""
        key = self.states[state]
        kept = self.counts
        self._reset()
        self.counts = kept
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _follow(self, node: int, byte: int) -> int:
        while True:
            nxt = self.child.get(node << 8 | byte)
            if nxt:
                return nxt
            if not node:
                return 0
            node = self.fail[node]

    def stands(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: no merge joins them across the border before both are complete.

        Undo the younger of the two tokens again and again; what then touches the border must not have merged with its
        neighbour before the undone merge took place (a merge further left comes first among equals).
        """
        got = self.valid.get((left, right))
        if got is None:
            got = self.valid[left, right] = self._stands(left, right)
        return got

    def _stands(self, left: int, right: int) -> bool:
        bound = (1 << 60, 0)  # a merge across the border counts if it comes before this (rank, side)
        while True:
            across = self.merged.get((left, right))
            if across and (across[0], 1) < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and (a[2], 0) > (b[2], 2)):
                bound, left = (a[2], 0), a[1]
            elif a is not None and a[2] == b[2]:
                # Equal ranks merge left to right: the right token's merge is the later one.
                bound, right = (b[2], 2), b[0]
            else:
                bound, right = (b[2], 2), b[0]

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        node, last, count = self.states[state]
        new = self._follow(node, byte)
        width = len(last)
        hit = self.hit[new]
        while hit:
            token = self.spells[hit]
            size = self.size[token]
            if size <= width:  # the position before the token lies in the window
                before = last[width - size]
                if before < 0 or self.stands(before, token):
                    gain = count[width - size] + 1
                    break
            hit = self.hit[self.fail[hit]]
        else:
            raise ValueError(f"byte {byte} has no token")
        # Positions that a longer token could still start from: as many as the suffix is long, and its own start; of
        # these, only where a node of the failure path can go on.
        keep = self.depth[new] + 1
        open_at, at = {1}, new
        while at:
            if at not in self.leaf:
                open_at.add(self.depth[at] + 1)
            at = self.fail[at]
        last, count = (*last, token)[-keep:], (*count, gain)[-keep:]
        window = tuple(t if keep - i in open_at else -2 for i, t in enumerate(last))
        counts = tuple(c - gain if keep - i in open_at else 0 for i, c in enumerate(count))
        key = (new, window, counts)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        got = self.step[state << 8 | byte] = (to, gain)
        return got

    def count(self, word: bytes) -> int:
        state = total = 0
        for c in word:
            got = self.step.get(state << 8 | c)
            if got is None:
                if len(self.step) >= KEPT_TRANSITIONS:  # compile afresh, from the state that is reached
                    state = self._restart(state)
                got = self._compile(state, c)
            state, gain = got
            total += gain
        return total

    def counts_of(self, words: list[bytes]) -> list[int]:
        kept, out = self.counts, []
        for w in words:
            n = kept.get(w)
            if n is None:
                n = self.count(w)
                if len(w) <= 64:
                    kept.put(w, n)
            out.append(n)
        return out


_compiled: dict[str, MergeTransducer] = {}


def compiled(path: str) -> MergeTransducer:
    """The worker's transducer of a file; a pure function of the file, kept between tasks."""
    if path not in _compiled:
        _compiled[path] = MergeTransducer(path)
        caches.hold(OWNER, _compiled.clear)
    return _compiled[path]


def _cut_special(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut at special strings: (offsets of the pieces, text of each piece, whether it is a special string)."""
    n = len(offsets) - 1
    raw = data.tobytes()
    cuts: list[tuple[int, int]] = []
    if any(s in raw for s in special):
        for i in range(n):
            at, stop = int(offsets[i]), int(offsets[i + 1])
            while at < stop:
                found = min(((p, -len(s)) for s in special if (p := raw.find(s, at, stop)) >= 0), default=None)
                if found is None:
                    break
                cuts.append((found[0], found[0] - found[1]))
                at = found[0] - found[1]
    if not cuts:
        return offsets, np.arange(n), np.zeros(n, bool)
    edges = np.unique(np.concatenate([offsets, np.array(cuts, np.int64).ravel()]))
    text = np.searchsorted(offsets, edges[:-1], "right") - 1
    return edges, text, np.isin(edges[:-1], [a for a, _ in cuts])


def count_tokens(text: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    tool = compiled(path)
    data, offsets = tb.flat(text)
    n = len(offsets) - 1
    total = np.zeros(n, np.int64)
    if len(data):
        edges, owner, special = _cut_special(data, offsets, tool.special)
        starts, ends, piece = pretokens.split(data, edges)
        keep = ~special[piece]
        starts, ends, piece = starts[keep], ends[keep], piece[keep]
        which, distinct = tb.numbered(data, starts, ends)
        counts = np.array(tool.counts_of(distinct.to_pylist()), np.int64)
        np.add.at(total, owner[special], 1)
        if len(which):
            total += np.bincount(owner[piece], weights=counts[which], minlength=n).astype(np.int64)
    return np.diff(offsets), total


def counted(docs: DataFrame, columns: list[str], path: str, limit: int = 1024) -> DataFrame:
    """``columns`` of every row plus n_bytes, n_tokens and over_limit."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            size, tokens = count_tokens(part.column(held), path)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(size), pa.array(tokens), pa.array(tokens > limit)], schema=arrow)

    return map_arrow(narrow, run, schema, OWNER)
