"""Byte-level BPE encoding and decoding by DuckDB recursive queries per partition (operator 1).

Spark deals the rows; a task cuts them into slices of bounded size and splits the texts before the merges. The distinct
pre-tokens that the worker has not met yet go to a DuckDB database of the worker as (word, position, token) rows. A
recursive query joins neighbours with the merge table, contracts each word's leftmost pair of least rank and repeats
until no word has a pair; an ordered aggregation gives the ids. Decoding joins (word, position, id) rows with the
vocabulary and aggregates the bytes in order.

The merge table holds every split of every vocabulary entry into two entries, ranked by the entry. A pre-token that is
an entry itself stands as it is. Words longer than ``LONG_WORD`` bytes are encoded in pieces, so that their cost grows
with their length: two encoded pieces join to the encoding of the whole if the bytes of the two tokens at the border
encode to just these tokens (no merge crosses it). Where they don't, the tokens around the border are encoded again as a
piece of their own, over a reach that doubles until all borders stand.

Defined cases: null text encodes as the empty text (no ids; both digests are those of the empty string); repeated rows
are encoded each; control strings have no special meaning.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import caches, pretokens
from grainwise.llm import textblocks as tb
from grainwise.llm.caches import Generations
from grainwise.llm.shipping import free_name, map_arrow

#: Texts worked on at once: larger slices give the recursive query more words a call.
ENCODE_BYTES = 2 << 20
#: Words of one generation of a worker's memory; results don't depend on it.
KEPT_WORDS = 200_000
#: Words of one recursive query.
QUERY_WORDS = 20_000
LONG_WORD = 48
OWNER = "byte_bpe"
#: Bytes of a piece of a long word.
PIECE = 32


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# A word's state is its tokens in order and its best pair as rank * 2^32 + position (null: finished). Each step unnests
# the contracted words into (word, position, token, next token) rows and joins them with the merge table.
ENCODE = """
WITH RECURSIVE state(w, toks, best) AS (
  SELECT l.w, l.toks, b.best
  FROM (SELECT w, list(tok ORDER BY pos) AS toks FROM positions GROUP BY w) l
  JOIN (SELECT p.w, min(m.whole * 4294967296 + p.pos + 1) AS best
        FROM positions p
        LEFT JOIN positions q ON q.w = p.w AND q.pos = p.pos + 1
        LEFT JOIN merges m ON m.lft = p.tok AND m.rgt = q.tok
        GROUP BY p.w) b ON b.w = l.w
  UNION ALL
  SELECT u.w, any_value(u.toks), min(m.whole * 4294967296 + u.pos)
  FROM (SELECT w, toks, unnest(toks) AS tok, unnest(toks[2:]) AS nxt, generate_subscripts(toks, 1) AS pos
        FROM (SELECT w, toks[:best % 4294967296 - 1] || [best // 4294967296] || toks[best % 4294967296 + 2:] AS toks
              FROM state WHERE best IS NOT NULL)) u
  LEFT JOIN merges m ON m.lft = u.tok AND m.rgt = u.nxt
  GROUP BY u.w
)
SELECT w, array_to_string(toks, ',') AS ids FROM state WHERE best IS NULL
"""
DECODE = """
SELECT w, string_agg(hex(v.bytes), '' ORDER BY i.pos) AS text
FROM ids i JOIN vocab v ON v.id = i.id GROUP BY w
"""


class DuckBpe:
    """The encoder and decoder of one worker."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "250MB", "preserve_insertion_order": False, "temp_directory": tempfile.gettempdir()})
        lft, rgt, whole = [], [], []
        ranks = self.ranks
        for b, r in ranks.items():
            for k in range(1, len(b)):
                a, c = ranks.get(b[:k]), ranks.get(b[k:])
                if a is not None and c is not None:
                    lft.append(a)
                    rgt.append(c)
                    whole.append(r)
        merges = pa.table({"lft": pa.array(lft, pa.int64()), "rgt": pa.array(rgt, pa.int64()), "whole": pa.array(whole, pa.int64())})
        vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "bytes": pa.array(list(ranks), pa.binary())})
        for name, rows in (("merges", merges), ("vocab", vocab)):
            self.con.register("incoming", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
            self.con.unregister("incoming")
        self.bytes = {r: b for b, r in ranks.items()}
        self.stands: dict[tuple[int, int], bool] = {}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.kept = Generations(KEPT_WORDS)

    def _run(self, sql: str, name: str, rows: pa.Table) -> list[tuple]:
        self.con.register(name, rows)
        try:
            return self.con.execute(sql).fetchall()
        finally:
            self.con.unregister(name)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The recursive query over non-empty words: ids of each, as decimals joined by commas."""
        out: list[bytes] = [b""] * len(words)
        for lo in range(0, len(words), QUERY_WORDS):
            part = words[lo : lo + QUERY_WORDS]
            size = np.array([len(w) for w in part])
            data = np.frombuffer(b"".join(part), np.uint8)
            pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            rows = pa.table({"w": np.repeat(np.arange(len(part)), size), "pos": pos, "tok": self.byte[data]})
            for w, ids in self._run(ENCODE, "positions", rows):
                out[lo + w] = ids.encode()
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as decimals joined by commas."""
        out: list[bytes] = [b""] * len(words)
        short, long = [], []
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = b"%d" % whole
            elif w:
                (short if len(w) <= LONG_WORD else long).append(i)
        for todo, fn in ((short, self.merge), (long, self.merge_pieces)):
            for i, ids in zip(todo, fn([words[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _lists(self, pieces: list[bytes]) -> list[list[int]]:
        return [[int(x) for x in ids.split(b",")] for ids in self.merge(pieces)]

    def merge_pieces(self, words: list[bytes]) -> list[bytes]:
        """As ``merge``, for long words: pieces first, then the borders that don't stand."""
        cuts = [range(0, len(w), PIECE) for w in words]
        done = iter(self._lists([w[k : k + PIECE] for w, c in zip(words, cuts, strict=True) for k in c]))
        state = [[next(done) for _ in c] for c in cuts]
        reach = 1
        while True:
            if len(self.stands) > KEPT_WORDS:
                self.stands.clear()
            borders = {(a[-1], b[0]) for s in state for a, b in zip(s, s[1:], strict=False)}
            ask = [p for p in borders if p not in self.stands]
            for p, ids in zip(ask, self._lists([self.bytes[a] + self.bytes[b] for a, b in ask]), strict=True):
                self.stands[p] = ids == list(p)
            again: list[bytes] = []
            for i, pieces in enumerate(state):
                new: list[list[int] | int] = []
                left = pieces[0]
                for right in pieces[1:]:
                    if not left or self.stands[left[-1], right[0]]:
                        new += [left] if left else []
                        left = right
                        continue
                    again.append(b"".join(self.bytes[t] for t in left[-reach:] + right[:reach]))
                    new += [left[:-reach], len(again) - 1] if left[:-reach] else [len(again) - 1]
                    left = right[reach:]
                state[i] = new + ([left] if left else [])
            if not again:
                return [b",".join(b"%d" % t for piece in s for t in piece) for s in state]
            fixed = self._lists(again)
            state = [[fixed[p] if isinstance(p, int) else p for p in s] for s in state]
            reach *= 2

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids (decimals joined by commas)."""
        size = np.array([x.count(b",") + 1 if x else 0 for x in ids], np.int64)
        flat = np.array(b",".join(x for x in ids if x).split(b",") if size.sum() else [], dtype="S20").astype(np.int64)
        out = [b""] * len(ids)
        if not len(flat):
            return out
        rows = pa.table({"w": np.repeat(np.arange(len(ids)), size), "pos": np.arange(len(flat)), "id": flat})
        for w, text in self._run(DECODE, "ids", rows):
            out[w] = bytes.fromhex(text)
        return out

    def words(self, distinct: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of distinct words, from what the worker has or from DuckDB."""
        found = [self.kept.get(w) for w in distinct]
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            ids = self.encode([distinct[i] for i in new])
            for i, got, text in zip(new, ids, self.decode(ids), strict=True):
                w = distinct[i]
                found[i] = got if text == w else (got, text)  # the ids alone where equal, to save memory
                if len(w) <= LONG_WORD:
                    self.kept.put(w, found[i])
        return [f if isinstance(f, tuple) else (f, w) for f, w in zip(found, distinct, strict=True)]


_tools: dict[str, DuckBpe] = {}


def _close() -> None:
    for bpe in _tools.values():
        bpe.con.close()
    _tools.clear()


def tool(path: str) -> DuckBpe:
    """The worker's database for a vocabulary file, kept between tasks."""
    if path not in _tools:
        _tools[path] = DuckBpe(path)
        caches.hold(OWNER, _close)
    return _tools[path]


def encode_texts(text: pa.Array, path: str) -> Iterator[tuple[bytes, bytes]]:
    """(ids joined by commas, decoded bytes) of each text."""
    bpe = tool(path)
    data, offsets = tb.flat(text)
    n = len(offsets) - 1
    starts, ends, owner = pretokens.split(data, offsets)
    which, distinct = tb.numbered(data, starts, ends)
    found = bpe.words(distinct.to_pylist())
    ids = [f[0] for f in found]
    decoded = [f[1] for f in found]
    cut = np.searchsorted(owner, np.arange(n + 1)).tolist()
    which = which.tolist()
    for i in range(n):
        mine = which[cut[i] : cut[i + 1]]
        yield b",".join([ids[k] for k in mine]), b"".join([decoded[k] for k in mine])


def encoded(docs: DataFrame, columns: list[str], path: str, with_ids: bool = False) -> DataFrame:
    """``columns`` of every row plus n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    extra = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        extra.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([*docs.select(*columns).schema.fields, *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held, ENCODE_BYTES):
            n, a, b, lists = [], [], [], []
            for ids, text in encode_texts(part.column(held), path):
                n.append(ids.count(b",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    lists.append(np.array(ids.split(b",") if ids else [], dtype="S20").astype(np.int32))
            more = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if with_ids:
                more.append(pa.array(lists, pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *more], names=arrow.names)
            yield out.cast(arrow)

    return map_arrow(narrow, run, schema, OWNER)
