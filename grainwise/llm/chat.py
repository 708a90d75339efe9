"""Chat formatting by token-level assembly (operator 6).

A turn becomes ``<|turn|>role<|body|>text<|end|>``. Role and text are escaped and encoded as segments of their own; the
control strings are reserved ids behind the vocabulary, spliced between the segments, so that no text can produce one.
Segment lengths are summed up to positions, from which the loss mask (the text of assistant turns) follows. Control
strings that occur in a text (those of the template and of common others) are escaped reversibly: backslashes are
doubled, and a single backslash goes behind the first character of a control string.

Turns are assembled and read back row by row, wherever they lie; only the digests need a conversation's turns in order,
which one task streams with constant memory.

Defined cases: null text or role counts as empty; turns with equal numbers are ordered by role and text; rows with a null
conv_id form one conversation; an empty table gives no conversations.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import map_arrow

TURN, BODY, STOP = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that must not occur in a formatted text outside their own place.
CONTROL = (TURN, BODY, STOP, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")

#: An assembled turn: ids with the reserved ones, the token positions of its segments, and the range under the loss mask.
TURNS = [
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("loss_start", T.LongType()),
    T.StructField("loss_stop", T.LongType()),
]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_sql(column: str) -> str:
    """``escape`` as SQL over a text column."""
    out = f"replace({column}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


class Codec:
    """Encoder of segments and reader of assembled turns, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 1
        self.reserved = {s: first + i for i, s in enumerate((TURN, BODY, STOP))}

    def assemble(self, roles: list[str], texts: list[str], learned: frozenset[str]) -> Iterator[tuple[np.ndarray, int, int]]:
        """(ids, loss start, loss stop) of each turn; positions are prefix sums of the segment lengths."""
        encode = self.encoding.encode_ordinary
        turn, body, stop = (np.array([self.reserved[s]], np.int32) for s in (TURN, BODY, STOP))
        known: dict[str, np.ndarray] = {}
        for role, text in zip(roles, texts, strict=True):
            if role not in known:
                known[role] = np.array(encode(escape(role)), np.int32)
            segments = [turn, known[role], body, np.array(encode(escape(text)), np.int32), stop]
            ends = np.cumsum([len(s) for s in segments])
            loss = (int(ends[2]), int(ends[3])) if role in learned else (0, 0)
            yield np.concatenate(segments), *loss

    def _text(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8")

    def read(self, ids: np.ndarray, loss_start: int, loss_stop: int) -> tuple[str, str, str, int]:
        """(role, text, text under the loss mask, code points of the formatted turn), from the assembled ids alone."""
        marks = [np.flatnonzero(ids == self.reserved[s]) for s in (TURN, BODY, STOP)]
        if [len(m) for m in marks] != [1, 1, 1]:
            raise ValueError("not an assembled turn")
        a, b, c = (int(m[0]) for m in marks)
        role, text = self._text(ids[a + 1 : b]), self._text(ids[b + 1 : c])
        formatted = len(TURN) + len(role) + len(BODY) + len(text) + len(STOP)
        return unescape(role), unescape(text), unescape(self._text(ids[loss_start:loss_stop])), formatted


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _assembled(part: pa.RecordBatch, path: str, learned: frozenset[str]) -> tuple[list[np.ndarray], list[int], list[int]]:
    got = list(codec(path).assemble(part.column("role").to_pylist(), part.column("text").to_pylist(), learned))
    return [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]


def assembled(conversations: DataFrame, path: str, learned: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """conv_id, turn, role and the assembled turn of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _turns(conversations)
    schema = T.StructType([*rows.select("conv_id", "turn", "role").schema.fields, *TURNS])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            ids, start, stop = _assembled(part, path, learned)
            more = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *more], names=arrow.names).cast(arrow)

    return map_arrow(rows, run, schema)


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role, text, loss (text under the mask), formatted_chars and n_tokens, from assembled turns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = turns.select("conv_id", "turn", "ids", "loss_start", "loss_stop")
    extra = [T.StructField(c, T.StringType()) for c in ("role", "text")] + [T.StructField("learned", T.BooleanType()), T.StructField("formatted_chars", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*rows.select("conv_id", "turn").schema.fields, *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[tuple] = []
            for ids, start, stop in zip(part.column("ids"), part.column("loss_start").to_pylist(), part.column("loss_stop").to_pylist(), strict=True):
                flat = ids.values.to_numpy()
                role, text, loss, formatted = codec(path).read(flat, start, stop)
                if stop > start and loss != text:
                    raise ValueError("the loss mask doesn't cover the turn's text")
                out.append((role, text, stop > start, formatted, len(flat)))
            columns = [pa.array([o[k] for o in out], arrow.field(2 + k).type) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=arrow.names).cast(arrow)

    return map_arrow(rows, run, schema)


DIGESTS = T.StructType(
    [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
)


def digests(read: DataFrame) -> DataFrame:
    """One row per conversation; its turns stream through one task in order, in constant memory."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = read.select("conv_id", "turn", "role", "text", "learned", "formatted_chars").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([read.schema["conv_id"], *DIGESTS.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state is not None:
                turns, all_, chars, loss, formatted = state
                done.append((now, turns, all_.hexdigest(), chars, loss.hexdigest(), formatted))

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], arrow.field(k).type) for k in range(6)], schema=arrow)
            done.clear()
            return out

        for part in tb.slices(batches):
            for conv, _, role, text, learned, formatted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if learned:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += formatted
            if len(done) >= 1000:
                yield batch()
        close()
        yield batch()

    return map_arrow(ordered, run, schema)
