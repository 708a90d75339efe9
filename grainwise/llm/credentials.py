"""Secret scan with multipart credential linking (operator 5).

Base spans (assignments, access identifiers, long hex runs) are always reported. Beside them a text may hold weak parts:
identifiers (user names, client or key ids), secrets (mixed-case random runs, values of password-like names) and
endpoints (URLs, addresses). A weak part is reported only where a complementary part lies in the same scope, the interval
between two blank lines: an identifier needs a secret, a secret needs an identifier or an endpoint, an endpoint needs a
secret. Base spans count as parts (access: identifier, assign and hex: secret).

Parts and scopes are joined as intervals: a scope is one row with the roles that occur in it, and its weak parts are kept
by a semi-join with that row. No pairs of parts are formed, however many a scope holds.

Defined cases: null text counts as empty; an empty table gives an empty result; repeated rows are scanned each; offsets
are code points, the end is exclusive; columns of the input may have any names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm import textblocks as tb
from grainwise.llm.shipping import free_name, map_arrow
from grainwise.session import scratch_path

#: Kinds in the order in which equal starts are listed: the base ones, then those of the method.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WEAK_IDENTIFIER = re.compile(r"""\b(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9._@+-]{3,})""", re.IGNORECASE | re.ASCII)
WEAK_VALUE = re.compile(r"""\b(?:pass(?:phrase)?|pwd|auth|credentials?|private_?key|secret_?key|access_?key|key)["']?\x20{0,4}[:=]\x20{0,4}["']?([A-Za-z0-9+/_.!@#$%^&*=-]{6,})""", re.IGNORECASE | re.ASCII)
WEAK_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b""", re.IGNORECASE | re.ASCII)
#: Strings without which (in lower case) a pattern can't match.
NEEDS = {ASSIGN: ("passw", "secret", "token", "api"), WEAK_IDENTIFIER: ("user", "login", "account", "client", "key"), WEAK_VALUE: ("pass", "pwd", "auth", "credential", "key")}

MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 8, 16, 32, 20
IS_HEX = np.zeros(256, bool)
IS_HEX[48:58] = IS_HEX[97:103] = True
IS_RANDOM = np.zeros(256, bool)
IS_RANDOM[48:58] = IS_RANDOM[65:91] = IS_RANDOM[97:123] = True
IS_RANDOM[[ord(c) for c in "+/_"]] = True

PARTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("scope", T.LongType())]))
SCAN = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType()), T.StructField("parts", PARTS)]

Span = tuple[str, int, int]


def _long_runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, text = tb.segments(kind[data], offsets)
    keep = ends - starts >= least
    return starts[keep], ends[keep], text[keep]


def _named(text: str, low: str, pattern: re.Pattern, group: int, least: int) -> Iterator[re.Match]:
    if any(s in low for s in NEEDS[pattern]):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield m


def _apart(parts: list[Span], spans: list[Span]) -> list[Span]:
    """The ``parts`` that overlap none of ``spans``: by the furthest end of the spans that start before a part ends."""
    if not spans:
        return parts
    spans = sorted(spans, key=lambda p: p[1])
    starts = [s for _, s, _ in spans]
    ends = list(accumulate((e for _, _, e in spans), max))
    return [p for p in parts if not (k := bisect_left(starts, p[2])) or ends[k - 1] <= p[1]]


def scan_texts(column: pa.Array) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, weak parts) of each text, each in listed order; weak parts that overlap a base span are left out."""
    data, offsets = tb.flat(column)
    n = len(offsets) - 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base: list[list[Span]] = [[] for _ in range(n)]
    weak: list[list[Span]] = [[] for _ in range(n)]
    raw = data.tobytes()
    for out, kind, table, least in ((base, "hex", IS_HEX, MIN_HEX), (weak, "secret", IS_RANDOM, MIN_RANDOM)):
        starts, ends, owner = _long_runs(data, offsets, table, least)
        for s, e, i in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
            run = raw[s:e]
            if kind == "secret" and not (re.search(rb"[a-z]", run) and re.search(rb"[A-Z]", run) and re.search(rb"[0-9]", run)):
                continue
            head = points[offsets[i]]
            out[i].append((kind, int(points[s] - head), int(points[e] - head)))
    for i, value in enumerate(column.to_pylist()):
        if not value:
            continue
        low = value.lower()
        base[i] += [("assign", *m.span()) for m in _named(value, low, ASSIGN, 2, MIN_ASSIGN)]
        if "AKIA" in value:
            base[i] += [("access", *m.span()) for m in ACCESS.finditer(value) if m.end() - m.start() >= MIN_ACCESS]
        weak[i] += [("identifier", *m.span(1)) for m in _named(value, low, WEAK_IDENTIFIER, 1, 1)]
        weak[i] += [("secret", *m.span(1)) for m in _named(value, low, WEAK_VALUE, 1, 1)]
        if "://" in value or value.count(".") > 2:
            weak[i] += [("endpoint", *m.span()) for m in WEAK_ENDPOINT.finditer(value)]
        if weak[i]:
            weak[i] = _apart(list(dict.fromkeys(weak[i])), base[i])
    order = lambda spans: sorted(spans, key=lambda p: (p[1], KINDS.index(p[0]), p[2]))
    return [order(b) for b in base], [order(w) for w in weak]


def _scopes(text: str, spans: list[Span]) -> list[int]:
    """The start of the paragraph (text between blank lines) of each span."""
    if not spans:
        return []
    edges = np.array([0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))])
    return edges[np.searchsorted(edges, [s for _, s, _ in spans], "right") - 1].tolist()


def scanned(docs: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """``columns`` of every row, the base figures and the parts (weak ones only where a complement could exist)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    held = free_name(columns, "text")
    narrow = docs.select(*columns, F.col("text").cast("string").alias(held))
    schema = T.StructType([*docs.select(*columns).schema.fields, *(T.StructField(prefix + f.name, f.dataType) for f in SCAN)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, held):
            texts = part.column(held)
            found = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "parts")}
            for text, base, weak in zip(texts.to_pylist(), *scan_texts(texts), strict=True):
                for kind in KINDS[:3]:
                    found["n_" + kind].append(sum(p[0] == kind for p in base))
                found["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
                spans = base + weak
                found["parts"].append([{"kind": k, "start": s, "end": e, "scope": z} for (k, s, e), z in zip(spans, _scopes(text or "", spans), strict=True)])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(found[f.name], arrow.field(prefix + f.name).type) for f in SCAN)], schema=arrow)

    return map_arrow(narrow, run, schema)


def _role(kind: Column) -> Column:
    return F.when(kind.isin("access", "identifier"), "identifier").when(kind == "endpoint", "endpoint").otherwise("secret")


def linked(parts: DataFrame) -> DataFrame:
    """The weak rows of ``parts`` (row, kind, start, end, scope) whose scope has a complementary part."""
    secret = _role(F.col("kind")) == "secret"
    scopes = parts.groupBy("row", "scope").agg(F.bool_or(secret).alias("has_secret"), F.bool_or(~secret).alias("has_other"))
    both = scopes.filter("has_secret and has_other").select("row", "scope")
    return parts.filter(F.col("kind").isin(*KINDS[3:])).join(both, ["row", "scope"], "left_semi").select("row", "kind", "start", "end").distinct()


def _listed(spans: Column) -> Column:
    """Spans in listed order."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    keyed = F.transform(spans, lambda p: F.struct(p["start"].alias("start"), rank(p["kind"]).alias("rank"), p["end"].alias("end"), p["kind"].alias("kind")))
    return F.array_sort(keyed)


def found(docs: DataFrame, columns: list[str], mark: str = "__secret_") -> DataFrame:
    """``columns`` of every row, its base figures, and ``spans``: base and linked weak spans in listed order."""
    spark = docs.sparkSession
    path = scratch_path(spark, "secrets")
    row = mark + "row"
    scanned(docs.withColumn(row, F.monotonically_increasing_id()), [*columns, row], mark).write.parquet(path)
    stage = spark.read.parquet(path)
    # Only rows with a weak part and a possible complement go through the join.
    parts = stage.select(F.col(row).alias("row"), F.col(mark + "parts").alias("parts"))
    is_weak = lambda p: p["kind"].isin(*KINDS[3:])
    open_rows = parts.filter(F.exists("parts", is_weak) & (F.size(F.array_distinct(F.transform("parts", lambda p: _role(p["kind"])))) > 1))
    links = linked(open_rows.select("row", F.inline("parts")))
    per_row = links.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    base = F.transform(F.filter(mark + "parts", lambda p: ~is_weak(p)), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    joined = stage.join(per_row.select(F.col("row").alias(row), F.col("weak").alias(mark + "weak")), row, "left")
    spans = _listed(F.when(F.col(mark + "weak").isNull(), base).otherwise(F.concat(base, F.col(mark + "weak"))))
    return joined.select(*columns, *(F.col(mark + c).alias(mark + c) for c in ("n_assign", "n_access", "n_hex", "base_sha256")), spans.alias(mark + "spans"))


def redact(docs: DataFrame, shown: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced; spans that overlap are replaced once. Columns as in ``docs``; n_chars follows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    mark = "__secret_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    rows = found(docs, docs.columns, mark)
    spans = F.when(F.size(mark + "spans") > 0, F.transform(mark + "spans", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    arrow = to_arrow_schema(docs.schema)

    def clean(text: str, spans: list[dict]) -> str:
        pieces, at = [], 0
        for p in spans:
            if p["start"] >= at:
                pieces += [text[at : p["start"]], shown]
            at = max(at, p["end"])
        return "".join([*pieces, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            columns = dict(zip(arrow.names, part.columns[:-1], strict=True))
            hit = [k for k, p in enumerate(part.column(len(arrow.names)).to_pylist()) if p]
            if hit:
                listed = part.column(len(arrow.names))
                texts = columns["text"].cast(pa.string()).to_pylist()
                sizes = columns["n_chars"].to_pylist() if "n_chars" in columns else None
                for k in hit:
                    texts[k] = clean(texts[k], listed[k].as_py())
                    if sizes:
                        sizes[k] = len(texts[k])
                columns["text"] = pa.array(texts, pa.string())
                if sizes:
                    columns["n_chars"] = pa.array(sizes).cast(arrow.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=arrow.names).cast(arrow)

    return map_arrow(rows.select(*docs.columns, spans.alias(mark + "spans")), run, docs.schema)
