"""WARC archives: writing, reading back and transaction assembly (operator 2).

Writing: one row becomes three records, tied by ``WARC-Concurrent-To``: the response (or a revisit of the response with
an equal payload), its request, and a metadata record that carries the row's key. Records are lines of Spark's text sink
whose separator is the record end, so that the files are plain gzipped WARC, written by the tasks in parallel and
committed as a whole.

Reading: each file is inflated and cut by ``Content-Length`` in a stream. Assembly: requests and metadata are reduced to
one per identifier and joined to responses and revisits; one nested row comes out per capture, and revisits are joined
to the response they refer to.

Defined cases: null payload counts as empty; a null url leaves out the header and reads back as null; line ends inside a
url are percent-encoded; every row is a capture of its own, also where key, url and payload repeat, as its place in the
table is part of its identifier; rows with the key of the response are responses too; a null key is always a response.
Payloads may hold record ends or headers of their own. A row is read several times: ``pages`` should be a stored table.

Files are bounded by bytes: rows are written by size class, larger payloads fewer to a file, the largest alone. A single
payload takes about four times its size in a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.llm.shipping import map_arrow
from grainwise.session import scratch_path

RECORD_END = "\r\n\r\n"
#: Payloads below this size aren't worth a revisit record.
MIN_REVISIT_BYTES = 1000
#: Payload bytes of a file, which the reader takes as a whole; a larger payload has a file of its own.
FILE_BYTES = 64 << 20
#: Largest payload of the first size class; each further class goes up to eight times as much.
CLASS_BYTES, CLASS_STEP = 64 << 10, 8
#: Bytes handed to the parser at once.
INFLATE_BYTES = 1 << 20

RECORDS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_id", "record_type", "target_uri", "concurrent_to", "refers_to", "header_digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha1", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())]
)


def _urn(*parts: Column) -> Column:
    """A name-based identifier as ``urn:uuid``."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines (those with null values left out) and the block."""
    lines = [F.concat(F.lit("WARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind))]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(RECORD_END), block)


def planned(pages: DataFrame, key: str, url: str, payload: str) -> tuple[DataFrame, int]:
    """key, url, payload, row, size, digest, and key, url and row of the response that a row revisits (null key: it is a response); the largest size."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("key"), F.regexp_replace(F.regexp_replace(F.col(url).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    path = scratch_path(spark, "warc-copies")
    sizes = Observation()
    seen = rows.observe(sizes, F.max("size").alias("largest"))
    copies = seen.filter(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.max(F.struct("key", "url", "row")).alias("top"), F.count("*").alias("n"))
    copies.filter("n > 1 and top.key is not null").select("digest", F.col("top.key").alias("original"), F.col("top.url").alias("original_url"), F.col("top.row").alias("original_row")).write.parquet(path)
    # A stored table of known size: Spark broadcasts it below its threshold and sorts both sides beyond.
    joined = rows.join(spark.read.parquet(path), "digest", "left")
    joined = joined.withColumn("original", F.when((F.col("size") >= MIN_REVISIT_BYTES) & (F.col("key") != F.col("original")), F.col("original")))
    return joined, sizes.get.get("largest") or 0


def write_archives(pages: DataFrame, path: str, key: str, url: str, payload: str, captured_at: str = "2024-01-01T00:00:00Z") -> None:
    rows, largest = planned(pages, key, url, payload)
    # A response is named by key, url, payload and row; revisits know those of the response they refer to.
    response_id = _urn(F.lit("response"), F.col("key"), F.col("url"), F.col("digest"), F.col("row"))
    original_id = _urn(F.lit("response"), F.col("original"), F.col("original_url"), F.col("digest"), F.col("original_row"))
    own_id = F.when(F.col("original").isNull(), response_id).otherwise(_urn(F.lit("revisit"), F.col("key"), F.col("url"), F.col("digest"), F.col("row")))
    date = F.lit(captured_at)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(RECORD_END))
    capture = _record(
        F.when(F.col("original").isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        [
            ("WARC-Record-ID", own_id),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.when(F.col("original").isNotNull(), original_id)),
            ("WARC-Profile", F.when(F.col("original").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(F.col("original").isNull(), F.concat(http, F.col("payload"))).otherwise(http),
    )
    shared = [("WARC-Date", date), ("WARC-Target-URI", F.col("url")), ("WARC-Concurrent-To", own_id)]
    request = _record(
        "request",
        [("WARC-Record-ID", _urn(F.lit("request"), own_id)), *shared, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + RECORD_END)),
    )
    metadata = _record(
        "metadata",
        [("WARC-Record-ID", _urn(F.lit("metadata"), own_id)), *shared, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("\r\n", F.concat(F.lit("key: "), F.col("key").cast("string")), F.concat(F.lit("original: "), F.col("original").cast("string")), F.lit("")),
    )
    low, high = -1, CLASS_BYTES
    while low < largest or low < 0:
        some = rows if largest <= CLASS_BYTES else rows.filter((F.col("size") > low) & (F.col("size") <= high))
        lines = some.select(F.explode(F.array(capture, request, metadata)).alias("value"))
        per_file = 3 * max(1, FILE_BYTES // high)
        lines.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
        low, high = high, high * CLASS_STEP


def _inflated(content: pa.Scalar) -> Iterator[bytes]:
    """The bytes of a file, gzipped in any number of members or plain, in pieces."""
    raw = memoryview(content.as_buffer())
    if bytes(raw[:2]) != b"\x1f\x8b":
        for at in range(0, len(raw), INFLATE_BYTES):
            yield bytes(raw[at : at + INFLATE_BYTES])
        return
    rest = raw
    while len(rest):
        member = zlib.decompressobj(31)
        piece = member.decompress(rest, INFLATE_BYTES)
        while piece or member.unconsumed_tail:
            yield piece
            piece = member.decompress(member.unconsumed_tail, INFLATE_BYTES)
        rest = memoryview(member.unused_data)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record."""
    source = iter(pieces)
    held = bytearray()

    def need(n: int) -> None:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                raise ValueError("archive ends inside a record")
            held.extend(piece)

    while True:
        while not held.strip(b"\r\n"):  # between records
            piece = next(source, None)
            if piece is None:
                return
            held[:] = piece
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            need(seen + 1)
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        size = int(headers["content-length"])
        need(end + 4 + size)
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type", "")
    payload, fields = None, None
    if kind in ("response", "revisit", "request"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif headers.get("content-type") == "application/warc-fields":
        fields = [(name.strip(), value.strip()) for name, _, value in (line.partition(":") for line in block.decode("utf-8").split("\r\n") if line)]
    digest = headers.get("warc-payload-digest")
    return (
        headers.get("warc-record-id"),
        kind,
        headers.get("warc-target-uri"),
        headers.get("warc-concurrent-to"),
        headers.get("warc-refers-to"),
        digest.partition(":")[2] if digest else None,
        len(payload) if kind == "response" else None,
        hashlib.sha1(payload).hexdigest() if kind == "response" else None,
        fields,
        payload if with_payload and kind == "response" else None,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(RECORDS)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in batches:
            for content in part.column("content"):
                for headers, block in parse_records(_inflated(content)):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) if with_payload else 0
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return map_arrow(files, run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, response, request, metadata, and the counts of the latter two."""
    responses = records.filter(F.col("record_type").isin("response", "revisit")).dropDuplicates(["record_id"])
    responses = responses.select("record_id", F.struct("record_type", "target_uri", "refers_to", "header_digest", "payload_bytes", "payload_sha1", "payload").alias("response"))

    def tied(kind: str, *columns: str) -> DataFrame:
        """One record of a kind per identifier it is concurrent to: that with the smallest identifier of its own."""
        rows = records.filter((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        one = F.min_by(F.struct(*columns), "record_id")
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(one.alias(kind), F.count_distinct("record_id").alias(f"n_{kind}"))

    return responses.join(tied("request", "record_id", "target_uri"), "record_id", "left").join(tied("metadata", "record_id", "fields"), "record_id", "left")


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read these back and assemble them."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, payload)
    stored = scratch_path(spark, "warc-records")
    read_archives(spark, path, with_payload).write.parquet(stored)
    return assemble(spark.read.parquet(stored))


def resolved(rows: DataFrame) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to (a key) of each capture; revisits are joined to what they refer to."""
    flat = rows.select(
        "record_id",
        F.col("metadata.fields")["key"].cast("long").alias("key"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.coalesce("response.payload_sha1", "response.header_digest").alias("payload_digest"),
    )
    # One read of the stored records: responses as targets, revisits as sources.
    targets = flat.filter("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"), F.col("own_bytes").alias("target_bytes"))
    revisits = flat.filter("record_type = 'revisit'").join(targets, "refers_id", "left")
    plain = flat.filter("record_type <> 'revisit'").withColumns({"refers_to": F.lit(None).cast("long"), "target_bytes": F.lit(None).cast("long")})
    both = plain.unionByName(revisits)
    return both.select("key", F.coalesce("own_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
