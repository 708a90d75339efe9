"""Registered queries of the training-data operators: each reads whole tables and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from grainwise.llm import byte_bpe, chat, credentials, decontaminate, merkle, quality_machine, quality_rules, runs, simhash, suffix_dedup, token_counts, toxic_spans, warc
from grainwise.llm.labelled import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.grouped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.references(docs), ["doc_id"])


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxic_spans.scored(docs, toxic_spans.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = fold(F.col("doc_id"), 4) == 2
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


@query
def op9_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_machine.scored(docs, quality_machine.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    held_out = fold(F.col("doc_id"), 5) == 0
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.captures(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


ORACLES["op2_warc"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
     g AS (SELECT d, max(page_id) AS original FROM p WHERE n >= {warc.MIN_REVISIT_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND n >= {warc.MIN_REVISIT_BYTES}
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = "__secret_"
    rows = credentials.found(table(spark, sf_dir, "documents"), ["doc_id"], mark=mark)
    listed = F.concat_ws(",", F.transform(mark + "spans", lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))))
    return rows.select("doc_id", *(F.col(mark + c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256")), listed.alias("spans"))


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.read_back(chat.assembled(rows.unionByName(extra), path), path))


ORACLES["op6_chat"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, {chat.escape_sql("role")} AS role_out, {chat.escape_sql("text")} AS text_out FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role_out) + length(text_out) + {len(chat.TURN + chat.BODY + chat.STOP)}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def _encoded_sql(*columns: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


# CRC-32 of the decimal id: each byte is mixed in once, then eight shifts follow.
ORACLES["op13_merkle"] = f"""
WITH RECURSIVE
rows_in AS (SELECT row_number() OVER () AS r, doc_id, {_encoded_sql("lang")} AS g, lang,
                   sha256({_encoded_sql("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
                   sha256({_encoded_sql("doc_id", "source", "lang", "n_chars + 1", "text")}) AS altered,
                   xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
                       string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CASE WHEN c = '' THEN CAST([] AS BIGINT[]) ELSE [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] END))),
                       lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END)) AS crc
            FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM rows_in),
nodes(g, h, i, n, d) AS (
  SELECT g, 0, i, n, leaf FROM leaves
  UNION ALL SELECT g, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, h, i // 2, n),
subroots AS (SELECT s.g, s.d, row_number() OVER (ORDER BY l.lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
             FROM nodes s JOIN (SELECT g, any_value(lang) AS lang FROM leaves GROUP BY g) l ON l.g = s.g WHERE s.n = 1),
tops(h, i, n, d) AS (
  SELECT 0, i, n, d FROM subroots
  UNION ALL SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY h, i // 2, n),
steps AS (
  SELECT l.r, v.h AS step, (l.i >> v.h) & 1 AS side, s.d
  FROM leaves l JOIN (SELECT DISTINCT g, h FROM nodes WHERE n > 1) v ON v.g = l.g
  LEFT JOIN nodes s ON s.g = l.g AND s.h = v.h AND s.i = xor(l.i >> v.h, 1)
  UNION ALL
  SELECT l.r, 1000 + v.h, (q.i >> v.h) & 1, s.d
  FROM leaves l JOIN subroots q ON q.g = l.g JOIN (SELECT DISTINCT h FROM tops WHERE n > 1) v ON true
  LEFT JOIN tops s ON s.h = v.h AND s.i = xor(q.i >> v.h, 1)),
proofs AS (SELECT r, coalesce(string_agg(d, '' ORDER BY step), '') AS siblings,
                  list(CASE WHEN d IS NULL THEN '-' WHEN side = 0 THEN '0' || d ELSE '1' || d END ORDER BY step) AS path FROM steps GROUP BY r),
folds AS (SELECT l.doc_id, l.leaf, q.d AS subroot, t.d AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
                 list_reduce(list_prepend(CASE WHEN l.crc % 7 = 0 THEN l.altered ELSE l.leaf END, coalesce(p.path, CAST([] AS VARCHAR[]))),
                             lambda a, c: sha256(CASE WHEN c[1] = '0' THEN a || c[2:] WHEN c[1] = '1' THEN c[2:] || a ELSE a END)) AS folded_root
          FROM leaves l JOIN subroots q ON q.g = l.g JOIN tops t ON t.n = 1 LEFT JOIN proofs p ON p.r = l.r)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    rows = runs.detected(docs, ["doc_id"])
    # Greatest length first; ties by smallest start, then period.
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = rows.withColumn("top", top)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.call_function("div", F.col("top.length") * 1000, -F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
