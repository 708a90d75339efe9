"""Bounded training samples for the classifiers, and the held-out fold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> pa.Table:
    """At most ``max_rows`` labelled texts outside the held-out fold, picked by the hash of doc_id: (text, label).

    Null labels and ids aren't used; of repeated labels the largest counts, of repeated documents the smallest text.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    usable = usable.filter(fold(F.col("doc_id"), folds) != held_out)
    picked = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The picked ids are bounded by max_rows, so that a broadcast is safe at any corpus size.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label").toArrow()
