"""Feature-collection documents (JSON text) to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_features(df: DataFrame, doc: str, properties: str) -> DataFrame:
    """One row per point feature: its properties as a struct, and lon / lat."""
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties.replace(' ', ': ')}>, geometry: STRUCT<coordinates: ARRAY<DOUBLE>>>>"
    rows = df.withColumn("_f", F.explode(F.from_json(doc, schema)["features"]))
    return rows.select(
        *[c for c in df.columns if c != doc], F.col("_f.properties").alias("properties"),
        F.get("_f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("_f.geometry.coordinates", F.lit(1)).alias("lat"),
    )
