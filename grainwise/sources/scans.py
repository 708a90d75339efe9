"""Reading: typed scans, file-tagged scans, semi scans, report-shaped sheets, verbatim text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_typed(
    spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None,
    fmt: str = "parquet", **options: str,
) -> DataFrame:
    """Read with an explicit schema and only the wanted columns; codes stay strings."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    return df.select(*columns) if columns else df


def scan_csv_latin1(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Latin-1 CSV with a header whose names may be quoted."""
    df = spark.read.schema(schema).csv(path, header=True, encoding="ISO-8859-1", enforceSchema=True)
    return df.toDF(*[c.strip().strip('"') for c in df.columns])


def scan_files_with_key(
    spark: SparkSession, path: str | list[str], pattern: str, column: str, schema: T.StructType,
    fmt: str = "csv", cast: str = "long", **options: str,
) -> DataFrame:
    """Read many files as one table, tagging each row with a key found in its file path."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(path)
    key = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast(cast)
    return df.select("*", key.alias(column))


def scan_semi(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep rows whose key occurs in ``keys``; the join strategy is left to Spark."""
    return df.join(keys.select(*on), list(on), "left_semi")


def scan_text_verbatim(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every column as text, so that writing it back changes nothing."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, nullValue="\u0000", emptyValue="")


def locate_block(df: DataFrame, label: str, suffix: str, number: str) -> DataFrame:
    """Data rows of a report-shaped sheet: label ends in ``suffix`` and ``number`` parses."""
    return df.where(F.col(label).endswith(suffix) & F.trim(F.col(number)).try_cast("double").isNotNull())


def header_map(header: DataFrame, order: str) -> dict[str, tuple[str, str]]:
    """Column -> (upper, lower) header text from the two header rows of a sheet."""
    rows = header.orderBy(order).drop(order).limit(2).collect()
    top, low = (r.asDict() for r in rows)
    out, last = {}, ""
    for c in top:
        last = (top[c] or "").strip() or last
        out[c] = (last, (low[c] or "").strip())
    return out


def select_rename(df: DataFrame, names: Mapping[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """Pick, rename and reorder columns; columns listed as optional may be absent."""
    return df.select(*[F.col(old).alias(new) for old, new in names.items() if old in df.columns or old not in optional])


def fixed_text(c: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals; NULL becomes an empty cell."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("")
