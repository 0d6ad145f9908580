"""Raw JSON payloads: shapes, nested records, files of overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every ``endpoint/symbol[__window].json.gz`` below ``path`` as one row of text.

    A payload file is one vendor response, so one row per file is bounded by one response.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.col("_metadata.file_path")
    return files.select(
        F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("endpoint"),
        F.split_part(F.regexp_extract(name, r"([^/]+)\.json(\.gz)?$", 1), F.lit("__"), F.lit(1)).alias("symbol"),
        name.alias("file"), F.col("value").alias("payload"),
    )


def rows_of(payload: Column, row: str) -> Column:
    """An array of records from a list, ``{historical: [..]}``, ``{data: [..]}`` or one object."""
    text = F.trim(payload)
    listed = F.from_json(text, f"array<{row}>")
    wrapped = F.from_json(text, f"struct<historical: array<{row}>, data: array<{row}>>")
    single = F.from_json(text, row)
    return (
        F.when(text.startswith("["), listed)
        .when(wrapped["historical"].isNotNull(), wrapped["historical"])
        .when(wrapped["data"].isNotNull(), wrapped["data"])
        .when(text.startswith("{"), F.array(single))
    )


def first_field(df: DataFrame, *names: str) -> Column:
    """A10: the first of several fields that holds a value; absent columns are passed over."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def merge_windows(rows: DataFrame) -> DataFrame:
    """One row per (endpoint, symbol, date); of overlapping files the first one counts."""
    rest = [c for c in rows.columns if c not in ("endpoint", "symbol", "date")]
    return (
        rows.groupBy("endpoint", "symbol", "date")
        .agg(F.min_by(F.struct(*rest), "file").alias("_r"))
        .select("endpoint", "symbol", "date", "_r.*")
    )


def explode_records(nested: DataFrame, key: str, records: str, fields: list[str]) -> DataFrame:
    """Nested records to distinct candidate rows."""
    return nested.select(key, F.explode(records).alias("_r")).select(
        key, *[F.col(f"_r.{f}").alias(f) for f in fields]
    ).dropDuplicates()
