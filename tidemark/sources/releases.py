"""Releases: named tables read as text, catalogs, and columns resolved by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def find_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """B1: the first of several names the table carries, or None."""
    return next((n for n in names if n in df.columns), None)


def require_column(df: DataFrame, names: Sequence[str], where: str) -> str:
    """B1: as ``find_column``, but an unknown layout stops the run."""
    found = find_column(df, names)
    if found is None:
        raise ValueError(f"{where}: none of {list(names)} among {df.columns}")
    return found


def canonical(df: DataFrame, aliases: dict[str, Sequence[str]], optional: set[str], where: str) -> DataFrame:
    """B1: a release's own names mapped to canonical ones; optional columns become null."""
    cols = []
    for name, spellings in aliases.items():
        if name in optional:
            found = find_column(df, spellings)
            cols.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
        else:
            cols.append(F.col(f"`{require_column(df, spellings, where)}`").alias(name))
    return df.select(*cols)


def as_text(df: DataFrame) -> DataFrame:
    """A1: every column as a string, blanks as ''. Precision as written is kept by never inferring."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def read_sheet(spark: SparkSession, base: str, sheet: str, release: str | None = None) -> DataFrame:
    """A1: one named table of one release (or of all), pruned by the release partition."""
    df = spark.read.parquet(f"{base}/{sheet}")
    return df.filter(F.col("release") == release) if release else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A3: typed CSV scan; the schema is declared, never inferred."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def slim_wide(spark: SparkSession, path: str, wanted: dict[str, tuple[int, str]], out: str) -> DataFrame:
    """A5: a few columns of a very wide CSV, after the header at each position is checked.

    ``wanted``: new name -> (position, header). Written once as Parquet, then read from there.
    """
    wide = spark.read.option("header", True).csv(path)
    for name, (at, header) in wanted.items():
        if at >= len(wide.columns) or wide.columns[at] != header:
            seen = wide.columns[at] if at < len(wide.columns) else None
            raise ValueError(f"column {at} is {seen!r}, not {header!r} ({name})")
    wide.select(*[F.col(f"`{h}`").alias(n) for n, (_, h) in wanted.items()]).write.mode("errorifexists").parquet(out)
    return spark.read.parquet(out)


def month_of_name(name: Column) -> Column:
    """Release month from a file name such as ``..-March-2025-V2.xlsx``."""
    month = F.regexp_extract(name, r"(January|February|March|April|May|June|July|August|September|October|November|December)", 1)
    year = F.regexp_extract(name, r"((?:19|20)\d{2})", 1)
    text = F.concat(year, F.lit("-"), month, F.lit("-01"))
    return F.when((month != "") & (year != ""), F.date_format(F.to_date(text, "yyyy-MMMM-dd"), "yyyy-MM"))


def one_file_per_month(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """A pinned file first, then a second version, then the name.

    ``files``: name. ``pinned``: name. Catalogs have one row per file.
    """
    p = pinned.select("name", F.lit(1).alias("_pin")).distinct()
    f = files.join(p, "name", "left").withColumn("month", month_of_name(F.col("name")))
    order = F.struct(F.coalesce("_pin", F.lit(0)), F.col("name").contains("V2").cast("int"), "name")
    return f.filter("month is not null").groupBy("month").agg(F.max_by("name", order).alias("name"))


def resolve_pins(pins: DataFrame, files: DataFrame) -> DataFrame:
    """How many files each pinned key names; anything but one is a failure."""
    hit = files.select("name", F.lit(1).alias("_f"))
    return pins.join(hit, "name", "left").groupBy("key").agg(
        F.count("_f").alias("files"), F.max(F.when(F.col("_f") == 1, F.col("name"))).alias("file")
    ).withColumn("state", F.when(F.col("files") == 1, "resolved").when(F.col("files") == 0, "absent").otherwise("ambiguous"))


def read_dated_text(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Numeric rows of a text file with a preamble and a footer.

    Data rows start with eight digits and a comma; the header is the line just above the first of
    them. A factor file has one line per day, so a file is one row until it is split.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"), F.col("_metadata.file_path").alias("file")
    )
    is_row = F.col("line").rlike(r"^\s*\d{8}\s*,")
    first = lines.filter(is_row).groupBy("file").agg(F.min("at").alias("_first"))
    j = lines.join(first, "file")
    head = j.filter(F.col("at") == F.col("_first") - 1).select("file", F.split("line", ",").alias("_h"))
    cells = F.split("line", ",")
    body = j.filter(is_row).join(head, "file")
    value = lambda name: F.trim(
        F.element_at(cells, F.array_position(F.transform("_h", lambda h: F.trim(h)), F.lit(name)).cast("int"))
    ).try_cast("double")
    return body.select(
        F.to_date(F.trim(F.element_at(cells, 1)), "yyyyMMdd").alias("date"),
        *[value(c).alias(c) for c in columns],
    )
