"""Files: sorted and write-once sinks, fingerprints, provenance and their verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import stored

RESERVED = ("script", "release_pin", "inputs")


def write_sorted_csv(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A published CSV in key order. Part files follow the global order of a range sort, so
    no single task writes the whole table."""
    df.orderBy(*keys).write.option("header", True).mode("errorifexists").csv(path)


def write_panel(df: DataFrame, path: str, date: str = "date") -> None:
    """A panel as Parquet, partitioned by year so that a year filter prunes files."""
    df.withColumn("year", F.year(date)).repartition("year", F.pmod(F.xxhash64("symbol"), F.lit(32))).write.partitionBy(
        "year"
    ).mode("errorifexists").parquet(path)


def write_once(df: DataFrame, base: str, pull: str) -> str:
    """A pull is never overwritten; a refetch goes beside it under its own stamp.

    The commit record, one row beside the pulls with the number of rows, is written last: a pull whose write was killed has
    none, no reader sees it, and its stamp stays taken.
    """
    path = f"{base}/pull={pull}"
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(path)
    record = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    record.write.mode("errorifexists").parquet(f"{commits(base)}/pull={pull}")
    return path


def commits(base: str) -> str:
    """The folder of the commit records that belong to the pulls in ``base``."""
    return base.rstrip("/") + "-commits"


def committed_pulls(spark: SparkSession, base: str) -> DataFrame:
    """Pull, n_rows of every pull whose write came to its end."""
    found = spark.read.option("basePath", commits(base)).schema("n_rows long, pull string").parquet(f"{commits(base)}/pull=*")
    return found.select("pull", "n_rows")


def latest_pull(spark: SparkSession, base: str) -> DataFrame:
    """The rows of the newest committed pull; an error if it holds other rows than its record says."""
    newest = committed_pulls(spark, base).agg(F.max_by(F.struct("pull", "n_rows"), "pull").alias("r")).first()["r"]
    if newest is None:
        raise FileNotFoundError(f"no committed pull in {base}")
    rows = spark.read.parquet(f"{base}/pull={newest['pull']}").withColumn("pull", F.lit(newest["pull"]))
    held = rows.agg(F.count(F.lit(1))).first()[0]  # from the files' footers
    if held != newest["n_rows"]:
        raise ValueError(f"pull {newest['pull']} holds {held} rows, its record says {newest['n_rows']}")
    return rows


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, bytes and sha256 of every file, whatever its size, empty files too.

    The name is the path below ``path``, so equal base names in different folders stay apart. The hash is that of
    the decompressed body for ``.gz`` files.
    """
    return stored.read(spark, path, pattern).select("name", "bytes", "sha256")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, bytes, modified of every file below ``path``, empty files too; no content is read."""
    return stored.read(spark, path, pattern, hashed=False).select("name", "bytes", "modified")


def provenance(inputs: DataFrame, script: str, pins: dict[str, str], extra: dict[str, str]) -> DataFrame:
    """One record per script: its inputs with checksums, the pins, and free notes.

    ``inputs``: role, name, bytes, sha256; a script names its inputs one by one.
    """
    clash = [k for k in extra if k in RESERVED]
    if clash:
        raise ValueError(f"reserved keys {clash}")
    m = inputs.agg(
        F.map_from_entries(F.collect_list(F.struct("role", F.struct("name", "bytes", "sha256")))).alias("inputs")
    )
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map()
    return m.select(F.lit(script).alias("script"), "inputs", as_map(pins).alias("release_pin"), as_map(extra).alias("extra"))


def write_provenance(records: DataFrame, path: str) -> None:
    """One JSON line per record, never over an existing folder."""
    records.write.mode("errorifexists").json(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "script string, inputs map<string, struct<name string, bytes bigint, sha256 string>>, "
        "release_pin map<string, string>, extra map<string, string>"
    ).json(path)


def check_provenance(records: DataFrame, found: DataFrame) -> DataFrame:
    """Q6: each recorded hash against the file's own."""
    want = records.select("script", F.explode("inputs").alias("role", "_i")).select(
        "script", "role", F.col("_i.name").alias("name"), F.col("_i.sha256").alias("recorded")
    )
    j = want.join(found.select("name", "sha256"), "name", "left")
    state = F.when(F.col("sha256").isNull(), "absent").when(F.col("sha256") == F.col("recorded"), "OK").otherwise("MISMATCH")
    return j.select("script", "role", "name", state.alias("state"))


def check_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Q5: missing, mismatched, unlisted and doubled files."""
    f = found.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.max("sha256").alias("sha256"))
    j = manifest.select("name", F.col("sha256").alias("_want")).join(f, "name", "full")
    state = (
        F.when(F.col("_want").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing")
        .when(F.col("copies") > 1, "second copy").when(F.col("sha256") != F.col("_want"), "mismatched").otherwise("ok")
    )
    return j.select("name", state.alias("state"))
