"""Raw pulls that keep arriving.

A file-source stream keeps the list of seen files in its checkpoint: a restart reads unseen files
only, and each batch is one write.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import materialise
from tidemark.sources.files import listing

RAW = "endpoint string, symbol string, date date, value double"
ARRIVED = RAW + ", file string, modified timestamp, batch long"
LEDGER = (
    "file string, bytes long, fetched timestamp, n_rows long, n_broken long, date_min date, date_max date, state string, batch long"
)
BROKEN = "_broken_line"
NOT_IN_A_BATCH = -1


def ingest_new_files(
    spark: SparkSession, incoming: str, table: str, ledger: str, checkpoint: str,
    schema: str = RAW, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append rows of unseen JSON files and one ledger row per file, then stop.

    The stream carries the files, not their rows, so the ledger has a row for each: ``ok``, ``broken`` (some lines are no JSON; they
    are kept beside the ledger, in ``<ledger>-broken``), ``no rows``, or ``empty`` for a file without bytes. A file counts as it was
    when it was first seen; what is added to it later is not taken in. Batch outputs go to a folder named by the batch id, so a batch that is run again after a lost
    driver replaces its own rows instead of adding them twice. The ledger is written last: ``committed_rows`` passes over a
    batch without one. An archive that cannot be unpacked fails its batch, and nothing of it is committed.
    """
    note_empty_files(spark, incoming, ledger)
    stream = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_batch).load(incoming)
        .select(
            "path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"),
            F.col("modificationTime").alias("fetched"),
        )
    )

    def write(batch: DataFrame, number: int) -> None:
        # at most ``files_per_batch`` names; a stream lists files twice where one of a batch has brackets in its name
        files = list({f["path"]: f for f in batch.collect()}.values())
        listed = spark.createDataFrame(files, batch.schema).drop("path")
        rows = (
            spark.read.schema(f"{schema}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN)
            .json([re.sub(r"([\\\[\]{}*?])", r"\\\1", f["path"]) for f in files])
            .withColumn("file", F.col("_metadata.file_path"))
            .withColumn("modified", F.col("_metadata.file_modification_time"))
        )
        # the files are read and parsed once, twice only if some lines are broken; the ledger comes from what was written
        seen = Observation()
        rows.observe(seen, F.count(BROKEN).alias("n")).filter(F.col(BROKEN).isNull()).drop(BROKEN).write.mode("overwrite").parquet(
            f"{table}/batch={number}"
        )
        written = spark.read.schema(f"{schema}, file string, modified timestamp").parquet(f"{table}/batch={number}")
        per_file = written.groupBy("file").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max")
        )
        if seen.get["n"]:
            # with whatever fields could be read of them
            rows.filter(F.col(BROKEN).isNotNull()).withColumnRenamed(BROKEN, "line").write.mode("overwrite").parquet(
                f"{ledger}-broken/batch={number}"
            )
            broken = spark.read.schema("file string, line string").parquet(f"{ledger}-broken/batch={number}")
            listed = listed.join(broken.groupBy("file").agg(F.count(F.lit(1)).alias("n_broken")), "file", "left")
        else:
            listed = listed.withColumn("n_broken", F.lit(0).cast("long"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        state = F.when(F.col("n_broken") > 0, "broken").when(F.col("n_rows") == 0, "no rows").otherwise("ok")
        entries = listed.join(per_file, "file", "left").select(
            "file", "bytes", "fetched", zero("n_rows"), zero("n_broken"), "date_min", "date_max"
        )
        entries.withColumn("state", state).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def note_empty_files(spark: SparkSession, incoming: str, ledger: str) -> None:
    """Ledger rows for files without bytes, which no stream of Spark's shows; each is noted once, outside any batch."""
    found = listing(spark, incoming).filter("bytes = 0").select(
        F.concat(F.lit(incoming.rstrip("/") + "/"), "name").alias("file"), "bytes", F.col("modified").alias("fetched")
    )
    if not found.isEmpty():
        at = f"{ledger}/batch={NOT_IN_A_BATCH}"
        none, no_date = F.lit(0).cast("long"), F.lit(None).cast("date")
        rows = found.select(
            "*", none.alias("n_rows"), none.alias("n_broken"), no_date.alias("date_min"), no_date.alias("date_max"), F.lit("empty").alias("state")
        )
        rows.limit(0).write.mode("append").parquet(at)
        known = spark.read.parquet(at).select("file")
        new = materialise(rows.join(known, "file", "left_anti"))
        new.coalesce(1).write.mode("append").parquet(at)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per file that was taken in, with the batch that took it."""
    return spark.read.schema(LEDGER).parquet(ledger)


def committed_rows(spark: SparkSession, table: str, ledger: str) -> DataFrame:
    """The rows of the batches whose ledger is written."""
    done = read_ledger(spark, ledger).select("batch").distinct()  # one row per batch
    return spark.read.parquet(table).join(done, "batch", "left_semi")


def newest_rows(rows: DataFrame, order: tuple[str, ...] = ("batch", "file")) -> DataFrame:
    """Per (endpoint, symbol, date) the row that arrived last replaces earlier ones.

    The table only grows, by one folder per batch; the newest rows are found when it is read, so no batch rewrites
    what earlier ones wrote.
    """
    rest = [c for c in rows.columns if c not in ("endpoint", "symbol", "date")]
    return (
        rows.groupBy("endpoint", "symbol", "date")
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select("endpoint", "symbol", "date", "_r.*")
    )


def replace_newest(
    spark: SparkSession, table: str, changes: str, checkpoint: str, schema: str = ARRIVED, order: tuple[str, ...] = ("batch", "file"),
) -> StreamingQuery:
    """Take in what is new in ``table`` and write the newest row of each key that it touches, then stop.

    The newest row of every key is the state of the stream, so old rows are read once, when they arrive, and a restart goes on from
    the checkpoint. Large states belong into the state store on disk that the session names. A row that arrives late and is older
    than the known one leaves that one in place. One folder is written for each batch, and again if the batch is run again.
    """
    rows = spark.readStream.schema(schema).parquet(table)
    newest = newest_rows(rows, order)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/change={number}")

    return (
        newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_newest(spark: SparkSession, changes: str) -> DataFrame:
    """One row per key, from the last change that touched it."""
    return newest_rows(spark.read.parquet(changes), ("change",)).drop("change")
