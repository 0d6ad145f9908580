"""Exact dedup against a persistent digest index.

The index is a table of (digest, doc_id, copies), bucketed and sorted by the digest. New documents are
reduced to one row per digest, a sort-merge anti-join leaves the digests that the index does not hold, and
those are appended. All of it is built from DataFrame functions.

Defined cases: a null text counts as empty, so all null and empty texts are copies of each other. Of equal texts
the row with the largest doc_id stays; a null doc_id is smaller than any number; of rows that repeat both doc_id
and text one stays. An empty table gives an empty result and appends nothing. Columns beside doc_id and text are
carried through untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialise, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = -(2**63)


def normal_form(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null becomes empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normal_form(text), 256))


class DigestIndex:
    """Digests of every text seen so far, in a folder that outlives the session.

    ``buckets`` belongs to the index: open it with the number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, doc_id BIGINT, copies BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS "
            f"LOCATION '{path.rstrip('/')}/b{int(buckets)}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add the unseen digests; running it again with the same rows adds nothing."""
        rows = self.unseen(groups).select("digest", F.col("keep_id").alias("doc_id"), "copies")
        # one file per bucket: the exchange uses the hash that the buckets use
        rows.repartition(self.buckets, "digest").write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id and digest of every document; written, so that row numbers stay as they are."""
    return materialise(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            digest(F.col("text")).alias("digest"),
        )
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest. Numbers only in the buffers, combined before the shuffle."""
    age = F.coalesce("doc_id", F.lit(LEAST))
    return rows.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("row", age).alias("keep_row"),
        F.count(F.lit(1)).alias("copies"),
    )


def mark_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document; the index learns the new texts.

    A text that the index held before keeps its older owner: no row of this batch is kept for it.
    """
    rows = digests(docs)
    groups = materialise(groups_of(rows))
    fresh = materialise(index.unseen(groups).select("digest"))
    index.append(groups)
    owners = (
        groups.join(fresh.withColumn("new", F.lit(True)), "digest", "left")
        .join(
            index.rows().select("digest", F.col("doc_id").alias("owner"), F.col("copies").alias("seen")).hint("merge"),
            "digest",
        )
        .select(
            "digest",
            F.when(F.col("new"), F.col("keep_id")).otherwise(F.col("owner")).alias("keep_id"),
            F.when(F.col("new"), F.col("keep_row")).alias("keep_row"),
            F.when(F.col("new"), F.col("copies")).otherwise(F.col("copies") + F.col("seen")).alias("group_size"),
        )
    )
    # a digest with a third of all rows: both sides are plain exchanges, so Spark can split it
    return rows.join(materialise(owners).hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, all columns as they were; with an index, none whose text it held before, and it learns the new ones."""
    # names that no column of the documents can have
    at, keep, n = (f"{name}_{uuid.uuid4().hex}" for name in ("digest", "keep", "n"))
    marked = docs.select("*", digest(F.col("text")).alias(at))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    same = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    age = F.coalesce("doc_id", F.lit(LEAST))
    groups = materialise(
        same.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("n", age).alias("n"), F.sum("n").alias("copies"))
    )
    if index is not None:
        groups = materialise(index.unseen(groups).select(*groups.columns))
        index.append(groups)
    best = groups.select(F.col("digest").alias(at), F.col("keep_id").alias(keep), F.col("n").alias(n))
    keyed = marked.join(best, at).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(keep)))
    once = keyed.filter(F.col(n) == 1)
    repeated = keyed.filter(F.col(n) > 1).dropDuplicates([at])
    return once.unionByName(repeated).select(*docs.columns)


def index_folder(spark: SparkSession) -> str:
    """A new folder for an index below the shared one."""
    return f"{shared_dir(spark)}/tidemark/digest_index_{uuid.uuid4().hex}"
