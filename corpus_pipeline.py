"""From raw documents to packed sequences: quality, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. A document goes when the classifier rejects it, when an equal text with a larger doc_id stays or an index that
outlives the run held its text, or when another of its group of near copies stays: that with the smallest doc_id, any before a
null one. One row of each group stays, whatever rows share a doc_id or have none. Personal data is masked in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, near_join, packing, pii, quality
from tidemark.llm.queries import BYTE_BPE, table, vocabulary
from tidemark.session import materialise

#: The setting that names a folder, shared by all executors, for an index of texts that outlives the run. A run keeps no text that an
#: earlier run with the same folder has seen; without the setting, each run begins with an empty index.
INDEX = "spark.tidemark.digest_index"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = spark.conf.get(INDEX, None)
    if folder:  # the number of buckets belongs to the index, whatever the session's partitions
        index = exact_dedup.DigestIndex(spark, folder)
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        index = exact_dedup.DigestIndex(spark, exact_dedup.index_folder(spark), buckets)
    return exact_dedup.drop_copies(docs, index)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.drop_near_copies(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary(BYTE_BPE), 1024)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: The classifier, the field and the tokenizer have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
