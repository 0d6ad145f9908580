"""One query per operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bpe_words, chat, collocations, exact_dedup, fingerprints, near_join, packing, passages, pii, quality, token_counts, url_filter, whitening,
)
from tidemark.llm.exact_dedup import LOWER, UPPER

QUERIES, ORACLES = {}, {}
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query(
    "op1_exact_dedup",
    f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = exact_dedup.DigestIndex(spark, exact_dedup.index_folder(spark), buckets)
    return exact_dedup.mark_copies(table(spark, sf, "documents"), index)


@query("op2_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), vocabulary(BYTE_BPE), 1024)


@query("op3_chat_format", chat.SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return chat.format_chats(table(spark, sf, "conversations"))


@query("op4_fingerprints")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf, "documents"))


@query("op5_quality")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary(WORD_BPE), 2048)


@query("op7_bpe")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_words.encode_and_decode(table(spark, sf, "documents"), vocabulary(BYTE_BPE))


@query("op8_pii")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find(table(spark, sf, "documents"))


@query("op9_url_filter", url_filter.SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(table(spark, sf, "pages"))


@query("op10_near_join")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return near_join.near_components(table(spark, sf, "documents"))


@query("op11_collocations", collocations.SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op13_substring_dedup", passages.SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf, "documents"))
