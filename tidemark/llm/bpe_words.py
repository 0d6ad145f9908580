"""BPE encoding and decoding through a table of distinct words.

Documents are dealt into blocks of bounded size; their texts move once, compressed, and both later passes over a block read the
same exchange. Words are encoded once each:

* the ``FREQUENT`` most frequent words of the corpus (counted over all documents) are encoded first, and every task gets that
  table, whose size is bounded;
* of the others, each block gives its distinct words with their place in the block's word list. They meet in one exchange by
  word, each distinct one is encoded once (its part keeps ``MEMORY`` of them), and its ids go back by block and place, packed.

Decoding joins the ids of each distinct word with the id-to-piece table, as large as the vocabulary, which every worker has. In the block, the ids and decoded pieces of a document are put together by position. Byte-level merging never
crosses a word, so the ids of a text are those of its words in order.

Defined cases: a null text is empty; special strings in a text are words of their own with their special id; repeated rows
are encoded each; an empty table gives an empty result; columns beside doc_id and text are ignored. A document is held by one
task, with the words of its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.splitting import byte_words
from tidemark.llm.words import released
from tidemark.session import materialise

BLOCK_BYTES = 32 << 20
FREQUENT = 200_000
MEMORY = 400_000  # distinct words whose ids a part keeps at a time
HELD = 500_000  # words of a part whose ids wait to be packed
OFTEN = 8  # times in one part before a word is counted for the frequent ones
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PACKED = pa.schema([
    ("block", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("numbers", pa.binary()),
    ("pieces", pa.list_(pa.struct([("place", pa.int32()), ("piece", pa.binary())]))),
])
DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def split_words(text: str, path: str) -> list[str]:
    """Words in order; nothing between them is lost."""
    parts = bpe.segments(text, path)
    if len(parts) == 1:
        return byte_words(text)
    return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else byte_words(part))]


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, docs: compressed runs of documents, in one exchange by block."""
    rows = plain(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))

    def run(batches):
        for batch in batches:
            blocks = np.asarray(batch.column(0))
            for block in np.unique(blocks).tolist():
                some = batch.take(pa.array(np.flatnonzero(blocks == block))).select(["doc_id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(some)
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return rows.select(block.alias("block"), "doc_id", "text").mapInArrow(released(run), "block int, docs binary").repartition(n, "block")


def opened(column: pa.Array):
    """Tables of documents from their compressed runs."""
    for run in column:
        yield pa.ipc.open_stream(run.as_buffer()).read_all()


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """word, n of the words that are frequent in some part."""

    def run(batches):
        seen: dict[str, int] = {}

        def often():
            rows = [(w, n) for w, n in seen.items() if n >= OFTEN]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(1):
                for word in split_words(text.as_py(), path):
                    seen[word] = seen.get(word, 0) + 1
            if len(seen) > 1_000_000:
                yield often()
                seen.clear()
        yield often()

    return plain(docs).mapInArrow(released(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str) -> dict[str, tuple[int, str, bytes]]:
    """word -> (number of ids, ids, decoded) of at most FREQUENT words."""
    words = materialise(count_words(docs, path).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word"))
    return {r[0]: (len(r[1]), ",".join(map(str, r[1])), bytes(r[2])) for r in encoded(words, path).collect()}


def coder(path: str):
    """From a word to its ids, and the bytes that those ids stand for."""
    enc, special, piece = bpe.encoder(path), bpe.specials(path), bpe.pieces_by_id(path)

    def code(word: str) -> tuple[list[int], bytes]:
        ids = [special[word]] if word in special else enc.encode_ordinary(word)
        return ids, b"".join([piece[i] for i in ids])

    return code


def encoded(words: DataFrame, path: str) -> DataFrame:
    """word, ids, piece of distinct words."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            ids, pieces = zip(*map(code, batch.column(0).to_pylist())) if batch.num_rows else ((), ())
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(pieces, pa.binary())], names=["word", "ids", "piece"])

    return words.mapInArrow(released(run), "word string, ids array<int>, piece binary")


def packed_ids(dealt: DataFrame, path: str) -> DataFrame:
    """block, n, size, numbers, pieces: of the words of a part that a block asks for, their places, numbers of ids and ids in one packed
    column, and what they decode to where that is not the word itself. ``dealt``: block, place, word, dealt by word.
    """

    def pack(block: int, rows: list):
        places, ids, pieces = zip(*rows)
        numbers = np.concatenate([np.array(places, dtype=np.int32), np.array([len(i) // 4 for i in ids], dtype=np.int32), np.frombuffer(b"".join(ids), dtype=np.int32)])
        odd = [{"place": p, "piece": x} for p, x in zip(places, pieces) if x is not None]
        return block, len(rows), len(numbers), pa.compress(numbers.tobytes(), "zstd", asbytes=True), odd

    def packs(held: dict):
        columns = zip(*(pack(block, rows) for block, rows in held.items()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, PACKED.types)], schema=PACKED)

    def run(batches):
        code, known, held, size = coder(path), {}, {}, 0
        for batch in batches:
            for block, place, word in zip(*(c.to_pylist() for c in batch.columns)):
                found = known.get(word)
                if found is None:
                    if len(known) >= MEMORY:
                        known.clear()
                    ids, piece = code(word)
                    found = known[word] = np.array(ids, dtype=np.int32).tobytes(), None if piece == word.encode() else piece
                held.setdefault(block, []).append((place, *found))
            size += batch.num_rows
            if size >= HELD:
                yield packs(held)
                held, size = {}, 0
        if held:
            yield packs(held)

    return dealt.select("block", "place", "word").mapInArrow(released(run), "block int, n int, size int, numbers binary, pieces array<struct<place: int, piece: binary>>")


def unpacked(table: pa.Table):
    """place, ids, piece of the words of ``packed_ids``."""
    for n, size, numbers, odd in zip(*(table.column(c) for c in ("n", "size", "numbers", "pieces"))):
        n = n.as_py()
        every = np.frombuffer(pa.decompress(numbers.as_buffer(), 4 * size.as_py(), "zstd"), dtype=np.int32)
        pieces = {x["place"]: x["piece"] for x in odd.as_py()}
        places, ends, ids = every[:n].tolist(), np.cumsum(every[n : 2 * n]).tolist(), every[2 * n :].tolist()
        for place, start, end in zip(places, [0, *ends], ends):
            yield place, ids[start:end], pieces.get(place)


def rare_words(placed: DataFrame, known, path: str) -> DataFrame:
    """block, place, word: the distinct words of each block that are not known, in sorted order."""

    def run(batches):
        seen: dict[int, set] = {}
        for batch in batches:
            for block, docs in zip(batch.column(0).to_pylist(), opened(batch.column(1))):
                words = seen.setdefault(block, set())
                for text in docs.column("text"):
                    words.update(split_words(text.as_py(), path))
        for block in list(seen):
            rows = sorted(seen.pop(block) - known.value.keys())
            for k in range(0, len(rows), 50_000):
                part = rows[k : k + 50_000]
                places = pa.array(range(k, k + len(part)), pa.int32())
                yield pa.record_batch([pa.array([block] * len(part), pa.int32()), places, pa.array(part, pa.string())], names=["block", "place", "word"])

    return placed.mapInArrow(released(run), "block int, place int, word string")


def assemble(known, path: str):
    """Results of a block's documents from its runs and the ids of its rare words."""

    def run(runs: pa.Table, table: pa.Table) -> pa.Table:
        docs = pa.concat_tables([d.cast(DOCS) for d in opened(runs.column("docs"))])
        split = [split_words(t.as_py(), path) for t in docs.column("text")]
        rare = sorted(set().union(*split) - known.value.keys())
        every = dict(known.value)
        for place, ids, piece in unpacked(table):
            every[rare[place]] = (len(ids), ",".join(map(str, ids)), rare[place].encode() if piece is None else piece)
        out = [[], [], []]
        for words in split:
            found = list(map(every.__getitem__, words))
            out[0].append(sum(f[0] for f in found))
            out[1].append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
            decoded = b"".join([f[2] for f in found]).decode("utf-8", "replace")
            out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_tokens": pa.array(out[0], pa.int64()),
            "ids_sha256": pa.array(out[1], pa.string()), "decoded_sha256": pa.array(out[2], pa.string()),
        })

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent_words(docs, tokenizer))  # at most FREQUENT words
    placed = in_blocks(docs, block_bytes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange by word: each of its words is encoded in its part, and the ids go straight back
    back = packed_ids(rare_words(placed, known, tokenizer).repartition(n, "word"), tokenizer)
    return placed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(assemble(known, tokenizer), SCHEMA)
