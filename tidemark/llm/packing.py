"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenised once, in Arrow batches; per piece only numbers are kept. What packing needs of the corpus is the
histogram of piece lengths, at most ``size`` numbers. From it the driver plans bins: the largest length left opens a bin, a
bitset subset-sum over the lengths still available finds the fullest feasible combination, and that combination is taken
as many times as the counts allow. Each step uses up a length (or leaves fewer than the combination needs), so the plan
has a few thousand steps at most, whatever the number of documents. Pieces of one length are interchangeable: the rank of
a piece among its length decides its bin and offset. Ranks come from counts per (part, length), so no group is sorted.

Defined cases: a null text is empty and packs as the end id alone; repeated rows are packed each; an empty table gives an
empty result; columns beside doc_id and text are ignored; a text of any length is cut into pieces of ``size`` tokens of
which the first may be shorter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.words import released
from tidemark.session import materialise

END_ID = 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(ids: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only longer ones are cut, the first piece takes the remainder."""
    first = (len(ids) - 1) % size + 1
    return [(0, first), *((s, size) for s in range(first, len(ids), size))]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in the same part."""

    def run(batches):
        from pyspark import TaskContext

        enc, allowed = bpe.encoder(tokenizer), set(bpe.specials(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
             ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
        )
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode_to_numpy(text.as_py() or "", allowed_special=allowed, disallowed_special=())
                ids = np.append(ids, END_ID).astype("<u4")
                for k, (start, length) in enumerate(cut(ids, size)):
                    row = (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length])
                    seen[length] += 1
                    for column, value in zip(out, row):
                        column.append(value)
            out.insert(5, [part] * len(out[0]))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill ``room`` as far as possible, larger lengths first."""
    reach, mask, taken = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            group = min(group, left)
            taken.append((length, group, reach))
            reach |= reach << (length * group) & mask
            left, group = left - group, group * 2
        if reach >> room & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for length, group, before in reversed(taken):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + group
            at -= length * group
    return picked


def plan_bins(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, number per bin, first bin, offset in the bin); a row holds until the next of its length."""
    counts, used, rows, bins = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while any(counts.values()):
        longest = max(x for x, c in counts.items() if c)
        counts[longest] -= 1
        picked = fullest(counts, size - longest)
        counts[longest] += 1
        picked[longest] = picked.get(longest, 0) + 1
        times, offset = min(counts[x] // k for x, k in picked.items()), 0
        for length, k in sorted(picked.items(), reverse=True):
            rows.append((length, used[length], k, bins, offset))
            used[length] += k * times
            counts[length] -= k * times
            offset += k * length
        bins += times
    return rows


def place(pieces: DataFrame, plan: list[tuple[int, int, int, int, int]], size: int) -> DataFrame:
    """sequence_id and offset of every piece from its rank. The plan has a bounded number of rows."""
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    starts = np.searchsorted(table[:, 0], np.arange(size + 2))

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            row = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                here = length == x
                lo, hi = starts[x], starts[x + 1]
                row[here] = lo + np.searchsorted(table[lo:hi, 1], rank[here], side="right") - 1
            _, first, k, base, offset = table[row].T
            steps = rank - first
            added = [pa.array(base + steps // k), pa.array(offset + steps % k * length)]
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index(c)) for c in keep] + added, names=[*keep, "sequence_id", "offset"]
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.mapInArrow(released(run), schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialise(token_pieces(docs, tokenizer, size))
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before")
    return place(ranked, plan_bins(histogram, size), size)
