"""Summaries of how often hashed items occur, one per hash partition, and a bit table of the items that may be frequent.

Items are 64-bit hashes. The high half names the hash partition (multiplied up to their number), the low half the item within it.
Each task counts its items in chunks and sends one packed row per chunk and partition. A partition's rows are merged as
Misra-Gries summaries: beyond ``capacity`` counters, the next largest count is taken from all, and what was taken adds up to
the summary's error. With capacity over mass / threshold the error stays below the threshold, so every item that occurs that
often keeps a counter; the partition's mass arrives in rows that sort before the others. Items that share the low half are counted
together, which lets too many through, never too few: what follows counts exactly.

Memory: a chunk of ``CHUNK`` items in the tasks that count, mass / threshold counters in those that merge. The number of partitions
follows the corpus, with about ``MASS`` items in each; one item with a third of all occurrences is one counter and one entry a chunk.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import words
from tidemark.llm.words import released

CHUNK = 1_200_000
MASS = 1 << 25
SLICES = 64
PROBES = 3
LOW = np.uint64(0xFFFFFFFF)


def partition_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each hash; sorted hashes have sorted partitions."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def packed(chunks: Iterator[np.ndarray], parts: int):
    """Rows (part, mass, items, counts) of chunks of hashes: one without items that tells the mass, and one with them."""
    held, size = [], 0
    for h in chunks:
        held.append(h)
        size += len(h)
        if size >= CHUNK:
            yield counted(np.concatenate(held), parts)
            held, size = [], 0
    if size:
        yield counted(np.concatenate(held), parts)


def counted(h: np.ndarray, parts: int) -> pa.RecordBatch:
    items, counts = np.unique(h, return_counts=True)
    part = partition_of(items, parts).astype(np.int32)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    mass = np.add.reduceat(counts, cuts[:-1])
    low, counts = (items & LOW).astype(np.uint32), counts.astype(np.uint32)
    bodies = [(low[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    named = pa.array(np.concatenate((part[cuts[:-1]],) * 2))
    return pa.record_batch(
        [
            named,
            pa.array([*mass.tolist(), *[None] * len(mass)], pa.int64()),
            pa.array([None] * len(mass) + [a for a, _ in bodies], pa.binary()),
            pa.array([None] * len(mass) + [b for _, b in bodies], pa.binary()),
        ],
        names=["part", "mass", "items", "counts"],
    )


class Summary:
    """A Misra-Gries summary that other counts are merged into. An entry is one number, the item above its count of 32 bits (a count
    beyond stays there, which is frequent by any threshold)."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.entries = np.zeros(0, dtype=np.uint64)
        self.held, self.size = [], 0

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((items.astype(np.uint64) << np.uint64(32)) | counts.astype(np.uint64))
        self.size += len(items)
        if self.size > max(len(self.entries), 1 << 18):
            self.merge()

    def merge(self) -> None:
        every = np.concatenate([self.entries, *self.held])
        self.held, self.size = [], 0
        if not len(every):
            return
        every.sort()
        items = (every >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        every &= LOW
        counts, items = np.minimum(np.add.reduceat(every, first), LOW), items[first]
        if len(items) > self.capacity:
            taken = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            left = counts > taken
            items, counts, self.error = items[left], counts[left] - taken, self.error + int(taken)
        self.entries = (items.astype(np.uint64) << np.uint64(32)) | counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Items that may occur ``threshold`` times; all that do are among them."""
        self.merge()
        often = (self.entries & LOW) >= np.uint64(max(threshold - self.error, 0))
        return (self.entries[often] >> np.uint64(32)).astype(np.uint32)


def survivors(rows: DataFrame, parts: int, threshold: int, bounded: bool = True) -> tuple[DataFrame, Callable]:
    """``rows`` (of ``packed``) dealt by partition, and what makes part, items (packed) of the items that may occur ``threshold`` times
    from their batches.

    Without a bound, a partition keeps a counter for each item, ``MASS`` at most or so; low thresholds gain nothing from one.
    """

    def finished(part: int, summary: Summary) -> pa.RecordBatch:
        return pa.record_batch([pa.array([part], pa.int32()), pa.array([summary.frequent(threshold).tobytes()])], names=["part", "items"])

    def work(batches):
        now, summary, mass = None, None, 0
        for batch in batches:
            for part, own, items, counts in zip(*batch.columns):
                part, own = part.as_py(), own.as_py()
                if part != now:
                    if summary is not None:
                        yield finished(now, summary)
                    now, summary, mass = part, None, 0
                if own is not None:
                    mass += own
                    continue
                if summary is None:
                    summary = Summary(mass // threshold + 1 if bounded else mass)
                summary.add(np.frombuffer(items.as_buffer(), dtype=np.uint32), np.frombuffer(counts.as_buffer(), dtype=np.uint32))
        if summary is not None:
            yield finished(now, summary)

    # by the number itself: a hash would deal several partitions to one task and none to others
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", rows["mass"].isNull())
    return dealt.select("part", "mass", "items", "counts"), work


def places(part: np.ndarray, low: np.ndarray, bits: int):
    """Places in the bit table of items of partitions, one set of places after the other."""
    item = words.mixed((part.astype(np.uint64) << np.uint64(32)) ^ low.astype(np.uint64))
    step = words.mixed(item + words.GOLD) | np.uint64(1)
    for k in range(PROBES):
        yield (item + np.uint64(k) * step) & np.uint64(bits - 1)


def bit_table(rows: DataFrame, found: Callable, bits: int) -> np.ndarray:
    """Bits of the survivors, or-ed over all partitions: bits / 8 bytes at any size of the corpus, so every task can have it.

    ``found`` makes part, items of the survivors from batches of ``rows``. The same worker marks them: with a step of its own for each,
    a task would have two workers, and an executor keeps all that it ever started.
    """
    width = bits // 8 // SLICES

    def mark(batches):
        table = np.zeros(bits // 8, dtype=np.uint8)
        for batch in found(batches):
            for part, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = np.frombuffer(items, dtype=np.uint32)
                for at in places(np.full(len(low), part), low, bits):
                    np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        table = table.reshape(SLICES, width)
        for k in np.flatnonzero(table.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pa.compress(table[k].tobytes(), "lz4", asbytes=True)])], names=["slice", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(width, dtype=np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(pa.decompress(x.as_py(), width, "lz4", asbytes=True), dtype=np.uint8)
        return pa.table({"slice": table.column("slice").slice(0, 1), "bits": pa.array([out.tobytes()])})

    # few, full parts: a slice is or-ed over as many rows as tasks
    marked = rows.coalesce(SLICES).mapInArrow(released(mark), "slice int, bits binary")
    out = np.zeros((SLICES, width), dtype=np.uint8)
    for k, row in marked.groupBy("slice").applyInArrow(either, "slice int, bits binary").toLocalIterator():
        out[k] = np.frombuffer(row, dtype=np.uint8)
    return out.ravel()


def may_be_frequent(h: np.ndarray, parts: int, table: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    left = np.arange(len(h))
    part, low = partition_of(h, parts), h & LOW
    for k in range(PROBES):
        at = next(itertools.islice(places(part[left], low[left], len(table) * 8), k, None))
        left = left[(table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
    return left


def candidates(docs: DataFrame, hashes: Callable, parts: int, threshold: int, bits: int, bounded: bool = True) -> np.ndarray:
    """The bit table of the items of ``docs`` that may occur ``threshold`` times; ``hashes`` gives a batch's items."""

    def work(batches):
        yield from packed((h for batch in batches for h in hashes(batch)), parts)

    rows = docs.mapInArrow(released(work), "part int, mass long, items binary, counts binary")
    return bit_table(*survivors(rows, parts, threshold, bounded), bits)


def partitions(docs: DataFrame, mass: int) -> int:
    """As many hash partitions as keep them at ``MASS`` items, and not fewer than the session's."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-mass // MASS))
