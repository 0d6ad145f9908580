"""Hashes of the words of whole Arrow columns, by numpy, without a Python object per word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
GOLD, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK = 1 << 16
LIBC = ctypes.CDLL(None)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


# odd random weights by place in the word; places beyond a block get a second factor
PLACE = mixed(np.arange(1, BLOCK + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
FAR = mixed(np.arange(BLOCK + 1, 2 * BLOCK + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a row's end parts words too."""
    word = ~apart[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[word[cuts] & word[cuts - 1]]
    first[both], last[both - 1] = True, True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, after lower-casing A-Z; words over a block long are weighted block by block."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    place = np.arange(total[-1], dtype=np.int64) - np.repeat(total[:-1], lengths)
    letters = LOWER[data[place + np.repeat(starts, lengths)]].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        letters *= PLACE[place % BLOCK]
        if lengths.max() > BLOCK:
            far = place >= BLOCK
            letters[far] *= FAR[(place[far] // BLOCK) % BLOCK]
        return mixed(np.add.reduceat(letters, total[:-1]) + lengths.astype(np.uint64) * GOLD)


def of_rows(column: pa.Array, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and per row the place of its first word (one more at the end)."""
    data, offsets = utf8(column)
    starts, ends = spans(data, offsets, apart)
    return hashes(data, starts, ends), np.searchsorted(starts, offsets)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with about ``most`` bytes of text each: memory does not grow with the batch."""
    at = batch.schema.get_field_index(column)
    values = batch.column(at)
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """What Arrow's pool and the C library's heap, which holds numpy's arrays, keep of freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):  # of glibc only
        LIBC.malloc_trim(0)


def released(work):
    """``work`` for mapInArrow; what the worker no longer uses goes back to the system after each batch, where it would keep it."""

    def spent(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def run(batches):
        yield from work(spent(batches))
        give_back()

    return run
