"""Repeated passages of documents, found by automata and cut out.

A window is ``WINDOW`` consecutive words. A word goes when a window that covers it also starts in a document with a smaller doc_id.

1. A window's probe is its ``PROBE``-word run with the least hash, so neighbours mostly share it. Probes are counted per hash partition
   (``tallies``); those that may occur twice set bits of a table of fixed size. A window that recurs has a probe that does.
2. Runs of windows whose probes' bits are set are cut where the least hash among a window's ``ANCHOR``-word runs changes. Each such segment
   goes to the shard that its anchor names, so equal windows meet there; equal segments are sent once, with their smallest doc_id.
3. A shard confirms the windows that occur in two segments, or in a segment that two documents hold, compiles them into an
   Aho-Corasick automaton over word numbers, and streams its segments through it: every occurrence gets the smallest doc_id of its
   window. Anchors with very many segments are dealt once more, window by window, by the window's own words.
4. The answers go back to the documents by the segments' digests, and the covered words are left out. Texts that no answer covers, by a bit
   table of fixed size, stay where they are.

Windows are told apart by their words; segments by 128-bit digests.

Hot keys: a passage that a third of all documents hold is one segment per task before the shuffle; the way back is a join whose
documents' side can be split.

Defined cases: a null or empty text has no words; a null doc_id counts as larger than any other, so such a document never takes words from
one that has an id, nor from another without; documents with the same doc_id never take words from each other, whatever their texts;
repeated rows have equal results; a text of fewer than ``WINDOW`` words keeps all; a very long text is held whole by one task, in the
first passes and the last; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tallies, words
from tidemark.session import counted, materialise

WINDOW = 13
PROBE = 8
ANCHOR = 3
BITS = 1 << 27
PIECE = 512 << 10
SHARD = 60_000  # windows in a shard, about
NO_ID = (1 << 63) - 1
RUN = 16
KEY_BITS = 1 << 26
NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
ODD = words.mixed(np.arange(401, 401 + WINDOW, dtype=np.uint64) * words.GOLD) | np.uint64(1)


class Texts:
    """Words of a column, told apart by case, and their hashes."""

    def __init__(self, column: pa.Array):
        self.data, offsets = words.utf8(column)
        self.starts, self.ends = words.spans(self.data, offsets)
        self.rows = np.searchsorted(self.starts, offsets)
        self.h = exact_hashes(self.data, self.starts, self.ends)

    def windows(self) -> np.ndarray:
        """Places where windows start."""
        last = np.repeat(self.rows[1:], np.diff(self.rows))
        return np.flatnonzero(np.arange(len(self.h)) + WINDOW <= last)


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with their case: the lower-cased word's, and where its capitals are."""
    h = words.hashes(data, starts, ends)
    capital = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)))
    some = np.flatnonzero(capital[ends] > capital[starts])
    if len(some):
        lengths = ends[some] - starts[some]
        total = np.concatenate(([0], np.cumsum(lengths)))
        place = np.arange(total[-1], dtype=np.int64) - np.repeat(total[:-1], lengths)
        letters = data[place + np.repeat(starts[some], lengths)]
        with np.errstate(over="ignore"):
            weight = np.where((letters >= 65) & (letters <= 90), words.FAR[place % words.BLOCK], np.uint64(0))
            h[some] = words.mixed(h[some] ^ words.mixed(np.add.reduceat(weight, total[:-1]) + np.uint64(1)))
    return h


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; short at the end."""
    with np.errstate(over="ignore"):
        return words.mixed(sum((h[k : max(0, len(h) - n + 1 + k)] * ODD[k] for k in range(n)), np.uint64(n))) if len(h) >= n else h[:0]


def least_runs(h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the n-word runs inside each window, the least hash and its leftmost place: equal windows have equal ones."""
    runs = run_hashes(h, n)
    least, where = runs[at], at.copy()
    for k in range(1, WINDOW - n + 1):
        other = runs[at + k]
        less = other < least
        least, where = np.where(less, other, least), np.where(less, at + k, where)
    return least, where


def segments(texts: Texts, hit: np.ndarray):
    """first, last window and anchor of the segments: neighbouring hit windows of a row with the same anchor."""
    least, where = least_runs(texts.h, hit, ANCHOR)
    row = np.searchsorted(texts.rows, hit, side="right")
    new = np.concatenate(([True], (np.diff(hit) > 1) | (np.diff(row) > 0) | (np.diff(where) > 0)))
    first = np.flatnonzero(new)
    return hit[first], hit[np.append(first[1:], len(hit)) - 1], least[first]


def probe_hashes(batch: pa.RecordBatch):
    """The probes of all windows, once where neighbouring windows share one. Windows that recur have probes that do."""
    for piece in words.pieces(batch, "text", PIECE):
        texts = Texts(piece.column(1))
        least, where = least_runs(texts.h, texts.windows(), PROBE)
        yield least[np.concatenate(([True], where[1:] != where[:-1]))] if len(where) else least


def occurrences(docs: DataFrame, parts: int, table: np.ndarray) -> DataFrame:
    """doc, key, starts, n, anchor, digest, text: segments of windows that may recur. A task sends each segment's text once."""

    def work(batches):
        sent = set()
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                texts = Texts(piece.column(1))
                at = texts.windows()
                hit = at[tallies.may_be_frequent(least_runs(texts.h, at, PROBE)[0], parts, table)]
                if not len(hit):
                    continue
                first, last, anchor = segments(texts, hit)
                rows = np.searchsorted(texts.rows, first, side="right") - 1
                raw, found = texts.data.tobytes(), {}
                begins, ends = texts.starts[first].tolist(), texts.ends[last + WINDOW - 1].tolist()
                for k, (row, a, b, start) in enumerate(zip(rows.tolist(), begins, ends, (first - texts.rows[rows]).tolist())):
                    text = b" ".join(raw[a:b].split())
                    known = found.get((row, text))
                    if known is None:
                        digest = xxhash.xxh3_128_digest(text)
                        found[row, text] = k, [start], digest, None if digest in sent else text
                        sent.add(digest)
                    else:
                        known[1].append(start)
                places = np.array([k for k, *_ in found.values()])
                row = pa.array(rows[places])
                yield pa.record_batch(
                    [
                        piece.column(0).take(row), piece.column(2).take(row), pa.array([s for _, s, *_ in found.values()], pa.list_(pa.int32())),
                        pa.array((last - first + 1)[places].astype(np.int32)), pa.array(anchor[places].view(np.int64), mask=np.array([t is None for *_, t in found.values()])),
                        pa.array([d for *_, d, _ in found.values()], pa.binary()), pa.array([t for *_, t in found.values()], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc", "key", "starts", "n", "anchor", "digest", "text"],
                )

    return docs.mapInArrow(work, "doc long, key binary, starts array<int>, n int, anchor long, digest binary, text string")


def in_shards(segs: DataFrame, hot: DataFrame, shards: int) -> DataFrame:
    """shard, digest, base, text, least, most: segments by anchor, and those of hot anchors cut into windows, by window."""

    def cut(batches):
        for batch in batches:
            rows = []
            for digest, text, least, most in zip(*(c.to_pylist() for c in batch.columns)):
                each = text.split(" ")
                rows += [(digest, k, " ".join(each[k : k + WINDOW]), least, most) for k in range(len(each) - WINDOW + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["digest", "base", "text", "least", "most"],
            )

    marked = segs.join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
    cold = marked.filter("hot IS NULL").select(
        F.expr(f"pmod(xxhash64(anchor), {shards}L)").alias("shard"), "digest", F.lit(0).alias("base"), "text", "least", "most"
    )
    single = marked.filter("hot").select("digest", "text", "least", "most").mapInArrow(cut, "digest binary, base int, text string, least long, most long")
    return cold.union(single.select(F.expr(f"-1 - pmod(xxhash64(text), {shards}L)").alias("shard"), "digest", "base", "text", "least", "most"))


def automaton(table: pa.Table) -> pa.Table:
    """digest, base, owners: for segments whose windows recur, the smallest document of each window, NO_ID where it is one document's."""
    digests, bases, texts, least, most = (table.column(c).to_pylist() for c in ("digest", "base", "text", "least", "most"))
    numbers: dict[str, str] = {}

    def letter(word: str) -> str:
        found = numbers.get(word)
        if found is None:
            at = len(numbers)
            found = numbers[word] = chr(at if at < 0xD800 else at + 0x800)
        return found

    lines = ["".join(map(letter, t.split(" "))) for t in texts]
    seen: dict[str, tuple[int, int]] = {}
    for line, lo, hi in zip(lines, least, most):
        for k in range(len(line) - WINDOW + 1):
            window = line[k : k + WINDOW]
            known = seen.get(window)
            seen[window] = (lo, hi) if known is None else (min(lo, known[0]), max(hi, known[1]))
    phrases = ahocorasick.Automaton()
    for window, (lo, hi) in seen.items():
        if lo < hi:
            phrases.add_word(window, lo)
    out = ([], [], [])
    if len(phrases):
        phrases.make_automaton()
        for digest, base, line, hi in zip(digests, bases, lines, most):
            owners = [NO_ID] * (len(line) - WINDOW + 1)
            for end, lo in phrases.iter(line):
                owners[end - WINDOW + 1] = lo
            if min(owners) < hi:
                for c, v in zip(out, (digest, base, owners)):
                    c.append(v)
    return pa.table({"digest": pa.array(out[0], pa.binary()), "base": pa.array(out[1], pa.int32()), "owners": pa.array(out[2], pa.list_(pa.int64()))})


def covers(docs: DataFrame, parts: int, table: np.ndarray) -> DataFrame:
    """key, runs: the windows of each document that start in one with a smaller doc_id too."""
    occ, n = counted(occurrences(docs, parts, table))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (WINDOW - ANCHOR + 1) // 2 // SHARD)
    hot = materialise(occ.filter("text IS NOT NULL").groupBy("anchor").agg(F.sum("n").alias("n")).filter(F.col("n") > SHARD).select("anchor"))
    segs = occ.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.max("anchor").alias("anchor"), F.max("text").alias("text"))
    owners = materialise(in_shards(segs, hot, shards).groupBy("shard").applyInArrow(automaton, "digest binary, base int, owners array<bigint>"))
    # a run of windows is one number, its start above its length, which is below ``RUN``
    whole = F.expr(f"transform(starts, s -> (s + base) * {RUN}L + size(owners))")
    some = F.expr(f"flatten(transform(starts, s -> filter(transform(owners, (o, k) -> if(o < doc, (s + base + k) * {RUN}L + 1, -1L)), x -> x >= 0)))")
    taken = F.when(F.array_max("owners") < F.col("doc"), whole).otherwise(some)
    found = occ.select("key", "doc", "starts", "digest").join(owners, "digest").select("key", taken.alias("runs")).filter(F.size("runs") > 0)
    # a set: repeated rows say the same
    return materialise(found.groupBy("key").agg(F.flatten(F.collect_set("runs")).alias("runs")))


def marked(keys: DataFrame) -> np.ndarray:
    """A bit table of hashed keys. ``keys``: h."""

    def pack(batches):
        for batch in batches:
            h = np.asarray(batch.column(0)).view(np.uint64)
            yield pa.record_batch([pa.array([0], pa.int32()), pa.array([(h & tallies.LOW).astype(np.uint32).tobytes()])], names=["part", "items"])

    return tallies.bit_table(keys, pack, KEY_BITS)


def results(doc_id: pa.Array, texts: pa.Array, runs: pa.Array | None, whole: bool) -> pa.RecordBatch:
    """A row for each document: its words without those that the runs of windows cover."""
    out = [], [], [], []
    for k, text in enumerate(texts):
        each = kept = (text.as_py() or b"").split()
        if runs is not None and runs[k].is_valid:
            run = np.unique(runs[k].values.to_numpy())
            edge = np.zeros(len(each) + 1, dtype=np.int32)
            np.add.at(edge, run // RUN, 1)
            np.add.at(edge, run // RUN + run % RUN - 1 + WINDOW, -1)
            kept = list(itertools.compress(each, (np.cumsum(edge[:-1]) == 0).tolist()))
        body = b" ".join(kept)
        for c, v in zip(out, (len(each), len(each) - len(kept), hashlib.sha256(body).hexdigest(), body if whole else None)):
            c.append(v)
    columns = [doc_id, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *([pa.array(out[3], pa.binary()).cast(pa.string())] if whole else [])], names=NAMES[: 4 + whole])


def kept_words(docs: DataFrame, covered: DataFrame, whole: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the documents, and ``kept``, the words that stay, if ``whole``.

    Only texts whose key's bit is set move to meet what covers them; the others keep all their words. ``docs``: doc_id, text, key.
    """
    table = marked(covered.select(F.xxhash64("key").alias("h")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * whole

    def hit(batch: pa.RecordBatch) -> np.ndarray:
        mask = np.zeros(batch.num_rows, dtype=bool)
        mask[tallies.may_be_frequent(np.asarray(batch.column(3)).view(np.uint64), 1, table)] = True
        return mask

    def untouched(batches):
        for batch in batches:
            rest = batch.filter(pa.array(~hit(batch)))
            yield results(rest.column(0), rest.column(1), None, whole)

    def touched(batches):
        for batch in batches:
            yield batch.filter(pa.array(hit(batch))).select([0, 1, 2])

    def cut(batches):
        for batch in batches:
            yield results(batch.column(0), batch.column(1), batch.column(2), whole)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "key", F.xxhash64("key").alias("h"))
    moved = rows.mapInArrow(touched, "doc_id long, text binary, key binary").join(covered, "key", "left")
    return rows.mapInArrow(untouched, schema).union(moved.select("doc_id", "text", "runs").mapInArrow(cut, schema))


def cut_repeats(docs: DataFrame, whole: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and ``kept``, the text that stays, if ``whole``."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))
    named = own.withColumn("key", key)
    letters = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tallies.partitions(docs, letters // 20)
    asked = named.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text", "key")
    table = tallies.candidates(asked.select("doc", "text"), probe_hashes, parts, 2, BITS, bounded=False)
    return kept_words(named, covers(asked, parts, table), whole)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return cut_repeats(docs, False)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS nr, doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+') if x <> ''] AS w FROM documents),
starts AS (SELECT nr, doc_id, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d),
windows AS (SELECT nr, doc_id, i, sha256(array_to_string(w[i:i + {WINDOW} - 1], ' ')) AS win FROM starts),
bad AS (SELECT nr, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT nr, list(DISTINCT i + k) AS gone FROM bad, range({WINDOW}) AS ks(k) GROUP BY nr),
listed AS (SELECT doc_id, w, coalesce(gone, []) AS gone, d.nr FROM d LEFT JOIN gone ON d.nr = gone.nr),
spread AS (SELECT nr, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
left_over AS (SELECT spread.* FROM spread ANTI JOIN (SELECT nr, unnest(gone) AS i FROM gone) AS g ON spread.nr = g.nr AND spread.i = g.i),
kept AS (SELECT nr, string_agg(word, ' ' ORDER BY i) AS kept FROM left_over GROUP BY nr)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN kept ON listed.nr = kept.nr
"""
