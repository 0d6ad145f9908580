"""Phrases of two and three words that occur together more often than their parts, per language.

Two passes over all texts. The first counts hashed runs of one to three words in mergeable Misra-Gries summaries, one per hash
partition, whose capacity exceeds mass / ``LEAST``: every run that occurs ``LEAST`` times survives (``tallies``). The second
counts what survives exactly, by text. A phrase's parts occur at least as often as the phrase, so they survive with it and their
counts come from the same table.

score = floor(1000000 * a * a / (l * r)) for the cut with the lowest score, the first of several; in decimals of 38 digits, exact
for counts below 10 ** 15. A candidate goes when a longer candidate holds its words and occurs at least half as often.

Hot keys: a task counts its runs before they are shuffled. A part with many phrases (a common word) is dealt into blocks
together with them. The ranking takes the first ``TOP`` of each language in every task before they meet.

Defined cases: a null text is empty; a null lang is ``und``, together with an own ``und``; doc_id is not used, so null and
repeated ids do not matter and a repeated row counts again; ties are broken by count, then phrase in UTF-8 order; a text is held whole by
one task in slices of ``PIECE`` bytes, one longer text at a time; an empty table gives an empty result; columns beside lang and
text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tallies, words
from tidemark.llm.exact_dedup import LOWER, UPPER
from tidemark.session import materialise

LONGEST = 3
LEAST = 10
TOP = 2000
HALF = 50  # percent of the shorter phrase's count
PIECE = 512 << 10
BITS = 1 << 27
HOT = 4096  # phrases of one part that a task meets
BREAK = np.zeros(256, dtype=bool)
BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
APART = BREAK.copy()
APART[[ord(" "), ord("\t")]] = True
ODD = [words.mixed(np.arange(k, k + LONGEST, dtype=np.uint64) * words.GOLD) | np.uint64(1) for k in (211, 307)]


class Runs:
    """Words of a batch (lang, text) and the runs of up to ``LONGEST`` that no break parts, under one or two hashes."""

    def __init__(self, batch: pa.RecordBatch, kinds: int):
        self.data, offsets = words.utf8(batch.column(1))
        self.starts, self.ends = words.spans(self.data, offsets, APART)
        h = words.hashes(self.data, self.starts, self.ends)
        row = np.searchsorted(offsets, self.starts, side="right") - 1
        langs = batch.column(0).dictionary_encode()
        self.langs, code = langs.dictionary, np.asarray(langs.indices)
        own = np.array([xxhash.xxh3_64_intdigest(x) for x in self.langs.to_pylist()], dtype=np.uint64)
        self.lang = code[row].astype(np.int32)
        by_lang = own[self.lang]
        breaks = np.concatenate(([0], np.cumsum(BREAK[self.data], dtype=np.int32)))
        part = breaks[self.starts]
        # place k: the run of k words that starts there stays in one piece
        joined = (row[1:] == row[:-1]) & (part[1:] == part[:-1])
        self.at, self.hashes = [], []
        ok = np.ones(len(h), dtype=bool)
        for k in range(1, LONGEST + 1):
            if k > 1:
                ok = ok[:-1] & joined[k - 2 :] if len(ok) > 1 else ok[:0]
            at = np.flatnonzero(ok)
            self.at.append(at)
            with np.errstate(over="ignore"):
                self.hashes.append([words.mixed(sum((h[at + j] * odd[j] for j in range(k)), np.uint64(k)) ^ by_lang[at]) for odd in ODD[:kinds]])

    def texts(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of ``k`` words from the places, lower-cased, joined by single spaces."""
        each = at[:, None] + np.arange(k)
        first, size = self.starts[each].ravel(), (self.ends - self.starts)[each].ravel() + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size - first, size)
        out = words.LOWER[self.data[np.minimum(place, len(self.data) - 1)]]
        out[ends - 1] = 32
        last = ends[k - 1 :: k]
        offsets = np.concatenate(([0], last - np.arange(1, len(last) + 1))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.delete(out, last - 1)))


def slices(batches, kinds: int):
    for batch in batches:
        for piece in words.pieces(batch, "text", PIECE):
            yield Runs(piece, kinds)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, n: words of every language. ``docs``: lang, text."""

    def work(batches):
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                data, offsets = words.utf8(piece.column(1))
                starts, _ = words.spans(data, offsets, APART)
                n = np.diff(np.searchsorted(starts, offsets))
                yield pa.record_batch([piece.column(0), pa.array(n.astype(np.int64))], names=["lang", "n"])

    return docs.mapInArrow(work, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")


def counted_runs(docs: DataFrame, parts: int, table: np.ndarray) -> DataFrame:
    """lang, k, phrase, f: exact counts of the runs whose bit is set. ``docs``: lang, text."""

    def tally(runs: Runs, k: int):
        first, second = runs.hashes[k - 1]
        hit = tallies.may_be_frequent(first, parts, table)
        if not len(hit):
            return None
        order = hit[np.argsort(first[hit], kind="stable")]
        a, b = first[order], second[order]
        # neighbours that differ in either hash are told apart; what is split that way is summed by text
        new = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1))
        at, f = runs.at[k - 1][order[new]], np.diff(np.append(new, len(order)))
        lang = pa.DictionaryArray.from_arrays(pa.array(runs.lang[at]), runs.langs).cast(pa.string())
        return pa.record_batch(
            [lang, pa.array(np.full(len(at), k, dtype=np.int32)), runs.texts(at, k), pa.array(f.astype(np.int64))],
            names=["lang", "k", "phrase", "f"],
        )

    def work(batches):
        for runs in slices(batches, 2):
            for k in range(1, LONGEST + 1):
                found = tally(runs, k)
                if found is not None:
                    yield found

    rows = docs.mapInArrow(work, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def frequent_runs(docs: DataFrame, mass: int, least: int = LEAST) -> DataFrame:
    """lang, k, phrase, f of all runs of 1 to 3 words that occur ``least`` times. ``docs``: lang, text with ``mass`` words."""
    parts = tallies.partitions(docs, LONGEST * mass)

    def hashes(batch):
        for runs in slices([batch], 1):
            for (first,) in runs.hashes:
                yield first

    table = tallies.candidates(docs, hashes, parts, least, BITS)
    return counted_runs(docs, parts, table).filter(F.col("f") >= least)


def cut_score(a: Column, left: Column, right: Column) -> Column:
    long = lambda c: c.cast("decimal(15,0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * long(a) * long(a)
    return F.call_function("div", top.cast("decimal(38,0)"), (long(left) * long(right)).cast("decimal(38,0)"))


def with_parts(frequent: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest cut of every phrase."""
    w = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(w, at, n), " ")
    pair = lambda cut, left, right: [F.struct(F.lit(cut).alias("cut"), F.lit(s).alias("side"), p.alias("part")) for s, p in ((0, left), (1, right))]
    two, three = F.array(*pair(1, part(1, 1), part(2, 1))), F.array(*pair(1, part(1, 1), part(2, 2)), *pair(2, part(1, 2), part(3, 1)))
    asked = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.when(F.col("k") == 2, two).otherwise(three)).alias("p")).select(
        "lang", "phrase", "a", "p.*"
    )
    # a common word is part of very many phrases: it and they are dealt into blocks
    uses = asked.groupBy("lang", "part").agg((1 + F.floor(F.count(F.lit(1)) / HOT)).alias("blocks"))
    known = uses.join(frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    hot = known.filter("blocks > 1")
    many = F.broadcast(hot.orderBy(F.desc("blocks"), "lang", "part").limit(HOT).select("lang", "part", "blocks"))
    dealt = asked.join(many, ["lang", "part"], "left").withColumn("block", F.expr("pmod(xxhash64(phrase), coalesce(blocks, 1))")).drop("blocks")
    spread = known.drop("blocks").join(many, ["lang", "part"], "left").select(
        "lang", "part", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block")
    )
    cuts = dealt.join(spread, ["lang", "part", "block"]).groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r")
    )
    scored = cuts.withColumn("score", cut_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def maximal(candidates: DataFrame) -> DataFrame:
    """Candidates that no longer candidate with half their count holds."""
    w = F.split("phrase", " ")
    inner = F.array(*(F.array_join(F.slice(w, k, 2), " ") for k in (1, 2)))
    held = candidates.filter("k = 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return candidates.join(held, ["lang", "phrase"], "left").filter(f"k = {LONGEST} OR longer IS NULL OR 100 * longer < {HALF} * f").drop("longer")


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    texts = texts_of(docs)
    per_lang = materialise(word_counts(texts))
    mass = per_lang.agg(F.sum("n")).first()[0] or 0
    frequent = materialise(frequent_runs(texts, mass, least))
    scored = with_parts(frequent, maximal(frequent.filter("k > 1")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, [x for x in regexp_split_to_array(piece, '[ \\t]+') if x <> ''] AS w FROM pieces),
runs AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
  FROM listed, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
held AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM held GROUP BY ALL),
left_over AS (
  SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < {HALF} * a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail
  FROM left_over, (VALUES (1), (2)) AS cs(cut) WHERE cut < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = head JOIN f AS y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
