"""Quality classifier: random-indexing word vectors, pooled per document, and a small network in numpy.

Words (runs of letters or digits, and runs of other signs, both hashed into ``BUCKETS``) get a fixed sparse random index
vector each. A word's vector is the sum of the index vectors of its neighbours over the whole corpus: every task adds up its
part as one matrix of fixed size, and Spark sums the matrices block by block. A document pools the vectors of all its words
(mean, spread, agreement of neighbours, how much it repeats itself); that is the input of a network with one hidden
layer. It learns from at most ``SAMPLE`` labelled documents, those with the smallest hash; a tenth of them is set aside to fit
the temperature that makes the outputs probabilities. Word statistics cover all documents, scoring reads whole texts.

Defined cases: a null or empty text pools to zeros and gets the score of such a row; without labels of both kinds every score is
the share of label 1 (0.5 without labels); null labels teach nothing; a doc_id labelled twice counts twice; an empty table gives
an empty result. Other columns, whatever their names, are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.words import released
from tidemark.session import materialise

BUCKETS = 1 << 14
DIM = 32
CHUNK = 1024  # buckets in one row of a partial sum
SAMPLE = 20_000
PIECE = 256 << 10  # bytes of text pooled at once: about 300 bytes of numbers for each
HIDDEN = 32
FEATURES = 3 * DIM + 6

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of the rows in order, and the place of each row's first token."""
    data, offsets = words.utf8(column)
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    kind = np.where(words.SPACE[data], 0, np.where(LETTER[data], 1, 2)).astype(np.int8)
    change = np.empty(len(kind), dtype=bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    cuts = offsets[1:-1]
    change[cuts[cuts < len(kind)]] = True
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(kind))
    real = kind[at] > 0
    starts, ends = at[real], ends[real]
    # capitals matter here: text in capitals is told from ordinary text by its words
    shout = (data[starts] >= 65) & (data[starts] <= 90) & (data[ends - 1] >= 65) & (data[ends - 1] <= 90) & (ends - starts > 1)
    h = words.hashes(data, starts, ends)
    h[shout] ^= words.GOLD
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Four places and signs of every bucket's sparse index vector, from the bucket number alone."""
    h = words.mixed(np.arange(1, 4 * BUCKETS + 1, dtype=np.uint64) * words.GOLD).reshape(BUCKETS, 4)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def neighbour_sums(docs: DataFrame) -> DataFrame:
    """chunk, sums: per block of buckets the summed index vectors of neighbours, and how often each bucket occurs."""

    def run(batches):
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * (DIM + 1))
        for batch in batches:
            for piece in words.pieces(batch, "text", 4 * PIECE):
                at, rows = tokens(piece.column(0))
                if not len(at):
                    continue
                total.reshape(BUCKETS, DIM + 1)[:, DIM] += np.bincount(at, minlength=BUCKETS)
                inside = np.ones(len(at), dtype=bool)
                inside[rows[:-1][rows[:-1] < len(at)]] = False  # no neighbour across documents
                here = np.flatnonzero(inside)
                left, right = at[here - 1], at[here]
                for word, other in ((left, right), (right, left)):
                    for k in range(4):
                        total += np.bincount(word * (DIM + 1) + places[other, k], signs[other, k], BUCKETS * (DIM + 1))
        for k in range(BUCKETS // CHUNK):
            part = total.reshape(-1, CHUNK * (DIM + 1))[k].astype("<f4")
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "sums"])

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CHUNK * (DIM + 1))
        for batch in tables:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_py(), dtype="<f4")
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["chunk", "sums"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(run), "chunk int, sums binary")
    return parts.groupBy("chunk").applyInArrow(add, "chunk int, sums binary")


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x (DIM + 1): unit vectors of the words and, last, minus the logarithm of their frequency. Of fixed size."""
    found = np.zeros((BUCKETS, DIM + 1))
    for chunk, sums in neighbour_sums(docs).collect():
        found[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums, dtype="<f8").reshape(CHUNK, DIM + 1)
    vectors, counts = found[:, :DIM], found[:, DIM]
    # what all words share says nothing: take out the mean direction of the corpus
    vectors = vectors / np.maximum(counts, 1)[:, None]
    vectors = vectors - (counts[:, None] * vectors).sum(0) / max(counts.sum(), 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    return np.column_stack([vectors, -np.log((counts + 1) / (counts.sum() + BUCKETS))]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of features per document."""
    at, rows = tokens(column)
    n = np.diff(rows)
    out = np.zeros((len(n), FEATURES), dtype=np.float32)
    if not len(at):
        return out
    v = vectors[at]
    some = np.flatnonzero(n > 0)
    begin = rows[:-1][some]
    mean = lambda x: np.add.reduceat(x, begin, axis=0) / n[some].reshape(-1, *[1] * (x.ndim - 1))
    follows = np.ones(len(at), dtype=bool)
    follows[begin] = False
    second = follows & np.concatenate(([False], follows[:-1]))  # two words of the same document before it
    previous = np.concatenate((at[:1], at[:-1]))
    before2 = np.concatenate((at[:2], at[:-2]))[: len(at)]
    twin = np.where(follows[:, None], v[:, :DIM] * vectors[previous][:, :DIM], 0)
    m = mean(v)
    spread = np.sqrt(np.maximum(mean(v[:, :DIM] ** 2) - m[:, :DIM] ** 2, 0))
    owner = np.repeat(np.arange(len(some)), n[some])
    distinct = np.unique(owner * BUCKETS + at) // BUCKETS
    out[some] = np.column_stack([
        m, spread, mean(twin), mean((follows & (at == previous)).astype(np.float32)), mean((second & (at == before2)).astype(np.float32)),
        np.bincount(distinct, minlength=len(some)) / n[some], np.log1p(n[some]), np.linalg.norm(m[:, :DIM], axis=1),
    ])
    return out


# ------------------------------------------------------------------ the network
def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Two layers, trained by Adam on log loss; the temperature is fitted on rows that training never saw."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 20 or share in (0.0, 1.0):
        return {"share": np.float32(share)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, rest = order[: max(1, len(y) // 10)], order[max(1, len(y) // 10) :]
    low, scale = x[rest].mean(0), x[rest].std(0) + 1e-3
    z = (x - low) / scale
    p = {
        "w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1),
    }
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    epochs = int(np.clip(400_000 / len(rest), 20, 60))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for at in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
            a = np.tanh(z[at] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(a @ p["w2"] + p["b2"], -30, 30))) - y[at]) / len(at)
            back = d[:, None] * p["w2"] * (1 - a**2)
            g = {"w1": z[at].T @ back + 1e-3 * p["w1"], "b1": back.sum(0), "w2": a.T @ d + 1e-3 * p["w2"], "b2": d.sum(keepdims=True)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    raw = np.tanh(z[aside] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    heats = np.geomspace(0.25, 8, 61)
    # smoothed targets: rows that the network parts without an error must not make it ever surer
    ones = float((y[aside] > 0).sum())
    goal = np.where(y[aside] > 0, (ones + 1) / (ones + 2), 1 / (len(aside) - ones + 2))
    losses = [np.mean(goal * np.logaddexp(0, -raw / t) + (1 - goal) * np.logaddexp(0, raw / t)) for t in heats]
    return {k: np.float32(v) for k, v in {**p, "low": low, "scale": scale, "heat": heats[int(np.argmin(losses))]}.items()}


def scores(x: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), float(model["share"]))
    a = np.tanh((x - model["low"]) / model["scale"] @ model["w1"] + model["b1"])
    p = 1 / (1 + np.exp(-np.clip((a @ model["w2"] + model["b2"]) / model["heat"], -30, 30).astype(np.float64)))
    return np.round(p, 6)  # sums in another order, as in another batch, differ in the last places


# ------------------------------------------------------------------ on Spark
def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Fit on the labelled documents outside the held-out fold, or on ``sample`` of them in the order of a hash."""
    known = labels.filter(F.col("quality").isNotNull() & (F.coalesce(remainder(F.col("doc_id")), F.lit(-1)) != 2))
    known = known.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_y"))
    picked = materialise(known.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # bounded by ``sample`` rows of two numbers, so the broadcast has a proven size
    chosen = rows.join(F.broadcast(picked), "_id").select("text", "_id", "_y", F.xxhash64("text").alias("_h"))

    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                x = pooled(piece.column(0), vectors)
                yield pa.record_batch(
                    [*piece.columns[1:], pa.array(list(map(bytes, x.astype("<f4"))), pa.binary())], names=["_id", "_y", "_h", "x"]
                )

    # one row for each of the sample's ids, also where rows share one: that of the text with the largest hash, in every run
    each = chosen.mapInArrow(released(run), "_id long, _y double, _h long, x binary").groupBy("_id").agg(
        F.max("_y").alias("_y"), F.max_by("x", "_h").alias("x")
    )
    seen = sorted((r[0], r[1], bytes(r[2])) for r in each.collect())
    x = np.array([np.frombuffer(r[2], dtype="<f4") for r in seen], dtype=np.float64).reshape(-1, FEATURES)
    return fit(x, np.array([float(r[1] > 0) for r in seen]))


def score(docs: DataFrame, vectors: np.ndarray, model: dict[str, np.ndarray], keep: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def run(batches):
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                p = scores(pooled(piece.column(0), vectors), model)
                yield pa.record_batch(
                    [piece.column(1), pa.array(p, pa.float64()), pa.array((p >= keep).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(released(run), "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, keep: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    vectors = word_vectors(docs)
    return score(docs, vectors, learn(docs, labels, vectors, sample), keep).withColumn(
        "held_out", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, all columns as they were, in one pass over the rows."""
    vectors = word_vectors(docs)
    model = learn(docs, labels, vectors, sample)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in words.pieces(batch, "text", PIECE):
                good = scores(pooled(piece.column(at), vectors), model) >= keep
                yield piece.filter(pa.array(good))

    return docs.mapInArrow(released(run), docs.schema)
