"""Collocations, whitening and repeated passages: brute force on small tables, edges, hot groups."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.helpers import SCHEMA, ascii_lower, awkward, awkward_rows, empty, phrase, rows_of, sha
from tidemark.llm import collocations, passages, tallies, whitening


# ------------------------------------------------------------------ summaries
def test_frequent_items_keep_a_counter():
    rng = np.random.default_rng(3)
    items = np.concatenate((np.repeat(np.arange(40), rng.integers(10, 60, 40)), np.arange(1000, 9000))).astype(np.uint32)
    rng.shuffle(items)
    summary = tallies.Summary(len(items) // 10 + 1)
    for k in range(0, len(items), 500):
        found, counts = np.unique(items[k : k + 500], return_counts=True)
        summary.add(found, counts)
        summary.merge()
    assert summary.error < 10 and set(range(40)) <= set(summary.frequent(10).tolist())


# ------------------------------------------------------------------ collocations
def plain_collocations(rows, top, least):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in cands.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            cuts = [(int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out, key=repr)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations_by_counting(spark, seed, monkeypatch):
    monkeypatch.setattr(collocations, "HOT", 5)
    monkeypatch.setattr(tallies, "CHUNK", 300)
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "of", "the", "São", "x1", "day", "of", "the"])
    rows = []
    for k in range(60):
        text = "".join(word() + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(40))
        rows.append((k, text, rng.choice(["en", "de", None, ""]), "s", 1))
    rows += [(None, None, None, None, None), (3, "", "en", "s", 0), (3, "the day of the day", "fr", "s", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(collocations.mine(docs, 12, 4), *NAMES)
    assert got == plain_collocations([(r[2], r[1]) for r in rows], 12, 4) and got


def test_collocations_of_awkward_rows(spark):
    for clash in (False, True):
        got = rows_of(collocations.mine(awkward(spark, clash), 50, 2), *NAMES)
        assert got == plain_collocations([(r[2], r[1]) for r in awkward_rows()], 50, 2) and got
    assert collocations.mine(empty(spark)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_007, 5_000_000_000_003, 4_000_000_000_021
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    got = row.select(collocations.cut_score(row.a, row.l, row.r).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


# ------------------------------------------------------------------ whitening
def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, vecs = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), values[::-1], c @ vecs[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), np.trace(c.T @ c / n)


def test_whitening_as_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 40)) * np.linspace(9, 1, 40)).astype(np.float32)
    vectors[100:200] = vectors[0]  # a vector with a third of all rows
    rows = [(k, v.tolist(), "own") for k, v in enumerate(vectors)]
    bad = [(900, None, "x"), (901, [1.0] * 39 + [None], "x"), (902, [float("nan")] * 40, "x"), (903, [float("inf")] * 40, "x"), (904, [1.0], "x"), (905, [], "x")]
    table = spark.createDataFrame([*rows, *bad, (None, vectors[7].tolist(), "x")], "vec_id long, embedding array<float>, component string")
    got = whitening.whiten(table, 12).collect()
    n, deviation, values, y, trace = plain_whitening([*vectors, vectors[7]])
    assert len(got) == n * 12 and {r.vec_id for r in got} == {*range(300), None}
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 13):
        own = np.array([by[k, c].whitened for k in range(300)])
        sign = np.sign(own @ y[:300, c - 1])
        assert np.abs(own * sign - y[:300, c - 1]).max() < 1e-8
        assert abs(by[5, c].explained - values[c - 1] / trace) < 1e-12 and by[5, c].n == n
    assert all(by[k, 1].deviation == deviation[k] for k in range(300))
    assert {r.identity_error for r in got} == {by[0, 1].identity_error} and by[0, 1].identity_error < 1e-10


@pytest.mark.parametrize("d,k,decay", [(64, 32, 0.0), (64, 32, 0.1), (200, 8, 0.05), (5, 32, 1.0), (1, 4, 0.0)])
def test_jacobi_davidson_as_eigh(d, k, decay):
    class Dense:
        def __init__(self, a):
            self.a, self.d = a, len(a)

        def product(self, u):
            return self.a @ u

    rng = np.random.default_rng(d)
    b = rng.standard_normal((3 * d, d)) * np.exp(-decay * np.arange(d))
    a = b.T @ b
    values, vectors = whitening.leading(Dense(a), k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    assert len(values) == min(k, d) and np.abs(values - want).max() < 1e-13 * want[0] * d
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_deviations_are_exact_beyond_doubles(spark):
    rows = [(0, [0.0, 40_000.0]), (1, [1.0, 0.0]), (2, [123.0, -1.0])]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == dict(enumerate(plain_whitening([v for _, v in rows])[1].tolist()))


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 4, schema)).collect() == []
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0]), (2, [3.0, 0.0])], schema)).collect()
    assert [r.component for r in got] == [1, 1, 1] and got[0].identity_error < 1e-12


# ------------------------------------------------------------------ repeated passages
def plain_cut(rows):
    """doc_id, words, removed, digest and text of what stays, by a dictionary of all windows."""
    least, out = {}, []
    big = float("inf")
    split = lambda t: [w for w in re.split(r"[ \t\n\v\f\r]+", t or "") if w]
    for doc, text in rows:
        w = split(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, big), big if doc is None else doc)
    for doc, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (big if doc is None else doc):
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), sha(kept), kept))
    return sorted(out, key=repr)


CUT = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


@pytest.mark.parametrize("shard", [60_000, 3])
def test_passages_by_dictionary(spark, shard, monkeypatch):
    monkeypatch.setattr(passages, "SHARD", shard)  # the small one makes every anchor a hot one
    rng = random.Random(shard)
    shared = [phrase(rng, n).split() for n in (13, 14, 40, 12, 200)] + [["la"] * 60, ["a", "b"] * 20]
    rows = []
    for k in range(80):
        body = []
        for _ in range(rng.randint(0, 6)):
            body += rng.choice(shared) if rng.random() < 0.5 else phrase(rng, rng.randint(1, 30)).split()
        text = "".join(w + rng.choice([" ", " ", "\n", "\t ", " " if rng.random() < 0.02 else " "]) for w in body)
        rows.append((rng.choice([k, k, None, 7]), text))
    rows += rows[:10] + [(200 + k, " ".join(shared[4])) for k in range(40)] + [(500, " ".join(shared[2]).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(passages.cut_repeats(docs), *CUT)
    assert got == plain_cut(rows) and sum(r[2] for r in got) > 1000


def test_passages_of_awkward_rows(spark):
    for clash in (False, True):
        got = rows_of(passages.without_repeats(awkward(spark, clash)), *CUT[:4])
        assert got == sorted((r[:4] for r in plain_cut([r[:2] for r in awkward_rows()])), key=repr)
    assert passages.without_repeats(empty(spark)).collect() == []
