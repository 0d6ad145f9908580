"""Packing, classifier, token counts, BPE, personal data, near copies and the pipeline: edges and brute force."""

import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward, awkward_rows, empty, near_groups, phrase, rows_of, sha, shingle_set
from tidemark.llm import bpe, bpe_words, components, near_join, packing, pii, quality, tallies, token_counts, words
from tidemark.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

BYTE, WORD = vocabulary(BYTE_BPE), vocabulary(WORD_BPE)
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: (lambda t, k=Tokenizer.from_file(p): k.encode(t or "", add_special_tokens=False).ids) for p in (BYTE, WORD)} | {
        "decode": Tokenizer.from_file(BYTE).decode
    }


# ------------------------------------------------------------------ tokens
odd_text = st.lists(
    st.one_of(
        st.text(max_size=6),
        st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "  ", "\n\n", "Σς", "é", "\x85", "\u2003", "İ", "中文", "12", "\U000323b5", "aaaa"]),
    ),
    max_size=8,
).map("".join)


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_texts_tokenise_as_the_library(library, text):
    assert token_counts.count(text, WORD) == len(library[WORD](text))
    ids = library[BYTE](text)
    assert bpe.encoder(BYTE).encode(text, allowed_special=set(bpe.specials(BYTE)), disallowed_special=()) == ids
    enc, special = bpe.encoder(BYTE), bpe.specials(BYTE)
    parts = bpe_words.split_words(text, BYTE)
    assert "".join(parts) == text
    assert [i for w in parts for i in ([special[w]] if w in special else enc.encode_ordinary(w))] == ids


@pytest.mark.parametrize("plane", [0, 1, 2, 3, 14])
def test_every_code_point_between_neighbours(plane):
    """After a sign, a letter, a number and a space; beyond these planes there is nothing but signs."""
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    points = [c for c in range(plane << 16, (plane << 16) + 0x10000) if not 0xD800 <= c < 0xE000]
    enc = bpe.encoder(BYTE)
    for at in range(0, len(points), 64):
        text = "".join(f"·{chr(c)}a{chr(c)}1{chr(c)} {chr(c)}· " for c in points[at : at + 64])
        assert token_counts.count(text, WORD) == len(word.encode(text, add_special_tokens=False).ids), hex(points[at])
        ids = byte.encode(text, add_special_tokens=False).ids
        assert [i for w in bpe_words.split_words(text, BYTE) for i in enc.encode_ordinary(w)] == ids, hex(points[at])
        assert enc.encode_ordinary(text) == ids, hex(points[at])


@pytest.mark.parametrize("clash", [False, True])
def test_counts_and_round_trip(spark, library, clash):
    docs = awkward(spark, clash)
    got = rows_of(token_counts.token_counts(docs, WORD, 100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), n := len(library[WORD](t)), n > 100) for d, t, *_ in awkward_rows()]
    assert got == sorted(want, key=repr)
    got = rows_of(bpe_words.encode_and_decode(docs, BYTE, 20_000), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for d, t, *_ in awkward_rows():
        ids = library[BYTE](t)
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library["decode"](ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)


def test_words_meet_in_one_exchange(spark):
    plan = bpe_words.encode_and_decode(awkward(spark), BYTE, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(word#", plan)) == 1, plan


def test_ids_go_back_packed_also_if_memory_overflows(monkeypatch):
    monkeypatch.setattr(bpe_words, "MEMORY", 2)
    monkeypatch.setattr(bpe_words, "HELD", 3)

    class Dealt:
        def select(self, *names):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    words_ = [" word", "aaaa", "\u00e9\u4e2d", "<|endoftext|>", " word", "", "aaaa"]
    batch = pa.record_batch([pa.array([1, 2, 1, 1, 2, 2, 1], pa.int32()), pa.array([4, 0, 2, 9, 7, 3, 1], pa.int32()), pa.array(words_)], names=["block", "place", "word"])
    out = pa.Table.from_batches(list(bpe_words.packed_ids(Dealt(), BYTE)(iter([batch.slice(0, 4), batch.slice(4)]))))
    code = bpe_words.coder(BYTE)
    for block in (1, 2):
        some = out.take(pa.array([k for k, b in enumerate(out.column("block").to_pylist()) if b == block]))
        got = sorted(bpe_words.unpacked(some))
        assert got == sorted((p, code(w)[0], None) for b, p, w in zip(*(c.to_pylist() for c in batch.columns)) if b == block)
    assert code("<|endoftext|>") == ([bpe.specials(BYTE)["<|endoftext|>"]], b"<|endoftext|>")
    # a word that does not decode to itself keeps what it decodes to
    monkeypatch.setattr(bpe_words, "coder", lambda path: lambda word: ([7, 8], word.encode() + b"!" if word == "aaaa" else word.encode()))
    out = pa.Table.from_batches(list(bpe_words.packed_ids(Dealt(), BYTE)(iter([batch.slice(0, 2)]))))
    assert sorted(bpe_words.unpacked(out)) == [(0, [7, 8], b"aaaa!"), (4, [7, 8], None)]


def test_arrow_memory_goes_back_after_each_batch(monkeypatch):
    back = []

    class Pool:
        def release_unused(self):
            back.append(len(seen))

    seen = []
    monkeypatch.setattr(words.pa, "default_memory_pool", Pool)
    out = list(words.released(lambda batches: (seen.append(b) or b for b in batches))(iter("abc")))
    assert out == seen == list("abc") and back == [1, 2, 3, 3]


def test_numpy_memory_goes_back_after_each_batch():
    """In a process of its own: 64 MB of small arrays are freed below one that stays."""
    code = """
import re
import numpy as np
from tidemark.llm import words
def held():
    return int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
def work(batches):
    global last
    for _ in batches:
        arrays = [np.ones(64 << 10, dtype=np.uint8) for _ in range(1024)]
        last = arrays[-1]
        print(held())
        del arrays
        yield
before = held()
at = words.released(work)(iter(range(2)))
next(at), next(at)
list(at)
print(before, held())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    first, second, before, after = map(int, out)
    assert min(first, second) >= before + 60 and max(first, second) < before + 100 and after < before + 16


def test_counted_items_are_marked_by_the_workers_that_count(spark, monkeypatch):
    """No task has two Python steps, and all frequent items are marked."""
    rare, often = (words.mixed(np.arange(a, a + 500, dtype=np.uint64)) for a in (0, 10_000))
    rows = spark.createDataFrame([(h.tobytes(),) for h in (rare, *[often] * 4)], "hashes binary").repartition(3)
    plans, frame = [], type(rows)
    local = frame.toLocalIterator
    monkeypatch.setattr(frame, "toLocalIterator", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or local(df))
    table = tallies.candidates(rows, lambda batch: (np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(0)), 70, 4, 1 << 20, bounded=False)
    assert tallies.may_be_frequent(often, 70, table).tolist() == list(range(500)) and len(tallies.may_be_frequent(rare, 70, table)) < 50
    steps = [x for line in plans[0].split("Initial Plan")[0].splitlines() for x in ("MapInArrow", "Exchange") if x in line.split("(")[0]]
    assert steps.count("MapInArrow") == 2 and ("MapInArrow", "MapInArrow") not in list(zip(steps, steps[1:]))


def test_no_documents(spark):
    assert token_counts.token_counts(empty(spark), WORD).collect() == []
    assert bpe_words.encode_and_decode(empty(spark), BYTE).collect() == []
    assert packing.pack(empty(spark), BYTE).collect() == []
    assert pii.find(empty(spark)).collect() == [] and pii.redact(empty(spark)).collect() == []
    assert near_join.near_components(empty(spark)).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classify(empty(spark), labels).collect() == []


def test_memory_may_overflow(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY", 3)
    counter = token_counts.WordCounter(WORD)
    texts = phrase(random.Random(1), 50).split()
    assert [counter[t] for t in texts] == [token_counts.counter(WORD)[t] for t in texts]


# ------------------------------------------------------------------ packing
def test_pieces(spark, library):
    got = packing.pack(awkward(spark, True), BYTE, 64).collect()
    by_row, bins = {}, {}
    for r in got:
        by_row.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    texts = {d: t for d, t, *_ in awkward_rows() if [x[0] for x in awkward_rows()].count(d) == 1}
    for doc_id, text in texts.items():
        ids = np.array([*library[BYTE](text), 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by_row[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert k == 0 or r.length == 64
            at += r.length
        assert at == len(ids)
    total = sum(len(library[BYTE](t)) + 1 for _, t, *_ in awkward_rows())
    assert sum(r.length for r in got) == total and len(bins) <= -(-total // 64) + 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 5), max_size=8), st.integers(1, 20))
def test_fullest_is_the_best_sum(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    picked = packing.fullest(counts, room)
    assert sum(x * k for x, k in picked.items()) == max(sums)
    assert all(k <= counts[x] for x, k in picked.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=12))
def test_plan_places_everything(histogram):
    bins, placed = {}, dict.fromkeys(histogram, 0)
    rows = packing.plan_bins(histogram, 32)
    for k, (length, first, per, base, offset) in enumerate(rows):
        upto = min([r[1] for r in rows if r[0] == length and r[1] > first], default=histogram[length])
        for rank in range(first, upto):
            step = rank - first
            bins.setdefault(base + step // per, []).append((offset + step % per * length, length))
            placed[length] += 1
    assert placed == histogram
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 32
    assert len(bins) >= -(-sum(x * n for x, n in histogram.items()) // 32)


# ------------------------------------------------------------------ classifier
def junk(rng):
    return " ".join(w + "$$$" for w in phrase(rng, 40).split())


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(k, phrase(rng, 40) if k % 3 else junk(rng)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)] + [(5, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(None, None), (1000, ""), (1001, None)], "doc_id long, text string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert held and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    empties = {r.score for r in got if r.doc_id in (None, 1000, 1001)}
    assert len(empties) == 1


def test_labels_of_the_held_out_rows_do_not_matter(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, phrase(rng, 20) if k % 2 else junk(rng), "x") for k in range(200)], "doc_id long, text string, lang string")
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2]
    labels = [(k, k % 2) for k in range(200)]
    other = [(k, 1 - q if k in held else q) for k, q in labels]
    a, b = (quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, other))
    assert rows_of(a, "doc_id", "score") == rows_of(b, "doc_id", "score")


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(awkward(spark, True), none).collect()} == {0.5}
    assert quality.keep_good(awkward(spark, True), none).count() == 0
    ones = spark.createDataFrame([(k, 1) for k in range(30)], "doc_id long, quality int")
    kept = quality.keep_good(awkward(spark, True), ones)
    assert kept.columns == awkward(spark, True).columns and kept.count() == len(awkward_rows())


# ------------------------------------------------------------------ personal data
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"ab.@-+% ()0123456789\né", "1.2.3.4", "4111111111111111", "@a.b", "+1 (519) 555-5645"]), max_size=24).map("".join))
def test_base_spans_are_the_patterns(text):
    base, added = pii.spans_of(text, pii.trained())
    assert base == plain_spans(text)
    places = sorted((a, b) for _, a, b in added)
    assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))
    assert not any(a < d and c < b for a, b in places for _, c, d in base)


def test_field_on_sentences_it_never_saw():
    rng, right, n, weights = random.Random(99), 0, 0, pii.trained()
    for _ in range(400):
        text, spans = pii.sentence(rng)
        base, added = pii.spans_of(text, weights)
        if not base:
            n, right = n + 1, right + (added == spans)
    assert right >= 0.93 * n
    assert pii.spans_of("nothing here in 1998, only 12,345.67 and v1.2.3 of 4738745 parts", weights) == ([], [])


def test_best_is_the_highest_total():
    rng = random.Random(8)
    for _ in range(60):
        scored = [(i, i + rng.randint(1, 4), rng.choice(pii.ADDED), rng.uniform(-1, 2)) for i in (rng.randrange(6) for _ in range(6))]
        value = {(i, j, k): s for i, j, k, s in sorted(scored, key=lambda x: x[3])}
        choices = [()]
        for seg in value:
            choices += [c + (seg,) for c in choices if all(seg[1] <= x[0] or x[1] <= seg[0] for x in c)]
        assert sum(value[s] for s in pii.best(10, scored)) == pytest.approx(max(sum(value[s] for s in c) for c in choices))


def test_find_and_redact(spark):
    got = {r.doc_id: r for r in pii.find(awkward(spark, True)).collect()}
    assert got[13].spans == "" and got[13].base_sha256 == sha("")
    text = "mail a.b@c.de or call +1 (519) 555-5645, card 4111 1111 1111 1111, 10.0.0.1 password=7695f98391c04c2f5d é"
    docs = spark.createDataFrame([(1, text, 5), (2, "clean", 99), (3, None, None)], "doc_id long, text string, n_chars long")
    r = pii.find(docs).filter("doc_id = 1").first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans.endswith("secret:85:103")
    assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text)))
    masked = "mail [EMAIL] or call [PHONE], card [CARD], [IP] password=[SECRET] é"
    assert rows_of(pii.redact(docs), "doc_id", "text", "n_chars") == [(1, masked, len(masked)), (2, "clean", 99), (3, None, None)]


def test_long_texts_take_linear_time():
    weights = pii.trained()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a.b@" * 100_000):
        assert isinstance(pii.spans_of(text, weights), tuple)


# ------------------------------------------------------------------ near copies
def test_word_hashes():
    texts = ["The  the\tTHE", None, "", "a\x0bb\x0cc\rd\x85e é É", "x" * 200_000 + " y", "y"]
    h, rows = words.of_rows(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(rows).tolist() == [len(s) for s in split]
    seen = {}
    for word, value in zip((w for s in split for w in s), h.tolist()):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["skip", *texts]).slice(1)
    assert words.of_rows(sliced)[0].tolist() == h.tolist()


def family(rng, size, edits):
    base = phrase(rng, 120).split()
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = phrase(rng, 1)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(near_join, "CHUNK", 6)
    monkeypatch.setattr(near_join, "COMMON", 3)
    rng = random.Random(seed)
    shared = phrase(rng, 60)
    texts = family(rng, 30, 3) + family(rng, 8, 5) + [phrase(rng, 30) + " " + shared for _ in range(12)]
    texts += [t for t, _ in zip(family(rng, 6, 2), range(6))] + ["one two", "One  TWO", "", None, "   ", "one two three four five"]
    texts += [shared, shared + " x", "a b c d e f", "b c d e f a"]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "own", "own") for k, t in enumerate(texts)], "doc_id long, text string, token string, set string")
    got = {r.doc_id: r.component_id for r in near_join.near_components(docs).collect()}
    assert [got[k] for k in range(len(texts))] == near_groups(texts)


def plain_links(texts):
    """The links between texts, by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    return [(a, b) for b in range(len(sets)) for a in range(b) if (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b])]


def test_every_link_is_counted(spark, monkeypatch):
    """A family over many chunks, with copies: links inside a component count, not just those that connect it."""
    monkeypatch.setattr(near_join, "CHUNK", 4)
    rng = random.Random(12)
    texts = family(rng, 40, 2) + [phrase(rng, 30) for _ in range(5)] + ["", None, "one two", "One two", "one two"]
    texts += [t.upper() for t in texts[:6]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_links(texts)
    got = {r.doc_id: r.n_links for r in near_join.near_components(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [sum(k in pair for pair in want) for k in range(len(texts))]
    ids = {r.doc_id: r["set"] for r in near_join.set_table(docs).collect()}
    pairs = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in want if ids[a] != ids[b]}
    assert rows_of(near_join.links(docs), "a", "b") == sorted(pairs, key=repr)
    assert near_join.links(empty(spark)).collect() == []


def test_no_table_of_whole_sets_is_written(spark, monkeypatch):
    """Who meets whom is known before the sets move, so they go from their copies to their meetings."""
    written, before = [], near_join.materialise
    monkeypatch.setattr(near_join, "materialise", lambda df: written.append(df.columns) or before(df))
    docs = spark.createDataFrame(list(enumerate(family(random.Random(3), 12, 2))), "doc_id long, text string")
    near_join.near_components(docs).collect()
    assert written and not [c for c in written if "tokens" in c]
    rows = [r for r in near_join.set_table(docs).collect()]
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), sorted(docs.collect(), key=lambda r: r.doc_id)):
        tokens = next(near_join.shingles(pa.array([t.text])))
        assert [r[c] for c in near_join.LEAST] == [int(words.mixed(tokens ^ x).min().view(np.int64)) for x in near_join.SALTS]


def test_marking_sets_takes_no_more_than_the_bit_table(spark, monkeypatch):
    import tracemalloc

    held = {}

    class Plan:
        def coalesce(self, n):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            sets = np.array([-1, 0, 5, 1 << 40], dtype=np.int64)
            tracemalloc.start()
            held["rows"] = [b.to_pylist() for b in work(iter([pa.record_batch([pa.array(sets)], names=["set"])]))]
            held["most"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

        def groupBy(self, key):  # noqa: N802
            return self

        def applyInArrow(self, work, schema):  # noqa: N802
            return self

        def collect(self):
            return [(r["part"], r["bits"]) for rows in held["rows"] for r in rows]

    bits = near_join.bit_table(Plan())
    assert held["most"] < near_join.BITS // 4
    on = {k for k in np.flatnonzero(np.unpackbits(bits)).tolist()}
    assert on == {k % near_join.BITS for k in (-1, 0, 5, 1 << 40)}


def test_near_edges(spark):
    got = rows_of(near_join.near_components(awkward(spark, True)), "doc_id", "n_shingles", "component_id")
    rows = awkward_rows()
    groups = near_groups([t for _, t, *_ in rows])
    want = []
    for (doc_id, text, *_), g in zip(rows, groups):
        n = len({tuple(w) for w in _five(text)})
        ids = [r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None]
        want.append((doc_id, n, (min(ids) if ids else None) if n else doc_id))
    assert got == sorted(want, key=repr)


def _five(text):
    w = (text or "").encode().lower().split()
    return [w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []


def test_connected_components(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(7, 3), (3, 9), (20, 20), (50, 51), (51, 50)]
    got = rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "comp")
    assert got == sorted([(k, 100) for k in range(100, 141)] + [(3, 3), (7, 3), (9, 3), (50, 50), (51, 50)], key=repr)


def test_one_row_of_each_component_stays(spark):
    import corpus_pipeline

    rng = random.Random(21)
    one, two, three, four = (phrase(rng, 60) for _ in range(4))
    rows = [(None, f"{one} {k}") for k in range(5)]  # no ids at all
    rows += [(7, f"{two} a"), (7, f"{two} b")]  # one id
    rows += [(3, f"{three} a"), (5, f"{three} b"), (5, "an unrelated text of the same id it is"), (None, f"{three} c")]
    rows += [(8, four), (8, four), (9, f"{four} x"), (10, ""), (10, ""), (None, None)]
    docs = spark.createDataFrame([(*r, f"row {k}") for k, r in enumerate(rows)], "doc_id long, text string, _own string")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    groups = near_groups([t for _, t in rows])
    want = {}
    for (doc_id, text), g in zip(rows, groups):
        want.setdefault(g, []).append((doc_id, text))
    for members in want.values():
        assert len(stay := [r for r in kept if r in members]) == (1 if members[0][1] else len(stay)), members
        assert stay[0][0] == min((d for d, _ in members if d is not None), default=None)
    assert len(kept) == 5 + 3  # five components with words, three rows without
    assert corpus_pipeline.without_near_copies(spark, empty(spark), "").collect() == []


# ------------------------------------------------------------------ the pipeline
def test_pipeline_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [phrase(rng, 40) if k % 4 else junk(rng) for k in range(240)]
    texts[5] = texts[1].upper()
    texts[6] = texts[2] + " extra"
    texts[7] += " write to some.one@mail.example.org"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns, name
        seen.append({r.doc_id: r.text for r in left.collect()})
    assert set(seen[0]) == {k for k in range(240) if k % 4}
    assert set(seen[0]) - set(seen[1]) == {1} and set(seen[1]) - set(seen[2]) == {6}
    assert {k for k in seen[3] if seen[3][k] != texts[k]} == {7} and "[EMAIL]" in seen[3][7]
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)), "doc_id", "piece", "length")
    enc = bpe.encoder(BYTE)
    assert got == sorted(((k, 0, len(enc.encode_ordinary(t)) + 1) for k, t in seen[3].items()), key=repr)


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = awkward(spark, True)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    ids = [(k, 1, 0) for k in range(21)] + [(None, 1, 0), (3, 1, 0)]
    spark.createDataFrame(ids, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    # 0, 10 and 11 are equal, as 2 and a row without id, and the empty texts; 12 is near 1, 17 near 16, which stands there twice
    assert sorted(r.doc_id for r in got if r.piece == 0) == [1, 2, 3, 4, 5, 11, 14, 15, 16, 18, 19, 20, 20]
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in held.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= 1024
    # without labels no document is taken for good, and without documents there is nothing to pack
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("b", docs), ("c", empty(spark))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect() == []


def test_sample_of_the_classifier_holds_one_row_of_an_id(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, phrase(rng, 40) if k % 2 else junk(rng)) for k in range(80)]
    rows += [(1, phrase(rng, 30)) for _ in range(200)]  # an id of most rows
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    sizes = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *rest: sizes.append((len(y), float(x.sum()), float(y.sum()))) or fit(x, y, *rest))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vectors = quality.word_vectors(docs)
    for parts in (1, 5):
        quality.learn(docs.repartition(parts), labels, vectors)
    known = [k for k in range(80) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert all(n == len(known) and ones == sum(k % 2 for k in known) for n, _, ones in sizes)
    assert abs(sizes[0][1] - sizes[1][1]) < 1e-2  # the same rows, whatever the layout
