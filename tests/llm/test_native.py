"""Exact dedup, chat formatting, fingerprints and URL filters: edges, and plain versions of the rules."""

import base64

import pytest

from tests.llm.helpers import ascii_lower, awkward, awkward_rows, empty, rows_of, sha
from tidemark.llm import chat, exact_dedup, fingerprints, url_filter


def index(spark, buckets=4):
    return exact_dedup.DigestIndex(spark, exact_dedup.index_folder(spark), buckets)


@pytest.mark.parametrize("clash", [False, True])
def test_copies_are_marked(spark, clash):
    got = exact_dedup.mark_copies(awkward(spark, clash), index(spark)).collect()
    groups = {}
    for doc_id, text, *_ in awkward_rows():
        groups.setdefault(sha(ascii_lower(text)), []).append(doc_id)
    assert len(got) == len(awkward_rows())
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_index_remembers(spark):
    seen = index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "A"), (4, "c"), (5, "C")], "doc_id long, text string")
    assert rows_of(exact_dedup.mark_copies(first, seen), "doc_id", "kept") == [(1, True), (2, True)]
    assert rows_of(exact_dedup.mark_copies(second, seen), "doc_id", "keep_id", "kept") == [(3, 1, False), (4, 5, False), (5, 5, True)]
    assert seen.rows().count() == 3
    again = exact_dedup.mark_copies(second, seen)
    assert seen.rows().count() == 3 and not any(r.kept for r in again.collect())
    plan = seen.unseen(exact_dedup.groups_of(exact_dedup.digests(first)))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_index_opens_again(spark):
    folder = exact_dedup.index_folder(spark)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    exact_dedup.mark_copies(docs, exact_dedup.DigestIndex(spark, folder, 4))
    assert exact_dedup.DigestIndex(spark, folder, 4).rows().count() == 1


def test_drop_copies(spark):
    docs = awkward(spark, True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    best = {}
    for doc_id, text, *_ in awkward_rows():
        key = ascii_lower(text)
        best[key] = max(best.get(key, -1), -1 if doc_id is None else doc_id)
    got = [(ascii_lower(r.text), -1 if r.doc_id is None else r.doc_id) for r in kept.collect()]
    assert sorted(got) == sorted(best.items())


def test_dropped_copies_are_remembered(spark):
    import corpus_pipeline

    first = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (3, "b", "z"), (None, None, "n")], "doc_id long, text string, lang string")
    second = spark.createDataFrame([(9, "B", "x"), (4, "c", "y"), (4, "c", "y"), (5, "", "z")], "doc_id long, text string, lang string")
    seen = index(spark)
    assert rows_of(exact_dedup.drop_copies(first, seen), "doc_id", "lang") == sorted([(2, "y"), (3, "z"), (None, "n")], key=repr)
    assert rows_of(exact_dedup.drop_copies(second, seen), "doc_id", "lang") == [(4, "y")]
    assert rows_of(seen.rows(), "doc_id", "copies") == sorted([(2, 2), (3, 1), (4, 2), (None, 1)], key=repr)
    spark.conf.set(corpus_pipeline.INDEX, exact_dedup.index_folder(spark))
    try:
        assert rows_of(corpus_pipeline.without_copies(spark, first, ""), "doc_id") == sorted([(2,), (3,), (None,)], key=repr)
        assert rows_of(corpus_pipeline.without_copies(spark, second, ""), "doc_id") == [(4,)]
    finally:
        spark.conf.unset(corpus_pipeline.INDEX)


def test_dedup_of_nothing(spark):
    assert exact_dedup.mark_copies(empty(spark), index(spark)).collect() == []
    assert exact_dedup.drop_copies(empty(spark)).collect() == []


# ------------------------------------------------------------------ chats
TURNS = "conv_id long, turn long, role string, text string, segment string, n string"


def chats(spark, logs):
    rows = [(c, t, r, x, "own", "own") for c, log in logs.items() for t, r, x in log]
    return spark.createDataFrame(rows, TURNS)


def test_longest_snapshots_stay(spark):
    a = [(0, "user", "hi"), (1, "assistant", "hello")]
    logs = {
        1: a[:1], 2: a, 3: a, 4: a + [(2, "user", "more")], 5: [(0, "user", "hi"), (1, "assistant", "other")],
        6: [(0, "user", "hi"), (2, "assistant", "hello")], 7: [(0, None, None)], 8: [(0, "", ""), (0, "", "")],
        9: [(None, "system", "x"), (0, "user", "hi")], None: [(0, "user", "nobody's")],
    }
    got = chat.format_chats(chats(spark, logs)).collect()
    assert {r.conv_id: r.n_messages for r in got} == {4: 3, 5: 2, 6: 2, 7: 1, 8: 2, 9: 2, None: 1}
    four = next(r for r in got if r.conv_id == 4)
    assert four.rendered == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    )


def test_equal_conversations_and_segments(spark):
    log = [(t, "user", f"m{t}") for t in range(10)]
    got = sorted(chat.format_chats(chats(spark, {7: log, 3: log}), 4).collect(), key=lambda r: r.segment)
    assert [(r.conv_id, r.segment, r.n_copies, r.n_messages) for r in got] == [(3, k, 2, 10) for k in range(3)]
    assert "".join(r.rendered for r in got).count("<|im_start|>") == 10
    assert chat.format_chats(chats(spark, {})).collect() == []


@pytest.mark.parametrize("turn", [None, 5, -(2**63)])
def test_messages_of_one_turn_are_split_by_their_position(spark, turn):
    log = [(turn, "user", f"m{k % 23:02}") for k in range(150)] + [(turn, None, "m22"), (turn, "", "m22")]
    got = sorted(chat.format_chats(chats(spark, {7: log, None: log, 3: [(1, "a", "x")]}), 16).collect(), key=lambda r: (r.n_messages, r.segment))
    bodies = [f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in sorted((r or "", t) for _, r, t in log)]
    want = ["".join(bodies[k : k + 16]) for k in range(0, len(bodies), 16)]
    assert [r.rendered for r in got if r.n_messages == 152] == want
    assert [r.rendered for r in got if r.n_messages == 1] == ["<|im_start|>a\nx<|im_end|>\n"]


# ------------------------------------------------------------------ fingerprints
def paragraph_set(text):
    return {line[k : k + 256] for line in text.split("\n") for k in range(0, len(line), 256)}


def likeness(a, b):
    x, y = paragraph_set(a), paragraph_set(b)
    return 1 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0


@pytest.mark.parametrize("clash", [False, True])
def test_fingerprints_against_sets(spark, clash):
    rows = [(d, t) for d, t, *_ in awkward_rows() if d is not None]
    rows = [r for k, r in enumerate(rows) if r[0] not in [x[0] for x in rows[:k]]]
    rows += [(100 + k, "\n".join(f"line {j * (1 + k % 3)}" for j in range(40 * k))) for k in range(12)]
    rows.append((50, "𝔘é" * 301))
    docs = awkward(spark, clash).limit(0).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    rows = sorted((d, t or "") for d, t in rows)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == sha(edited)
        assert r.near_edited == pytest.approx(likeness(text, edited)) and r.near_next == pytest.approx(likeness(text, following))
        assert (r.fingerprint == r.edited_fingerprint) == (paragraph_set(text) == paragraph_set(edited))
        assert len(base64.b64decode(r.fingerprint)) == 20 * 3 * fingerprints.CELLS


def test_blocks_hand_over(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 7)
    rows = [(k * k, f"text {k}") for k in range(100)] + [(None, "none"), (4, "four again")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 102
    follows = {(r.doc_id, r.text): r.next_text for r in got}
    assert follows[(None, "none")] == "text 0" and follows[(99 * 99, "text 99")] == "none"
    assert {follows[(4, "text 2")], follows[(4, "four again")]} & {"text 3"}
    assert all(follows[(k * k, f"text {k}")] == f"text {k + 1}" for k in range(3, 99))
    assert fingerprints.fingerprints(empty(spark)).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 0


# ------------------------------------------------------------------ urls
def pages(spark, urls):
    return spark.createDataFrame([(k, u, "own", "own") for k, u in enumerate(urls)], "page_id long, url string, host string, template string")


def test_rules_and_parts(spark):
    urls = [
        "https://A.Example.COM/en/1?x", "http://www.example.com/en/2", "x://example.com", "http://example.com/de#t", None, "nothing", "",
        "http://sub.net/es/9", "http://net/fr/", "http://subnet/es/9", "http://b.org/a/b", "http://xcom/en/", "://u@h:1/p://q", "http://n.net/ES/1",
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages(spark, urls)).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2] == ("example.com", "", None, "allow") and got[3] == ("example.com", "/de", "com/", "allow")
    assert got[4] == got[5] == got[6] == ("", "", None, "allow")
    assert got[7] == ("sub.net", "/es/9", "net/es/", "block") and got[8] == ("net", "/fr/", "net/fr/", "block")
    assert got[9][2:] == (None, "allow") and got[11][2:] == (None, "allow") and got[12][:2] == ("u@h:1", "/p://q")
    assert url_filter.judge(pages(spark, [])).collect() == []


def test_templates_generalise(spark):
    rows = [("h", f"/list/{name}/view", "block" if k < 30 else None) for k, name in enumerate("".join(c) for c in _names(40))]
    rows += [("h", f"/good/{k}", "allow") for k in range(20)] + [("h", "/es/a", "block"), ("h", "/fr/a", "block")] * 20
    rows += [("h", "/".join(["", *"abcdefghijkl"]), None)]
    urls = spark.createDataFrame(rows, "host string, path string, label string")
    learned = url_filter.templates(urls.select("host", url_filter.shapes(urls.path).alias("segs"), "label")).collect()
    by = {"/".join(r.segs): r for r in learned}
    some = [r for p, r in by.items() if p.startswith("list/")]
    assert {r.template.split("/")[2] for r in some} == {"*"} and all(r.rejected for r in some)
    assert not by["good/#"].rejected and by["good/#"].template.endswith("/#")
    assert by["es/a"].template == by["fr/a"].template and by["es/a"].rejected
    assert by["a/b/c/d/e/f/g/h/**"].template.endswith("**") and not by["a/b/c/d/e/f/g/h/**"].rejected


def _names(n):
    return [(chr(97 + k // 26), chr(97 + k % 26), "x") for k in range(n)]
