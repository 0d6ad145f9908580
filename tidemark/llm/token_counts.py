"""Token counts by byte-pair merging on a heap and a linked list, without ids.

A word starts as its symbols. A heap holds the rank of every adjacent pair; the lowest rank, leftmost first, is merged,
its neighbours' pairs enter the heap, and stale entries are skipped when they come up. A word has as many tokens as it had
symbols, less the merges done. Words repeat, so each worker remembers the counts of the last ``MEMORY`` distinct words.

Defined cases: a null text is empty and has no tokens; special strings inside a text are one token each, as the
tokenizer file has it; repeated rows are counted each; an empty table gives an empty result; columns beside doc_id and text are
ignored. A text is held whole by one task, and time grows with its length times a logarithm.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.splitting import word_words

MEMORY = 800_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class WordCounter(dict):
    """Word -> number of tokens; a missing word is merged and remembered."""

    def __init__(self, path: str):
        super().__init__()
        model = bpe.vocabulary(path)["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        letters = bpe.byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        self[word] = n = len(symbols) - self.merges(symbols)
        return n

    def merges(self, symbols: list[int]) -> int:
        ranks, n, done = self.ranks, len(symbols), 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or (found := ranks.get((symbols[i], symbols[j]))) is None or found[0] != rank:
                continue
            symbols[i], symbols[j], k = found[1], -1, after[j]
            after[i], done = k, done + 1
            if k < n:
                before[k] = i
                if r := ranks.get((symbols[i], symbols[k])):
                    heapq.heappush(heap, (r[0], i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))):
                heapq.heappush(heap, (r[0], h))
        return done


@functools.cache
def counter(path: str) -> WordCounter:
    return WordCounter(path)


@functools.cache
def odd_capitals() -> dict[int, str]:
    """Code points to which the tokenizers library gives another lower case than Python does to the letter alone or in a word."""
    from tokenizers import normalizers

    # lower case exists in the first two planes only; a line feed parts the answers
    points = [c for c in range(0x20000) if c != 10 and not 0xD800 <= c < 0xE000]
    library = normalizers.Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
    return {c: low for c, low in zip(points, library) if low != chr(c).lower() or c == ord("Σ")}


@functools.cache
def odd_pattern() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, map(chr, odd_capitals()))) + "]")


def lowered(text: str) -> str:
    """Composed form in lower case, letter by letter: without the final form of sigma."""
    text = unicodedata.normalize("NFC", text)
    if not text.isascii() and odd_pattern().search(text):
        text = text.translate(odd_capitals())
    return text.lower()


def count(text: str, path: str) -> int:
    parts, known = bpe.segments(text, path), counter(path)
    return len(parts) // 2 + sum(sum(map(known.__getitem__, word_words(lowered(part)))) for part in parts[::2])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            n = [count(t.as_py() or "", tokenizer) for t in texts]
            size = [0 if not t.is_valid else t.as_buffer().size for t in texts]
            yield pa.record_batch(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
