"""Word boundaries of the two tokenizer patterns, found on whole texts at once instead of match by match."""

from __future__ import annotations

import functools
import itertools

import numpy as np

LETTER, NUMBER, SPACE, SIGN = 0, 1, 2, 3
#: Endings that the patterns cut off after an apostrophe.
MARK = "\U0010ffff"
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def kinds() -> np.ndarray:
    """Kind of every code point, asked of the tokenizers library, whose Unicode version may differ from Python's."""
    from tokenizers import Regex, pre_tokenizers

    def pieces(pattern: str, behaviour: str, text: str) -> list[tuple[int, int]]:
        return [at for _, at in pre_tokenizers.Split(Regex(pattern), behaviour).pre_tokenize_str(text)]

    points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
    runs = np.array([a for a, _ in pieces(r"\p{L}+|\p{N}+|\s+", "isolated", points.tobytes().decode("utf-32-le"))])
    first = points[runs].tobytes().decode("utf-32-le")
    kind = np.full(len(runs), SIGN, dtype=np.uint8)
    for k, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        fits = np.ones(len(runs), dtype=bool)
        for a, b in pieces(pattern, "removed", first):
            fits[a:b] = False
        kind[fits] = k
    out = np.full(0x110000, SIGN, dtype=np.uint8)
    out[points] = np.repeat(kind, np.diff(np.append(runs, len(points))))
    return out


def endings(text: str, start: np.ndarray, first: np.ndarray) -> None:
    """Cut what follows an apostrophe that starts a word. ``start`` marks word starts, ``first`` holds apostrophes' places."""
    for at in first.tolist():
        if start[at]:
            for end in ENDINGS:
                if text.startswith(end, at + 1):
                    start[at + 1] = False
                    if at + 1 + len(end) < len(text):
                        start[at + 1 + len(end)] = True
                    break


def parted(text: str, points: np.ndarray, cuts: np.ndarray) -> list[str]:
    """The text cut at the places: by one split at marks put in, which is faster than slices."""
    if MARK in text:
        places = cuts.tolist()
        return [text[a:b] for a, b in zip(places, [*places[1:], len(text)])]
    out = np.empty(len(points) + len(cuts) - 1, dtype=np.uint32)
    marks = cuts[1:] + np.arange(len(cuts) - 1)
    rest = np.ones(len(out), dtype=bool)
    rest[marks] = False
    out[marks] = ord(MARK)
    out[rest] = points
    return out.tobytes().decode("utf-32-le", "surrogatepass").split(MARK)


def byte_words(text: str) -> list[str]:
    """Words of ``bpe.BYTE_PATTERN``; together they are the text."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds()[points]
    start = np.empty(len(kind), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # the last of several spaces, or a single one, is a word of its own or, as a blank, begins the next
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:])
    start[last] = True
    blank = last[points[last] == 32]
    start[blank + 1] = False
    if "'" in text:
        endings(text, start, np.flatnonzero(points == 39))
    return parted(text, points, np.flatnonzero(start))


def word_words(text: str) -> list[str]:
    """Words of ``bpe.WORD_PATTERN``: letters together, numbers one by one, signs together, no spaces."""
    if not text:
        return []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds()[points]
    start = np.empty(len(kind), dtype=bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == NUMBER
    if "'" in text:
        endings(text, start, np.flatnonzero(points == 39))
    cuts = np.flatnonzero(start)
    return list(itertools.compress(parted(text, points, cuts), (kind[cuts] != SPACE).tolist()))
