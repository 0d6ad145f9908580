"""Reading byte-pair vocabularies, and splitting texts as they expect it. One copy per worker process and file."""

from __future__ import annotations

import functools
import json
import re

#: The pre-tokenizer patterns of the two vocabulary files.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@functools.cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.cache
def pieces(path: str) -> dict[bytes, int]:
    """Bytes of every piece of a byte-level vocabulary with its id."""
    back = {letter: b for b, letter in enumerate(byte_letters())}
    return {bytes(back[c] for c in piece): i for piece, i in vocabulary(path)["model"]["vocab"].items()}


@functools.cache
def specials(path: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in vocabulary(path)["added_tokens"]}


@functools.cache
def pieces_by_id(path: str) -> dict[int, bytes]:
    """What each id of a byte-level file decodes to, special strings among them."""
    return {**{i: p for p, i in pieces(path).items()}, **{i: s.encode() for s, i in specials(path).items()}}


@functools.cache
def encoder(path: str):
    """An encoder for a byte-level file whose ids are its merge ranks. Special strings become their ids."""
    import tiktoken

    return tiktoken.Encoding(path, pat_str=BYTE_PATTERN, mergeable_ranks=pieces(path), special_tokens=specials(path))


@functools.cache
def special_cut(path: str):
    return re.compile("(" + "|".join(re.escape(s) for s in specials(path)) + ")")


def segments(text: str, path: str) -> list[str]:
    """The text parted at special strings: ordinary text at even places, special strings at odd ones."""
    if not any(s in text for s in specials(path)):
        return [text]
    return special_cut(path).split(text)
