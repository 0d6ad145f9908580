"""Small tables with awkward rows, and plain versions of the rules to hold results against."""

from __future__ import annotations

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside, as extra columns of the input
CLASHING = ("_digest", "_keep", "_n", "_key", "key", "at", "starts", "doc", "items", "phrase", "digest", "keep", "row", "n", "set", "block", "token", "part", "score", "_id", "_gone", "kept", "keys", "rank")


def ascii_lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def phrase(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    base = [phrase(rng, 60) for _ in range(6)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(base)]
    rows += [(10, base[0].upper(), None, "s", 1), (11, base[0], "en", None, None), (12, base[1] + " one more word", "en", "s", 5)]
    rows += [(13, None, "en", "s", 0), (14, "", "en", "s", 0), (15, "   \n\t ", "en", "s", 6), (None, base[2], "en", "s", 3)]
    rows += [(None, None, None, None, None), (16, "tiny text", "en", "s", 9), (17, "Tiny  Text", "en", "s", 9), (16, "tiny text", "en", "s", 9)]
    rows += [(18, phrase(rng, 9000), "en", "s", 7), (19, "É" + "x" * 5000, "fr", "s", 2), (20, "éa <|endoftext|> 12\u00a0b", "fr", "s", 3)]
    rows += [(20, "the same id again, another text altogether", "fr", "s", 3)]
    return rows


def awkward(spark, clash: bool = False):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    if clash:
        docs = docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return docs


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *names) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def near_groups(texts: list[str | None]) -> list[int]:
    """Place of the first row of each row's component, by comparing all pairs."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]
