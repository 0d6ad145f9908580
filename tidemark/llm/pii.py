"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of four patterns, each checked afterwards; a match
that fails its check is dropped and not retried. Around digits, codes and spelled-out addresses outside the base spans, the field
looks at candidate segments: whole spans of tokens of at most ``LONGEST`` tokens that have the build of a kind. Features
of the whole span (its shape, length, check digits, what stands before it) score each candidate, and a dynamic program over
the tokens chooses boundaries and kinds together, so that chosen segments never overlap. Kinds it adds: local_phone, spoken_email,
iban and secret. It is trained here, by gradient ascent on the conditional likelihood of generated sentences (``SENTENCES`` of
them), which also hold look-alikes: dates, amounts, versions, order numbers.

Defined cases: a null text is empty and has no spans; offsets count code points, ends are exclusive; repeated rows are searched
each; an empty table gives an empty result; columns beside doc_id and text are ignored by the search and carried through by
``redact``. A text is searched whole, in time proportional to its length.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.words import released

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "spoken_email", "iban", "secret")
KINDS = (*BASE, *ADDED)
LONGEST = 12
SENTENCES = 1200

# The base patterns. The domain is looked for first, its local part is what stands to its left.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed, then start."""
    found, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                end = m.end()
    if DIGIT.search(text):
        if text.count(".") > 2:
            found += [
                ("ip", m.start(), m.end()) for m in IP.finditer(text)
                if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m.group().split(".")))
            ]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return found


# ------------------------------------------------------------------ candidate segments
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
TRIGGER = re.compile(r"[0-9]{3,}|[0-9][A-Za-z]|[A-Za-z][0-9]|\b(?:dot|DOT|punkt|punto|point)\b")
DOTS, ATS = {"dot", "punkt", "punto", "point"}, {"at", "arroba", "chez"}
CLUES = {"tel", "phone", "call", "mobile", "fax", "password", "passwd", "pwd", "token", "secret", "key", "iban", "mail", "email", "contact"}
PHONE_SIGNS = {"(", ")", "-", ".", "/"}
REACH = 160  # characters to either side of a trigger that its segment may take


def candidates(text: str, tokens: list[tuple[int, int]], taken) -> list[tuple[int, int, str]]:
    """(first token, token after the last, kind) of every segment that has the build of a kind and meets no taken place."""
    piece = [text[a:b] for a, b in tokens]
    near = [b == len(text) or k + 1 == len(tokens) or tokens[k + 1][0] - b <= 1 for k, (a, b) in enumerate(tokens)]
    out = []
    for i, word in enumerate(piece):
        if taken(*tokens[i]):
            continue
        digits = word.isdecimal()
        if len(word) >= 12 and any(c.isdecimal() for c in word) and any(c.isalpha() for c in word) and word.isascii():
            out.append((i, i + 1, "secret"))
        account = len(word) >= 4 and word[:2].isalpha() and word[:2].isupper() and word[2:4].isdecimal() and word.isascii()
        if not (digits or account or word == "(" or word.isalnum() and word.isascii()):
            continue
        ats = dots = 0
        for j in range(i, min(i + LONGEST, len(piece))):
            w = piece[j]
            if taken(*tokens[j]) or j > i and not near[j - 1]:
                break
            ats, dots = ats + (w.lower() in ATS), dots + (w.lower() in DOTS)
            if account and (w.isalnum() and w.isascii()):
                if 15 <= tokens[j][1] - tokens[i][0] <= 42:
                    out.append((i, j + 1, "iban"))
            if (digits or word == "(") and j > i and w.isdecimal() and w.isascii():
                out.append((i, j + 1, "local_phone"))
            if ats and dots and w.isalnum() and w.lower() not in DOTS | ATS and word.lower() not in ATS | DOTS and j - i >= 4:
                out.append((i, j + 1, "spoken_email"))
            if not (w.isalnum() or w in PHONE_SIGNS or w in "[]{}<>_"):
                break
    return [c for c in out if c[2] != "local_phone" or all(p.isdecimal() or p in PHONE_SIGNS for p in piece[c[0] : c[1]])]


def iban_holds(code: str) -> bool:
    code = "".join(c for c in code if c.isalnum()).upper()
    if not (15 <= len(code) <= 34 and code.isascii()):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def features(text: str, tokens: list[tuple[int, int]], segment: tuple[int, int, str]) -> list[str]:
    """Names of the features of a whole segment, each with its kind."""
    i, j, kind = segment
    span = text[tokens[i][0] : tokens[j - 1][1]]
    shape = re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", span)))
    runs = [len(x) for x in re.findall(r"[0-9]+", span)]
    total = sum(runs)
    before = [text[a:b].lower() for a, b in tokens[max(0, i - 3) : i]]
    names = [
        "bias", f"tokens={min(j - i, 8)}", f"digits={min(total, 20)}", f"runs={min(len(runs), 6)}", f"last={runs[-1] if runs else 0}",
        f"signs={''.join(sorted(set(re.sub(r'[A-Za-z0-9]', '', span))))}", f"clue={any(b in CLUES for b in before)}",
        f"equals={'=' in before or ':' in before}",
    ]
    if kind == "local_phone":
        names += [f"shape={shape}", f"groups={'-'.join(map(str, runs[:5]))}", f"cut={_joined(text, tokens, i, j)}"]
    elif kind == "spoken_email":
        lower = [text[a:b].lower() for a, b in tokens[i:j]]
        names += [f"ats={sum(x in ATS for x in lower)}", f"dots={min(3, sum(x in DOTS for x in lower))}", f"end={len(lower[-1]) in (2, 3)}",
                  f"spaced={span.count(' ') >= 4}", f"single={[x for x in lower if x.isalnum()].index(next(x for x in lower if x in ATS)) == 1}", f"bracket={'[' in span or '(' in span}"]
    elif kind == "iban":
        names += [f"holds={iban_holds(span)}", f"length={len(span.replace(' ', ''))}"]
    else:
        hexa = all(c in "0123456789abcdef" for c in span.strip("AKI"))
        upper = sum(c.isupper() for c in span) / len(span)
        names += [f"hex={hexa}", f"upper={round(upper * 4)}", f"len={min(len(span) // 4, 10)}", f"mixed={round(4 * total / len(span))}"]
    return [f"{kind}:{n}" for n in names]


def _joined(text: str, tokens, i: int, j: int) -> str:
    """Whether the segment is cut out of a longer run of digits and signs."""
    a, b = tokens[i][0], tokens[j - 1][1]
    return f"{a > 0 and (text[a - 1].isalnum() or text[a - 1] in '.-/,:$€')}{b < len(text) - 1 and text[b] in '.-/,:' and text[b + 1].isalnum()}"


# ------------------------------------------------------------------ the field
def best(n: int, scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The segments of the highest total score; tokens outside segments score nothing."""
    ends: dict[int, list] = {}
    for i, j, kind, s in scored:
        if s > 0:
            ends.setdefault(j, []).append((i, kind, s))
    top, back = [0.0] * (n + 1), [None] * (n + 1)
    for p in range(1, n + 1):
        top[p] = top[p - 1]
        for i, kind, s in ends.get(p, ()):
            if top[i] + s > top[p]:
                top[p], back[p] = top[i] + s, (i, kind)
    out, p = [], n
    while p:
        if back[p]:
            out.append((back[p][0], p, back[p][1]))
            p = back[p][0]
        else:
            p -= 1
    return out[::-1]


def marginals(n: int, scored: list[tuple[int, int, str, float]]) -> list[float]:
    """Probability of every candidate, by the forward and backward sums over all choices of segments."""
    starts, ends = {}, {}
    for k, (i, j, _, s) in enumerate(scored):
        starts.setdefault(i, []).append((j, s))
        ends.setdefault(j, []).append((i, s))
    add = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for p in range(1, n + 1):
        ahead[p] = add([ahead[p - 1], *(ahead[i] + s for i, s in ends.get(p, ()))])
    for p in range(n - 1, -1, -1):
        behind[p] = add([behind[p + 1], *(behind[j] + s for j, s in starts.get(p, ()))])
    return [math.exp(ahead[i] + s + behind[j] - ahead[n]) for i, j, _, s in scored]


def sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence and its spans: invented words, one thing to find or a look-alike."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "es", "ti", "en", "de", "la", "sch", "que", "bo")) for _ in range(rng.randint(1, 4)))
    text = lambda: " ".join(word() for _ in range(rng.randint(2, 7)))
    kind, clue = rng.choice([*ADDED, *ADDED, None, None, None, None, None, None]), ""
    if kind == "local_phone":
        a, b, c = digits(3), digits(3), digits(4)
        thing = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"({a}) {b} {c}"])
        clue = rng.choice(["", "", "tel ", "call ", "phone: "])
    elif kind == "spoken_email":
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        thing = word() + rng.choice(["", digits(2)]) + at + word() + dot + rng.choice(["com", "org", "net", "de", "fr"])
        clue = rng.choice(["", "mail ", "contact: "])
    elif kind == "iban":
        body, land = digits(18), rng.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        thing = f"{land}{check:02d}{body}"
        if rng.random() < 0.5:
            thing = " ".join(thing[k : k + 4] for k in range(0, len(thing), 4))
        clue = rng.choice(["", "iban ", "IBAN: "])
    elif kind == "secret":
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 20, 32, 40])))
        key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        key = key[:7] + rng.choice("234567") + key[8:]
        clue, thing, tail = rng.choice([("password=", hexa, ""), ('token = "', hexa, '"'), ("secret: ", hexa, ""), ("", "AKIA" + key, "")])
        left = f"{text()} {clue}"
        return f"{left}{thing}{tail} {text()}", [(kind, len(left), len(left) + len(thing))]
    else:
        thing = rng.choice([
            digits(rng.randint(3, 12)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"19{digits(2)}-0{digits(1)}-1{digits(1)}", digits(16), f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}",
            f"v{digits(1)}.{digits(2)}.{digits(3)}", f"12:{digits(2)}:{digits(2)}", f"{word()}{digits(3)}", f"{digits(3)} {word()} {digits(4)}", f"{digits(3)}-{digits(2)}", f"{word()} dot {word()}",
            f"{word()} at the dot {word()}", f"{digits(4)} {digits(4)}", f"({digits(4)})", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{word()}{word()}{digits(1)}{word()}{word()}", f"AB{digits(2)} {word()} {word()} {word()}",
            f"{digits(3)}-{digits(3)}-{digits(4)}-{digits(3)}", f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
        ])
    left = f"{text()} {clue}"
    whole = f"{left}{thing}{rng.choice(['', '.', ','])} {text()}"
    return whole, [(kind, len(left), len(left) + len(thing))] if kind else []


@functools.cache
def trained(sentences: int = SENTENCES, seed: int = 11, rounds: int = 8) -> dict[str, float]:
    """Weights of all features, by stochastic gradient ascent on the likelihood of the generated spans."""
    rng, weights, cases = random.Random(seed), {}, []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segments = candidates(text, tokens, lambda a, b: False)
        if segments:
            true = [(k, tokens[i][0], tokens[j - 1][1]) in [*spans] for i, j, k in segments]
            cases.append((len(tokens), segments, [features(text, tokens, s) for s in segments], true))
    for step in range(rounds):
        rng.shuffle(cases)
        for n, segments, named, true in cases:
            scored = [(*s, sum(weights.get(f, 0.0) for f in fs)) for s, fs in zip(segments, named)]
            for p, fs, is_true in zip(marginals(n, scored), named, true):
                push = 0.3 / (1 + step) * (is_true - p)
                for f in fs:
                    weights[f] = weights.get(f, 0.0) * (1 - 1e-5) + push
    return weights


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """Spans the field finds outside the base ones."""
    covered = sorted((a, b) for _, a, b in base)
    regions: list[list[int]] = []
    k = 0
    for m in TRIGGER.finditer(text):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if k < len(covered) and covered[k][0] <= m.start() and m.end() <= covered[k][1]:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    found = []
    for a, b in regions:
        tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
        blocked = bytearray(b - a)
        for x, y in covered:
            if x < b and y > a:
                blocked[max(x, a) - a : min(y, b) - a] = b"\1" * (min(y, b) - max(x, a))
        segments = candidates(text, tokens, lambda x, y: 1 in blocked[x - a : y - a])
        scored = [(*s, sum(weights.get(f, 0.0) for f in features(text, tokens, s))) for s in segments]
        found += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in best(len(tokens), scored)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def spans_of(text: str, weights: dict[str, float]) -> tuple[list, list]:
    base = base_spans(text)
    return base, added_spans(text, base, weights)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, and all spans of every document."""
    weights = trained()

    def run(batches):
        names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column(1):
                base, added = spans_of(text.as_py() or "", weights)
                kinds = [k for k, _, _ in base]
                for column, value in zip(out, (*map(kinds.count, BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added))):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *map(pa.array, out, kinds)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), schema)


def masked(text: str, weights: dict[str, float]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    base, added = spans_of(text, weights)
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data masked in text, and n_chars, if there is one, counted anew where text changed."""
    weights = trained()

    def run(batches):
        for batch in batches:
            at, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
            for piece in words.pieces(batch, "text"):
                old = piece.column(at).to_pylist()
                new = [t and masked(t, weights) for t in old]
                piece = piece.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
                if size >= 0:
                    counts = [n if a == b else len(b) for n, a, b in zip(piece.column(size).to_pylist(), old, new)]
                    piece = piece.set_column(size, batch.schema.field(size), pa.array(counts, batch.schema.field(size).type))
                yield piece

    return docs.mapInArrow(released(run), docs.schema)
