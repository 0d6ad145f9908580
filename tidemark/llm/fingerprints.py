"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut every ``PARAGRAPH`` code points. The distinct 64-bit digests of a text go into the cells of a
small sketch: each digest enters three cells, which hold a count, the xor of the digests and the xor of their check hashes.
Two sketches subtract cell by cell; what both texts share cancels, and peeling (cells that hold one digest give it up)
recovers the differing digests. If the small sketch of the fingerprint is too full to be peeled, the pair is retried
with larger ones: the digests are dealt into strata of a few each by their hash and every stratum is sketched and peeled
alone, with more cells on every attempt. Likeness is 1 - differing / (digests of both).

The next document comes from a window over blocks of neighbouring doc_ids; the first document of a block is also sent to the
block before, so no window spans the table. Everything runs in one exchange of the text, with DataFrame functions.

Defined cases: a null text is empty; an empty text has an empty sketch and likeness 1 to another empty one; rows with the
same doc_id follow each other by the hash of their text; a null doc_id comes first; a table of one row is its own next
document; an empty table gives an empty result. Columns beside doc_id and text are ignored. Long texts cost time in
proportion to their length, as strata are dealt in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARAGRAPH = 256
CELLS = 8  # per hash function, in the fingerprint
ROUNDS = 24
FINE = 8  # digests in a stratum, about
COARSE = 512
ATTEMPTS = (12, 24, 48, 96)  # cells per hash function of each retry
BLOCK_ROWS = 1000
SPLIT = 64  # blocks are found in two steps of at most 64 cuts
LEAST = -(2**63)


def digests_of(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    parts = F.regexp_extract_all(text, F.lit("[^\\n]{1,%d}" % PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


# ------------------------------------------------------------------ sketches, as SQL on arrays
def let(var: str, value: str, body: str) -> str:
    """``body`` with ``var`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def entries(keys: str, salt: int) -> str:
    return f"transform({keys}, k -> named_struct('k', k, 'h', xxhash64(k, {salt}L)))"


def cells(items: str, m: int) -> str:
    """3 * m cells over (digest, check) entries; s and i say which bits of the check choose the cell."""
    places = ", ".join(f"named_struct('s', {9 * t}, 'i', {i}L)" for t in range(3) for i in range(m))
    return (
        f"transform(array({places}), j -> aggregate({items}, "
        "named_struct('s', j.s, 'i', j.i, 'n', 0, 'x', 0L, 'h', 0L), (a, e) -> "
        f"IF((shiftrightunsigned(e.h, j.s) & 511L) % {m}L = j.i, "
        "named_struct('s', a.s, 'i', a.i, 'n', a.n + 1, 'x', a.x ^ e.k, 'h', a.h ^ e.h), a)))"
    )


def less(left: str, right: str) -> str:
    return (
        f"zip_with({left}, {right}, (p, q) -> "
        "named_struct('s', p.s, 'i', p.i, 'n', p.n - q.n, 'x', p.x ^ q.x, 'h', p.h ^ q.h))"
    )


def peeled(difference: str, m: int, salt: int) -> str:
    """Number of digests recovered from a difference of sketches, null when some stay hidden."""
    alone = (
        f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = xxhash64(c.x, {salt}L)), "
        "c -> named_struct('n', c.n, 'x', c.x, 'h', c.h)))"
    )
    rest = (
        "transform(s.cells, c -> aggregate(f, c, (a, e) -> "
        f"IF((shiftrightunsigned(e.h, c.s) & 511L) % {m}L = c.i, "
        "named_struct('s', a.s, 'i', a.i, 'n', a.n - e.n, 'x', a.x ^ e.x, 'h', a.h ^ e.h), a)))"
    )
    step = let(
        "f", alone, f"named_struct('cells', IF(size(f) = 0, s.cells, {rest}), 'd', s.d + size(f), 'go', size(f) > 0)"
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'd', 0, 'go', true), "
        f"(s, r) -> IF(s.go, {step}, s), "
        "s -> IF(forall(s.cells, c -> c.n = 0 AND c.x = 0L AND c.h = 0L), s.d, NULL))"
    )


def retried(left: str, right: str, m: int, salt: int) -> str:
    """The same over strata: about ``FINE`` digests in each, whatever the number of paragraphs."""
    inner = let(
        "v",
        "named_struct('a', filter(u.a, e -> shiftrightunsigned(e.h, 28) % u.n = y), "
        "'b', filter(u.b, e -> shiftrightunsigned(e.h, 28) % u.n = y))",
        peeled(less(cells("v.a", m), cells("v.b", m)), m, salt),
    )
    outer = let(
        "u",
        let(
            "w",
            "named_struct('a', filter(z.a, e -> shiftrightunsigned(e.h, 44) % z.n = x), "
            "'b', filter(z.b, e -> shiftrightunsigned(e.h, 44) % z.n = x))",
            f"named_struct('a', w.a, 'b', w.b, 'n', bigint(1 + (size(w.a) + size(w.b)) div {FINE}))",
        ),
        f"aggregate(transform(sequence(0L, u.n - 1L), y -> {inner}), 0, (a, c) -> a + c)",
    )
    return let(
        "z",
        f"named_struct('a', {entries(left, salt)}, 'b', {entries(right, salt)}, "
        f"'n', bigint(1 + (size({left}) + size({right})) div {COARSE}))",
        f"aggregate(transform(sequence(0L, z.n - 1L), x -> {outer}), 0, (a, c) -> a + c)",
    )


def differing(left: str, right: str) -> str:
    """Digests that one side has and the other lacks. The sets themselves are compared only if every size failed."""
    tries = ", ".join(retried(left, right, m, k + 1) for k, m in enumerate(ATTEMPTS))
    first = peeled(less(f"{left}_cells", f"{right}_cells"), CELLS, 0)
    return f"coalesce({first}, {tries}, size(array_except({left}, {right})) + size(array_except({right}, {left})))"


def likeness(left: str, right: str) -> Column:
    total = F.expr(f"size({left}) + size({right})")
    return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.expr(differing(left, right)) / total)


def printed(sketch: str) -> Column:
    """Base64 of the cells: count, digests, checks."""
    one = "concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.x), 16, '0'), lpad(hex(c.h), 16, '0'))"
    return F.translate(F.expr(f"base64(unhex(array_join(transform({sketch}, c -> {one}), '')))"), "\r\n", "")


# ------------------------------------------------------------------ neighbours by doc_id
def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys of every document, and next_text, next_keys of the one that follows in doc_id order."""
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    oid = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    n = docs.count()
    blocks = max(1, min(SPLIT * SPLIT, n // BLOCK_ROWS))
    cuts = base.select(oid.alias("o")).agg(
        F.percentile_approx("o", [k / blocks for k in range(1, blocks)], 100_000)
    ).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []))
    coarse = cuts[SPLIT - 1 :: SPLIT]
    fine = [cuts[k * SPLIT : (k + 1) * SPLIT - 1] for k in range(len(coarse) + 1)]
    longs = lambda xs: "cast(array(" + ", ".join(f"{x}L" for x in xs) + ") AS array<bigint>)"
    block = F.expr(
        let(
            "g",
            f"size(filter({longs(coarse)}, c -> c <= oid))",
            f"g * {SPLIT} + size(filter(get(array({', '.join(map(longs, fine))}), g), c -> c <= oid))",
        )
    )
    placed = base.withColumn("oid", oid).withColumn("block", block)
    # at most SPLIT * SPLIT rows: the first document of every block
    heads = sorted((r[0], r[1]) for r in placed.groupBy("block").agg(F.min("oid")).collect())
    before = {first: heads[k - 1][0] for k, (_, first) in enumerate(heads)}
    ghost = F.lit(None).cast("int")
    if before:
        pairs = [x for first, b in before.items() for x in (F.lit(first).cast("long"), F.lit(b))]
        ghost = F.create_map(*pairs)[F.col("oid")]
    keyed = placed.withColumn("keys", digests_of(F.col("text")))
    rows = keyed.withColumn(
        "at",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("block").alias("block"), F.lit(False).alias("ghost")),
                    F.struct(ghost.alias("block"), F.lit(True).alias("ghost")),
                ),
                lambda x: x["block"].isNotNull(),
            )
        ),
    ).select("doc_id", "text", "keys", "oid", F.xxhash64("text").alias("tie"), "at.block", "at.ghost")
    order = Window.partitionBy("block").orderBy("ghost", "oid", "tie")
    return (
        rows.withColumns({"next_text": F.lead("text").over(order), "next_keys": F.lead("keys").over(order)})
        .filter(~F.col("ghost"))
        .select("doc_id", "text", "keys", "next_text", "next_keys")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and the likeness to the edited and to the next text."""
    n, half = F.length("text"), F.expr("length(text) div 2").cast("int")
    edited = with_next(docs).select(
        "doc_id", "keys", "next_keys",
        n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    keyed = edited.withColumns({"edited_keys": digests_of(F.col("edited")), "edited_sha256": F.sha2("edited", 256)})
    sketched = keyed.drop("edited").withColumns(
        {f"{k}_cells": F.expr(cells(entries(k, 0), CELLS)) for k in ("keys", "edited_keys", "next_keys")}
    )
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256",
        printed("keys_cells").alias("fingerprint"),
        printed("edited_keys_cells").alias("edited_fingerprint"),
        likeness("keys", "edited_keys").alias("near_edited"),
        likeness("keys", "next_keys").alias("near_next"),
    )
