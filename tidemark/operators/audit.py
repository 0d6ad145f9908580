"""Checks, fingerprints, scans and reconciliations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.identifiers import SECRET_SHAPES
from tidemark.operators.ordering import null_safe_join
from tidemark.session import materialise


def expectations(*one_row: DataFrame) -> DataFrame:
    """Q1, Q2: frames of one row with boolean columns become rows (name, pass)."""
    rows = [
        d.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("pass"))
                        for c in d.columns
                    ]
                )
            )
        )
        for d in one_row
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def require_all(checks: DataFrame) -> None:
    """Q2: stop when any check fails. The names are gathered on the executors; one string reaches the driver."""
    failed = checks.filter("not coalesce(pass, false)").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names")
    ).first()
    if failed["n"]:
        raise AssertionError(f"{failed['n']} failed checks: {failed['names']}")


LIMBS = 8


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table's content: n_rows, and content, the sum of the rows' sha-256 modulo 2 ** 256.

    A row is hashed as JSON over its sorted columns, nulls named. The eight 32-bit limbs are summed apart, map-side first, so
    parts of a table can be added in any order; carries are taken once, in the last row. An empty table has content 0.
    """
    row = F.to_json(
        F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]),
        {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"},
    )
    limb = lambda k: F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("decimal(10,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    sums = df.select(F.sha2(row, 256).alias("_h")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(limb(k)), zero).cast("decimal(30,0)").alias(f"_{k}") for k in range(LIMBS)]
    )
    # from the lowest limb, which is the last: what it keeps, and what it hands on
    kept, carry = [], F.lit(0).cast("decimal(30,0)")
    for k in reversed(range(LIMBS)):
        sums = sums.withColumn("_t", (F.col(f"_{k}") + carry).cast("decimal(30,0)"))
        sums = sums.withColumn(f"_k{k}", F.lpad(F.lower(F.hex((F.col("_t") % 2**32).cast("long"))), 8, "0"))
        sums = sums.withColumn("_c", F.expr(f"_t div {2**32}").cast("decimal(30,0)"))
        kept, carry = [f"_k{k}", *kept], F.col("_c")
    return sums.select("n_rows", F.concat(*kept).alias("content"))


def may_promote(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q11: a replacement must have the same columns, row count and content."""
    same_columns = old.columns == new.columns
    a = fingerprint(old)
    b = fingerprint(new).select(*[F.col(c).alias("_" + c) for c in ("n_rows", "content")])
    eq = lambda c: F.col(c).eqNullSafe(F.col("_" + c))
    return a.crossJoin(F.broadcast(b)).select(
        F.lit(same_columns).alias("same_columns"), eq("n_rows").alias("same_rows"),
        (F.lit(same_columns) & eq("n_rows") & eq("content")).alias("may_promote"),
    )


def secret_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that carry the shape of a credential, with their line number.

    Whole texts are split into lines; a cheap test on the text keeps clean ones out of the split.
    """
    any_shape = "|".join(f"(?:{s})" for _, s in SECRET_SHAPES)
    lines = texts.filter(F.col(text).rlike(any_shape)).select(
        key, F.posexplode(F.split(text, "\n")).alias("_i", "_line")
    )
    hits = F.filter(
        F.array(*[F.when(F.col("_line").rlike(s), F.lit(n)) for n, s in SECRET_SHAPES]),
        lambda x: x.isNotNull(),
    )
    return lines.select(key, (F.col("_i") + 1).alias("line"), F.explode(hits).alias("shape"))


def signed_expiries(texts: DataFrame, text: str) -> DataFrame:
    """Declared expiry seconds of signed links with their counts."""
    found = F.regexp_extract_all(text, F.lit(r"(?:[?&]|&amp;)X-Amz-Expires=(\d{1,7})"), F.lit(1))
    return (
        texts.filter(F.col(text).contains("X-Amz-Expires="))
        .select(F.explode(found).alias("_e"))
        .groupBy(F.col("_e").cast("int").alias("expires")).agg(F.count(F.lit(1)).alias("n"))
    )


def reconcile_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Q4: every stored file is vouched for by an equal ledger entry, or the reason it is not.

    ``files``: file, bytes, n_rows, date_min, date_max. ``ledger``: the same without bytes.
    """
    e = ledger.select(
        "file", F.lit(True).alias("_e"), *[F.col(c).alias("_" + c) for c in ("n_rows", "date_min", "date_max")]
    )
    j = files.join(e, "file", "left")
    same_dates = F.col("date_min").eqNullSafe(F.col("_date_min")) & F.col("date_max").eqNullSafe(F.col("_date_max"))
    why = (
        F.when(F.col("_e").isNull(), "no ledger entry").when(F.col("bytes") == 0, "zero bytes")
        .when(~F.col("n_rows").eqNullSafe(F.col("_n_rows")), "row count differs")
        .when(~same_dates, "date range differs").otherwise("kept")
    )
    return j.select("file", why.alias("why"))


def claim_status(claims: DataFrame, results: DataFrame, provenance: DataFrame) -> DataFrame:
    """Q7: each claimed figure against the result tables and their provenance.

    ``claims``: section, source, metric, value. ``results``: source, metric, value.
    ``provenance``: source.
    """
    r = results.groupBy("source", "metric").agg(
        F.count(F.lit(1)).alias("_n"), F.max("value").alias("_v"), F.min("value").alias("_lo")
    )
    sources = results.select("source", F.lit(True).alias("_s")).distinct()
    p = provenance.select("source", F.lit(True).alias("_p")).distinct()
    j = claims.join(r, ["source", "metric"], "left").join(sources, "source", "left").join(p, "source", "left")
    equal = F.coalesce((F.col("_v") == F.col("value")) | (F.col("_lo") == F.col("value")), F.lit(False))
    state = (
        F.when(F.col("_s").isNull(), "NO SOURCE").when(~equal, "UNTRACEABLE")
        .when(F.col("_p").isNull(), "NO-PROV").otherwise("OK")
    )
    return j.groupBy("section", state.alias("state")).agg(F.count(F.lit(1)).alias("claims"))


def unresolved_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Q8: claimed metrics that resolve to no value or to several."""
    n = results.groupBy("source", "metric").agg(F.count(F.lit(1)).alias("_n"))
    return (
        claims.select("source", "metric").distinct().join(n, ["source", "metric"], "left")
        .select("source", "metric", F.coalesce("_n", F.lit(0)).alias("values")).filter("values <> 1")
    )


def publish_gate(outputs: DataFrame, inputs: DataFrame, withheld: DataFrame) -> DataFrame:
    """Q10: class of each output by what it consumes, and whether it may be published.

    ``outputs``: item. ``inputs``: item, class. ``withheld``: item (the tainted set).
    """
    classes = inputs.groupBy("item").agg(
        F.min("class").alias("_lo"), F.max("class").alias("_hi"), F.count("class").alias("_n")
    )
    w = withheld.select("item", F.lit(True).alias("_w")).distinct()
    j = outputs.join(classes, "item", "left").join(w, "item", "left")
    label = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "unknown").when(F.col("_lo") != F.col("_hi"), "mixed").otherwise(F.col("_lo"))
    )
    j = j.withColumn("class", label)
    ok = ~F.col("class").isin("unknown", "mixed", "licensed") & F.col("_w").isNull()
    return j.select("item", "class", F.coalesce("_w", F.lit(False)).alias("tainted"), ok.alias("publish"))


def stratified_sample(frame: DataFrame, stratum: str, key: list[str], n: int, seed: int) -> DataFrame:
    """Per stratum ``max(1, round(n * size / total))`` rows in hash order, at most n in all.

    The draw is fixed by the seed and the keys alone; it is not any other generator's draw.
    """
    frame = materialise(frame)
    drawn = [F.md5(F.concat_ws("|", *key, F.lit(str(seed)))), *[F.col(k) for k in key]]
    # no stratum gives more than n rows, so each shrinks to n by pieces before one task orders what is left
    piece = F.pmod(F.hash(*key), F.lit(64))
    first = lambda df, *by: df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*drawn))).filter(F.col("_i") <= max(1, n))
    x = first(first(frame, stratum, piece).drop("_i"), stratum)
    sizes = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    take = sizes.crossJoin(F.broadcast(total)).select(
        stratum, F.greatest(F.lit(1.0), F.rint(n * F.col("_size") / F.col("_total"))).alias("_take")
    )
    kept = null_safe_join(x, take, [stratum]).filter(F.col("_i") <= F.col("_take"))
    return kept.orderBy(stratum, "_i").limit(n).drop("_i", "_take")


def key_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N distinct keys in hash order (a bounded top-k)."""
    return df.select(key).distinct().orderBy(F.md5(F.concat_ws("|", key, F.lit(str(seed)))), key).limit(n)
