"""Comparing dated releases of a keyed table and naming the cause of every difference.

Two releases are one long table with a ``release`` column. A diff is therefore one aggregation on
the key: one shuffle, partial aggregates before it, duplicates of a hot key resolved map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import GO_AT, NOGO_BELOW, REAL_CHURN, SAME_SHARE, SMALL_MOVE
from tidemark.functions.cleaning import half_up, ratio

BUILD, RESTATE, METHOD, SAME, UNKNOWN = (
    "BUILD-OUT", "RESTATEMENT", "METHODOLOGY", "UNCHANGED", "UNATTRIBUTABLE",
)


def compare_releases(edges: DataFrame, old: str, new: str) -> DataFrame:
    """C4: full outer diff on (subject, party); the last row of a duplicate key wins, its flag too.

    Returns subject, party, a (old share), b (new share), imputed, status.
    """
    in_old, in_new = F.col("release") == old, F.col("release") == new
    # numbers and booleans only in the buffers: a struct would turn the hash aggregate into a sort
    last = lambda which: F.max_by(
        F.when(which, F.col("share")), F.when(which, F.col("ord"))
    )
    both = (
        edges.filter(F.col("release").isin(old, new))
        .groupBy("subject", "party")
        .agg(
            last(in_old).alias("a"), last(in_new).alias("b"),
            F.max(in_old).alias("_o"), F.max(in_new).alias("_n"),
            F.coalesce(F.max_by(F.when(in_new, F.col("imputed")), F.when(in_new, F.col("ord"))), F.lit(False)).alias("imputed"),
        )
    )
    status = F.when(~F.col("_o"), "new only").when(~F.col("_n"), "gone").otherwise("both")
    return both.select("subject", "party", "a", "b", "imputed", status.alias("status"))


def moved(a: Column, b: Column) -> Column:
    """Absolute difference on six places, so that 0.06 is 0.06 on every engine."""
    return half_up(F.abs(a - b), 6)


def classify(diff: DataFrame, entities_old: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """Bucket and detail of every edge. Entity lists are joined only where they decide."""
    known = entities_old.select("entity").distinct()
    dropped = removed_ids.select("entity").distinct()
    hit = lambda d, key, out: d.select(F.col("entity").alias(key), F.lit(True).alias(out))
    new_only = (
        diff.filter("status = 'new only'")
        .join(hit(known, "subject", "_s"), "subject", "left")
        .join(hit(known, "party", "_p"), "party", "left")
        .withColumn("bucket", F.lit(BUILD))
        .withColumn(
            "detail",
            F.when(F.col("_s") & F.col("_p"), "new link between covered entities").otherwise(
                "entity newly covered"
            ),
        )
    )
    gone = (
        diff.filter("status = 'gone'")
        .join(hit(dropped, "subject", "_s"), "subject", "left")
        .join(hit(dropped, "party", "_p"), "party", "left")
        .withColumn("_d", F.coalesce(F.col("_s"), F.col("_p"), F.lit(False)))
        .withColumn("bucket", F.when(F.col("_d"), METHOD).otherwise(RESTATE))
        .withColumn(
            "detail",
            F.when(F.col("_d"), "entity removed as duplicate").otherwise("link removed"),
        )
    )
    a, b, imputed = F.col("a"), F.col("b"), F.col("imputed")
    d = moved(a, b)
    pick = lambda filled, filled_imp, blank, same, imp, small, big: (
        F.when(a.isNull() & b.isNotNull() & imputed, filled_imp)
        .when(a.isNull() & b.isNotNull(), filled)
        .when(a.isNull() | b.isNull(), blank)
        .when(d <= SAME_SHARE, same)
        .when(imputed, imp)
        .when(d <= SMALL_MOVE, small)
        .otherwise(big)
    )
    both = (
        diff.filter("status = 'both'")
        .withColumn("bucket", pick(BUILD, METHOD, SAME, SAME, METHOD, RESTATE, RESTATE))
        .withColumn(
            "detail",
            pick(
                "blank filled by research", "blank filled by imputation", "no comparable value",
                "same or rounding only", "imputed share moved", "share revised, small",
                "share revised, material",
            ),
        )
    )
    cols = ["subject", "party", "a", "b", "imputed", "status", "bucket", "detail"]
    return new_only.select(cols).unionByName(gone.select(cols)).unionByName(both.select(cols))


def change_buckets(classified: DataFrame) -> DataFrame:
    """Counts by detail, by bucket and overall, with the share of all changed edges."""
    # edges are counted once; the subtotals come from that table of a few rows
    counts = (
        classified.filter(F.col("bucket") != SAME)
        .groupBy("bucket", "detail").agg(F.count(F.lit(1)).alias("_n"))
    )
    levels = counts.rollup("bucket", "detail").agg(F.sum("_n").alias("edges"))
    total = F.max("edges").over(Window.partitionBy(F.lit(0)))
    return levels.select(
        F.coalesce("bucket", F.lit("ALL")).alias("bucket"),
        F.coalesce("detail", F.lit("TOTAL")).alias("detail"),
        "edges",
        half_up(100.0 * F.col("edges") / total, 4).alias("pct"),
    )


def verdict(value: Column, go: float = GO_AT, nogo: float = NOGO_BELOW) -> Column:
    """Q3: a verdict against thresholds fixed in advance."""
    return F.when(value >= go, "GO").when(value < nogo, "NO-GO").otherwise("JUDGEMENT")


def ratio_and_ceiling(classified: DataFrame, churn: float = REAL_CHURN) -> DataFrame:
    """R, its verdict, and R after crediting the most real events the churn rate allows."""
    of = lambda b: F.count_if(F.col("bucket") == b)
    s = classified.agg(
        of(BUILD).alias("build"), of(RESTATE).alias("restate"), of(METHOD).alias("method"),
        of(SAME).alias("unchanged"), F.count_if(F.col("status") == "both").alias("both"),
    )
    changed = F.col("build") + F.col("restate") + F.col("method")
    s = s.withColumn("changed", changed).withColumn(
        "ceiling", F.least(F.floor(F.col("both") * F.lit(churn)), F.col("restate"))
    )
    r = ratio(F.col("restate") + F.col("method"), F.col("changed"))
    low = ratio(F.col("restate") - F.col("ceiling") + F.col("method"), F.col("changed"))
    return s.select(
        "build", "restate", "method", "unchanged", "both", "changed", "ceiling",
        half_up(r, 6).alias("r"), verdict(r).alias("verdict"),
        half_up(low, 6).alias("r_floor"), (low >= GO_AT).alias("floor_clears"),
    )


def release_pairs(catalog: DataFrame) -> DataFrame:
    """F8: each release that has the sheet with the one before it that has it.

    One row per release: bounded by the number of releases, never by their rows.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("rel")
    kept = catalog.filter("has_sheet")
    return (
        kept.select(
            "rel", "month", "has_flag", F.lag("rel").over(w).alias("prev_rel"),
            F.lag("month").over(w).alias("prev_month"), F.row_number().over(w).alias("pos"),
        )
        .withColumn(
            "months",
            F.round(
                F.months_between(
                    F.concat("month", F.lit("-01")).cast("date"),
                    F.concat("prev_month", F.lit("-01")).cast("date"),
                )
            ).cast("int"),
        )
    )


def decompose_pairs(edges: DataFrame, catalog: DataFrame, removed_ids: DataFrame) -> DataFrame:
    """Every consecutive pair at once, blind to the flag and aware of it.

    ``edges``: rel, subject, party, share, imputed, ord; of rows that repeat a key within a release the one with
    the largest ord counts (any of them without that column).

    One aggregation on (subject, party) holds every release of a key side by side, so a row is never copied for the two
    pairs it is part of, and edges that lie by subject are not shuffled at all. Only keys that left a release meet
    ``removed_ids``; everything else is counted first.
    """
    # one row per release: bounded, so the driver may hold it
    spark, listed = catalog.sparkSession, release_pairs(catalog)
    found = sorted(listed.collect(), key=lambda x: x["pos"])
    pairs = spark.createDataFrame(found, listed.schema)
    places = F.broadcast(pairs.select("rel", (F.col("pos") - 1).alias("_k")))
    e = edges if "ord" in edges.columns else edges.withColumn("ord", F.lit(0))
    # numbers only in the buffers: the hash aggregate is kept, and repeated keys merge before any shuffle. A filter, unlike a
    # condition on the value, leaves the buffers of the other releases alone
    sides = [F.count(F.lit(1)).alias("_rows")]
    for k in range(len(found)):
        here = f"FILTER (WHERE _k = {k})"
        sides += [
            F.expr(f"max_by(share, ord) {here}").alias(f"share_{k}"), F.expr(f"max_by(imputed, ord) {here}").alias(f"imp_{k}"),
            F.expr(f"count(1) {here} > 0").alias(f"has_{k}"),
        ]
    keys = e.join(places, "rel").groupBy("subject", "party").agg(*sides)

    # the two sides of each pair; what changed is judged once after that, so the generated code stays small
    sides = [
        F.struct(
            F.lit(k + 1).alias("pos"), F.col(f"has_{k - 1}").alias("had"), F.col(f"has_{k}").alias("has"),
            F.col(f"share_{k - 1}").alias("a"), F.col(f"share_{k}").alias("b"), F.col(f"imp_{k}").alias("imp"),
        )
        for k in range(1, len(found))
    ]
    none = F.expr("named_struct('pos', 0, 'had', false, 'has', false, 'a', double(null), 'b', double(null), 'imp', boolean(null))")
    had, has, a, b = F.col("had"), F.col("has"), F.col("a"), F.col("b")
    imp = F.coalesce("imp", F.lit(False))
    kind = (
        F.when(has & ~had, "new")
        .when(had & ~has, "gone")
        .when(~had, None)
        .when(a.isNull() & b.isNotNull(), F.when(imp, "filled by rule").otherwise("filled"))
        .when(moved(a, b) > SAME_SHARE, F.when(imp, "moved by rule").otherwise("moved"))
    )
    cells = keys.select("subject", "party", F.inline(F.array(*(sides or [none])))).select("subject", "party", "pos", kind.alias("kind"))
    cells = cells.filter("kind is not null")
    gone = F.col("kind") == "gone"
    counted = cells.groupBy(
        "pos", "kind",
        F.when(gone, F.col("subject")).alias("subject"), F.when(gone, F.col("party")).alias("party"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    dropped = removed_ids.select("entity").distinct()
    hit = lambda k, out: dropped.select(F.col("entity").alias(k), F.lit(True).alias(out))
    marked = counted.join(hit("subject", "_s"), "subject", "left").join(hit("party", "_p"), "party", "left")
    tally = marked.groupBy("pos", "kind", F.coalesce("_s", "_p", F.lit(False)).alias("dup")).agg(F.sum("_n").alias("_n"))

    def bucket(aware: bool) -> Column:
        has = F.col("has_flag") if aware else F.lit(False)
        filled, imp = F.col("kind").startswith("filled"), F.col("kind").endswith("by rule")
        return (
            F.when(F.col("kind") == "new", BUILD)
            .when(gone & F.col("dup"), METHOD)
            .when(gone, RESTATE)
            .when(filled & ~has, UNKNOWN)
            .when(filled & imp, METHOD)
            .when(filled, BUILD)
            .when(has & imp, METHOD)
            .otherwise(RESTATE)
        )

    named = tally.join(F.broadcast(pairs.select("pos", "has_flag")), "pos")
    named = named.withColumn("_blind", bucket(False)).withColumn("_aware", bucket(True))
    names = {"build": BUILD, "restate": RESTATE, "method": METHOD, "unattr": UNKNOWN}
    of = lambda view, v: F.sum(F.when(F.col(view) == v, F.col("_n")).otherwise(0))
    counts = named.groupBy("pos").agg(
        F.sum("_n").alias("changed"),
        *[of("_aware", v).alias(f"{k}_aware") for k, v in names.items()],
        *[of("_blind", v).alias(f"{k}_blind") for k, v in names.items()],
    )
    pct = lambda c: half_up(100.0 * F.col(c) / F.col("changed"), 1).alias(c + "_pct")
    return (
        pairs.join(counts, "pos")
        .select(
            "prev_month", "month", "months", "has_flag", "changed",
            *[pct(f"{k}_{v}") for v in ("aware", "blind") for k in names],
        )
    )


def monthly_rates(pairs: DataFrame) -> DataFrame:
    """Changes a month, since the gaps between releases are uneven."""
    rate = lambda c: half_up(
        ratio(F.col("changed") * F.col(c) / 100, F.col("months")), 4
    )
    return pairs.select(
        "prev_month", "month", rate("build_blind_pct").alias("build_rate"),
        rate("restate_blind_pct").alias("restate_rate"),
    )


def halves(series: DataFrame, order: str, values: list[str]) -> DataFrame:
    """F16: means of the first ``n div 2`` rows and of the rest (a series of releases: bounded)."""
    w = Window.partitionBy(F.lit(0))
    s = series.withColumn("_i", F.row_number().over(w.orderBy(order))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    stats = []
    for v in values:
        for half, which in (("first", first), ("second", ~first)):
            x = F.when(which, F.col(v))
            stats += [
                F.avg(x).alias(f"{v}_{half}_mean"), F.var_samp(x).alias(f"{v}_{half}_var"),
                F.count(x).alias(f"{v}_{half}_n"),
            ]
    return s.agg(*stats)


def chain_crosstab(paths: DataFrame) -> DataFrame:
    """Did the chain change length, and did the share move by more than a point?"""
    chain = (
        F.when(F.col("depth_new") > F.col("depth_old"), "lengthened")
        .when(F.col("depth_new") == F.col("depth_old"), "same")
        .otherwise("shortened")
    )
    big = F.coalesce(moved(F.col("a"), F.col("b")) > SMALL_MOVE, F.lit(False))
    return (
        paths.withColumn("chain", chain)
        .groupBy("chain")
        .agg(
            F.count_if(big).alias("moved"), F.count_if(~big).alias("stable"),
            half_up(100.0 * F.count_if(big) / F.count(F.lit(1)), 4).alias("moved_pct"),
        )
    )


def key_churn(keys: DataFrame, old: str, new: str, flag: str) -> DataFrame:
    """Universe churn and flips of a flag on keys present in both."""
    at = lambda rel, c: F.max(F.when(F.col("release") == rel, F.col(c)))
    k = keys.withColumn("_here", F.lit(True)).groupBy("entity").agg(
        at(old, "_here").alias("o"), at(new, "_here").alias("n"),
        at(old, flag).alias("fo"), at(new, flag).alias("fn"),
    )
    return k.agg(
        F.count("o").alias("n_old"), F.count("n").alias("n_new"),
        F.count_if(F.col("o") & F.col("n")).alias("n_both"),
        F.count_if(F.col("n").isNull()).alias("n_gone"),
        F.count_if(F.col("o").isNull()).alias("n_added"),
        F.count_if(F.col("fo") & ~F.col("fn")).alias("true_to_false"),
        F.count_if(~F.col("fo") & F.col("fn")).alias("false_to_true"),
    )


def owner_set_changes(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Share of assets whose set of owners changed, by sector, for two owner columns at once.

    The sets are compared through order-free sums of hashes of distinct owners, so no set is ever
    collected: one asset with millions of owners costs no more memory than any other.
    """
    distinct = rows.filter(F.col("owner").isNotNull()).dropDuplicates(
        ["release", "sector", "unit", "kind", "owner"]
    )
    at = lambda rel: F.col("release") == rel
    h = F.xxhash64("owner").cast("decimal(38,0)")
    h2 = F.xxhash64(F.col("owner"), F.lit(7)).cast("decimal(38,0)")
    sums = distinct.groupBy("sector", "unit", "kind").agg(
        *[
            agg(F.when(at(rel), x)).alias(f"{name}_{side}")
            for side, rel in (("o", old), ("n", new))
            for name, x, agg in (("c", h, F.count), ("h", h, F.sum), ("g", h2, F.sum))
        ]
    )
    both = sums.filter("c_o > 0 and c_n > 0")
    same = (
        (F.col("c_o") == F.col("c_n")) & (F.col("h_o") == F.col("h_n"))
        & (F.col("g_o") == F.col("g_n"))
    )
    k = lambda kind: F.col("kind") == kind
    return both.groupBy("sector").agg(
        F.count_if(k("parent")).alias("assets"),
        F.count_if(k("parent") & ~same).alias("parent_changed"),
        F.count_if(k("immediate") & ~same).alias("immediate_changed"),
    )


def precision_loss(written: DataFrame) -> DataFrame:
    """How many differences are rounding, given the share as written in each release.

    ``written``: subject, party, a_text, b_text (first row of a duplicate key already chosen).
    """
    from tidemark.functions.cleaning import decimals, half_even, number

    a, b = number(F.col("a_text")), number(F.col("b_text"))
    w = written.select(
        a.alias("a"), b.alias("b"), decimals(F.col("a_text")).alias("da"),
        decimals(F.col("b_text")).alias("db"),
    ).filter("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    differs = half_up(a, 6) != half_up(b, 6)
    strict = differs & (F.col("da") > 1) & (half_up(half_even(a, 1), 6) == half_up(b, 6))
    broad = strict | (differs & (F.abs(a - b) < 0.05))
    small = differs & (moved(a, b) <= SAME_SHARE)
    return w.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("da") >= 2).alias("old_two_places"),
        F.count_if(F.col("db") >= 2).alias("new_two_places"),
        F.count_if(differs).alias("differs"),
        F.count_if(strict).alias("strict"),
        F.count_if(broad).alias("broad"),
        F.count_if(small).alias("suppressed"),
        F.count_if(differs & ~small).alias("survives"),
    )


def restricted_ratio(classified: DataFrame, names: DataFrame) -> DataFrame:
    """R with unnamed remainder parties taken out of both sides, with a control count."""
    from tidemark.functions.identifiers import residual

    party_names = names.select(F.col("entity").alias("party"), "name")
    c = (
        classified.filter(F.col("bucket") != SAME)
        .join(party_names, "party", "left")
        .withColumn("_res", residual(F.col("name")))
    )
    per = [
        expr
        for k, b in (("build", BUILD), ("restate", RESTATE), ("method", METHOD))
        for expr in (
            F.count_if(F.col("bucket") == b).alias(k),
            F.count_if((F.col("bucket") == b) & F.col("_res")).alias(f"{k}_residual"),
        )
    ]
    s = c.agg(*per, F.count_if(F.col("name").isNull()).alias("unnamed"))
    total = F.col("build") + F.col("restate") + F.col("method")
    res = F.col("build_residual") + F.col("restate_residual") + F.col("method_residual")
    num = F.col("restate") + F.col("method")
    rnum = num - F.col("restate_residual") - F.col("method_residual")
    return s.select(
        "*", half_up(ratio(num, total), 6).alias("r"),
        half_up(ratio(rnum, total - res), 6).alias("r_restricted"),
        (ratio(rnum, total - res) >= GO_AT).alias("clears"),
    )


def ladder(buckets: DataFrame, readings: DataFrame) -> DataFrame:
    """R for several readings of the real-event share; both inputs have a few rows."""
    r = ratio(
        F.col("restate") * (1 - F.col("v")) + F.col("method"),
        F.col("build") + F.col("restate") + F.col("method"),
    )
    return (
        buckets.crossJoin(F.broadcast(readings))
        .withColumn("_r", r)
        .select(
            "release", "reading", half_up(F.col("v"), 6).alias("v"), half_up(F.col("_r"), 6).alias("r"),
            F.when(F.col("_r") >= GO_AT, "clears").otherwise("FAILS").alias("verdict"),
        )
    )


def missing_sheets(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """A2: expected (release, sheet) pairs the catalog does not hold."""
    return expected.join(catalog, ["release", "sheet"], "left_anti")


def value_counts_of(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by category."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def union_all(*frames: DataFrame) -> DataFrame:
    """H1: stack by column name."""
    return reduce(lambda x, y: x.unionByName(y), frames)


ENTITY_KEYS = ("Entity ID", "Full Entity ID")
REVIEW = "Last Review Date"


def layouts(spark: SparkSession, releases: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Month, sheets, entity_key, ownership_cols, has_review of every release, from the schemas of its sheets.

    Only schemas are looked at, and a catalog has one entry per release.
    """
    rows = []
    for month, sheets in releases.items():
        entities, ownership = sheets.get("entities"), sheets.get("ownership")
        names = entities.columns if entities is not None else []
        width = len(ownership.columns) if ownership is not None else 0
        has_review = REVIEW in names or ownership is not None and REVIEW in ownership.columns
        rows.append((month, len(sheets), next((k for k in ENTITY_KEYS if k in names), None), width, has_review))
    return spark.createDataFrame(rows, "month string, sheets int, entity_key string, ownership_cols int, has_review boolean")


def schema_drift(layouts: DataFrame) -> DataFrame:
    """The layout of every release beside the number of distinct entity keys, widths and review columns in use."""
    kinds = layouts.agg(
        F.count_distinct("entity_key").alias("distinct_keys"), F.count_distinct("ownership_cols").alias("distinct_widths"),
        F.count_distinct("has_review").alias("distinct_reviews"),
    )
    return layouts.crossJoin(F.broadcast(kinds))


def mean_depths(paths: DataFrame) -> DataFrame:
    """Mean chain depth of the paths carried in each of two releases."""
    mean = lambda side: F.avg(F.when(F.col(f"in_{side}"), F.col(f"depth_{side}"))).alias(f"depth_{side}")
    return paths.agg(mean("old"), mean("new"))
