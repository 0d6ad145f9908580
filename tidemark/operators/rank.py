"""Rank statistics of firms: correlation of ranks, overlap of top sets under ties, stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEGENERATE_IQR, DEGENERATE_MEDIAN, FOOTNOTE_SPEARMAN, MIN_FIRMS
from tidemark.functions.stats import correlation
from tidemark.operators.ordering import null_safe_join, average_rank, cut_values, positions, quantiles
from tidemark.session import materialise


def fifth(rule: str) -> Column:
    """Size of the top fifth, by floor or by rounding half to even."""
    n = F.col("n")
    return F.floor(n / 5) if rule == "floor" else F.rint(n / 5.0)


def _pairs(df: DataFrame, a: str, b: str, *keep: str) -> DataFrame:
    """Rows with both values, written once because several passes read them."""
    return materialise(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keep, a, b))


def spearman(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Pearson on average ranks; null when a side is constant."""
    both = _pairs(df, a, b, *group)
    x = average_rank(both, a, group, "_ra")
    x = average_rank(x, b, group, "_rb")
    return x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), correlation("_ra", "_rb").alias("spearman")
    )


def overlap_bounds(
    df: DataFrame, a: str, b: str, rule: str = "floor", group: Sequence[str] = (),
    k: int | None = None,
) -> DataFrame:
    """Lowest and highest number of firms common to both top sets over every order of ties.

    Only counts leave the data: firms surely in, tied at a cut, or out, in each of the two lists.
    With t tied firms shared by both lists, the number drawn from them enters the bounds through
    piecewise linear terms, so the extremes lie at their break points and no range is enumerated.
    """
    both = _pairs(df, a, b, *group)
    size = F.lit(k) if k is not None else fifth(rule)
    name = lambda d, s: d.select(
        *group, "k", *[F.col(c).alias(f"{c}_{s}") for c in ("cut", "sure", "tied", "places")]
    )
    ca = name(cut_values(both, a, size, group), "a")
    cb = name(cut_values(both, b, size, group), "b").drop("k")
    # without groups each side is one row, and null_safe_join broadcasts it
    cuts = null_safe_join(ca, cb, group)
    x = null_safe_join(both, cuts, group)
    sa, ta = F.col(a) > F.col("cut_a"), F.col(a) == F.col("cut_a")
    sb, tb = F.col(b) > F.col("cut_b"), F.col(b) == F.col("cut_b")
    keep = ["k", "cut_a", "sure_a", "tied_a", "places_a", "cut_b", "sure_b", "tied_b", "places_b"]
    c = x.groupBy(*group).agg(
        *[F.first(q).alias(q) for q in keep],
        F.count_if(sa & sb).alias("a0"), F.count_if(ta & sb).alias("p"),
        F.count_if(sa & tb).alias("x1"), F.count_if(ta & tb).alias("q"),
    )
    p, x1, q, ma, mb = (F.col(i) for i in ("p", "x1", "q", "places_a", "places_b"))
    ua, ub = F.col("tied_a") - p - q, F.col("tied_b") - x1 - q
    zero = F.lit(0).cast("long")
    c = c.withColumns(
        {
            "_ua": ua, "_ub": ub,
            "_la": F.greatest(zero, ma - ua - p), "_ha": F.least(q, ma),
            "_lb": F.greatest(zero, mb - ub - x1), "_hb": F.least(q, mb),
        }
    )
    la, ha, lb, hb = (F.col(i) for i in ("_la", "_ha", "_lb", "_hb"))
    top = F.least(ha, hb)
    clip = lambda t: F.greatest(zero, F.least(t, top))
    marks = F.array(*[clip(t) for t in (zero, la, lb, ma - p, mb - x1, top)])
    gain = F.transform(
        marks,
        lambda t: F.least(p, ma - F.greatest(t, la)) + F.least(x1, mb - F.greatest(t, lb))
        + F.least(F.greatest(t, la), F.greatest(t, lb)),
    )
    da = F.least(F.greatest(ma - F.col("_ua"), la), ha)
    db = F.least(F.greatest(mb - F.col("_ub"), lb), hb)
    loss = (
        F.greatest(zero, ma - da - F.col("_ua")) + F.greatest(zero, mb - db - F.col("_ub"))
        + F.greatest(zero, da + db - q)
    )
    return c.select(
        *group, "k", (F.col("a0") + loss).alias("lowest"),
        (F.col("a0") + F.array_max(gain)).alias("highest"),
        *keep[1:],
        ((F.col("tied_a") > ma) | (F.col("tied_b") > mb)).alias("has_ties"),
    )


def movers(df: DataFrame, a: str, b: str, key: str, rule: str = "floor") -> DataFrame:
    """Firms that enter or leave the top fifth, with the size of their move."""
    both = _pairs(df, a, b, key)
    x = positions(both, [F.col(a).desc(), F.col(key)], out="_pa")
    x = positions(x, [F.col(b).desc(), F.col(key)], out="_pb")
    n = both.agg(F.count(F.lit(1)).alias("n")).select(F.greatest(F.lit(1), fifth(rule)).alias("k"))
    x = x.crossJoin(F.broadcast(n))
    in_a, in_b = F.col("_pa") <= F.col("k"), F.col("_pb") <= F.col("k")
    return x.filter(in_a != in_b).select(
        key, F.when(in_b, "in").otherwise("out").alias("move"), a, b,
        (F.col(b) - F.col(a)).alias("change"),
    )


def degeneracy(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Quartiles, spread, share at one, and whether a share is degenerate."""
    q = quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    ones = (
        df.filter(F.col(value).isNotNull()).groupBy(*group)
        .agg((F.count_if(F.col(value) >= 0.9995) / F.count(F.lit(1))).alias("at_one"))
    )
    j = null_safe_join(q, ones, group)
    iqr = F.col("q3") - F.col("q1")
    return j.withColumn("iqr", iqr).withColumn(
        "degenerate", (F.col("median") > DEGENERATE_MEDIAN) & (iqr < DEGENERATE_IQR)
    )


def stability(long: DataFrame, key: str) -> DataFrame:
    """Does a measure order firms the same way in two releases, on several universes?

    ``long``: key, rule, measure, a, b, raw_a, raw_b, in_panel. The raw measure is scored on the
    same firms. Universes are four fixed flags, so rows grow by at most four.
    """
    a, b = F.col("a"), F.col("b")
    flags = {
        "all": F.lit(True), "panel": F.col("in_panel"),
        "present in both": a.isNotNull() & b.isNotNull() & ((a > 0) | (b > 0)),
        "positive in both": (a > 0) & (b > 0),
    }
    rows = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]),
        lambda u: u.isNotNull(),
    )
    g = ["universe", "rule", "measure"]
    x = materialise(
        long.filter("a is not null and b is not null").withColumn("universe", F.explode(rows))
        .select(*g, "a", "b", "raw_a", "raw_b")
    )
    own = spearman(x, "a", "b", g)
    raw = spearman(x, "raw_a", "raw_b", g).select(*g, F.col("spearman").alias("raw_spearman"))
    ov = overlap_bounds(x, "a", "b", "round", g).select(*g, "k", "lowest", "highest")
    return (
        own.join(raw, g).join(ov, g)
        .filter(F.col("n") >= MIN_FIRMS)
        .withColumn(
            "reading",
            F.when(F.col("spearman") > FOOTNOTE_SPEARMAN, "footnote").otherwise("reportable"),
        )
    )
