"""Positions, running totals, quantiles and ranks that no single task has to hold.

A window without a partition, or one over a group that holds a third of all rows, runs in one
task. The functions here sort with Spark's range partitioning instead, pin that layout by writing
it, and stitch the parts together with one small row per (part, group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names where null meets null; the keys of ``left`` stay. Without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.select(
        *[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys]
    )
    same = None
    for i, k in enumerate(keys):
        here = left[k].eqNullSafe(named[f"_right_{i}"])
        same = here if same is None else same & here
    return left.join(named, same, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    weight: Column,
    group: Sequence[str] = (),
    out: str = "running",
) -> DataFrame:
    """Inclusive running total of ``weight`` within ``group`` in the given order.

    ``order`` must be unique within a group. The range partitioning is on (group, order), so a hot
    group is spread over many parts.
    """
    keys = [F.col(g) for g in group]
    laid = materialise(
        df.withColumn("_w", weight)
        .sort(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        laid.groupBy("_part", *group)
        .agg(F.sum("_w").alias("_sum"))
        .select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    running = laid.withColumn("_in", F.sum("_w").over(inside))
    if group:
        joined = null_safe_join(running, starts, ["_part", *group])
    else:
        # one row per part of the sort: bounded by the number of shuffle partitions
        joined = running.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_in") + F.col("_start")).drop(
        "_w", "_part", "_in", "_start"
    )


def positions(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """1-based position in the order, within each group."""
    return running_total(df, order, F.lit(1).cast("long"), group, out)


def value_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: hot values shrink to one row before any shuffle."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def average_rank(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """average rank of every row's value (1 = smallest), ties share their mean rank."""
    counts = value_counts(df, value, group)
    run = running_total(counts, [F.col(value)], F.col("_n"), group, "_run")
    ranks = run.select(
        *group, value, (F.col("_run") - (F.col("_n") - 1) / 2.0).cast("double").alias(out)
    )
    return null_safe_join(df, ranks, [*group, value], "left")


def quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles by linear interpolation, one row per group."""
    counts = value_counts(df, value, group)
    run = running_total(counts, [F.col(value)], F.col("_n"), group, "_run")
    totals = run.groupBy(*group).agg(F.max("_run").alias("_total"))
    both = null_safe_join(run, totals, group)
    picks = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("_run") - F.col("_n") <= k) & (k < F.col("_run"))
        picks += [
            F.max(F.when(holds(low), F.col(value))).alias(f"_{name}_lo"),
            F.max(F.when(holds(high), F.col(value))).alias(f"_{name}_hi"),
            F.max(at - low).alias(f"_{name}_f"),
        ]
    wide = both.groupBy(*group).agg(F.max("_total").alias("n"), *picks)
    return wide.select(
        *group,
        "n",
        *[
            (
                F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_f")
            ).alias(k)
            for k in probs
        ],
    )


def cut_values(df: DataFrame, value: str, k: Column, group: Sequence[str] = ()) -> DataFrame:
    """the k-th largest value, how many lie above it, how many tie at it, places left.

    ``k`` is an expression over the group's row count ``n`` and is clipped to 1..n.
    """
    counts = value_counts(df, value, group)
    run = running_total(counts, [F.col(value).desc()], F.col("_n"), group, "_run")
    totals = run.groupBy(*group).agg(F.max("_run").alias("n"))
    both = null_safe_join(run, totals, group)
    both = both.withColumn("k", F.greatest(F.lit(1), F.least(k, F.col("n"))).cast("long"))
    at = both.filter((F.col("_run") >= F.col("k")) & (F.col("_run") - F.col("_n") < F.col("k")))
    return at.select(
        *group,
        "n",
        "k",
        F.col(value).alias("cut"),
        (F.col("_run") - F.col("_n")).alias("sure"),
        F.col("_n").alias("tied"),
        (F.col("k") - (F.col("_run") - F.col("_n"))).alias("places"),
    )


def legs(
    df: DataFrame, value: str, tie: str, parts: int, group: Sequence[str] = (), out: str = "leg"
) -> DataFrame:
    """top and bottom ``n div parts`` rows (at least one) by value, ties broken by id."""
    pos = positions(df, [F.col(value).desc(), F.col(tie)], group, "_pos")
    totals = pos.groupBy(*group).agg(F.max("_pos").alias("_total"))
    both = null_safe_join(pos, totals, group)
    k = F.greatest(F.lit(1), F.floor(F.col("_total") / parts))
    leg = F.when(F.col("_pos") <= k, "top").when(F.col("_pos") > F.col("_total") - k, "bottom")
    return both.withColumn(out, leg).withColumn("k", k.cast("long")).drop("_total", "_pos")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """the first row of each key in file order, by a mergeable aggregate (no sort of a key)."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """the last row of each key in file order."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*")
