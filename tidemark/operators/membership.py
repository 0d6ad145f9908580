"""Point-in-time membership from a log of additions and removals.

The log is reduced to one row per (symbol, day) before any window opens over a symbol, so a symbol
that fills a third of the log still has at most one row per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.vintage import union_all


def mentions(events: DataFrame) -> DataFrame:
    """One row per named symbol of a change row: symbol, kind, date, added, removed."""
    named = F.filter(
        F.array(
            F.struct(F.col("added").alias("symbol"), F.lit("add").alias("kind")),
            F.struct(F.col("removed").alias("symbol"), F.lit("remove").alias("kind")),
        ),
        lambda x: F.coalesce(x["symbol"], F.lit("")) != "",
    )
    return events.select("date", "added", "removed", F.inline(named))


def universe(events: DataFrame, current: DataFrame) -> DataFrame:
    """H2: every symbol that is current or was ever named."""
    return current.select("symbol").union(mentions(events).select("symbol")).distinct()


def symbol_days(events: DataFrame) -> DataFrame:
    return mentions(events).groupBy("symbol", "date").agg(
        F.max(F.col("kind") == "add").alias("has_add"),
        F.max(F.col("kind") == "remove").alias("has_remove"),
    )


def spans(events: DataFrame, current: DataFrame, clamp_from=None, until=None) -> DataFrame:
    """Membership spans. Each removal closes the last earlier addition; members stay open.

    A span without a recorded addition opens at the first day of the log, one without a removal ends at
    ``until`` (a Column; today if it is not given), not at the last logged change. ``clamp_from`` (a Column)
    drops spans that end before it (``spans_before`` counts them) and moves earlier starts up to it.
    """
    days = symbol_days(events)
    limits = days.agg(F.min("date").alias("_lo"))
    end = F.current_date() if until is None else until.cast("date")
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    closed = (
        days.withColumn("_a", F.max(F.when(F.col("has_add"), F.col("date"))).over(w))
        .filter("has_remove").select("symbol", "_a", F.col("date").alias("_b"))
    )
    last_add = days.filter("has_add").groupBy("symbol").agg(F.max("date").alias("_a"))
    opened = current.select("symbol").distinct().join(last_add, "symbol", "left").select(
        "symbol", "_a", F.lit(None).cast("date").alias("_b")
    )
    out = closed.unionByName(opened).crossJoin(F.broadcast(limits)).select(
        "symbol", F.coalesce("_a", "_lo").alias("from"), F.coalesce(F.col("_b"), end).alias("to")
    )
    if clamp_from is not None:
        out = out.filter(F.col("to") >= clamp_from).withColumn("from", F.greatest("from", clamp_from))
    return out


def spans_before(events: DataFrame, current: DataFrame, start, until=None) -> DataFrame:
    """How many spans, and of how many symbols, end before the window."""
    gone = spans(events, current, until=until).filter(F.col("to") < start)
    return gone.agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("symbol").alias("symbols"))


def periods(member_spans: DataFrame, unit: str = "month") -> DataFrame:
    """The periods a symbol was a member, both ends included, each once."""
    step = F.expr(f"interval 1 {unit}")
    start = F.trunc("from", "month") if unit == "month" else F.col("from")
    stop = F.trunc("to", "month") if unit == "month" else F.col("to")
    return member_spans.select("symbol", F.explode(F.sequence(start, stop, step)).alias("period")).distinct()


def covered_members(
    member_periods: DataFrame, have: DataFrame, bucket: str, need: float
) -> DataFrame:
    """Members by bucket and those whose periods are covered to ``need``.

    ``member_periods``: symbol, period, bucket. ``have``: symbol, period.
    """
    h = have.select("symbol", "period", F.lit(1).alias("_h")).distinct()
    per = (
        member_periods.join(h, ["symbol", "period"], "left")
        .groupBy(bucket, "symbol")
        .agg((F.count("_h") / F.count(F.lit(1))).alias("_share"))
    )
    return per.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("_share") >= need).alias("covered")
    ).withColumn("pct", 100.0 * F.col("covered") / F.col("members"))


def members_at(events: DataFrame, current: DataFrame, period: str = "period") -> DataFrame:
    """member count at the end of each period, rebuilt backward from the current list.

    For a symbol and a cut the earliest event after the cut decides: an addition means it was not
    a member, a removal means it was. Only the first event of a (symbol, period) can decide, so
    each symbol becomes a few intervals whose ends are added up per period; no symbol is paired
    with every cut. ``events``: date, added, removed and the integer ``period`` of the date.
    """
    named = F.filter(
        F.array(
            F.struct(F.col("removed").alias("symbol"), F.lit(0).alias("k")),
            F.struct(F.col("added").alias("symbol"), F.lit(1).alias("k")),
        ),
        lambda x: F.coalesce(x["symbol"], F.lit("")) != "",
    )
    first = (
        events.select(F.col(period).alias("p"), "date", "added", "removed", F.inline(named))
        .groupBy("symbol", "p")
        .agg(F.min_by("k", F.struct("date", "added", "removed", "k")).alias("k"))
    )
    w = Window.partitionBy("symbol").orderBy("p")
    runs = first.withColumn("_prev", F.lag("p").over(w))
    start = F.lit(-(2**31)).cast("long")
    inside = runs.filter("k = 0").select(
        F.inline(
            F.array(
                F.struct(F.coalesce(F.col("_prev").cast("long"), start).alias("p"), F.lit(1).alias("d")),
                F.struct(F.col("p").cast("long").alias("p"), F.lit(-1).alias("d")),
            )
        )
    )
    last = first.groupBy("symbol").agg(F.max("p").alias("p"))
    tail = current.select("symbol").distinct().join(last, "symbol", "left").select(
        F.coalesce(F.col("p").cast("long"), start).alias("p"), F.lit(1).alias("d")
    )
    limits = events.agg(F.min(period).cast("long").alias("lo"), F.max(period).cast("long").alias("hi"))
    cuts = limits.select(F.explode(F.sequence("lo", "hi")).alias("p"), F.lit(0).alias("d"))
    # one row per period from here on
    per = union_all(inside, tail, cuts).groupBy("p").agg(F.sum("d").alias("d"))
    run = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = per.withColumn("members", F.sum("d").over(run))
    return counted.join(cuts.select("p"), "p", "left_semi").select(F.col("p").alias(period), "members")


def rows_per_period(events: DataFrame, period: str = "period") -> DataFrame:
    """Change rows of every period of the range, empty periods included."""
    n = events.groupBy(F.col(period).cast("long").alias("p")).agg(F.count(F.lit(1)).alias("rows"))
    span = n.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("p"))
    return every.join(n, "p", "left").select(
        F.col("p").alias(period), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def onward(table: DataFrame, period: str, ok: str) -> DataFrame:
    """does this period and every later one pass? A period without evidence passes."""
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(
        Window.currentRow, Window.unboundedFollowing
    )
    return table.withColumn("_ok", F.coalesce(F.col(ok), F.lit(True))).withColumn(
        "onward", F.min("_ok").over(w)
    ).drop("_ok")


def earliest_start(table: DataFrame, period: str, ok: str) -> DataFrame:
    """earliest period from which all pass, and the silent periods inside the window."""
    t = onward(table, period, ok)
    return t.agg(
        F.min(F.when(F.col("onward"), F.col(period))).alias("starts"),
        F.count_if(F.col("onward") & F.col(ok).isNull()).alias("silent"),
    )


def dense_enough(counts: DataFrame, period: str, years: int, floor: int) -> DataFrame:
    """each run of ``years`` periods holds the floor and no period is empty."""
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.currentRow, years - 1)
    full = F.count(F.lit(1)).over(w) == years
    rolled = F.sum("rows").over(w)
    return counts.withColumn("rolling", F.when(full, rolled)).withColumn(
        "ok", (F.col("rows") > 0) & F.coalesce(F.col("rolling") >= floor, F.lit(True))
    )


def against_current(events: DataFrame, current: DataFrame) -> DataFrame:
    """Current list against history: omission, stale, never."""
    m = mentions(events).groupBy("symbol").agg(
        F.max(F.when(F.col("kind") == "add", F.col("date"))).alias("last_add"),
        F.max(F.when(F.col("kind") == "remove", F.col("date"))).alias("last_remove"),
    )
    c = current.select("symbol", F.lit(True).alias("_c")).distinct()
    j = m.join(c, "symbol", "full")
    old = F.lit("0001-01-01").cast("date")
    add, rem = F.coalesce("last_add", old), F.coalesce("last_remove", old)
    here = F.coalesce("_c", F.lit(False))
    finding = (
        F.when(~here & F.col("last_add").isNotNull() & (add > rem), "omission")
        .when(here & (rem > add), "stale")
        .when(here & F.col("last_add").isNull() & F.col("last_remove").isNull(), "never")
    )
    return j.select("symbol", "last_add", "last_remove", finding.alias("finding")).filter("finding is not null")
