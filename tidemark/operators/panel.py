"""Price panels: returns, portfolios and what is measured on them.

Prices are unique by (symbol, date) before any window opens, so a window over one symbol holds at
most one row per calendar day, whatever share of the raw rows the symbol had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EXTREME_MOVE, FRAGILE_CORR, RETURN_HIGH, RETURN_LOW, ROBUST_CORR
from tidemark.functions.cleaning import ratio
from tidemark.functions.stats import correlation, slope
from tidemark.operators.calendar import every_day, month_of, sessions


def month_end_prices(prices: DataFrame) -> DataFrame:
    """last price of each month by symbol."""
    return prices.groupBy("symbol", month_of(F.col("date")).alias("month")).agg(
        F.max_by("price", "date").alias("price")
    )


def row_returns(prices: DataFrame, order: str) -> DataFrame:
    """simple return to the previous row; a missing period gives a longer return."""
    w = Window.partitionBy("symbol").orderBy(order)
    return prices.withColumn("ret", ratio(F.col("price"), F.lag("price").over(w)) - 1)


def plausible(returns: DataFrame) -> DataFrame:
    """Returns inside the plausible range."""
    return returns.filter(F.col("ret").between(RETURN_LOW, RETURN_HIGH))


def range_counts(returns: DataFrame) -> DataFrame:
    """Kept and dropped, counted in one pass."""
    inside = F.col("ret").between(RETURN_LOW, RETURN_HIGH)
    return returns.agg(
        F.count("ret").alias("returns"), F.count_if(inside).alias("kept"),
        F.count_if(~inside).alias("dropped"),
    )


def extreme_symbols(returns: DataFrame, threshold: float = EXTREME_MOVE) -> DataFrame:
    """Extreme daily moves by symbol: flagged and counted, not dropped."""
    big = F.abs("ret") > threshold
    return returns.groupBy("symbol").agg(
        F.count_if(big).alias("n_extreme"), F.max(F.when(big, F.abs("ret"))).alias("worst")
    ).filter("n_extreme > 0")


def without_broken(returns: DataFrame, at_least: int) -> DataFrame:
    """Symbols with that many extreme moves or more are left out."""
    broken = extreme_symbols(returns).filter(F.col("n_extreme") >= at_least).select("symbol")
    return returns.join(broken, "symbol", "left_anti")


def compounded(returns: DataFrame, period: str, keep: list[str] | None = None) -> DataFrame:
    """Product of (1 + r) - 1 by symbol and period, through logs (every r is above -1)."""
    extra = [F.first(c, True).alias(c) for c in keep or []]
    return (
        returns.filter(F.col("ret").isNotNull())
        .groupBy("symbol", period)
        .agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("ret"), *extra)
    )


def portfolio(returns: DataFrame, period: str, weight: str | None = None) -> DataFrame:
    """Equal-weighted or value-weighted return by period."""
    r = returns.filter(F.col("ret").isNotNull())
    if weight is None:
        return r.groupBy(period).agg(F.avg("ret").alias("port"), F.count("ret").alias("firms"))
    r = r.filter(F.col(weight).isNotNull())
    w = F.col(weight)
    return r.groupBy(period).agg(
        ratio(F.sum(w * F.col("ret")), F.sum(w)).alias("port"), F.count("ret").alias("firms")
    )


def weights(symbols: DataFrame, cap: str, fallback: str) -> DataFrame:
    """Market value where known, traded value otherwise, with the source named."""
    use_cap = F.col(cap) > 0
    return symbols.withColumn(
        "weight", F.when(use_cap, F.col(cap)).when(F.col(fallback) > 0, F.col(fallback))
    ).withColumn(
        "source", F.when(use_cap, "market value").when(F.col(fallback) > 0, "traded value").otherwise("none")
    )


def leg_spread(returns: DataFrame, legs: DataFrame, arm: list[str]) -> DataFrame:
    """Mean of the top leg minus mean of the bottom leg by month; months with one leg drop.

    ``legs``: arm columns, symbol, leg. ``returns``: symbol, month, ret.
    """
    j = returns.join(legs.filter("leg is not null"), "symbol")
    mean = lambda leg: F.avg(F.when(F.col("leg") == leg, F.col("ret")))
    return (
        j.groupBy(*arm, "month")
        .agg((mean("top") - mean("bottom")).alias("spread"))
        .filter("spread is not null")
    )


def span_returns(prices: DataFrame, days: int, min_bars: int) -> DataFrame:
    """return over the last ``days`` of each symbol: first and last bar of the span."""
    last = prices.groupBy("symbol").agg(F.max("date").alias("end"))
    span = prices.join(last, "symbol").filter(F.col("date") >= F.date_sub("end", days))
    return (
        span.groupBy("symbol")
        .agg(
            F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("bars"),
            (ratio(F.max_by("price", "date"), F.min_by("price", "date")) - 1).alias("ret"),
        )
        .filter(F.col("bars") >= min_bars)
    )


def gap_to_market(spans: DataFrame, market: DataFrame) -> DataFrame:
    """Market return inside each firm's own span, and the gap to it.

    The range join of days between lo and hi only needs the market's first and last session in the
    range; both come from equi joins with one row per calendar day. ``market``: date, price.
    """
    cal = sessions(market)
    m = market.select("date", F.col("price").alias("m"))
    day = every_day(cal)
    first = (
        day.join(m, day.next_date == m.date).select(
            F.col("day").alias("lo"), F.col("m").alias("m_lo"), F.col("next_pos").alias("p_lo")
        )
    )
    last = (
        day.join(m, day.prev_date == m.date).select(
            F.col("day").alias("hi"), F.col("m").alias("m_hi"), F.col("prev_pos").alias("p_hi")
        )
    )
    j = spans.join(F.broadcast(first), "lo").join(F.broadcast(last), "hi").filter("p_hi > p_lo")
    return j.withColumn("mkt", ratio(F.col("m_hi"), F.col("m_lo")) - 1).withColumn(
        "gap", F.col("ret") - F.col("mkt")
    ).drop("m_lo", "m_hi", "p_lo", "p_hi")


def annual_returns(prices: DataFrame, more_than: int = 200) -> DataFrame:
    """last over first price of a year, for years with enough bars."""
    return (
        prices.groupBy("symbol", F.year("date").alias("year"))
        .agg(
            (ratio(F.max_by("price", "date"), F.min_by("price", "date")) - 1).alias("ret"),
            F.count(F.lit(1)).alias("bars"),
        )
        .filter(F.col("bars") > more_than)
    )


def step_ratio(prices: DataFrame, days: DataFrame) -> DataFrame:
    """last price before a day over the first price on or after it.

    ``days``: symbol, day. Days and bars share one ordered stream per symbol, so the work is linear
    in both and no day is paired with the bars of its symbol.
    """
    day = days.select("symbol", F.col("day").alias("date"), F.lit(None).cast("double").alias("price")).distinct()
    rows = prices.select("symbol", "date", "price").withColumn("_bar", F.lit(1)).unionByName(
        day.withColumn("_bar", F.lit(0))
    )
    w = Window.partitionBy("symbol").orderBy("date", "_bar")
    before = F.last("price", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("price", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return (
        rows.withColumn("step", ratio(before, after)).filter("_bar = 0")
        .select("symbol", F.col("date").alias("day"), "step")
    )


def split_convention(steps: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Q12: a step near 1 means adjusted, near the split ratio means not adjusted."""
    near = lambda x, y: F.abs(ratio(x, y) - 1) <= tolerance
    return steps.withColumn(
        "convention",
        F.when(F.col("step").isNull(), "no bars")
        .when(near(F.col("step"), F.lit(1.0)), "adjusted")
        .when(near(F.col("step"), F.col("ratio")), "not adjusted")
        .otherwise("unclear"),
    )


def coverage_by_symbol(prices: DataFrame) -> DataFrame:
    """Rows, first and last day by symbol."""
    return prices.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("date").alias("first"), F.max("date").alias("last")
    )


def adjustment_evidence(returns: DataFrame, thresholds: list[float]) -> DataFrame:
    """One-day moves beyond each threshold and how many symbols show them.

    Moves are counted per symbol first, so no row is copied for a distinct count.
    """
    per = returns.groupBy("symbol").agg(
        *[F.count_if(F.abs("ret") > t).alias(f"_m{i}") for i, t in enumerate(thresholds)]
    )
    rows = [
        F.struct(
            F.lit(t).alias("threshold"), F.coalesce(F.sum(f"_m{i}"), F.lit(0)).alias("moves"),
            F.count_if((F.col(f"_m{i}") > 0) & F.col("symbol").isNotNull()).alias("symbols"),
        )
        for i, t in enumerate(thresholds)
    ]
    return per.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def liquidity(prices: DataFrame) -> DataFrame:
    """Median traded value, bars and median volume by listing (bounded by the calendar)."""
    return prices.groupBy("symbol").agg(
        F.median(F.col("price") * F.col("volume")).alias("dollar_vol"),
        F.count(F.lit(1)).alias("bars"), F.median("volume").alias("share_vol"),
    )


def arm_correlations(series: DataFrame, period: str, arm: str, value: str, arms: list[str]) -> DataFrame:
    """S3: correlation of every pair of a fixed list of arms: one pivot, one aggregate, no self join."""
    w = series.groupBy(period).pivot(arm, arms).agg(F.first(value))
    col = lambda a: F.col(f"`{a}`")
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"),
                F.count_if(col(a).isNotNull() & col(b).isNotNull()).alias("months"),
                correlation(f"`{a}`", f"`{b}`").alias("rho"),
            )
            for a in sorted(arms)
            for b in sorted(arms)
            if a < b
        ]
    )
    return w.agg(pairs.alias("_p")).select(F.inline("_p"))


def leg_turnover(legs: DataFrame, rule: str, old: str, new: str, parts: str = "release") -> DataFrame:
    """H5, H6: names that differ between two top sets, and the share replaced.

    ``legs``: rule, release, symbol, k of the top leg only.
    """
    m = legs.groupBy(rule, "symbol").agg(
        F.max(F.col(parts) == old).alias("a"), F.max(F.col(parts) == new).alias("b"), F.max("k").alias("k")
    )
    a, b = F.col("a"), F.col("b")
    return m.groupBy(rule).agg(
        F.count_if(a & ~b).alias("left_top"), F.count_if(b & ~a).alias("entered_top"),
        F.count_if(a != b).alias("differing"), ratio(F.count_if(b & ~a), F.max("k")).alias("turnover"),
    )


def aligned(series: DataFrame, keys: list[str], side: str, old: str, new: str, value: str) -> DataFrame:
    """C17: two series on the periods both have, with their difference; one aggregate on the keys."""
    at = lambda s: F.max(F.when(F.col(side) == s, F.col(value)))
    j = series.groupBy(*keys).agg(at(old).alias("x"), at(new).alias("y"))
    return j.filter("x is not null and y is not null").withColumn("d", F.col("y") - F.col("x"))


def spread_verdict(means: DataFrame, pairs: DataFrame, rule: str, side: str, old: str, new: str) -> DataFrame:
    """Does a spread move with the release? Within one error and above the upper correlation
    it is robust; outside, or below the lower one, it is fragile.

    ``means``: rule, side, mean, se_nw. ``pairs``: rule, x, y.
    """
    at = lambda s, c: F.max(F.when(F.col(side) == s, F.col(c)))
    v = means.groupBy(rule).agg(
        (at(new, "mean") - at(old, "mean")).alias("diff"),
        F.greatest(at(old, "se_nw"), at(new, "se_nw")).alias("se"),
    )
    c = pairs.groupBy(rule).agg(correlation("x", "y").alias("rho"))
    within = F.abs("diff") < F.col("se")
    return v.join(c, rule).withColumn(
        "verdict",
        F.when(within & (F.col("rho") > ROBUST_CORR), "ROBUST")
        .when(~within | (F.col("rho") < FRAGILE_CORR), "FRAGILE").otherwise("MIXED"),
    )


def symbol_betas(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Slope of each symbol's excess return on the market. ``factors`` has one row per day; Spark decides by its size."""
    j = returns.filter("ret is not null").join(factors, "date")
    return j.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), slope(F.col("ret") - F.col("rf"), F.col("mkt")).alias("beta")
    )


def tracking_difference(annual: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Upper middle element of the absolute annual differences, in basis points.

    A symbol has one value per year, so its sorted list is bounded by the calendar.
    """
    d = annual.join(benchmark, "year").withColumn("_bp", F.abs((F.col("ret") - F.col("mkt")) * 10000))
    g = d.groupBy("symbol").agg(F.sort_array(F.collect_list("_bp")).alias("_l"))
    return g.select(
        "symbol", F.size("_l").cast("long").alias("years"),
        F.expr("element_at(_l, cast(size(_l) div 2 + 1 as int))").alias("median_bp"),
    )
