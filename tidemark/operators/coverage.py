"""Completeness of pulls, coverage of series, reuse of symbols, lags of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DELIST_TOLERANCE, FAST_LAG_DAYS
from tidemark.functions.cleaning import ratio
from tidemark.functions.identifiers import FUND_WORDS, name_tokens
from tidemark.operators.calendar import sessions_between


def latest_entries(ledger: DataFrame) -> DataFrame:
    """The last written entry of each (endpoint, symbol) of an append-only log."""
    return (
        ledger.filter(F.col("disposition").isin("WROTE_NEW", "WROTE_BESIDE"))
        .groupBy("endpoint", "symbol")
        .agg(F.max_by(F.struct("n_rows", "date_min", "date_max", "line"), "line").alias("e"))
        .select("endpoint", "symbol", "e.*")
    )


def completeness(requested: DataFrame, latest: DataFrame) -> DataFrame:
    """Usable, empty and missing by endpoint against the requested list."""
    j = requested.join(latest, ["endpoint", "symbol"], "left")
    got = F.col("line").isNotNull()
    usable = got & (F.coalesce("n_rows", F.lit(0)) > 0)
    return j.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(usable).alias("usable"),
        F.count_if(got & ~usable).alias("empty"), F.count_if(~got).alias("missing"),
    ).withColumn("pct", 100.0 * F.col("usable") / F.col("requested"))


def pulled(ledger: DataFrame) -> DataFrame:
    """Rows, dates and files over all windows of a pull."""
    return ledger.filter(F.col("disposition").isin("WROTE_NEW", "WROTE_BESIDE")).groupBy(
        "endpoint", "symbol"
    ).agg(
        F.sum("n_rows").alias("n_rows"), F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"), F.count(F.lit(1)).alias("files"),
    )


def start_clusters(latest: DataFrame, keep: int = 3) -> DataFrame:
    """Most common start years by endpoint (years are few, so the ranking is bounded)."""
    from pyspark.sql import Window

    n = latest.groupBy("endpoint", F.year("date_min").alias("year")).agg(F.count(F.lit(1)).alias("symbols"))
    w = Window.partitionBy("endpoint").orderBy(F.col("symbols").desc(), "year")
    return n.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def by_year(listings: DataFrame, date: str) -> DataFrame:
    """Counts by year."""
    return listings.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(
        F.count(F.lit(1)).alias("n")
    )


def recency(listings: DataFrame, date: str, early: tuple[int, int], late: tuple[int, int], before: int) -> DataFrame:
    """Late against early counts, and the share before a year."""
    y = F.year(date)
    s = listings.filter(F.col(date).isNotNull()).agg(
        F.count_if(y.between(*early)).alias("early"), F.count_if(y.between(*late)).alias("late"),
        F.count_if(y < before).alias("before"), F.count(F.lit(1)).alias("n"),
    )
    return s.select(
        "*", ratio(F.col("late"), F.col("early")).alias("ratio"),
        ratio(F.col("before"), F.col("n")).alias("share_before"),
    )


def delisting_rates(listings: DataFrame, venues: DataFrame, floor: DataFrame, recent: str) -> DataFrame:
    """Crude, venue-matched, recent and size-matched rates, and the count they imply.

    ``listings``: venue, value, delisted_on (null = alive). ``venues``: venue. ``floor``: one row f.
    """
    v = venues.select("venue", F.lit(True).alias("_v")).distinct()
    j = listings.join(v, "venue", "left").crossJoin(F.broadcast(floor))
    gone, here = F.col("delisted_on").isNotNull(), F.coalesce("_v", F.lit(False))
    large, n = F.col("value") >= F.col("f"), F.count_if
    t = j.agg(
        F.count(F.lit(1)).alias("n"), n(gone).alias("d"), n(here).alias("nm"), n(here & gone).alias("dm"),
        n(F.col("delisted_on") >= F.lit(recent).cast("date")).alias("rec"), n(large).alias("ns"),
        n(large & gone).alias("ds"),
    )
    part = lambda a, b: ratio(F.col(a), F.col(b))
    return t.select(
        part("d", "n").alias("crude"), part("dm", "nm").alias("matched"), part("rec", "n").alias("recent"),
        part("ds", "ns").alias("size_matched"), (part("ds", "ns") * F.col("nm")).alias("implied"),
    )


def share_with_error(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """A share by group with 1.96 binomial standard errors."""
    s = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("share"))
    p = F.col("share")
    return s.withColumn("margin", 1.96 * F.sqrt(p * (1 - p) / F.col("n")))


def run_to_end(
    symbols: DataFrame, calendar: DataFrame, group: Column, tolerance: int = DELIST_TOLERANCE
) -> DataFrame:
    """Does each series run to its delisting? ``symbols``: symbol, end, last (null = no bars).

    Two scores: of all on the list, and of those with bars.
    """
    g = sessions_between(symbols, "last", "end", calendar, "_gap")
    state = (
        F.when(F.col("last").isNull(), "none").when(F.col("_gap") <= tolerance, "ok")
        .when(F.col("last") > F.col("end"), "late").otherwise("early")
    )
    n = lambda s: F.count_if(F.col("_s") == s)
    return (
        g.withColumn("_s", state).groupBy(group.alias("year"))
        .agg(
            F.count(F.lit(1)).alias("listed"), n("ok").alias("ok"), n("late").alias("late"),
            n("early").alias("early"), n("none").alias("no_bars"),
        )
        .withColumn("pct", 100.0 * F.col("ok") / F.col("listed"))
        .withColumn(
            "pct_priced",
            100.0 * F.col("ok") / F.greatest(F.lit(1), F.col("listed") - F.col("no_bars")),
        )
    )


def without_any(universe: DataFrame, *have: DataFrame) -> DataFrame:
    """Symbols found in none of the tables."""
    out = universe.select("symbol").distinct()
    for h in have:
        out = out.join(h.select("symbol"), "symbol", "left_anti")
    return out


def first_and_latest(rows: DataFrame, key: str, name: str, date: str, tie: str) -> DataFrame:
    """First day seen and the latest name of each key."""
    return rows.groupBy(key).agg(
        F.min(date).alias("first_seen"), F.max_by(name, F.struct(date, tie)).alias("latest_name")
    )


def reused_symbols(symbols: DataFrame) -> DataFrame:
    """Detectors for a symbol that now names another company.

    ``symbols``: symbol, history_name, profile_name, first_seen, ipo, list_id, profile_id,
    continues_after. A: no shared word, tier 1 when something corroborates it; B: listed after it
    was first seen; C: the two registry numbers differ.
    """
    th, tp = name_tokens(F.coalesce("history_name", F.lit(""))), name_tokens(F.coalesce("profile_name", F.lit("")))
    clash = (F.size(th) > 0) & (F.size(tp) > 0) & ~F.arrays_overlap(th, tp)
    fund = lambda c: F.coalesce(F.lower(F.col(c)).rlike("|".join(FUND_WORDS)), F.lit(False))
    backed = F.coalesce("continues_after", F.lit(False)) | (fund("profile_name") & ~fund("history_name"))
    bare = lambda c: F.ltrim(F.coalesce(F.col(c), F.lit("")), F.lit("0"))
    return symbols.select(
        "symbol", clash.alias("clash"),
        F.when(clash & backed, 1).when(clash, 2).alias("tier"),
        F.coalesce(F.col("ipo") > F.col("first_seen"), F.lit(False)).alias("listed_after_seen"),
        (F.coalesce(F.col("ipo") > F.col("first_seen"), F.lit(False)) & clash).alias("seen_and_clash"),
        ((bare("list_id") != "") & (bare("profile_id") != "") & (bare("list_id") != bare("profile_id"))).alias("id_differs"),
    )


def release_array(releases: DataFrame, month: str = "month") -> DataFrame:
    """The release months as one sorted array: one element per release."""
    return releases.agg(F.array_sort(F.collect_set(month)).alias("_rel"))


def record_lags(cases: DataFrame, releases: DataFrame, base: str) -> DataFrame:
    """How long after a transaction a release carried it.

    ``cases``: case, happened (date), carried (release month). The first release that could carry
    it is the first after both the transaction's month and the base release.
    """
    x = cases.crossJoin(F.broadcast(release_array(releases)))
    month = F.date_format("happened", "yyyy-MM")
    after = F.filter("_rel", lambda m: (m > month) & (m > F.lit(base)))
    first = F.when(F.size(after) > 0, F.element_at(after, 1))
    day = lambda c: F.concat(c, F.lit("-01")).cast("date")
    pos = lambda c: F.array_position("_rel", c)
    x = x.withColumn("first_possible", first)
    before = F.col("happened") < F.lit(base + "-01").cast("date")
    lag = F.date_diff(day(F.col("carried")), F.col("happened"))
    return x.select(
        "case", F.col("happened").cast("string").alias("happened"), "carried", "first_possible",
        lag.alias("lag_days"),
        F.date_diff(day(F.col("carried")), day(F.col("first_possible"))).alias("days_after_first"),
        (pos(F.col("carried")) - pos(F.col("first_possible")) + 1).alias("position"),
        before.alias("before_base"),
        F.when(before, F.date_diff(day(F.col("first_possible")), F.col("happened"))).otherwise(
            F.date_diff(day(F.element_at("_rel", -1)), F.col("happened"))
        ).alias("bound_days"),
        F.when(lag <= FAST_LAG_DAYS, "fast").otherwise("slow").alias("speed"),
    )


def evidence_problems(sample: DataFrame, evidence: DataFrame) -> DataFrame:
    """Full join on (subject, party): missing, extra, verdict differs, stamp differs."""
    s = sample.select("subject", "party", F.col("verdict").alias("_v"), F.col("stamp").alias("_st"), F.lit(True).alias("_s"))
    e = evidence.select("subject", "party", "verdict", "stamp", F.lit(True).alias("_e"))
    j = s.join(e, ["subject", "party"], "full")
    problem = (
        F.when(F.col("_e").isNull(), "missing").when(F.col("_s").isNull(), "extra")
        .when(~F.col("verdict").eqNullSafe(F.col("_v")), "verdict differs")
        .when(~F.coalesce(F.col("_st").startswith(F.col("stamp")), F.lit(False)), "stamp differs")
    )
    return j.select("subject", "party", problem.alias("problem")).filter("problem is not null")
