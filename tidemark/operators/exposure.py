"""Attribution of asset capacity to listed holders, and tables built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import half_up, ratio

#: Holders in one array where sets of holders meet; a larger set takes several rows.
HOLDERS_A_ROW = 1_000


def usable_units(units: DataFrame) -> DataFrame:
    """Rows with a known share and capacity; the rest is dropped, never read as zero."""
    return units.filter(
        F.col("unit").isNotNull() & F.col("owner").isNotNull()
        & F.col("cap").isNotNull() & F.col("hop").isNotNull()
    )


def dropped_by_sector(units: DataFrame) -> DataFrame:
    """Rows kept and dropped by sector, counted in one pass."""
    known = F.col("cap").isNotNull() & F.col("hop").isNotNull()
    return units.groupBy("sector").agg(
        F.count_if(known).alias("kept"), F.count_if(~known).alias("dropped")
    )


def attribute(units: DataFrame, held: DataFrame, together: bool = False) -> DataFrame:
    """Capacity and share of each unit by listed firm: unit, firm, mw, share.

    ``held``: source, parent, weight. The join key is the immediate owner; an owner of a third of
    all units is split by AQE's skew join, and the aggregate after it is on (unit, firm). ``together``
    lays the rows of a unit in one task instead, so that a next step by unit moves nothing again.
    """
    j = units.join(held, units.owner == held.source).select(
        "unit", F.col("parent").alias("firm"),
        (F.col("hop") * F.col("weight") * F.col("cap")).alias("mw"), (F.col("hop") * F.col("weight")).alias("share"),
    )
    if together:
        j = j.repartition("unit")
    return j.groupBy("unit", "firm").agg(F.sum("mw").alias("mw"), F.sum("share").alias("share"))


def firm_capacity(attributed: DataFrame) -> DataFrame:
    """Capacity and number of units by firm; (unit, firm) is unique, so count is distinct."""
    return attributed.groupBy("firm").agg(
        F.sum("mw").alias("mw"), F.count(F.lit(1)).alias("units")
    )


def fleet(units: DataFrame) -> DataFrame:
    """Capacity of distinct units."""
    return units.groupBy("unit").agg(F.max("cap").alias("cap")).agg(F.sum("cap").alias("fleet"))


def overcount(units: DataFrame) -> DataFrame:
    """Capacity added over every row against the capacity of distinct units."""
    naive = units.agg(F.sum(F.col("hop") * F.col("cap")).alias("naive"))
    return naive.crossJoin(fleet(units)).withColumn(
        "ratio", ratio(F.col("naive"), F.col("fleet"))
    )


def holder_sets(pairs: DataFrame, key: str, name: str) -> DataFrame:
    """The holders of each key as arrays of bounded size: key, name. ``pairs``: key, holder (repeats and nulls are left out)."""
    known = pairs.select(key, "holder").dropna().distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy("holder"))
    return (
        known.withColumn("_row", F.floor((place - 1) / HOLDERS_A_ROW))
        .groupBy(key, "_row").agg(F.collect_list("holder").alias(name)).drop("_row")
    )


def split_entrants(
    unit_mw: DataFrame, old_units: DataFrame, old_holders: DataFrame, owners: DataFrame,
    listed_old: DataFrame,
) -> DataFrame:
    """An entrant's new capacity in three exhaustive parts.

    Part 1: the unit was carried before, the entrant was not listed then, and a holder of the unit
    at that time owns the entrant now. Part 2: carried before otherwise. Part 3: not carried.

    ``unit_mw``: firm, unit, mw. ``old_units``: unit. ``old_holders``: unit, holder.
    ``owners``: firm, holder (who owns the entrant now). ``listed_old``: firm.
    """
    carried = old_units.select("unit", F.lit(True).alias("_carried")).distinct()
    pairs = unit_mw.groupBy("unit", "firm").agg(F.count(F.lit(1)).alias("_n"), F.sum("mw").alias("mw"))
    # A unit is under a current owner when (unit, holder) meets (firm, holder). The owners of an entrant
    # that was not listed travel to its units as arrays and meet the unit's holders there, so no row is
    # made, moved or sorted for an entrant and a holder that only share a unit.
    new = owners.select("firm", "holder").filter("holder <> firm").join(listed_old.select("firm"), "firm", "left_anti")
    above, held = holder_sets(new, "firm", "_above").hint("merge"), holder_sets(old_holders, "unit", "_held")
    rows = (
        pairs.join(above, "firm", "left").join(carried, "unit", "left").join(held, "unit", "left")
        # one row of each pair again where a set took several
        .groupBy("unit", "firm").agg(
            F.max("_n").alias("_n"), F.max("mw").alias("mw"), F.coalesce(F.max("_carried"), F.lit(False)).alias("_carried"),
            F.coalesce(F.max(F.arrays_overlap("_above", "_held")), F.lit(False)).alias("_under"),
        )
        .withColumn("part", F.when(~F.col("_carried"), 3).when(F.col("_under"), 1).otherwise(2))
    )
    mw = lambda p: F.sum(F.when(F.col("part") == p, F.col("mw")).otherwise(0.0))
    n = lambda cond: F.sum(F.when(cond, F.col("_n")).otherwise(0))
    return rows.groupBy("firm").agg(
        F.sum("mw").alias("mw"), F.sum("_n").alias("units"),
        n(F.col("_carried")).alias("units_carried"), n(F.col("part") == 1).alias("units_part_1"),
        mw(1).alias("mw_part_1"), mw(2).alias("mw_part_2"), mw(3).alias("mw_part_3"),
        (F.abs(mw(1) + mw(2) + mw(3) - F.sum("mw")) < 1e-6).alias("adds_up"),
    )


def unit_attributes(rows: DataFrame) -> DataFrame:
    """One row per unit: sorted distinct statuses joined, largest capacity, first sector.

    Statuses form a small vocabulary, so the set of one unit is bounded by that vocabulary.
    """
    return rows.groupBy("unit").agg(
        F.array_join(F.array_sort(F.collect_set("status")), "|").alias("status"),
        F.max("cap").alias("cap"),
        F.min_by("sector", F.struct("ord", "sector")).alias("sector"),
        F.min_by("capunit", F.struct("ord", "sector")).alias("capunit"),
    )


def survivors(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """How many rows are left after each filter, in one pass."""
    kept, aggs, names = None, [F.count(F.lit(1)).alias("s0")], ["all"]
    for i, (name, cond) in enumerate(steps.items(), start=1):
        kept = cond if kept is None else kept & cond
        aggs.append(F.count_if(F.coalesce(kept, F.lit(False))).alias(f"s{i}"))
        names.append(name)
    one = df.agg(*aggs)
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("n"))
                    for i, n in enumerate(names)
                ]
            )
        )
    )


def coverage(units: DataFrame) -> DataFrame:
    """Coverage by count, by capacity and share-weighted, never pooled across units of measure.

    ``units``: sector, capunit, cap, listed_share, region_share (one row per unit).
    """
    l, g = F.coalesce("listed_share", F.lit(0.0)), F.coalesce("region_share", F.lit(0.0))
    pct = lambda num, den, name: half_up(ratio(100 * num, den), 4).alias(name)
    cap, n = F.sum("cap"), F.count(F.lit(1))
    when_cap = lambda x: F.sum(F.when(x > 0, F.col("cap")).otherwise(0.0))
    return units.groupBy("sector", "capunit").agg(
        n.alias("units"), half_up(cap, 4).alias("capacity"),
        pct(F.count_if(l > 0), n, "listed_by_count"), pct(when_cap(l), cap, "listed_by_capacity"),
        pct(F.count_if(g > 0), n, "region_by_count"), pct(when_cap(g), cap, "region_by_capacity"),
        pct(
            F.sum(F.col("cap") * F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))), cap,
            "region_share_weighted",
        ),
    )


def holdings(attributed: DataFrame, at_least: int = 5) -> DataFrame:
    """Distinct assets against holdings, and firms with at least five."""
    per = attributed.groupBy("firm").agg(F.count(F.lit(1)).alias("_n"))
    firms = per.agg(
        F.count(F.lit(1)).alias("firms"), F.sum("_n").alias("holdings"),
        F.count_if(F.col("_n") >= at_least).alias("large"),
    )
    assets = attributed.select("unit").distinct().agg(F.count(F.lit(1)).alias("assets"))
    return firms.crossJoin(F.broadcast(assets))


def matched_growth(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Totals and growth of firms in both, and how many moved less than the tolerance."""
    x = a.select(key, F.col(value).alias("a"))
    y = b.select(key, F.col(value).alias("b"))
    j = x.join(y, key, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return j.agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(both).alias("n_both"),
        half_up(F.sum(F.when(both, F.col("a"))), 2).alias("total_a"),
        half_up(F.sum(F.when(both, F.col("b"))), 2).alias("total_b"),
        half_up(
            ratio(F.sum(F.when(both, F.col("b"))), F.sum(F.when(both, F.col("a")))) - 1, 6
        ).alias("growth"),
        F.count_if(both & (F.abs(F.col("b") - F.col("a")) < 1e-6)).alias("unchanged"),
    )


def largest_moves(a: DataFrame, b: DataFrame, key: str, value: str, n: int = 12) -> DataFrame:
    """G1: the n largest absolute moves, ties by key (a bounded top-k)."""
    x = a.select(key, F.col(value).alias("a"))
    y = b.select(key, F.col(value).alias("b"))
    j = x.join(y, key).withColumn("change", half_up(F.col("b") - F.col("a"), 6))
    return j.orderBy(F.abs("change").desc(), key).limit(n)


def wide_measures(long: DataFrame, key: str, arm: str, arms: list[str], value: str) -> DataFrame:
    """One row per firm, one column per arm, no exposure read as a real zero."""
    return long.groupBy(key).pivot(arm, arms).agg(F.sum(value)).na.fill(0.0, arms)


def sector_shares(long: DataFrame) -> DataFrame:
    """Capacity by firm and sector group, totals, and shares that are null over zero.

    ``long``: firm, grp (coal, gas, bio), mw.
    """
    w = long.groupBy("firm").pivot("grp", ["coal", "gas", "bio"]).agg(F.sum("mw")).na.fill(0.0)
    fossil, thermal = F.col("coal") + F.col("gas"), F.col("coal") + F.col("gas") + F.col("bio")
    return w.select(
        "firm", "coal", "gas", "bio", fossil.alias("fossil"), thermal.alias("thermal"),
        F.when(thermal > 0, fossil / thermal).alias("fossil_share"),
        F.when(fossil > 0, F.col("coal") / fossil).alias("coal_share"),
    )


def panel_flow(wide: DataFrame, old: str, new: str) -> DataFrame:
    """Exposed, never exposed, entered and left, in one pass."""
    a, b = F.col(old) > 0, F.col(new) > 0
    return wide.agg(
        F.count(F.lit(1)).alias("firms"), F.count_if(a).alias("exposed_old"),
        F.count_if(b).alias("exposed_new"), F.count_if(~a & ~b).alias("never"),
        F.count_if(a | b).alias("active"), F.count_if(~a & b).alias("entered"),
        F.count_if(a & ~b).alias("left"),
    )
