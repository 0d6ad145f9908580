"""Lookups on a trading calendar. A calendar has one row per day, so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(dates: DataFrame, col: str = "date") -> DataFrame:
    """Distinct sessions with their position."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    d = dates.select(F.col(col).alias("date")).filter("date is not null").distinct()
    return d.withColumn("pos", F.row_number().over(w))


def every_day(cal: DataFrame) -> DataFrame:
    """Each day of the calendar's span with the session on or after it and on or before it."""
    span = cal.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    j = days.join(cal, days.day == cal.date, "left")
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(
        "day",
        F.min("date").over(ahead).alias("next_date"), F.min("pos").over(ahead).alias("next_pos"),
        F.max("date").over(behind).alias("prev_date"), F.max("pos").over(behind).alias("prev_pos"),
    )


def sessions_between(df: DataFrame, a: str, b: str, cal: DataFrame, out: str) -> DataFrame:
    """Sessions between two dates; weekdays by days * 5 div 7 once the calendar has ended.

    A date before the calendar takes its first session. The theta join "first session on or after"
    becomes an equi join with one row per day.
    """
    day = every_day(cal).select("day", "next_pos")
    lo = cal.agg(F.min("date").alias("_lo"))
    x = df.crossJoin(F.broadcast(lo))
    key = lambda c: F.greatest(F.col(c), F.col("_lo"))
    left = F.broadcast(day.select(F.col("day").alias("_ka"), F.col("next_pos").alias("_pa")))
    right = F.broadcast(day.select(F.col("day").alias("_kb"), F.col("next_pos").alias("_pb")))
    x = x.withColumn("_ja", key(a)).withColumn("_jb", key(b))
    x = x.join(left, F.col("_ja") == F.col("_ka"), "left").join(
        right, F.col("_jb") == F.col("_kb"), "left"
    )
    plain = F.floor(F.abs(F.date_diff(F.col(b), F.col(a))) * 5 / 7).cast("int")
    known = F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
    gap = F.when(known, F.abs(F.col("_pb") - F.col("_pa"))).otherwise(plain)
    return x.withColumn(
        out, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), gap)
    ).drop("_lo", "_ja", "_jb", "_ka", "_kb", "_pa", "_pb")


def month_of(c: Column) -> Column:
    """Month key."""
    return F.date_format(c, "yyyy-MM")
