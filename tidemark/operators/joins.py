"""Joins with a stated rule for what does not match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def later_wins(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Union of two maps; the later one wins on a shared key."""
    n = new.select(key, F.col(value).alias("_new"))
    return old.join(n, key, "full").select(key, F.coalesce("_new", value).alias(value))
