"""Text to value rules. Every rule is a Column expression, so scans stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import BLANK_WORDS, MISSING_CODES


def blank(c: Column) -> Column:
    """B2: empty after trimming, or one of the words that stand for a missing value."""
    t = F.trim(c)
    return c.isNull() | (t == "") | F.lower(t).isin(*BLANK_WORDS)


def present_or_null(c: Column) -> Column:
    """The value, or null where it is blank, so that blank keys never match each other."""
    return F.when(~blank(c), F.trim(c))


def fraction(c: Column) -> Column:
    """Percent text to a fraction, unreadable text to zero."""
    return F.coalesce(F.rtrim(F.trim(c), F.lit("%")).try_cast("double"), F.lit(0.0)) / 100


def number(c: Column) -> Column:
    """Number text to double; commas and percent signs go, unreadable text becomes null."""
    return F.trim(F.regexp_replace(c, "[,%]", "")).try_cast("double")


def decimals(c: Column) -> Column:
    """Decimal places as written, trailing zeros not counted; null for no number."""
    t = F.trim(F.rtrim(F.trim(c), F.lit("%")))
    places = F.length(F.rtrim(F.regexp_extract(t, r"\.(\d*)", 1), F.lit("0")))
    return F.when(t.try_cast("double").isNotNull() & (F.lower(t) != "nan"), places)


def last_hop(path: Column) -> Column:
    """The last bracketed percent of a path as a fraction; null when there is none."""
    shares = F.regexp_extract_all(path, F.lit(r"\[([0-9.]+)%\]"), F.lit(1))
    return F.when(F.size(shares) > 0, F.element_at(shares, -1).try_cast("double") / 100)


def chain_depth(path: Column) -> Column:
    """Number of arrows in a path."""
    return F.size(F.split(path, "->")) - 1


def path_product(path: Column) -> Column:
    """Product of all bracketed percents, in percent; null when there is none."""
    shares = F.regexp_extract_all(path, F.lit(r"\[([0-9.]+)%\]"), F.lit(1))
    product = F.aggregate(shares, F.lit(100.0), lambda a, s: a * s.try_cast("double") / 100)
    return F.when(F.size(shares) > 0, product)


def key_of(*parts: Column) -> Column:
    """Composite key."""
    return F.concat_ws("|", *parts)


def coded_number(c: Column, percent: bool = True) -> Column:
    """Cast first, then missing codes to null, then percent to a fraction."""
    v = c.try_cast("double")
    v = F.when(~v.isin(*MISSING_CODES), v)
    return v / 100 if percent else v


def to_date(c: Column) -> Column:
    """Date, null where the text is no date."""
    return F.trim(c).try_cast("date")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (plain division by zero stops a query under ANSI rules)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_up(c: Column, places: int) -> Column:
    """Rounding by floor, the same arithmetic on every engine."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5).cast("double") / scale


def half_even(c: Column, places: int) -> Column:
    """Ties go to the even digit, as pandas and Python round."""
    scale = float(10**places)
    return F.rint(c * scale) / scale
