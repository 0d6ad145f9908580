"""From entities to identifiers to one primary listing, with every loss counted.

"Best within a group" is always an aggregate (``max``, then ``max_by``), never a sorted group, so a
firm with a third of all candidates is reduced map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import CANDIDATE_CAPS, HOME_FACTOR, MIN_BARS, NAME_SIMILARITY, VALUE_FACTOR
from tidemark.functions.cleaning import blank, present_or_null, ratio
from tidemark.functions.identifiers import MINOR_UNITS, has_lei, plain_name
from tidemark.operators.ordering import positions


def priceable(listings: DataFrame) -> DataFrame:
    """Lines that trade and have enough bars."""
    return listings.filter((F.col("dollar_vol") > 0) & (F.col("bars") > MIN_BARS))


def best_listing(listings: DataFrame, key: str) -> DataFrame:
    """within a factor of the most traded value, the line with the most shares, then value."""
    alive = priceable(listings).filter(F.col(key).isNotNull())
    top = alive.groupBy(key).agg(F.max("dollar_vol").alias("_top"))
    near = alive.join(top, key).filter(F.col("dollar_vol") >= F.col("_top") / VALUE_FACTOR)
    best = F.max_by(
        F.struct("symbol", "exchange", "dollar_vol", "share_vol"),
        F.struct("share_vol", "dollar_vol", "symbol"),
    )
    return near.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def null_safe_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Blank keys become null first, so they match nothing and are kept unmatched."""
    l = left.withColumn(key, present_or_null(F.col(key)))
    rest = right.withColumn(key, present_or_null(F.col(key))).filter(F.col(key).isNotNull())
    return l.join(rest, key, "left")


def second_route(
    unresolved: DataFrame, listings: DataFrame, key: str
) -> DataFrame:
    """Best line by traded value through a second identifier."""
    alive = listings.withColumn(key, present_or_null(F.col(key))).filter(
        F.col(key).isNotNull() & (F.col("bars") > MIN_BARS) & (F.col("dollar_vol") > 0)
    )
    best = alive.groupBy(key).agg(
        F.max_by(F.struct("symbol", "exchange", "dollar_vol"), F.struct("dollar_vol", "symbol")).alias("_b")
    )
    return (
        unresolved.withColumn(key, present_or_null(F.col(key)))
        .join(best, key, "left")
        .select(*unresolved.columns, "_b.*")
    )


def similarity(a: str, b: str) -> Column:
    """Edit similarity of two plain names, 1 - edits / length of the longer one; null if a name is null.

    A score of its own: it is no sequence matcher's ratio, is lower for names whose words are reordered, and has its
    own floor. Two empty names are alike.
    """
    x, y = plain_name(F.col(a)), plain_name(F.col(b))
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(x, y) / longer)


def name_route(
    candidates: DataFrame, entity: str, name: str, other: str, floor: float = NAME_SIMILARITY
) -> DataFrame:
    """Best candidate by (similarity, traded value) above the floor.

    Candidates are rows found for an entity beforehand; names are never paired with each other.
    """
    # a name can't reach the floor against one that much longer: that is tested before any edits are counted
    x, y = F.length(plain_name(F.col(name))), F.length(plain_name(F.col(other)))
    scored = (
        candidates.filter(F.col("bars") > MIN_BARS).filter(F.least(x, y) >= F.greatest(x, y) * floor)
        .withColumn("score", similarity(name, other))
        .filter(F.col("score") >= floor)
    )
    best = F.max_by(F.struct("symbol", "score", "dollar_vol"), F.struct("score", "dollar_vol", "symbol"))
    return scored.groupBy(entity).agg(best.alias("_b")).select(entity, "_b.*")


def home_switch(current: DataFrame, home: DataFrame, key: str) -> DataFrame:
    """Move to a home line only when it trades more than three times the current one.

    ``current``: key, symbol, dollar_vol. ``home``: key, symbol, dollar_vol, bars.
    """
    best = (
        home.filter(F.col("bars") > MIN_BARS)
        .groupBy(key)
        .agg(
            F.max_by("symbol", F.struct("dollar_vol", "symbol")).alias("_s"),
            F.max("dollar_vol").alias("_v"),
        )
    )
    j = current.join(best, key, "left")
    better = F.coalesce(
        F.col("_v") > F.greatest(F.coalesce("dollar_vol", F.lit(0.0)) * HOME_FACTOR, F.lit(1.0)),
        F.lit(False),
    )
    return j.select(
        key, F.when(better, F.col("_s")).otherwise(F.col("symbol")).alias("symbol"),
        F.when(better, F.col("_v")).otherwise(F.col("dollar_vol")).alias("dollar_vol"),
        better.alias("moved"),
    )


def apply_overrides(chosen: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """C20: overrides come last; a blank symbol excludes the entity."""
    o = overrides.select(
        F.trim(F.col(key)).alias("_k"), F.col("symbol").alias("_o"), F.lit(True).alias("_hit")
    )
    j = chosen.join(o, F.trim(chosen[key]) == F.col("_k"), "left")
    return j.select(
        *[c for c in chosen.columns if c != "symbol"],
        F.when(F.col("_hit"), present_or_null(F.col("_o"))).otherwise(F.col("symbol")).alias("symbol"),
        F.coalesce("_hit", F.lit(False)).alias("overridden"),
    )


def unused_overrides(chosen: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """C20: overrides that name no entity."""
    return overrides.withColumn(key, F.trim(F.col(key))).join(
        chosen.select(F.trim(F.col(key)).alias(key)).distinct(), key, "left_anti"
    )


def double_claims(chosen: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols claimed by more than one entity, as rows of the claiming entities."""
    twice = (
        chosen.filter(F.col(symbol).isNotNull()).groupBy(symbol)
        .agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")
    )
    return chosen.join(twice, symbol)


def candidate_waves(
    candidates: DataFrame, firm: str, order: list[Column], hit: str,
    caps: tuple[int, ...] = CANDIDATE_CAPS,
) -> DataFrame:
    """Home-first position of each candidate and the wave that would look it up.

    A rank replaces repeated scans. The last wave has no cap, so nothing is left out. Returns one
    row per firm: candidates, wave that resolved it (null when none did).
    """
    pos = positions(candidates, order, [firm], "_pos")
    wave = F.lit(len(caps) + 1)
    for i, cap in reversed(list(enumerate(caps, start=1))):
        wave = F.when(F.col("_pos") <= cap, i).otherwise(wave)
    return pos.withColumn("_wave", wave).groupBy(firm).agg(
        F.count(F.lit(1)).alias("candidates"), F.max("_wave").alias("waves"),
        F.min(F.when(F.col(hit), F.col("_wave"))).alias("resolved_wave"),
    )


def fallback_lookup(rows: DataFrame, table: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The first key that is found decides all fields together."""
    out, found = rows, []
    for i, k in enumerate(keys):
        t = table.select(
            F.col("gid").alias(f"_g{i}"), F.struct(*fields).alias(f"_f{i}")
        )
        out = out.withColumn(f"_k{i}", F.when(F.col(k) != "", F.col(k))).join(
            t, F.col(f"_k{i}") == F.col(f"_g{i}"), "left"
        )
        found.append(F.col(f"_f{i}"))
    out = out.withColumn("_f", F.coalesce(*found))
    return out.select(*rows.columns, *[F.col(f"_f.{f}").alias(f) for f in fields])


def candidate_bands(candidates: DataFrame, key: str) -> DataFrame:
    """E5: keys with 1, 2 to 3 and more candidates."""
    n = F.col("_n")
    band = F.when(n == 1, "1").when(n <= 3, "2-3").otherwise("more than 3")
    per = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("firms"))


def survival_by_country(firms: DataFrame, codes: DataFrame, key: str, country: str) -> DataFrame:
    """Firms, identifiers and usable codes by country: where the narrowing loses firms.

    ``firms``: key, country, lei, cik. ``codes``: key, good (boolean), one row per code.
    """
    per = codes.groupBy(key).agg(F.max("good").alias("_good"))
    j = firms.join(per, key, "left")
    good = F.coalesce("_good", F.lit(False))
    return j.groupBy(F.col(country).alias("country")).agg(
        F.count(F.lit(1)).alias("firms"), F.count_if(has_lei(F.col("lei"))).alias("with_lei"),
        F.count_if(~blank(F.col("cik"))).alias("with_cik"), F.count("_good").alias("in_list"),
        F.count_if(good).alias("with_code"), ratio(100.0 * F.count_if(good), F.count(F.lit(1))).alias("pct_code"),
    )


def prefix_counts(codes: DataFrame, code: str, wanted: DataFrame) -> DataFrame:
    """Codes by country prefix, with zeros for wanted prefixes that never occur."""
    n = codes.groupBy(F.substring(code, 1, 2).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(n, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


def results_by(chosen: DataFrame, keys: list[Column], assets: Column) -> DataFrame:
    """Firms, listed firms and the assets of the listed, by country and route."""
    listed = F.col("symbol").isNotNull()
    return chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("firms"), F.count("symbol").alias("listed"),
        F.coalesce(F.sum(F.when(listed, assets)), F.lit(0)).cast("long").alias("assets_listed"),
    )


def currency_pairs(currencies: DataFrame, bases: tuple[str, ...] = ("USD", "EUR")) -> DataFrame:
    """Major unit and divisor of each currency, and its pair with every other base."""
    major, divisor = F.col("code"), F.lit(1.0)
    for minor, big, d in MINOR_UNITS:
        major = F.when(F.col("code") == minor, big).otherwise(major)
        divisor = F.when(F.col("code") == minor, d).otherwise(divisor)
    base = F.explode(F.array(*[F.lit(b) for b in bases])).alias("base")
    x = currencies.select("code", major.alias("major"), divisor.alias("divisor"), base)
    return x.filter("major <> base").select("code", "major", "divisor", F.concat("major", "base").alias("pair"))


def register_checks(firms: DataFrame, register: DataFrame) -> DataFrame:
    """Identifiers found in the register, and found ones that are not active or not general.

    ``register``: lei, state, category.
    """
    reg = register.select("lei", F.col("state").alias("_st"), F.col("category").alias("_ca"), F.lit(1).alias("_f"))
    return firms.filter(has_lei(F.col("lei"))).join(reg, "lei", "left").agg(
        F.count(F.lit(1)).alias("entities"), F.count("_f").alias("found"),
        F.count_if(F.col("_f").isNull()).alias("absent"), F.count_if(F.col("_st") != "ACTIVE").alias("not_active"),
        F.count_if(F.col("_ca") != "GENERAL").alias("not_general"),
    )
