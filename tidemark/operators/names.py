"""Search by name: every pair of similar names, found through an inverted index of letter pairs.

Names within a share of edits have letter pairs in common: with d edits, names of lengths n <= m share at least m + 1 - 2 d of the pairs of
their padded forms. Each name enters the index with so many of its rarest pairs that similar names must meet there several
times, and only those that do are compared. No name is paired with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import MIN_BARS, NAME_SIMILARITY
from tidemark.functions.identifiers import plain_name
from tidemark.session import materialise

HOT = 1000  # names under one pair of letters before it is split by length


def letter_pairs(name: Column) -> Column:
    """Neighbouring letters of ``#name#``; the second ``ab`` is another pair than the first."""
    padded = F.concat(F.lit("#"), name, F.lit("#"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda k: F.substring(padded, k, F.lit(2)))
    return F.transform(pairs, lambda p, k: F.concat(p, F.size(F.filter(F.slice(pairs, 1, k + 1), lambda other: other == p)).cast("string")))


def needed(length: Column, floor: float) -> Column:
    """Pairs that a name of this length shares with any similar one, at the least; it grows with the length."""
    return F.greatest(F.lit(1), F.ceil((2 * floor - 1) * length + 1 - 1e-9))


def meetings_asked(length: Column, floor: float) -> Column:
    """Pairs that similar names must share within their index entries."""
    return 1 + F.floor(needed(length, floor) / 3)


def index_entries(names: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """name, size, pair: the rarest pairs of every name. ``names``: name, size, pairs; ``pairs``: pair, often."""
    each = names.select("name", "size", F.explode("pairs").alias("pair")).join(pairs, "pair")
    sorted_pairs = each.groupBy("name", "size").agg(F.array_sort(F.collect_list(F.struct("often", "pair")))["pair"].alias("rare"))
    kept = F.col("size") + 1 - needed(F.col("size"), floor) + meetings_asked(F.col("size"), floor)
    return sorted_pairs.select("name", "size", F.explode(F.slice("rare", 1, kept.cast("int"))).alias("pair"))


def similar_names(left: DataFrame, right: DataFrame, floor: float = NAME_SIMILARITY) -> DataFrame:
    """x, y, score: all pairs of distinct plain names (``left``: x, ``right``: y) with 1 - edits / longer length >= floor > 0.5.

    A pair of letters that many names of ``right`` hold is split by their lengths; a name asks under each length that can be
    similar to its own. Null names match nothing; empty ones match each other.
    """

    def prepared(names: DataFrame, name: str) -> DataFrame:
        own = names.select(F.col(name).alias("name")).filter(F.col(name).isNotNull()).distinct()
        return materialise(own.select("name", F.length("name").alias("size"), letter_pairs(F.col("name")).alias("pairs")))

    a, b = prepared(left, "x"), prepared(right, "y")
    pairs = materialise(
        a.select("pairs").union(b.select("pairs")).select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("often"))
    )
    entries = materialise(index_entries(b, pairs, floor).withColumnsRenamed({"name": "y", "size": "m"}))
    hot = entries.groupBy("pair").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > HOT).select("pair", F.lit(True).alias("hot"))
    held = entries.join(hot, "pair", "left").select("pair", F.when(F.col("hot"), F.col("m")).otherwise(-1).alias("at"), "y", "m")
    n = F.col("n")
    lengths = F.sequence(F.ceil(n * floor - 1e-9).cast("int"), F.floor(n / floor + 1e-9).cast("int"))
    asked = index_entries(a, pairs, floor).withColumnsRenamed({"name": "x", "size": "n"}).join(hot, "pair", "left").select(
        "pair", F.explode(F.when(F.col("hot"), lengths).otherwise(F.array(F.lit(-1)))).alias("at"), "x", "n"
    )
    longer = F.greatest("n", "m")
    fits = F.least("n", "m") >= longer * floor - 1e-9
    met = asked.join(held, ["pair", "at"]).filter(fits).groupBy("x", "n", "y", "m").agg(F.count(F.lit(1)).alias("common"))
    enough = F.col("common") >= F.least(meetings_asked(F.col("n"), floor), meetings_asked(F.col("m"), floor))
    score = F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein("x", "y") / longer)
    return met.filter(enough).select("x", "y", score.alias("score")).filter(F.col("score") >= floor)


def search_by_name(entities: DataFrame, lines: DataFrame, floor: float = NAME_SIMILARITY) -> DataFrame:
    """C22 from its search on: entity, symbol, score, dollar_vol of the best line of a similar name by (score, traded value, symbol).

    ``entities``: entity, name. ``lines``: symbol, other, bars, dollar_vol; lines of too few bars do not count. Lines of one name are reduced
    to the best before names meet, and entities of one name are met once.
    """
    named = entities.select("entity", plain_name(F.col("name")).alias("x"))
    of_name = materialise(
        lines.filter(F.col("bars") > MIN_BARS).select(plain_name(F.col("other")).alias("y"), "symbol", "dollar_vol")
        .groupBy("y").agg(F.max(F.struct("dollar_vol", "symbol")).alias("line"))
    )
    best = (
        similar_names(named, of_name, floor).join(of_name, "y")
        .groupBy("x").agg(F.max(F.struct("score", "line.dollar_vol", "line.symbol")).alias("b"))
    )
    return named.join(best, "x").select("entity", "b.symbol", "b.score", "b.dollar_vol")
