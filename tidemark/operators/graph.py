"""Walks on a weighted ownership graph, level by level.

Each level is one join with the edge table and one aggregation. The result of a level is written
to the shared folder, so lineage stays short and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.vintage import union_all
from tidemark.session import counted, materialise


def fill_blanks(edges: DataFrame, rule: str) -> DataFrame:
    """D3: shares for blank edges. ``zero`` gives 0; ``impute`` splits what the known leave.

    Per-subject sums are an aggregate joined back, not a window: a subject with a third of all
    edges is summed map-side and its rows stay spread.
    """
    if rule == "zero":
        return edges.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    if rule != "impute":
        raise ValueError(f"unknown blank rule {rule}")
    known = edges.groupBy("subject").agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_known"),
        F.count_if(F.col("weight").isNull()).alias("_blank"),
    ).filter("_blank > 0")
    fill = F.greatest(F.lit(0.0), 1.0 - F.col("_known")) / F.col("_blank")
    return (
        edges.join(known, "subject", "left")
        .withColumn("weight", F.coalesce("weight", fill, F.lit(0.0)))
        .drop("_known", "_blank")
    )


def peeled(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges on or between cycles: those without a way in or a way out are peeled off until none is left to peel."""

    def peel(e: DataFrame) -> DataFrame:
        ins = e.select(F.col("party").alias("subject")).distinct()
        outs = e.select(F.col("subject").alias("party")).distinct()
        return e.join(ins, "subject", "left_semi").join(outs, "party", "left_semi").select("subject", "party")

    left, n = counted(peel(edges))
    while n:
        smaller, m = counted(peel(peel(left)))
        if m == n:
            break
        left, n = smaller, m
    return left, n


def colours(edges: DataFrame) -> DataFrame:
    """node, colour: the largest node that reaches it, or itself. ``edges``: subject, party."""
    ends = edges.select(F.col("subject").alias("node")).union(edges.select(F.col("party").alias("node"))).distinct()
    labels, changed = materialise(ends.select("node", F.col("node").alias("colour"))), True
    while changed:
        met = labels.join(edges, labels["node"] == edges["subject"]).groupBy(F.col("party").alias("node")).agg(F.max("colour").alias("met"))
        seen = Observation()
        higher = labels.join(met, "node", "left").select("node", F.greatest("colour", F.coalesce("met", "colour")).alias("next"), "colour")
        labels = materialise(higher.observe(seen, F.count_if(F.col("next") != F.col("colour")).alias("n")).select("node", F.col("next").alias("colour")))
        changed = bool(seen.get["n"])
    return labels


def strong_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """node, comp of the nodes on cycles, comp the largest node of the component, and their number. ``edges``: subject, party.

    Peeling, then forward and backward by colours: of the nodes with one colour, those that reach the node it is named after are one
    component. They leave, edges between colours leave, and what is left is peeled and coloured again.
    """
    # a loop of one edge never lies on a simple path
    left, n = peeled(edges.select("subject", "party").filter("subject <> party").distinct())
    found = []
    while n:
        labels = colours(left)
        of = lambda end: labels.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        own = left.join(of("subject"), "subject").join(of("party"), "party").filter("subject_colour = party_colour")
        own = materialise(own.select("subject", "party", F.col("subject_colour").alias("comp")))
        front, m = counted(labels.filter("node = colour").select("node", F.col("colour").alias("comp")))
        taken = Pieces()
        while m:
            taken.add(front, m)
            back = own.join(front.select(F.col("node").alias("party")), "party").select(F.col("subject").alias("node"), "comp").distinct()
            front, m = counted(back.join(taken.rows(), ["node", "comp"], "left_anti"))
        members = materialise(taken.rows())
        sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("comp")
        found.append(members.join(sizes, "comp").select("node", "comp"))
        gone = members.select("node")
        rest = own.join(gone.withColumnRenamed("node", "subject"), "subject", "left_anti").join(
            gone.withColumnRenamed("node", "party"), "party", "left_anti"
        )
        left, n = peeled(rest.select("subject", "party"))
    if not found:
        return edges.select(F.col("subject").alias("node"), F.col("party").alias("comp")).limit(0), 0
    return counted(union_all(*found))


def ways_through(inner: DataFrame, entries: DataFrame, cap: int | None) -> DataFrame:
    """entry, node, weight, steps: the simple paths inside a component from each entry to each node, summed (per length, with a cap).

    A row is a set of nodes met and the last of them, so a component of m nodes has at most m * 2 ** m rows an entry, whatever
    the number of sources. ``inner``: subject, party, share; ``entries``: entry.
    """
    front = entries.select("entry", F.col("entry").alias("node"), F.array("entry").alias("seen"), F.lit(1.0).alias("weight"))
    front, n = counted(front)
    ways, level = [], 0
    while n and (cap is None or level < cap):
        ways.append(front.groupBy("entry", "node").agg(F.sum("weight").alias("weight")).withColumn("steps", F.lit(level)))
        level += 1
        step = (
            front.join(inner, front["node"] == inner["subject"]).filter(~F.array_contains("seen", F.col("party")))
            # the set is sorted: its order does not matter for what may follow
            .select("entry", F.col("party").alias("node"), F.array_sort(F.array_append("seen", F.col("party"))).alias("seen"), F.expr("weight * share").alias("weight"))
            .groupBy("entry", "node", "seen").agg(F.sum("weight").alias("weight"))
        )
        front, n = counted(step)
    every = union_all(*ways)
    return every if cap is not None else every.groupBy("entry", "node").agg(F.sum("weight").alias("weight")).withColumn("steps", F.lit(0))


def condensed(flagged: DataFrame, comps: DataFrame, walkers: DataFrame, cap: int | None) -> DataFrame:
    """subject, party, share, stop, steps: edges without cycles that stand for all simple paths.

    A path that leaves a component never comes back, so from each node where paths enter one, the simple paths inside are summed
    once, and the edges that leave it start at that entry.
    """
    of = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
    placed = materialise(flagged.join(of("subject"), "subject", "left").join(of("party"), "party", "left"))
    inside = F.col("subject_comp").eqNullSafe(F.col("party_comp")) & F.col("subject_comp").isNotNull() & ~F.col("stop")
    outer, inner = placed.filter(~inside), materialise(placed.filter(inside).select("subject", "party", "share"))
    entries = outer.filter("party_comp IS NOT NULL AND NOT stop").select(F.col("party").alias("entry")).union(
        walkers.select(F.col("source").alias("entry")).join(comps.select(F.col("node").alias("entry")), "entry", "left_semi")
    )
    ways = materialise(ways_through(inner, entries.distinct(), cap))
    leaving = outer.filter("subject_comp IS NOT NULL").select(F.col("subject").alias("node"), "party", "share", "stop")
    through = ways.join(leaving, "node").groupBy(F.col("entry").alias("subject"), "party", "stop", F.expr("steps + 1").alias("steps")).agg(
        F.sum(F.expr("weight * share")).alias("share")
    )
    plain = outer.filter("subject_comp IS NULL").select("subject", "party", "share", "stop", F.lit(1).alias("steps"))
    return materialise(plain.unionByName(through))


def nearest_listed(
    edges: DataFrame, listed: DataFrame, sources: DataFrame, cap: int | None = None
) -> DataFrame:
    """Nearest listed parents of each source with the summed product of shares.

    The sum is over all simple paths (of at most ``cap`` edges, if it is given); a path ends at its first
    listed entity, and the walk at its own end, when no path can go on.
    Cycles are walked once, before and apart from the sources: strongly connected components are condensed to the edges that
    leave them (``condensed``). What is left has no cycle, so paths that meet at a node are one row (source, node, weight) and no row
    remembers where it was. Rows of weight 0 stay, since a holder of nothing is still a holder.

    ``edges``: subject, party, weight (no nulls; parallel edges add). ``listed``: entity.
    ``sources``: entity. Returns source, parent, weight.
    """
    marked = listed.select(F.col("entity").alias("party"), F.lit(True).alias("stop")).distinct()
    summed = edges.groupBy("subject", "party").agg(F.sum("weight").alias("share"))
    flagged = summed.join(marked, "party", "left").withColumn("stop", F.coalesce("stop", F.lit(False)))
    flagged = materialise(flagged.select("subject", "party", "share", "stop").filter("stop OR subject <> party"))
    walkers = sources.select(F.col("entity").alias("source")).distinct().join(
        listed.select(F.col("entity").alias("source")), "source", "left_anti"
    )
    comps, n_comps = strong_components(flagged.filter("not stop"))
    hops = condensed(flagged, comps, walkers, cap) if n_comps else flagged.withColumn("steps", F.lit(1))
    front = walkers.select("source", F.col("source").alias("subject"), F.lit(1.0).alias("weight"), F.lit(0).alias("steps"))
    hits, level = [], 0
    while cap is None or level < cap:
        level += 1
        # lengths matter, and part the rows, only under a cap
        length = F.lit(0) if cap is None else front["steps"] + hops["steps"]
        step = (
            front.join(hops, "subject")
            .select("source", F.col("party").alias("node"), "stop", length.alias("steps"), (F.col("weight") * F.col("share")).alias("weight"))
            .filter(F.lit(True) if cap is None else F.col("steps") <= cap)
            .groupBy("source", "node", "stop", "steps").agg(F.sum("weight").alias("weight"))
        )
        step, n = counted(step)
        if n == 0:
            break
        hits.append(step.filter("stop").select("source", "node", "weight"))
        front = step.filter("not stop").select("source", F.col("node").alias("subject"), "weight", "steps")
    if not hits:
        return walkers.select(
            "source", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("weight")
        ).filter("parent is not null")
    return (
        union_all(*hits)
        .groupBy("source", F.col("node").alias("parent"))
        .agg(F.sum("weight").alias("weight"))
    )


def holders(
    edges: DataFrame, listed: DataFrame, sources: DataFrame, cap: int | None = None
) -> DataFrame:
    """Listed holders of each owner: a listed owner holds for itself, others look through."""
    sources = materialise(sources.select("entity").distinct())
    own = sources.select(F.col("entity").alias("source")).join(
        listed.select(F.col("entity").alias("source")).distinct(), "source", "left_semi"
    )
    itself = own.select("source", F.col("source").alias("parent"), F.lit(1.0).alias("weight"))
    return nearest_listed(edges, listed, sources, cap).unionByName(itself)


class Pieces:
    """A growing set of rows in few written pieces: two of similar size become one, so a row is rewritten a
    logarithmic number of times and a level reads a logarithmic number of tables."""

    def __init__(self):
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, rows: DataFrame, n: int) -> None:
        self.parts.append((rows, n))
        while len(self.parts) > 1 and self.parts[-2][1] < 2 * self.parts[-1][1]:
            (a, _), (b, _) = self.parts[-2:]
            self.parts[-2:] = [counted(union_all(a, b))]

    def rows(self) -> DataFrame:
        return union_all(*[p for p, _ in self.parts])


def closure(
    edges: DataFrame, sources: DataFrame, cap: int | None = None
) -> DataFrame:
    """Every node reachable upward from each source (``cap`` levels, or all).

    Semi-naive: a level joins only the pairs found in the level before and drops known pairs.
    Returns source, node.
    """
    links = materialise(edges.select("subject", "party").distinct())
    front = sources.select(
        F.col("entity").alias("source"), F.col("entity").alias("subject")
    ).distinct()
    found, level = Pieces(), 0
    while cap is None or level < cap:
        step = front.join(links, "subject").select("source", F.col("party").alias("node")).distinct()
        if found.parts:
            step = step.join(found.rows(), ["source", "node"], "left_anti")
        step, n = counted(step)
        if n == 0:
            break
        found.add(step, n)
        front = step.select("source", F.col("node").alias("subject"))
        level += 1
    if not found.parts:
        return front.select("source", F.col("subject").alias("node")).limit(0)
    return found.rows()


def listed_ancestors(
    edges: DataFrame, listed: DataFrame, sources: DataFrame, cap: int | None = None
) -> DataFrame:
    """Every listed entity above a source, without stopping (within ``cap`` levels, if it is given)."""
    return closure(edges, sources, cap).join(
        listed.select(F.col("entity").alias("node")).distinct(), "node", "left_semi"
    ).select("source", F.col("node").alias("parent"))


def tainted(uses: DataFrame, origin: DataFrame) -> DataFrame:
    """Items that depend, at any distance, on an item of ``origin``.

    ``uses``: item, upstream. One set grows by levels; no pair table is needed.
    """
    found = Pieces()
    front, n = counted(origin.select("item").distinct())
    found.add(front, n)
    while n:
        step = (
            uses.join(front.select(F.col("item").alias("upstream")), "upstream", "left_semi")
            .select("item").distinct()
            .join(found.rows(), "item", "left_anti")
        )
        front, n = counted(step)
        found.add(front, n)
    return found.rows()


def consolidation_flags(relations: DataFrame, panel: DataFrame, names: DataFrame) -> DataFrame:
    """Active, published consolidation links whose child is in the panel.

    ``relations``: child, parent, kind, status, state. ``panel``: lei. ``names``: lei, name.
    """
    kept = relations.filter(
        (F.col("status") == "ACTIVE") & (F.col("state") == "PUBLISHED")
        & F.col("kind").isin("IS_ULTIMATELY_CONSOLIDATED_BY", "IS_DIRECTLY_CONSOLIDATED_BY")
    )
    inside = panel.select(F.col("lei").alias("parent"), F.lit(True).alias("_in")).distinct()
    return (
        kept.join(panel.select(F.col("lei").alias("child")).distinct(), "child", "left_semi")
        .join(inside, "parent", "left")
        .join(names.select(F.col("lei").alias("parent"), F.col("name").alias("parent_name")), "parent", "left")
        .select("child", "parent", "parent_name", F.coalesce("_in", F.lit(False)).alias("parent_in_panel"))
    )
