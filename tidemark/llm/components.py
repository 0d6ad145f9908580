"""Connected components of a table of links, labels spreading with pointer jumps; every round is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.session import materialise, shared_dir


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node of its component, for every node that has a link. ``edges``: a, b."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        met = labels.join(near, "node").select("node", "comp", F.least("comp", "other").alias("met"))
        up = labels.select(F.col("node").alias("met"), F.col("comp").alias("up"))
        jumped = met.join(up, "met", "left").select("node", "comp", F.least("met", F.coalesce("up", "met")).alias("next"))
        labels, changed = written(jumped)
        if not changed:
            return labels


def written(jumped: DataFrame) -> tuple[DataFrame, bool]:
    """The next labels, and whether any differs, observed during the same write."""
    seen, path = Observation(), f"{shared_dir(jumped.sparkSession)}/tidemark/{uuid.uuid4().hex}"
    jumped.observe(seen, F.count_if(F.col("next") < F.col("comp")).alias("n")).select(
        "node", F.col("next").alias("comp")
    ).write.parquet(path)
    return jumped.sparkSession.read.schema("node long, comp long").parquet(path), bool(seen.get["n"])
