"""URL filters: a path-template tree per host, learned from labelled urls.

Urls are reduced to (host, shapes of the path segments) with counts, so that everything after the first aggregation
is small. The tree of a host is walked from the root. At every node
* a segment that varies by its form (digits, long hex) is already a wildcard: its shape;
* a child seen on few pages under a node with many children becomes ``*``;
* labelled children whose share of blocked pages is indistinguishable (Hoeffding bound) from that of their labelled
  siblings merge into ``~``.
A template is rejected when its smoothed share of blocked pages, (blocked + 1) / (labelled + 2), reaches 0.8: without
labels the benefit of the doubt holds.

Defined cases: host and path of a null url, or one without ``://``, are empty. Segments beyond ``DEPTH`` share one tail
wildcard. Repeated rows count each time. An empty table gives an empty result. Columns beside page_id and url are ignored.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import LOWER, UPPER
from tidemark.session import materialise

DEPTH = 8
MANY_CHILDREN = 20
FEW_PAGES = 3
DELTA = 0.05
BOUND = math.sqrt(0.5 * math.log(2 / DELTA))

# Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def by_length(rules) -> list[tuple[str, str, str]]:
    """Longest host and path first; of equal length, as listed."""
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def first_fit(host: Column, path: Column, rules, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(by_length(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    return F.when(segment.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{id}")).otherwise(
        F.regexp_replace(segment, "[0-9]+", "#")
    )


def shapes(path: Column) -> Column:
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shape)
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH), F.array(F.lit("**")))).otherwise(
        segments
    )


def templates(urls: DataFrame) -> DataFrame:
    """host, segs, template, rejected. ``urls``: host, segs, label (``block``, ``allow`` or null), one row per page."""
    tree = materialise(
        urls.groupBy("host", "segs").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("label").alias("labelled"),
            F.count(F.when(F.col("label") == "block", 1)).alias("blocked"),
        ).withColumn("template", F.lit(""))
    )
    depth = tree.agg(F.max(F.size("segs"))).first()[0] or 0
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    for k in range(depth):
        level = tree.withColumn("child", F.get("segs", F.lit(k)))
        children = level.filter(F.col("child").isNotNull()).groupBy("host", "template", "child").agg(*sums)
        nodes = children.groupBy("host", "template").agg(
            F.count(F.lit(1)).alias("children"),
            F.sum("labelled").alias("all_labelled"),
            F.sum("blocked").alias("all_blocked"),
        )
        rest, hits = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") - F.col("blocked")
        near = F.abs(F.col("blocked") / F.nullif("labelled", F.lit(0)) - hits / F.nullif(rest, F.lit(0))) < BOUND * (
            1 / F.sqrt("labelled") + 1 / F.sqrt(rest)
        )
        like_siblings = (F.col("labelled") > 0) & (rest > 0) & F.coalesce(near, F.lit(False))
        steps = children.join(nodes, ["host", "template"]).select(
            "host",
            "template",
            "child",
            F.when((F.col("children") >= MANY_CHILDREN) & (F.col("n") < FEW_PAGES), F.lit("*"))
            .when(like_siblings, F.lit("~"))
            .otherwise(F.col("child"))
            .alias("step"),
        )
        tree = materialise(
            level.join(steps, ["host", "template", "child"], "left")
            .withColumn("template", F.concat("template", F.coalesce(F.concat(F.lit("/"), "step"), F.lit(""))))
            .drop("child", "step")
        )
    verdicts = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")).select(
        "host", "template", ((F.col("b") + 1) * 10 >= (F.col("l") + 2) * 8).alias("rejected")
    )
    return tree.join(verdicts, ["host", "template"]).select("host", "segs", "template", "rejected")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every page; pages that a rule fits are the labelled ones."""
    url = F.col("url").cast("string")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumns(
        {
            "rule": first_fit(host, path, rules, lambda r: r[1] + r[2]),
            "label": first_fit(host, path, rules, lambda r: r[0]),
            "segs": shapes(path),
        }
    )
    learned = materialise(templates(judged))
    # a host or shape with a third of all pages: the pages' side of this join can be split
    return judged.join(learned, ["host", "segs"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
    )


def _case(value) -> str:
    arms = " ".join(
        f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{value(r)}'"
        for r in by_length(RULES)
    )
    return f"CASE {arms} END"


def _level(k: int) -> str:
    return f"""
l{k} AS MATERIALIZED (SELECT *, segs[{k + 1}] AS child FROM t{k}),
c{k} AS MATERIALIZED (SELECT host, template, child, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
  FROM l{k} WHERE child IS NOT NULL GROUP BY ALL),
d{k} AS MATERIALIZED (SELECT host, template, count(*) AS children, sum(labelled) AS al, sum(blocked) AS ab FROM c{k} GROUP BY ALL),
s{k} AS MATERIALIZED (SELECT c.host, c.template, child,
  CASE WHEN children >= {MANY_CHILDREN} AND n < {FEW_PAGES} THEN '*'
       WHEN labelled > 0 AND al > labelled AND abs(blocked::DOUBLE / labelled - (ab - blocked)::DOUBLE / (al - labelled))
            < {BOUND!r} * (1 / sqrt(labelled) + 1 / sqrt(al - labelled)) THEN '~' ELSE child END AS step
  FROM c{k} c JOIN d{k} d ON c.host = d.host AND c.template = d.template),
t{k + 1} AS MATERIALIZED (SELECT l.host, segs, n, labelled, blocked, l.template || coalesce('/' || step, '') AS template
  FROM l{k} l LEFT JOIN s{k} s ON l.host = s.host AND l.template = s.template AND l.child = s.child),"""


SQL = f"""
WITH u AS (SELECT page_id, contains(url, '://') AS ok, url FROM pages),
h AS (SELECT page_id,
  translate(CASE WHEN ok THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, '{UPPER}', '{LOWER}') AS host,
  CASE WHEN ok THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
g AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
  list_transform(list_filter(string_split(coalesce(path, ''), '/'), lambda s: s <> ''),
    lambda s: CASE WHEN regexp_full_match(s, '[0-9a-fA-F-]{{16,}}') THEN '{{id}}' ELSE regexp_replace(s, '[0-9]+', '#', 'g') END) AS all_segs
  FROM h),
j AS MATERIALIZED (SELECT page_id, host, path, {_case(lambda r: r[1] + r[2])} AS rule, {_case(lambda r: r[0])} AS label,
  CASE WHEN len(all_segs) > {DEPTH} THEN list_append(all_segs[1:{DEPTH}], '**') ELSE all_segs END AS segs FROM g),
t0 AS MATERIALIZED (SELECT host, segs, count(*) AS n, count(label) AS labelled, count(*) FILTER (WHERE label = 'block') AS blocked,
  '' AS template FROM j GROUP BY host, segs),{"".join(_level(k) for k in range(DEPTH + 1))}
v AS (SELECT host, template, (sum(blocked) + 1) * 10 >= (sum(labelled) + 2) * 8 AS rejected FROM t{DEPTH + 1} GROUP BY host, template)
SELECT page_id, j.host, path, rule,
  coalesce(label, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict, t.template
FROM j JOIN t{DEPTH + 1} t ON j.host = t.host AND j.segs = t.segs JOIN v ON v.host = t.host AND v.template = t.template
"""
