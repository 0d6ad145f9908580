"""Views on the driver tables that stand for the inputs of the operators.

Each view has a Spark form and a SQL form with the same formula and maps all rows of its tables
onto releases, arms, sectors, sheets or membership changes. Misses are made by renamed or null keys, not by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cleaning import half_up

OLD, NEW = "1999-01", "2002-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# lines that a task holds after they were laid by subject
LINES_A_TASK = 150_000


def lines_by_subject(spark: SparkSession, sf: str, *more: Column | str) -> DataFrame:
    """Lines with the key of an edge (subject, s, p) and l_quantity, shuffled once by subject; a part of the layout is bounded."""
    lines = table(spark, sf, "lineitem").filter("l_partkey is not null")
    parts = lines.count() // LINES_A_TASK + 1
    s = F.col("l_partkey")
    return lines.select(
        F.concat(F.lit("P"), s).alias("subject"), s.alias("s"), F.col("l_suppkey").alias("p"), "l_quantity", *more
    ).repartition(parts, "subject")


def lines_by_part(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    """Lines of a part with both keys (u, o), l_quantity and ``more``, shuffled once by part; a part of the layout is bounded."""
    lines = table(spark, sf, "lineitem").filter("l_partkey is not null")
    parts = lines.count() // LINES_A_TASK + 1
    return lines.select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("o"), "l_quantity", *more).repartition(parts, "u")


def twice(rows: DataFrame) -> DataFrame:
    """Rows with ord 1, and those marked ``again`` a second time with another share, the other flag and ord 0."""
    ords = F.when(F.col("again"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
    first = F.col("ord") == 1
    return rows.select("*", F.explode(ords).alias("ord")).select(
        *[c for c in rows.columns if c not in ("share", "imputed", "again")],
        F.when(first, F.col("share")).otherwise(F.coalesce(F.col("share") / 2, F.lit(1.0))).alias("share"),
        F.when(first, F.col("imputed")).otherwise(~F.col("imputed")).alias("imputed"),
        "ord",
    )


# ---------------------------------------------------------------- ownership edges, two releases
EDGES_SQL = """
line_cut AS (
  SELECT l_partkey AS s, l_suppkey AS p, l_quantity AS q,
         l_shipdate < TIMESTAMP '1999-01-01' OR l_partkey % 3 <> 0 OR (l_partkey * 7 + l_suppkey) % 29 = 0 AS before,
         (l_partkey * 7 + l_suppkey) % 29 <> 0 AS carried
  FROM lineitem),
edge_qty AS (
  SELECT s, p, sum(q) FILTER (WHERE before) AS q_old, sum(q) FILTER (WHERE carried) AS q_new
  FROM line_cut GROUP BY s, p),
edge_tot AS (SELECT s, sum(q_old) AS t_old, sum(q_new) AS t_new FROM edge_qty GROUP BY s),
edge_both AS (
  SELECT e.s, e.p, q_old, q_new,
         CASE WHEN (e.s * 31 + e.p) % 13 <> 0
              THEN floor(100 * q_old / t_old * 100.0 + 0.5) / 100.0 END AS share_old,
         floor(100 * q_new / t_new * 10.0 + 0.5) / 10.0 AS share_new,
         ((e.s * 31 + e.p) % 13 = 0 AND (e.s + e.p) % 4 <> 0) OR (e.s * 17 + e.p) % 11 = 0 AS imputed
  FROM edge_qty e JOIN edge_tot t ON e.s = t.s),
edge_old AS (SELECT 'P' || s AS subject, 'S' || p AS party, share_old AS share
             FROM edge_both WHERE q_old IS NOT NULL),
edge_new AS (SELECT 'P' || s AS subject, 'S' || p AS party, share_new AS share, imputed
             FROM edge_both WHERE q_new IS NOT NULL),
entity_old AS (SELECT 'P' || p_partkey AS entity FROM part WHERE p_partkey % 19 <> 7
               UNION ALL SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 23 <> 5),
entity_new AS (SELECT 'P' || p_partkey AS entity FROM part WHERE p_partkey % 37 <> 4
               UNION ALL SELECT 'S' || s_suppkey FROM supplier),
dedup_map AS (SELECT 'S' || s_suppkey AS entity FROM supplier WHERE s_suppkey % 17 = 3)
"""


def _edge_both(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("s"), F.col("p")
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    carried = (s * 7 + p) % 29 != 0
    before = early | (s % 3 != 0) | ~carried
    qty = (
        lines_by_subject(spark, sf, "l_shipdate")
        .groupBy("subject", "s", "p")
        .agg(
            F.sum(F.when(before, F.col("l_quantity"))).alias("q_old"),
            F.sum(F.when(carried, F.col("l_quantity"))).alias("q_new"),
        )
    )
    total = Window.partitionBy("subject")
    e = qty.select("*", F.sum("q_old").over(total).alias("t_old"), F.sum("q_new").over(total).alias("t_new"))
    return e.select(
        "subject",
        F.concat(F.lit("S"), p).alias("party"),
        "q_old",
        "q_new",
        F.when(
            (s * 31 + p) % 13 != 0, half_up(100 * F.col("q_old") / F.col("t_old"), 2)
        ).alias("share_old"),
        half_up(100 * F.col("q_new") / F.col("t_new"), 1).alias("share_new"),
        (((s * 31 + p) % 13 == 0) & ((s + p) % 4 != 0) | ((s * 17 + p) % 11 == 0)).alias("imputed"),
    )


def edges(spark: SparkSession, sf: str, repeated: bool = False) -> DataFrame:
    """Edges of both releases as one long table: release, subject, party, share, imputed, ord.

    With ``repeated``, some keys come a second time with another share, the other flag and a lower ord: the later row wins.
    """
    both = _edge_both(spark, sf)
    rows = F.array(
        F.when(
            F.col("q_old").isNotNull(),
            F.struct(
                F.lit(OLD).alias("release"), F.col("share_old").alias("share"),
                F.lit(False).alias("imputed"),
            ),
        ),
        F.when(
            F.col("q_new").isNotNull(),
            F.struct(
                F.lit(NEW).alias("release"), F.col("share_new").alias("share"),
                F.col("imputed").alias("imputed"),
            ),
        ),
    )
    again = F.pmod(F.hash("subject", "party"), F.lit(5)) == 0
    long = (
        both.select("subject", "party", again.alias("again"), F.explode(rows).alias("r"))
        .filter(F.col("r").isNotNull())
        .select("r.release", "subject", "party", "r.share", "r.imputed", "again")
    )
    return twice(long) if repeated else long.drop("again").withColumn("ord", F.lit(0))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entity lists of both releases: release, entity."""
    p = table(spark, sf, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("entity"),
        (F.col("p_partkey") % 19 != 7).alias("o"),
        (F.col("p_partkey") % 37 != 4).alias("n"),
    )
    s = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("entity"),
        (F.col("s_suppkey") % 23 != 5).alias("o"),
        F.lit(True).alias("n"),
    )
    e = p.unionByName(s)
    return e.filter("o").select(F.lit(OLD).alias("release"), "entity").unionByName(
        e.filter("n").select(F.lit(NEW).alias("release"), "entity")
    )


def dedup_map(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .filter(F.col("s_suppkey") % 17 == 3)
        .select(F.concat(F.lit("S"), "s_suppkey").alias("entity"))
    )


# ---------------------------------------------------------------- quarterly releases, as many as the data has
# Release 3 lacks the ownership sheet; release 11 repeats release 10; the flag exists from 8 on.
SEQ_SQL = """
seq_line AS (
  SELECT l_partkey AS s, l_suppkey AS p, l_quantity AS q,
         greatest(1, (year(l_shipdate) - 1998) * 4 + quarter(l_shipdate) - 1) AS r0
  FROM lineitem),
seq_last AS (SELECT max(r0) AS n FROM seq_line),
seq_qty AS (SELECT s, p, r0, sum(q) AS q FROM seq_line GROUP BY s, p, r0),
seq_rel AS (
  SELECT s, p, rel, sum(q) AS q
  FROM (SELECT s, p, q, unnest(generate_series(r0, n)) AS rel FROM seq_qty, seq_last)
  GROUP BY s, p, rel),
seq_kept AS (SELECT * FROM seq_rel WHERE (s * 7 + p + rel) % 29 <> 0 AND rel <> 3 AND rel <> 11),
seq_copy AS (SELECT * FROM seq_kept UNION ALL
             SELECT s, p, 11 AS rel, q FROM seq_kept WHERE rel = 10),
release_seq AS (
  SELECT rel, 'P' || s AS subject, 'S' || p AS party,
         CASE WHEN rel >= 8 OR (s * 31 + p) % 13 <> 0
              THEN floor(100 * q / sum(q) OVER (PARTITION BY rel, s) * 10.0 + 0.5) / 10.0 END AS share,
         rel >= 8 AND (((s * 31 + p) % 13 = 0 AND (s + p) % 4 <> 0) OR (s * 17 + p) % 11 = 0) AS imputed
  FROM seq_copy),
seq_catalog AS (
  SELECT rel, strftime(TIMESTAMP '1998-04-01' + to_months(CAST(3 * rel AS INTEGER)), '%Y-%m') AS month,
         rel IN (SELECT rel FROM seq_copy) AS has_sheet, rel >= 8 AS has_flag
  FROM (SELECT DISTINCT rel FROM seq_rel))
"""


def quarter_of(d):
    """Number of the first release that holds a line of this date."""
    return F.greatest(F.lit(1), (F.year(d) - 1998) * 4 + F.quarter(d) - 1)


def last_release(spark: SparkSession, sf: str) -> int:
    """Number of releases; 0 for an empty table."""
    return table(spark, sf, "lineitem").agg(F.max(quarter_of(F.col("l_shipdate")))).first()[0] or 0


def release_seq(spark: SparkSession, sf: str, repeated: bool = False) -> DataFrame:
    """Edges of all releases: rel, subject, party, share, imputed, ord; some keys twice if ``repeated``.

    Quantities of all cuts are sums side by side. The lines are shuffled once, by subject, and stay there: sums, totals
    and whatever groups the edges by subject need no other shuffle.
    """
    s, p = F.col("s"), F.col("p")
    releases = range(1, max(1, last_release(spark, sf)) + 1)
    qty = (
        lines_by_subject(spark, sf, quarter_of(F.col("l_shipdate")).alias("r0"))
        .groupBy("subject", "s", "p")
        .agg(*[F.sum(F.when(F.col("r0") <= k, F.col("l_quantity"))).alias(f"q{k}") for k in releases])
    )
    here = lambda k: (s * 7 + p + k) % 29 != 0
    kept = qty.select("subject", "s", "p", *[F.when(here(k), F.col(f"q{k}")).alias(f"q{k}") for k in releases])
    total = Window.partitionBy("subject")
    kept = kept.select("*", *[F.sum(f"q{k}").over(total).alias(f"t{k}") for k in releases])
    source = {k: 10 if k == 11 else k for k in releases if k != 3}
    cells = F.array(
        *[F.struct(F.lit(k).alias("rel"), F.col(f"q{i}").alias("q"), F.col(f"t{i}").alias("t")) for k, i in source.items()]
    )
    e = kept.select("subject", F.concat(F.lit("S"), p).alias("party"), "s", "p", F.inline(cells)).filter("q is not null")
    blank = (s * 31 + p) % 13 == 0
    late = F.col("rel") >= 8
    return twice(
        e.select(
            "rel",
            "subject",
            "party",
            F.when(late | ~blank, half_up(100 * F.col("q") / F.col("t"), 1)).alias("share"),
            (late & (blank & ((s + p) % 4 != 0) | ((s * 17 + p) % 11 == 0))).alias("imputed"),
            (F.lit(repeated) & ((s + p) % 5 == 0)).alias("again"),
        )
    )


def seq_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The releases that the lines give, and whether each has ownership rows."""
    r0 = quarter_of(F.col("l_shipdate")).alias("r0")
    s, p = F.col("l_partkey"), F.col("l_suppkey")
    # an edge is in every release from its first line on, but for those that its key leaves out: of a key only that remainder counts
    held = table(spark, sf, "lineitem").select(r0, F.pmod(s * 7 + p, F.lit(29)).alias("m")).distinct()
    span = held.agg(F.min("r0").alias("lo"), F.max("r0").alias("n"))
    rels = span.select(F.explode(F.sequence("lo", "n")).alias("rel"))
    source = F.when(F.col("rel") == 11, 10).otherwise(F.col("rel"))
    sheets = (
        rels.filter("rel <> 3").withColumn("src", source)
        .join(F.broadcast(held), (F.col("r0") <= F.col("src")) & (F.pmod(F.col("m") + F.col("src"), F.lit(29)) != 0))
        .select("rel", F.lit(True).alias("has_sheet")).distinct()
    )
    rels = rels.join(sheets, "rel", "left")
    month = F.add_months(F.lit("1998-04-01").cast("date"), 3 * F.col("rel"))
    return rels.select(
        "rel",
        F.date_format(month, "yyyy-MM").alias("month"),
        F.coalesce("has_sheet", F.lit(False)).alias("has_sheet"),
        (F.col("rel") >= 8).alias("has_flag"),
    )


# ---------------------------------------------------------------- owner graph on suppliers
GRAPH_SQL = """
graph_edge AS (
  SELECT 'S' || s_suppkey AS subject, 'S' || CAST(s_suppkey // 3 AS BIGINT) AS party,
         CASE WHEN s_suppkey % 7 <> 0 THEN 0.6 END::DOUBLE AS weight, 1 AS ord
  FROM supplier WHERE s_suppkey > 0
  UNION ALL
  SELECT 'S' || s_suppkey, 'S' || CAST(s_suppkey // 5 AS BIGINT), 0.4::DOUBLE, 2
  FROM supplier WHERE s_suppkey > 0),
graph_listed AS (SELECT 'S' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 6000)
"""
CYCLE_SQL = GRAPH_SQL.replace(
    "graph_edge AS (",
    "graph_edge AS (\n  SELECT 'S' || s_suppkey AS subject, 'S' || (s_suppkey + 1) AS party, "
    "0.5::DOUBLE AS weight, 3 AS ord FROM supplier WHERE s_suppkey % 4 = 0\n  UNION ALL",
)


def graph_edges(spark: SparkSession, sf: str, cyclic: bool = False) -> DataFrame:
    s = F.col("s_suppkey")
    sup = table(spark, sf, "supplier").select("s_suppkey")
    to = lambda n: F.concat(F.lit("S"), n.cast("string"))
    parts = [
        F.struct(
            to(F.expr("s_suppkey div 3")).alias("party"),
            F.when(s % 7 != 0, F.lit(0.6)).alias("weight"), F.lit(1).alias("ord"),
        ),
        F.struct(
            to(F.expr("s_suppkey div 5")).alias("party"),
            F.lit(0.4).alias("weight"), F.lit(2).alias("ord"),
        ),
    ]
    out = sup.filter("s_suppkey > 0").select(
        to(s).alias("subject"), F.inline(F.array(*parts))
    )
    if cyclic:
        out = out.unionByName(
            sup.filter(s % 4 == 0).select(
                to(s).alias("subject"), to(s + 1).alias("party"),
                F.lit(0.5).alias("weight"), F.lit(3).alias("ord"),
            )
        )
    return out


def graph_listed(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .filter("s_acctbal > 6000")
        .select(F.concat(F.lit("S"), "s_suppkey").alias("entity"))
    )


# ---------------------------------------------------------------- asset units
UNITS_SQL = """
unit_row AS (
  SELECT l_partkey AS u, l_suppkey AS o, sum(l_quantity) AS q,
         min(CAST(l_shipdate AS DATE)) < DATE '1999-01-01' AS early,
         string_agg(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'operating'
                                  ELSE 'retired' END, '|' ORDER BY
                    CASE WHEN l_linestatus = 'O' THEN 'operating' ELSE 'retired' END) AS status
  FROM lineitem GROUP BY 1, 2),
unit_cap AS (SELECT u, sum(q) AS cap FROM unit_row GROUP BY u),
unit AS (
  SELECT 'P' || r.u AS unit, 'S' || r.o AS owner, c.cap,
         CASE WHEN (r.u + r.o) % 17 = 0 THEN NULL WHEN (r.u + r.o) % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS hop,
         p.p_type AS sector, CASE WHEN p.p_size % 2 = 0 THEN 'MW' ELSE 'Mtpa' END AS capunit,
         r.status, r.early
  FROM unit_row r JOIN unit_cap c ON r.u = c.u JOIN part p ON r.u = p.p_partkey)
"""


def units(spark: SparkSession, sf: str) -> DataFrame:
    # short keys and two booleans move, no names, dates or sets
    lines = lines_by_part(
        spark, sf, F.coalesce(F.col("l_linestatus") == "O", F.lit(False)).alias("open"),
        (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")).alias("early"),
    )
    rows = lines.groupBy("u", "o").agg(
        F.sum("l_quantity").alias("q"), F.max("early").alias("early"),
        F.concat_ws("|", F.when(F.max("open"), "operating"), F.when(F.max(~F.col("open")), "retired")).alias("status"),
    )
    rows = rows.withColumn("cap", F.sum("q").over(Window.partitionBy("u")))
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("u"), F.col("p_type").alias("sector"),
        F.when(F.col("p_size") % 2 == 0, "MW").otherwise("Mtpa").alias("capunit"),
    )
    u, o = F.col("u"), F.col("o")
    hop = F.when((u + o) % 17 == 0, F.lit(None)).when((u + o) % 2 == 0, 1.0).otherwise(0.5)
    return (
        rows.join(part, "u")
        .select(
            F.concat(F.lit("P"), u).alias("unit"), F.concat(F.lit("S"), o).alias("owner"), "cap",
            hop.cast("double").alias("hop"), "sector", "capunit", "status", "early",
        )
    )


# ---------------------------------------------------------------- daily prices
PRICES_SQL = """
prices AS (
  SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
         sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)
"""
BRAND_SQL = """
prices AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date,
         sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
"""


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per (symbol, day). A symbol is bounded by the calendar after this aggregate."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("S"), "l_suppkey").alias("symbol"),
            F.col("l_shipdate").cast("date").alias("date"),
        )
        .agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def brand_prices(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return (
        table(spark, sf, "lineitem")
        .select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
            F.sum("l_quantity").alias("volume"),
        )
    )


# ---------------------------------------------------------------- factors in percent
FACTORS_SQL = """
order_day AS (
  SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS m,
         avg(o_totalprice) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS a,
         avg(o_totalprice) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS b,
         avg(c_acctbal) AS c
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
factors AS (
  SELECT date, 2 * (m / 250000 - 1) AS mkt, coalesce(a - b, 0) / 100000 AS smb,
         (c - 4500) / 2000 AS hml, 0.01::DOUBLE AS rf
  FROM order_day)
"""


def factors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per day: bounded by the calendar, so it may be broadcast."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    seg = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    day = (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderdate").cast("date").alias("date"))
        .agg(
            F.avg("o_totalprice").alias("m"),
            F.avg(F.when(seg, F.col("o_totalprice"))).alias("a"),
            F.avg(F.when(~seg, F.col("o_totalprice"))).alias("b"),
            F.avg("c_acctbal").alias("c"),
        )
    )
    return day.select(
        "date",
        (2 * (F.col("m") / 250000 - 1)).alias("mkt"),
        (F.coalesce(F.col("a") - F.col("b"), F.lit(0)) / 100000).alias("smb"),
        ((F.col("c") - 4500) / 2000).alias("hml"),
        F.lit(0.01).alias("rf"),
    )


# ---------------------------------------------------------------- index membership events
MEMBERS_SQL = """
member_event AS (
  SELECT event_id, CAST(ts AS DATE) AS date,
         CASE WHEN event_type IN ('error', 'click') THEN '' ELSE 'U' || user_id END AS added,
         CASE WHEN event_type IN ('error', 'click') THEN 'U' || user_id ELSE '' END AS removed
  FROM events),
member_current AS (
  SELECT symbol FROM (
    SELECT 'U' || user_id AS symbol, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS last
    FROM events GROUP BY 1)
  WHERE last NOT IN ('error', 'click'))
"""


def member_events(spark: SparkSession, sf: str) -> DataFrame:
    """Change rows: date, added symbol, removed symbol ('' when the row has none)."""
    u = F.concat(F.lit("U"), "user_id")
    leaves = F.col("event_type").isin("error", "click")
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("date"),
        F.when(leaves, "").otherwise(u).alias("added"),
        F.when(leaves, u).otherwise("").alias("removed"),
    )


def member_current(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("U"), "user_id").alias("symbol"))
        .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
        .filter("last not in ('error', 'click')")
        .select("symbol")
    )


# ---------------------------------------------------------------- fetch ledger
LEDGER_SQL = """
ledger AS (
  SELECT event_type AS endpoint, 'U' || user_id AS symbol, ts AS fetched, event_id AS line,
         CASE WHEN event_id % 11 = 0 THEN 'HTTP_ERROR' WHEN event_id % 5 = 0 THEN 'WROTE_BESIDE'
              ELSE 'WROTE_NEW' END AS disposition,
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS n_rows,
         CAST(ts AS DATE) - CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 30 AS INTEGER) AS date_min,
         CAST(ts AS DATE) AS date_max
  FROM events)
"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    day = F.col("ts").cast("date")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"),
        F.concat(F.lit("U"), "user_id").alias("symbol"),
        F.col("ts").alias("fetched"),
        F.col("event_id").alias("line"),
        F.when(F.col("event_id") % 11 == 0, "HTTP_ERROR")
        .when(F.col("event_id") % 5 == 0, "WROTE_BESIDE")
        .otherwise("WROTE_NEW").alias("disposition"),
        F.when(F.col("event_id") % 7 == 0, F.lit(0).cast("long")).otherwise(k).alias("n_rows"),
        F.date_sub(day, (k * 30).cast("int")).alias("date_min"),
        day.alias("date_max"),
    )


# ---------------------------------------------------------------- listing candidates
# One candidate listing per (customer, supplier) that traded: linear in lineitem.
CANDIDATES_SQL = """
trade AS (
  SELECT o_custkey AS c, l_suppkey AS s, sum(l_quantity) AS share_vol,
         sum(l_extendedprice) AS dollar_vol, count(*) * 12 AS bars
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
candidate AS (
  SELECT 'C' || c AS entity, 'S' || s AS symbol,
         CASE WHEN c % 9 = 4 THEN 'not found' WHEN c % 9 = 5 THEN '' ELSE 'L' || c END AS lei,
         CASE WHEN c % 4 = 1 THEN '' ELSE 'K' || c END AS cik,
         c_name, s_name, c_nationkey AS hq, s_nationkey AS exchange,
         share_vol, dollar_vol, CAST(bars AS BIGINT) AS bars
  FROM trade JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey)
"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    trade = (
        o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.col("o_custkey").alias("c"), F.col("l_suppkey").alias("s"))
        .agg(
            F.sum("l_quantity").alias("share_vol"),
            F.sum("l_extendedprice").alias("dollar_vol"),
            (F.count(F.lit(1)) * 12).alias("bars"),
        )
    )
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("c"), "c_name", F.col("c_nationkey").alias("hq")
    )
    sup = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("s"), "s_name", F.col("s_nationkey").alias("exchange")
    )
    c = F.col("c")
    return (
        trade.join(cust, "c").join(sup, "s")
        .select(
            F.concat(F.lit("C"), c).alias("entity"),
            F.concat(F.lit("S"), "s").alias("symbol"),
            F.when(c % 9 == 4, "not found").when(c % 9 == 5, "")
            .otherwise(F.concat(F.lit("L"), c)).alias("lei"),
            F.when(c % 4 == 1, "").otherwise(F.concat(F.lit("K"), c)).alias("cik"),
            "c_name", "s_name", "hq", "exchange", "share_vol", "dollar_vol", "bars",
        )
    )
