"""Queries on the ownership graph and on capacity attributed along it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cleaning import half_up
from tidemark.functions.identifiers import operating
from tidemark.operators import exposure as X
from tidemark.operators import graph as G
from tidemark.operators.ordering import first_wins
from tidemark.plans import standins as S
from tidemark.plans.registry import query, r
from tidemark.session import materialise

IMPUTED_SQL = """filled AS (
  SELECT subject, party, coalesce(weight, CASE WHEN '{rule}' = 'impute' THEN
    greatest(0.0, 1.0 - coalesce(sum(weight) OVER (PARTITION BY subject), 0)) /
    nullif(count(*) FILTER (WHERE weight IS NULL) OVER (PARTITION BY subject), 0) ELSE 0.0 END)::DOUBLE AS weight
  FROM graph_edge)"""


def walk_sql(name: str, listed: str, edges: str = "filled") -> str:
    """Recursive oracle of the simple-path walk, as CTEs ending in ``{name}`` (source, parent, weight)."""
    return f"""{name}_w(src, cur, w, path, hit) AS (
  SELECT subject, party, weight, [subject, party], party IN (SELECT entity FROM {listed})
  FROM {edges} WHERE subject NOT IN (SELECT entity FROM {listed})
  UNION ALL
  SELECT src, e.party, w * e.weight, list_append(path, e.party),
         e.party IN (SELECT entity FROM {listed})
  FROM {name}_w JOIN {edges} e ON cur = e.subject
  WHERE NOT hit AND NOT list_contains(path, e.party)),
{name} AS (SELECT src AS source, cur AS parent, sum(w) AS weight FROM {name}_w WHERE hit GROUP BY 1, 2)"""


def base_sql(rule: str = "zero", cyclic: bool = False) -> str:
    return (S.CYCLE_SQL if cyclic else S.GRAPH_SQL) + ", " + IMPUTED_SQL.format(rule=rule)


def suppliers(spark, sf):
    return S.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("entity"))


def filled(spark, sf, rule="zero", cyclic=False):
    return G.fill_blanks(S.graph_edges(spark, sf, cyclic), rule)


def rounded(df, *cols, places=6):
    return df.select(*[(half_up(F.col(c), places).alias(c) if c in cols else F.col(c)) for c in df.columns])


@query(
    "d03_blank_share_rules",
    f"""WITH {S.GRAPH_SQL}, z AS (SELECT subject, party, ord, coalesce(weight, 0.0) AS zero,
      coalesce(weight, greatest(0.0, 1.0 - coalesce(sum(weight) OVER (PARTITION BY subject), 0)) /
        count(*) FILTER (WHERE weight IS NULL) OVER (PARTITION BY subject)) AS impute FROM graph_edge)
    SELECT subject, party, ord, {r('zero', 6)} AS zero, {r('impute', 6)} AS impute FROM z""",
)
def d03(spark, sf):
    e = S.graph_edges(spark, sf)
    z = G.fill_blanks(e, "zero").withColumnRenamed("weight", "zero")
    i = G.fill_blanks(e, "impute").withColumnRenamed("weight", "impute")
    return rounded(z.join(i, ["subject", "party", "ord"]), "zero", "impute")


@query(
    "d01_nearest_listed",
    f"WITH RECURSIVE {base_sql()}, {walk_sql('near', 'graph_listed')} SELECT source, parent, {r('weight', 6)} AS weight FROM near",
)
def d01(spark, sf):
    return rounded(
        G.nearest_listed(filled(spark, sf), S.graph_listed(spark, sf), suppliers(spark, sf)), "weight"
    )


@query(
    "d01_nearest_listed_cyclic",
    f"WITH RECURSIVE {base_sql('impute', True)}, {walk_sql('near', 'graph_listed')} SELECT source, parent, {r('weight', 6)} AS weight FROM near",
)
def d01c(spark, sf):
    return rounded(
        G.nearest_listed(
            filled(spark, sf, "impute", True), S.graph_listed(spark, sf), suppliers(spark, sf)
        ),
        "weight",
    )


CLOSURE_SQL = """reach(source, node) AS (
  SELECT subject, party FROM graph_edge UNION
  SELECT source, party FROM reach JOIN graph_edge ON node = subject)"""


@query(
    "d02_listed_ancestors",
    f"""WITH RECURSIVE {S.GRAPH_SQL}, {CLOSURE_SQL}
    SELECT source, node AS parent FROM reach WHERE node IN (SELECT entity FROM graph_listed)""",
)
def d02(spark, sf):
    return G.listed_ancestors(
        S.graph_edges(spark, sf), S.graph_listed(spark, sf), suppliers(spark, sf)
    )


@query("d07_upward_closure", f"WITH RECURSIVE {S.CYCLE_SQL}, {CLOSURE_SQL} SELECT source, node FROM reach")
def d07(spark, sf):
    return G.closure(S.graph_edges(spark, sf, True), suppliers(spark, sf))


@query(
    "d10_taint",
    f"""WITH RECURSIVE {S.GRAPH_SQL}, bad(item) AS (
      SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey < 4 AND s_acctbal > 2000
      UNION SELECT subject FROM bad JOIN graph_edge ON party = item) SELECT item FROM bad""",
)
def d10(spark, sf):
    uses = S.graph_edges(spark, sf).select(F.col("subject").alias("item"), F.col("party").alias("upstream"))
    origin = S.table(spark, sf, "supplier").filter("s_nationkey < 4 and s_acctbal > 2000").select(
        F.concat(F.lit("S"), "s_suppkey").alias("item")
    )
    return G.tainted(uses, origin)


@query(
    "d11_consolidation_flags",
    """WITH rel AS (SELECT 'C' || o_custkey AS child, 'C' || CAST(o_custkey // 2 AS BIGINT) AS parent,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'IS_ULTIMATELY_CONSOLIDATED_BY'
          WHEN '2-HIGH' THEN 'IS_DIRECTLY_CONSOLIDATED_BY' ELSE 'IS_FUND_MANAGED_BY' END AS kind,
        CASE WHEN o_orderstatus = 'O' THEN 'ACTIVE' ELSE 'INACTIVE' END AS status,
        CASE WHEN o_orderkey % 4 <> 0 THEN 'PUBLISHED' ELSE 'LAPSED' END AS state FROM orders),
      panel AS (SELECT 'C' || c_custkey AS lei FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT DISTINCT child, parent, c_name AS parent_name, parent IN (SELECT lei FROM panel) AS parent_in_panel
    FROM rel LEFT JOIN customer ON parent = 'C' || c_custkey
    WHERE kind <> 'IS_FUND_MANAGED_BY' AND status = 'ACTIVE' AND state = 'PUBLISHED' AND child IN (SELECT lei FROM panel)""",
)
def d11(spark, sf):
    o = S.table(spark, sf, "orders")
    rel = o.select(
        F.concat(F.lit("C"), "o_custkey").alias("child"),
        F.concat(F.lit("C"), F.expr("o_custkey div 2")).alias("parent"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "IS_ULTIMATELY_CONSOLIDATED_BY")
        .when(F.col("o_orderpriority") == "2-HIGH", "IS_DIRECTLY_CONSOLIDATED_BY")
        .otherwise("IS_FUND_MANAGED_BY").alias("kind"),
        F.when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, "PUBLISHED").otherwise("LAPSED").alias("state"),
    ).distinct()
    c = S.table(spark, sf, "customer")
    lei = F.concat(F.lit("C"), "c_custkey").alias("lei")
    panel = c.filter("c_mktsegment = 'BUILDING'").select(lei)
    return G.consolidation_flags(rel, panel, c.select(lei, F.col("c_name").alias("name"))).distinct()


# ---------------------------------------------------------------- attribution
ATTR_SQL = f"""{base_sql('{rule}')}, {S.UNITS_SQL}, {walk_sql('near', 'graph_listed')},
held AS (SELECT * FROM near UNION ALL SELECT entity, entity, 1.0 FROM graph_listed),
usable AS (SELECT * FROM unit WHERE hop IS NOT NULL AND contains(status, 'operating')),
attr AS (SELECT unit, parent AS firm, sum(hop * weight * cap) AS mw, sum(hop * weight) AS share
  FROM usable JOIN held ON owner = source GROUP BY 1, 2)"""


def attr_sql(rule: str) -> str:
    return ATTR_SQL.replace("{rule}", rule)


def usable(spark, sf):
    u = S.units(spark, sf)
    return X.usable_units(u.filter(operating(F.col("status"))))


def attributed(spark, sf, rule="zero"):
    u = materialise(usable(spark, sf))
    owners = u.select(F.col("owner").alias("entity")).distinct()
    held = G.holders(filled(spark, sf, rule), S.graph_listed(spark, sf), owners)
    return X.attribute(u, held)


@query(
    "d04_attribution",
    f"WITH RECURSIVE {attr_sql('zero')} SELECT unit, firm, {r('mw', 4)} AS mw, {r('share', 6)} AS share FROM attr",
)
def d04(spark, sf):
    return rounded(rounded(attributed(spark, sf), "share"), "mw", places=4)


@query(
    "d05_firm_capacity",
    f"""WITH RECURSIVE {attr_sql('impute')}, f AS (SELECT firm, sum(mw) AS mw, count(DISTINCT unit) AS units FROM attr GROUP BY firm)
    SELECT firm, {r('mw', 2)} AS mw, units FROM f""",
)
def d05(spark, sf):
    return rounded(X.firm_capacity(attributed(spark, sf, "impute")), "mw", places=2)


@query(
    "d06_overcount",
    f"""WITH {S.UNITS_SQL}, u AS (SELECT * FROM unit WHERE hop IS NOT NULL),
    t AS (SELECT sum(hop * cap) AS naive, (SELECT sum(c) FROM (SELECT max(cap) AS c FROM u GROUP BY unit)) AS fleet FROM u)
    SELECT {r('naive', 2)} AS naive, {r('fleet', 2)} AS fleet, {r('naive / fleet', 6)} AS ratio FROM t""",
)
def d06(spark, sf):
    return rounded(
        rounded(X.overcount(X.usable_units(S.units(spark, sf))), "naive", "fleet", places=2), "ratio"
    )


@query(
    "b31_dropped_by_sector",
    f"WITH {S.UNITS_SQL} SELECT sector, count(hop) AS kept, count(*) - count(hop) AS dropped FROM unit GROUP BY sector",
)
def b31(spark, sf):
    return X.dropped_by_sector(S.units(spark, sf))


D8_SQL = f"""{base_sql('impute')}, {S.UNITS_SQL},
listed_old AS (SELECT CASE WHEN s_suppkey % 3 = 1 THEN 'F' ELSE 'S' END || s_suppkey AS entity FROM supplier WHERE s_acctbal > 6000),
{walk_sql('near', 'graph_listed')}, {walk_sql('nearo', 'listed_old')},
held AS (SELECT * FROM near UNION ALL SELECT entity, entity, 1.0 FROM graph_listed),
heldo AS (SELECT * FROM nearo UNION ALL SELECT entity, entity, 1.0 FROM listed_old),
un AS (SELECT * FROM unit WHERE hop IS NOT NULL), uo AS (SELECT * FROM unit WHERE hop IS NOT NULL AND early),
attrn AS (SELECT unit, parent AS firm, sum(hop * weight * cap) AS mw FROM un JOIN held ON owner = source GROUP BY 1, 2),
attro AS (SELECT unit, parent AS firm, sum(hop * weight * cap) AS mw FROM uo JOIN heldo ON owner = source GROUP BY 1, 2),
entrant AS (SELECT firm FROM attrn GROUP BY firm HAVING sum(mw) > 0
  EXCEPT SELECT firm FROM attro GROUP BY firm HAVING sum(mw) > 0),
{CLOSURE_SQL},
part AS (SELECT n.firm, n.unit, n.mw, n.unit IN (SELECT unit FROM uo) AS carried,
  CASE WHEN n.unit NOT IN (SELECT unit FROM uo) THEN 3
       WHEN n.firm NOT IN (SELECT entity FROM listed_old) AND EXISTS (SELECT 1 FROM attro h JOIN reach c
         ON c.source = n.firm AND c.node = h.firm WHERE h.unit = n.unit AND h.firm <> n.firm) THEN 1 ELSE 2 END AS p
  FROM attrn n WHERE n.firm IN (SELECT firm FROM entrant))"""
# the CTE name 'part' would hide the table of the same name
D8_SQL = D8_SQL.replace("\npart AS (SELECT n.firm", "\npiece AS (SELECT n.firm")


@query(
    "d08_entrant_split",
    f"""WITH RECURSIVE {D8_SQL} SELECT firm, {r('sum(mw)', 4)} AS mw, count(*) AS units,
      count(*) FILTER (WHERE carried) AS units_carried, count(*) FILTER (WHERE p = 1) AS units_part_1,
      {r('coalesce(sum(mw) FILTER (WHERE p = 1), 0)', 4)} AS mw_part_1,
      {r('coalesce(sum(mw) FILTER (WHERE p = 2), 0)', 4)} AS mw_part_2,
      {r('coalesce(sum(mw) FILTER (WHERE p = 3), 0)', 4)} AS mw_part_3, true AS adds_up FROM piece GROUP BY firm""",
)
def d08(spark, sf):
    e = filled(spark, sf, "impute")
    listed = S.graph_listed(spark, sf)
    number = F.substring("entity", 2, 20)
    former = F.concat(F.when(number.cast("long") % 3 == 1, "F").otherwise("S"), number)  # a listing under a former name
    listed_old = listed.select(former.alias("entity"))
    un = materialise(X.usable_units(S.units(spark, sf)).select("unit", "owner", "cap", "hop", "early"))
    uo = un.filter("early")
    owners = un.select(F.col("owner").alias("entity")).distinct()
    held, held_old = materialise(G.holders(e, listed, owners)), materialise(G.holders(e, listed_old, owners))

    def firms(units, holding):
        """Firms with capacity: an owner's units count as one here, so units do not meet every firm above them."""
        whole = units.groupBy("owner").agg(F.sum(F.col("hop") * F.col("cap")).alias("cap")).select("*", F.col("owner").alias("unit"), F.lit(1.0).alias("hop"))
        return X.attribute(whole, holding).groupBy("firm").agg(F.sum("mw").alias("mw")).filter("mw > 0").select("firm")

    entrant = materialise(firms(un, held).join(firms(uo, held_old), "firm", "left_anti"))
    above = materialise(
        G.closure(e, entrant.select(F.col("firm").alias("entity"))).select(F.col("source").alias("firm"), F.col("node").alias("holder"))
    )
    # only entrants are split, and only holders of that time above an entrant decide how; written, so that the next plan knows how small they are
    above = above.join(held_old.select(F.col("parent").alias("holder")).distinct(), "holder", "left_semi")
    held_now = materialise(held.join(entrant.select(F.col("firm").alias("parent")), "parent", "left_semi"))
    held_then = materialise(held_old.join(above.select(F.col("holder").alias("parent")).distinct(), "parent", "left_semi"))
    mw = X.attribute(un, held_now).select("firm", "unit", "mw")
    old = X.attribute(uo, held_then, together=True)
    out = X.split_entrants(
        mw, uo.select("unit"), old.select("unit", F.col("firm").alias("holder")), above,
        listed_old.select(F.col("entity").alias("firm")),
    )
    return rounded(out, "mw", "mw_part_1", "mw_part_2", "mw_part_3", places=4)


@query(
    "e01_survivor_funnel",
    f"""WITH {S.UNITS_SQL}, t AS (SELECT count(*) AS s0, count(*) FILTER (WHERE contains(status, 'operating')) AS s1,
      count(*) FILTER (WHERE contains(status, 'operating') AND hop IS NOT NULL) AS s2,
      count(*) FILTER (WHERE contains(status, 'operating') AND hop IS NOT NULL AND s_nationkey < 12) AS s3,
      count(*) FILTER (WHERE contains(status, 'operating') AND hop IS NOT NULL AND s_nationkey < 12 AND s_acctbal > 6000) AS s4
      FROM unit JOIN supplier ON owner = 'S' || s_suppkey)
    SELECT 0 AS step, 'all' AS name, s0 AS n FROM t UNION ALL SELECT 1, 'operating', s1 FROM t
    UNION ALL SELECT 2, 'known share', s2 FROM t UNION ALL SELECT 3, 'in region', s3 FROM t
    UNION ALL SELECT 4, 'listed', s4 FROM t""",
)
def e01(spark, sf):
    s = S.table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("owner"), "s_nationkey", "s_acctbal"
    )
    return X.survivors(
        S.units(spark, sf).join(s, "owner"),
        {
            "operating": operating(F.col("status")), "known share": F.col("hop").isNotNull(),
            "in region": F.col("s_nationkey") < 12, "listed": F.col("s_acctbal") > 6000,
        },
    )


@query(
    "e02_unit_attributes",
    """SELECT 'P' || l_partkey AS unit, string_agg(DISTINCT lower(l_linestatus || l_returnflag), '|'
       ORDER BY lower(l_linestatus || l_returnflag)) AS status, max(l_extendedprice) AS cap,
      arg_min(l_shipmode_, struct_pack(o := l_linenumber, s := l_shipmode_)) AS sector,
      arg_min(capunit_, struct_pack(o := l_linenumber, s := l_shipmode_)) AS capunit
    FROM (SELECT *, 'T' || (l_suppkey % 5) AS l_shipmode_, CASE WHEN l_suppkey % 5 < 3 THEN 'MW' ELSE 'Mtpa' END AS capunit_ FROM lineitem)
    GROUP BY 1""",
)
def e02(spark, sf):
    line = S.table(spark, sf, "lineitem")
    rows = line.select(
        F.concat(F.lit("P"), "l_partkey").alias("unit"),
        F.lower(F.concat("l_linestatus", "l_returnflag")).alias("status"),
        F.col("l_extendedprice").alias("cap"), F.col("l_linenumber").alias("ord"),
        F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("sector"),
        F.when(F.col("l_suppkey") % 5 < 3, "MW").otherwise("Mtpa").alias("capunit"),
    )
    return X.unit_attributes(rows)


COVER_SQL = f"""{attr_sql('impute')}, region AS (SELECT 'S' || s_suppkey AS firm FROM supplier WHERE s_nationkey < 12),
per AS (SELECT unit, sum(share) AS l, sum(share) FILTER (WHERE firm IN (SELECT firm FROM region)) AS g FROM attr GROUP BY unit),
one AS (SELECT unit, max(sector) AS sector, max(capunit) AS capunit, max(cap) AS cap FROM usable GROUP BY unit),
cov AS (SELECT sector, capunit, cap, coalesce(l, 0) AS l, coalesce(g, 0) AS g FROM one LEFT JOIN per USING (unit))"""


@query(
    "e03_coverage",
    f"""WITH RECURSIVE {COVER_SQL} SELECT sector, capunit, count(*) AS units, {r('sum(cap)', 4)} AS capacity,
      {r('100.0::DOUBLE * count(*) FILTER (WHERE l > 0) / count(*)', 4)} AS listed_by_count,
      {r('100 * coalesce(sum(cap) FILTER (WHERE l > 0), 0) / sum(cap)', 4)} AS listed_by_capacity,
      {r('100.0::DOUBLE * count(*) FILTER (WHERE g > 0) / count(*)', 4)} AS region_by_count,
      {r('100 * coalesce(sum(cap) FILTER (WHERE g > 0), 0) / sum(cap)', 4)} AS region_by_capacity,
      {r('100 * sum(cap * least(greatest(g, 0), 1)) / sum(cap)', 4)} AS region_share_weighted
    FROM cov GROUP BY sector, capunit""",
)
def e03(spark, sf):
    u = usable(spark, sf)
    a = attributed(spark, sf, "impute")
    region = S.table(spark, sf, "supplier").filter("s_nationkey < 12").select(
        F.concat(F.lit("S"), "s_suppkey").alias("firm"), F.lit(True).alias("_r")
    )
    per = a.join(region, "firm", "left").groupBy("unit").agg(
        F.sum("share").alias("listed_share"),
        F.sum(F.when(F.col("_r"), F.col("share"))).alias("region_share"),
    )
    one = u.groupBy("unit").agg(
        F.max("sector").alias("sector"), F.max("capunit").alias("capunit"), F.max("cap").alias("cap")
    )
    return X.coverage(one.join(per, "unit", "left"))


@query(
    "e04_holdings",
    f"""WITH RECURSIVE {attr_sql('zero')}, p AS (SELECT firm, count(DISTINCT unit) AS n FROM attr GROUP BY firm)
    SELECT count(*) AS firms, CAST(sum(n) AS BIGINT) AS holdings, count(*) FILTER (WHERE n >= 5) AS large,
      (SELECT count(DISTINCT unit) FROM attr) AS assets FROM p""",
)
def e04(spark, sf):
    return X.holdings(attributed(spark, sf))


@query(
    "f07_first_and_last_wins",
    """SELECT 'P' || l_partkey AS unit, arg_min(l_quantity, k) AS first_qty, arg_max(l_quantity, k) AS last_qty
    FROM (SELECT *, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_extendedprice) AS k FROM lineitem) GROUP BY 1""",
)
def f07(spark, sf):
    from tidemark.operators.ordering import last_wins

    rows = S.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("unit"), "l_quantity", "l_orderkey", "l_linenumber",
        "l_suppkey", "l_extendedprice",
    )
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    first = first_wins(rows, ["unit"], order).select("unit", F.col("l_quantity").alias("first_qty"))
    last = last_wins(rows, ["unit"], order).select("unit", F.col("l_quantity").alias("last_qty"))
    return first.join(last, "unit")
