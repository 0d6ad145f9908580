"""Queries on exposure panels: ranks, overlaps, stability, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.cleaning import half_up
from tidemark.functions.stats import correlation
from tidemark.operators import exposure as X
from tidemark.operators import rank as K
from tidemark.operators.ordering import average_rank, cut_values
from tidemark.operators.vintage import union_all
from tidemark.plans import standins as S
from tidemark.plans.q_graph import rounded
from tidemark.plans.registry import query, r

ARMS = ["2025_zero", "2025_impute", "2026_zero", "2026_impute"]
LONG_SQL = """exp_row AS (
  SELECT 'C' || o_custkey AS firm, floor(o_totalprice / 50000) AS mw, o_orderdate < TIMESTAMP '1997-01-01' AS early,
    coalesce(o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW'), false) AS stated FROM orders),
exp_long AS (
  SELECT firm, '2025_zero' AS arm, sum(mw) AS mw FROM exp_row WHERE stated AND early GROUP BY 1
  UNION ALL SELECT firm, '2025_impute', sum(CASE WHEN stated THEN mw ELSE floor(mw / 2) END) FROM exp_row WHERE early GROUP BY 1
  UNION ALL SELECT firm, '2026_zero', sum(mw) FROM exp_row WHERE stated GROUP BY 1
  UNION ALL SELECT firm, '2026_impute', sum(CASE WHEN stated THEN mw ELSE floor(mw / 2) END) FROM exp_row GROUP BY 1),
exp_wide AS (SELECT 'C' || c_custkey AS firm, c_mktsegment AS seg,
  coalesce(max(mw) FILTER (WHERE arm = '2025_zero'), 0) AS z25, coalesce(max(mw) FILTER (WHERE arm = '2025_impute'), 0) AS i25,
  coalesce(max(mw) FILTER (WHERE arm = '2026_zero'), 0) AS z26, coalesce(max(mw) FILTER (WHERE arm = '2026_impute'), 0) AS i26
  FROM customer LEFT JOIN exp_long ON firm = 'C' || c_custkey GROUP BY 1, 2)"""


def exposure_long(spark, sf):
    """Every order counts: with its whole amount where its share is stated, with half of it where it is imputed."""
    o = S.table(spark, sf, "orders")
    mw = F.floor(F.col("o_totalprice") / 50000).cast("double")
    early = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    stated = F.coalesce(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM", "5-LOW"), F.lit(False))
    imputed = F.when(stated, mw).otherwise(F.floor(mw / 2))
    add = lambda cond, x: F.sum(F.when(cond, x))
    g = o.groupBy(F.concat(F.lit("C"), "o_custkey").alias("firm")).agg(
        add(stated & early, mw).alias("a"), add(early, imputed).alias("b"),
        add(stated, mw).alias("c"), F.sum(imputed).alias("d"),
    )
    row = lambda arm, x: F.struct(F.lit(arm).alias("arm"), x.cast("double").alias("mw"))
    return g.select(
        "firm",
        F.inline(
            F.array(
                row("2025_zero", F.col("a")), row("2025_impute", F.col("b")),
                row("2026_zero", F.col("c")), row("2026_impute", F.col("d")),
            )
        ),
    ).filter("mw is not null")


def panel(spark, sf):
    """Every panel firm, no exposure read as a real zero."""
    w = X.wide_measures(exposure_long(spark, sf), "firm", "arm", ARMS, "mw")
    c = S.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("firm"), F.col("c_mktsegment").alias("seg")
    )
    names = dict(zip(ARMS, ("z25", "i25", "z26", "i26")))
    j = c.join(w, "firm", "left").na.fill(0.0, ARMS)
    return j.select("firm", "seg", *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


@query("c03_e20_wide_panel", f"WITH {LONG_SQL} SELECT firm, seg, z25, i25, z26, i26 FROM exp_wide")
def c03(spark, sf):
    return panel(spark, sf)


@query(
    "e19_panel_flow",
    f"""WITH {LONG_SQL} SELECT count(*) AS firms, count(*) FILTER (WHERE z25 > 0) AS exposed_old,
    count(*) FILTER (WHERE z26 > 0) AS exposed_new, count(*) FILTER (WHERE z25 = 0 AND z26 = 0) AS never,
    count(*) FILTER (WHERE z25 > 0 OR z26 > 0) AS active, count(*) FILTER (WHERE z25 = 0 AND z26 > 0) AS entered,
    count(*) FILTER (WHERE z25 > 0 AND z26 = 0) AS "left" FROM exp_wide""",
)
def e19(spark, sf):
    return X.panel_flow(panel(spark, sf), "z25", "z26")


SECTOR_SQL = """sector_long AS (SELECT 'C' || o_custkey AS firm, CASE o_orderpriority WHEN '1-URGENT' THEN 'coal'
    WHEN '2-HIGH' THEN 'gas' ELSE 'bio' END AS grp, sum(floor(o_totalprice / 50000)) AS mw,
    CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'old' ELSE 'new' END AS rel
  FROM orders GROUP BY ALL),
sector_firm AS (SELECT firm, rel, coalesce(sum(mw) FILTER (WHERE grp = 'coal'), 0) AS coal, coalesce(sum(mw) FILTER (WHERE grp = 'gas'), 0) AS gas,
    coalesce(sum(mw) FILTER (WHERE grp = 'bio'), 0) AS bio FROM sector_long GROUP BY 1, 2),
sector_share AS (SELECT *, coal + gas AS fossil, coal + gas + bio AS thermal,
    CASE WHEN coal + gas + bio > 0 THEN (coal + gas) / (coal + gas + bio) END AS fossil_share,
    CASE WHEN coal + gas > 0 THEN coal / (coal + gas) END AS coal_share FROM sector_firm)"""


def sector_long(spark, sf):
    p = F.col("o_orderpriority")
    return (
        S.table(spark, sf, "orders")
        .groupBy(
            F.concat(F.lit("C"), "o_custkey").alias("firm"),
            F.when(p == "1-URGENT", "coal").when(p == "2-HIGH", "gas").otherwise("bio").alias("grp"),
            F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"), "old").otherwise("new").alias("rel"),
        )
        .agg(F.sum(F.floor(F.col("o_totalprice") / 50000)).cast("double").alias("mw"))
    )


def shares(spark, sf, rel):
    return X.sector_shares(sector_long(spark, sf).filter(F.col("rel") == rel))


@query(
    "e21_sector_shares",
    f"WITH {SECTOR_SQL} SELECT firm, coal, gas, bio, fossil, thermal, {r('fossil_share', 6)} AS fossil_share, {r('coal_share', 6)} AS coal_share FROM sector_share WHERE rel = 'new'",
)
def e21(spark, sf):
    return rounded(shares(spark, sf, "new"), "fossil_share", "coal_share")


@query(
    "e22_degeneracy",
    f"""WITH {SECTOR_SQL}, q AS (SELECT count(fossil_share) AS n, quantile_cont(fossil_share, 0.25) AS q1, median(fossil_share) AS median,
      quantile_cont(fossil_share, 0.75) AS q3, avg(CASE WHEN fossil_share >= 0.9995 THEN 1.0 ELSE 0.0 END) AS at_one
      FROM sector_share WHERE rel = 'new' AND fossil_share IS NOT NULL)
    SELECT n, {r('q1', 6)} AS q1, {r('median', 6)} AS median, {r('q3', 6)} AS q3, {r('q3 - q1', 6)} AS iqr, {r('at_one', 6)} AS at_one,
      median > 0.95 AND q3 - q1 < 0.10 AS degenerate FROM q""",
)
def e22(spark, sf):
    return rounded(K.degeneracy(shares(spark, sf, "new"), "fossil_share"), "q1", "median", "q3", "iqr", "at_one")


RANK_SQL = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)::DOUBLE"


@query(
    "f06_average_rank",
    f"WITH {LONG_SQL} SELECT firm, i25, {RANK_SQL.format(c='i25')} AS rank FROM exp_wide",
)
def f06(spark, sf):
    return average_rank(panel(spark, sf).select("firm", "i25"), "i25").select("firm", "i25", "rank")


@query("s01_pearson", f"WITH {LONG_SQL} SELECT {r('corr(i25, i26)', 6)} AS pearson, count(*) AS n FROM exp_wide")
def s01(spark, sf):
    return panel(spark, sf).agg(half_up(correlation("i25", "i26"), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


@query(
    "s02_spearman",
    f"""WITH {LONG_SQL}, k AS (SELECT {RANK_SQL.format(c='i25')} AS x, {RANK_SQL.format(c='i26')} AS y FROM exp_wide)
    SELECT count(*) AS n, {r('corr(x, y)', 6)} AS spearman FROM k""",
)
def s02(spark, sf):
    return rounded(K.spearman(panel(spark, sf), "i25", "i26"), "spearman")


@query(
    "f13_cut_value",
    f"""WITH {LONG_SQL}, n AS (SELECT count(*) AS n, greatest(1, count(*) // 5) AS k FROM exp_wide),
    c AS (SELECT n, k, (SELECT i26 FROM exp_wide ORDER BY i26 DESC LIMIT 1 OFFSET (SELECT k - 1 FROM n)) AS cut FROM n)
    SELECT n, k, cut, (SELECT count(*) FROM exp_wide WHERE i26 > cut) AS sure, (SELECT count(*) FROM exp_wide WHERE i26 = cut) AS tied,
      k - (SELECT count(*) FROM exp_wide WHERE i26 > cut) AS places FROM c""",
)
def f13(spark, sf):
    return cut_values(panel(spark, sf), "i26", K.fifth("floor"))


BOUNDS_SQL = """cut AS (SELECT k, (SELECT {a} FROM src ORDER BY {a} DESC LIMIT 1 OFFSET (SELECT k - 1 FROM kk)) AS ca,
   (SELECT {b} FROM src ORDER BY {b} DESC LIMIT 1 OFFSET (SELECT k - 1 FROM kk)) AS cb FROM kk),
cnt AS (SELECT max(k) AS k, max(ca) AS cut_a, max(cb) AS cut_b, count(*) FILTER (WHERE {a} > ca) AS sure_a, count(*) FILTER (WHERE {a} = ca) AS tied_a,
   count(*) FILTER (WHERE {b} > cb) AS sure_b, count(*) FILTER (WHERE {b} = cb) AS tied_b, count(*) FILTER (WHERE {a} > ca AND {b} > cb) AS a0,
   count(*) FILTER (WHERE {a} = ca AND {b} > cb) AS p, count(*) FILTER (WHERE {a} > ca AND {b} = cb) AS x1, count(*) FILTER (WHERE {a} = ca AND {b} = cb) AS q
   FROM src, cut),
mm AS (SELECT *, k - sure_a AS places_a, k - sure_b AS places_b, tied_a - p - q AS ua, tied_b - x1 - q AS ub FROM cnt),
tt AS (SELECT mm.*, x.ta, y.tb, greatest(0, places_a - ta - ua) AS la, least(p, places_a - ta) AS ha, greatest(0, places_b - tb - ub) AS lb,
   least(x1, places_b - tb) AS hb FROM mm, LATERAL (SELECT unnest(generate_series(0, q)) AS ta) x, LATERAL (SELECT unnest(generate_series(0, q)) AS tb) y),
bounds AS (SELECT k, min(a0 + la + lb + greatest(0, ta + tb - q)) AS lowest, max(a0 + ha + hb + least(ta, tb)) AS highest,
   max(cut_a) AS cut_a, max(sure_a) AS sure_a, max(tied_a) AS tied_a, max(places_a) AS places_a, max(cut_b) AS cut_b, max(sure_b) AS sure_b,
   max(tied_b) AS tied_b, max(places_b) AS places_b, max(tied_a) > max(places_a) OR max(tied_b) > max(places_b) AS has_ties
   FROM tt WHERE la <= ha AND lb <= hb GROUP BY k)"""


@query(
    "s17_overlap_bounds",
    f"WITH {LONG_SQL}, src AS (SELECT * FROM exp_wide), kk AS (SELECT greatest(1, count(*) // 5) AS k FROM src), {BOUNDS_SQL.format(a='z25', b='z26')} SELECT * FROM bounds",
)
def s17(spark, sf):
    return K.overlap_bounds(panel(spark, sf), "z25", "z26")


@query(
    "s18_fifth_by_rule",
    f"""WITH {LONG_SQL}, src AS (SELECT * FROM exp_wide WHERE z26 > 0), kk AS (SELECT CAST(round_even(count(*) / 5.0, 0) AS BIGINT) AS k FROM src),
    {BOUNDS_SQL.format(a='i25', b='i26')} SELECT 'round' AS rule, k, lowest, highest FROM bounds
    UNION ALL SELECT 'floor', k, lowest, highest FROM (WITH kk AS (SELECT greatest(1, count(*) // 5) AS k FROM src),
    {BOUNDS_SQL.format(a='i25', b='i26')} SELECT * FROM bounds)""",
)
def s18(spark, sf):
    p = panel(spark, sf).filter("z26 > 0")
    one = lambda rule: K.overlap_bounds(p, "i25", "i26", rule).select(
        F.lit(rule).alias("rule"), "k", "lowest", "highest"
    )
    return one("round").unionByName(one("floor"))


@query(
    "g01_largest_moves",
    f"WITH {LONG_SQL} SELECT firm, i25 AS a, i26 AS b, i26 - i25 AS change FROM exp_wide ORDER BY abs(i26 - i25) DESC, firm LIMIT 12",
)
def g01(spark, sf):
    p = panel(spark, sf)
    return X.largest_moves(
        p.select("firm", F.col("i25").alias("mw")), p.select("firm", F.col("i26").alias("mw")), "firm", "mw"
    )


@query(
    "g04_top_movers",
    f"""WITH {LONG_SQL}, x AS (SELECT *, row_number() OVER (ORDER BY i25 DESC, firm) AS pa, row_number() OVER (ORDER BY i26 DESC, firm) AS pb,
      greatest(1, count(*) OVER () // 5) AS k FROM exp_wide)
    SELECT firm, CASE WHEN pb <= k THEN 'in' ELSE 'out' END AS move, i25, i26, i26 - i25 AS change FROM x WHERE (pa <= k) <> (pb <= k)""",
)
def g04(spark, sf):
    return K.movers(panel(spark, sf), "i25", "i26", "firm").orderBy(F.abs("change").desc(), "firm")


@query(
    "e45_matched_growth",
    f"""WITH {LONG_SQL}, a AS (SELECT * FROM exp_long WHERE arm = '2025_impute'), b AS (SELECT * FROM exp_long WHERE arm = '2026_impute'),
    j AS (SELECT a.mw AS a, b.mw AS b, a.mw IS NOT NULL AND b.mw IS NOT NULL AS both_ FROM a FULL JOIN b ON a.firm = b.firm)
    SELECT count(a) AS n_a, count(b) AS n_b, count(*) FILTER (WHERE both_) AS n_both, {r('sum(a) FILTER (WHERE both_)', 2)} AS total_a,
      {r('sum(b) FILTER (WHERE both_)', 2)} AS total_b, {r('sum(b) FILTER (WHERE both_) / sum(a) FILTER (WHERE both_) - 1', 6)} AS growth,
      count(*) FILTER (WHERE both_ AND abs(b - a) < 1e-6) AS unchanged FROM j""",
)
def e45(spark, sf):
    e = exposure_long(spark, sf)
    return X.matched_growth(
        e.filter("arm = '2025_impute'"), e.filter("arm = '2026_impute'"), "firm", "mw"
    )


S25_SQL = f"""{SECTOR_SQL}, pair AS (SELECT a.firm, c_mktsegment = 'BUILDING' AS in_panel, a.fossil AS raw_a, b.fossil AS raw_b,
    a.fossil_share AS fa, b.fossil_share AS fb, a.coal_share AS ca, b.coal_share AS cb
  FROM sector_share a JOIN sector_share b ON a.firm = b.firm AND a.rel = 'old' AND b.rel = 'new' JOIN customer ON a.firm = 'C' || c_custkey),
meas AS (SELECT firm, in_panel, 'fossil' AS measure, raw_a AS a, raw_b AS b, raw_a, raw_b FROM pair
  UNION ALL SELECT firm, in_panel, 'fossil_share', fa, fb, raw_a, raw_b FROM pair UNION ALL SELECT firm, in_panel, 'coal_share', ca, cb, raw_a, raw_b FROM pair),
ok AS (SELECT * FROM meas WHERE a IS NOT NULL AND b IS NOT NULL),
uni AS (SELECT 'all' AS universe, * FROM ok UNION ALL SELECT 'panel', * FROM ok WHERE in_panel
  UNION ALL SELECT 'present in both', * FROM ok WHERE a > 0 OR b > 0 UNION ALL SELECT 'positive in both', * FROM ok WHERE a > 0 AND b > 0),
rk AS (SELECT universe, measure, {', '.join(f"rank() OVER (PARTITION BY universe, measure ORDER BY {c}) + (count(*) OVER (PARTITION BY universe, measure, {c}) - 1) / 2.0 AS r{c}" for c in ('a', 'b', 'raw_a', 'raw_b'))} FROM uni)"""


@query(
    "s25_measure_stability",
    f"""WITH {S25_SQL} SELECT universe, 'zero' AS rule, measure, count(*) AS n, {r('corr(ra, rb)', 6)} AS spearman, {r('corr(rraw_a, rraw_b)', 6)} AS raw_spearman,
      CASE WHEN corr(ra, rb) > 0.95 THEN 'footnote' ELSE 'reportable' END AS reading FROM rk GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
)
def s25(spark, sf):
    return rounded(stability_table(spark, sf), "spearman", "raw_spearman").drop("k", "lowest", "highest")


def _overlap_of(universe: str, measure: str) -> str:
    return f"""SELECT '{universe}' AS universe, 'zero' AS rule, '{measure}' AS measure, k, lowest, highest FROM (
      WITH src AS (SELECT * FROM uni WHERE universe = '{universe}' AND measure = '{measure}'),
      kk AS (SELECT greatest(1, CAST(round_even(count(*) / 5.0, 0) AS BIGINT)) AS k FROM src HAVING count(*) >= 10), {BOUNDS_SQL.format(a='a', b='b')} SELECT * FROM bounds)"""


UNIVERSES, MEASURES = ("all", "panel", "present in both", "positive in both"), ("fossil", "fossil_share", "coal_share")


@query(
    "s25_measure_overlap",
    f"WITH {S25_SQL} " + " UNION ALL ".join(_overlap_of(u, m) for u in UNIVERSES for m in MEASURES),
)
def s25_overlap(spark, sf):
    return stability_table(spark, sf).select("universe", "rule", "measure", "k", "lowest", "highest")


def stability_table(spark, sf):
    old = shares(spark, sf, "old").select("firm", *[F.col(c).alias(c + "_a") for c in ("fossil", "fossil_share", "coal_share")])
    new = shares(spark, sf, "new").select("firm", *[F.col(c).alias(c + "_b") for c in ("fossil", "fossil_share", "coal_share")])
    c = S.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("firm"), (F.col("c_mktsegment") == "BUILDING").alias("in_panel")
    )
    j = old.join(new, "firm").join(c, "firm")
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("measure"), F.col(m + "_a").alias("a"), F.col(m + "_b").alias("b"))
            for m in ("fossil", "fossil_share", "coal_share")
        ]
    )
    long = j.select(
        "firm", "in_panel", F.lit("zero").alias("rule"), F.col("fossil_a").alias("raw_a"),
        F.col("fossil_b").alias("raw_b"), F.inline(rows),
    )
    return K.stability(long, "firm")


# ---------------------------------------------------------------- set operations
@query(
    "h01_union_all",
    """SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL
    SELECT 'supplier', s_name FROM supplier UNION ALL SELECT 'part', p_name FROM part) GROUP BY kind""",
)
def h01(spark, sf):
    t = lambda n, c: S.table(spark, sf, n).select(F.lit(n).alias("kind"), F.col(c).alias("name"))
    return union_all(t("customer", "c_name"), t("supplier", "s_name"), t("part", "p_name")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "h02_union_distinct",
    f"""WITH {S.MEMBERS_SQL} SELECT symbol FROM member_current UNION SELECT added FROM member_event WHERE added <> ''
    UNION SELECT removed FROM member_event WHERE removed <> ''""",
)
def h02(spark, sf):
    from tidemark.operators.membership import universe

    return universe(S.member_events(spark, sf), S.member_current(spark, sf))


DATES_SQL = """o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)"""


def two_calendars(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    line = S.table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"))
    return o, line


@query("h03_intersection", f"WITH {DATES_SQL} SELECT CAST(d AS VARCHAR) AS d FROM (SELECT d FROM o INTERSECT SELECT d FROM l)")
def h03(spark, sf):
    o, line = two_calendars(spark, sf)
    return o.intersect(line).select(F.col("d").cast("string").alias("d"))


@query(
    "h04_difference_both_ways",
    f"""WITH {DATES_SQL} SELECT 'orders only' AS side, CAST(d AS VARCHAR) AS d FROM (SELECT d FROM o EXCEPT SELECT d FROM l)
    UNION ALL SELECT 'lineitem only', CAST(d AS VARCHAR) FROM (SELECT d FROM l EXCEPT SELECT d FROM o)""",
)
def h04(spark, sf):
    o, line = two_calendars(spark, sf)
    side = lambda a, b, n: a.subtract(b).select(F.lit(n).alias("side"), F.col("d").cast("string").alias("d"))
    return side(o, line, "orders only").unionByName(side(line, o, "lineitem only"))
