"""Queries on releases: diffs, buckets, ratios and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.cleaning import chain_depth, half_up, last_hop, path_product
from tidemark.operators import vintage as V
from tidemark.plans import standins as S
from tidemark.plans.registry import query, r
from tidemark.session import materialise

DIFF_SQL = (
    S.EDGES_SQL
    + """, diff AS (
  SELECT coalesce(o.subject, n.subject) AS subject, coalesce(o.party, n.party) AS party,
         o.share AS a, n.share AS b, coalesce(n.imputed, false) AS imputed,
         CASE WHEN o.subject IS NULL THEN 'new only' WHEN n.subject IS NULL THEN 'gone'
              ELSE 'both' END AS status,
         floor(abs(o.share - n.share) * 1000000.0 + 0.5) / 1000000.0 AS d
  FROM edge_old o FULL JOIN edge_new n ON o.subject = n.subject AND o.party = n.party),
cls AS (
  SELECT *, CASE
    WHEN status = 'new only' THEN 'BUILD-OUT'
    WHEN status = 'gone' THEN CASE WHEN subject IN (SELECT entity FROM dedup_map)
      OR party IN (SELECT entity FROM dedup_map) THEN 'METHODOLOGY' ELSE 'RESTATEMENT' END
    WHEN a IS NULL AND b IS NOT NULL THEN CASE WHEN imputed THEN 'METHODOLOGY' ELSE 'BUILD-OUT' END
    WHEN a IS NULL OR b IS NULL THEN 'UNCHANGED'
    WHEN d <= 0.06 THEN 'UNCHANGED' WHEN imputed THEN 'METHODOLOGY' ELSE 'RESTATEMENT' END AS bucket,
  CASE
    WHEN status = 'new only' THEN CASE WHEN subject IN (SELECT entity FROM entity_old)
      AND party IN (SELECT entity FROM entity_old) THEN 'new link between covered entities'
      ELSE 'entity newly covered' END
    WHEN status = 'gone' THEN CASE WHEN subject IN (SELECT entity FROM dedup_map)
      OR party IN (SELECT entity FROM dedup_map) THEN 'entity removed as duplicate' ELSE 'link removed' END
    WHEN a IS NULL AND b IS NOT NULL THEN CASE WHEN imputed THEN 'blank filled by imputation'
      ELSE 'blank filled by research' END
    WHEN a IS NULL OR b IS NULL THEN 'no comparable value'
    WHEN d <= 0.06 THEN 'same or rounding only' WHEN imputed THEN 'imputed share moved'
    WHEN d <= 1 THEN 'share revised, small' ELSE 'share revised, material' END AS detail
  FROM diff)
"""
)


def diff(spark, sf):
    return V.compare_releases(S.edges(spark, sf, repeated=True), S.OLD, S.NEW)


def classified(spark, sf):
    ents = S.entities(spark, sf).filter(F.col("release") == S.OLD)
    return V.classify(diff(spark, sf), ents, S.dedup_map(spark, sf))


@query(
    "c04_release_diff",
    f"WITH {DIFF_SQL} SELECT subject, party, a, b, imputed, status FROM diff",
)
def c04(spark, sf):
    return diff(spark, sf)


@query(
    "e09_change_buckets",
    f"""WITH {DIFF_SQL} SELECT coalesce(bucket, 'ALL') AS bucket, coalesce(detail, 'TOTAL') AS detail,
    count(*) AS edges, {r("100.0 * count(*) / (SELECT count(*) FROM cls WHERE bucket <> 'UNCHANGED')", 4)} AS pct
    FROM cls WHERE bucket <> 'UNCHANGED' GROUP BY ROLLUP (bucket, detail)""",
)
def e09(spark, sf):
    return V.change_buckets(classified(spark, sf))


BUCKETS_SQL = """, b AS (SELECT count(*) FILTER (WHERE bucket = 'BUILD-OUT') AS build,
  count(*) FILTER (WHERE bucket = 'RESTATEMENT') AS restate,
  count(*) FILTER (WHERE bucket = 'METHODOLOGY') AS method,
  count(*) FILTER (WHERE bucket = 'UNCHANGED') AS unchanged,
  count(*) FILTER (WHERE status = 'both') AS "both" FROM cls),
bb AS (SELECT *, build + restate + method AS changed,
  least(CAST(floor("both" * 0.052::DOUBLE) AS BIGINT), restate) AS ceiling FROM b)"""


@query(
    "e10_ratio_and_ceiling",
    f"""WITH {DIFF_SQL} {BUCKETS_SQL} SELECT build, restate, method, unchanged, "both", changed, ceiling,
    {r("(restate + method)::DOUBLE / changed", 6)} AS r,
    CASE WHEN (restate + method)::DOUBLE / changed >= 0.25 THEN 'GO'
         WHEN (restate + method)::DOUBLE / changed < 0.10 THEN 'NO-GO' ELSE 'JUDGEMENT' END AS verdict,
    {r("(restate - ceiling + method)::DOUBLE / changed", 6)} AS r_floor,
    (restate - ceiling + method)::DOUBLE / changed >= 0.25 AS floor_clears FROM bb""",
)
def e10(spark, sf):
    return V.ratio_and_ceiling(classified(spark, sf))


PAIR_SQL = (
    S.EDGES_SQL
    + ","
    + S.SEQ_SQL
    + """, pairs AS (
  SELECT rel, month, has_flag, lag(rel) OVER (ORDER BY rel) AS prev_rel,
         lag(month) OVER (ORDER BY rel) AS prev_month, row_number() OVER (ORDER BY rel) AS pos
  FROM seq_catalog WHERE has_sheet),
pm AS (SELECT *, (CAST(month[1:4] AS INTEGER) - CAST(prev_month[1:4] AS INTEGER)) * 12
   + CAST(month[6:7] AS INTEGER) - CAST(prev_month[6:7] AS INTEGER) AS months FROM pairs),
seq_cell AS (
  SELECT pm.rel AS pair, coalesce(a.subject, b.subject) AS subject, coalesce(a.party, b.party) AS party,
         a.share AS a, b.share AS b, a.subject IS NOT NULL AS has_a, b.subject IS NOT NULL AS has_b,
         coalesce(b.imputed, false) AS imp, pm.has_flag,
         floor(abs(a.share - b.share) * 1000000.0 + 0.5) / 1000000.0 AS d
  FROM (SELECT p.rel AS pair, e.* FROM pairs p JOIN release_seq e ON e.rel = p.prev_rel) a
  FULL JOIN (SELECT p.rel AS pair, e.* FROM pairs p JOIN release_seq e ON e.rel = p.rel
             WHERE p.prev_rel IS NOT NULL) b
    ON a.pair = b.pair AND a.subject = b.subject AND a.party = b.party
  JOIN pm ON pm.rel = coalesce(a.pair, b.pair)),
seq_kept2 AS (
  SELECT *, subject IN (SELECT entity FROM dedup_map) OR party IN (SELECT entity FROM dedup_map) AS dup
  FROM seq_cell WHERE NOT has_a OR NOT has_b OR (a IS NULL AND b IS NOT NULL) OR d > 0.06),
seq_cls AS (
  SELECT pair,
    CASE WHEN NOT has_a THEN 'B' WHEN NOT has_b AND dup THEN 'M' WHEN NOT has_b THEN 'R'
         WHEN a IS NULL AND NOT has_flag THEN 'U' WHEN a IS NULL AND imp THEN 'M' WHEN a IS NULL THEN 'B'
         WHEN has_flag AND imp THEN 'M' ELSE 'R' END AS aware,
    CASE WHEN NOT has_a THEN 'B' WHEN NOT has_b AND dup THEN 'M' WHEN NOT has_b THEN 'R'
         WHEN a IS NULL THEN 'U' ELSE 'R' END AS blind
  FROM seq_kept2),
pair_table AS (
  SELECT prev_month, month, months, has_flag, changed, """
    + ", ".join(
        f"floor((100.0::DOUBLE * {k}_{v} / changed) * 10.0 + 0.5) / 10.0 AS {k}_{v}_pct"
        for v in ("aware", "blind")
        for k in ("build", "restate", "method", "unattr")
    )
    + """ FROM pm JOIN (SELECT pair, count(*) AS changed, """
    + ", ".join(
        f"count(*) FILTER (WHERE {v} = '{c}') AS {k}_{v}"
        for v in ("aware", "blind")
        for k, c in (("build", "B"), ("restate", "R"), ("method", "M"), ("unattr", "U"))
    )
    + """ FROM seq_cls GROUP BY pair) c ON c.pair = pm.rel)
"""
)


def pair_table(spark, sf):
    return V.decompose_pairs(
        S.release_seq(spark, sf, repeated=True), S.seq_catalog(spark, sf), S.dedup_map(spark, sf)
    )


@query(
    "f08_release_pairs",
    f"WITH {PAIR_SQL} SELECT CAST(rel AS INTEGER) AS rel, month, has_flag, CAST(prev_rel AS INTEGER) AS prev_rel, prev_month, CAST(pos AS INTEGER) AS pos, months FROM pm",
)
def f08(spark, sf):
    return V.release_pairs(S.seq_catalog(spark, sf))


@query("e11_pair_decomposition", f"WITH {PAIR_SQL} SELECT * FROM pair_table")
def e11(spark, sf):
    return pair_table(spark, sf)


@query(
    "e12_monthly_rates",
    f"""WITH {PAIR_SQL} SELECT prev_month, month,
    {r("changed * build_blind_pct / 100 / months", 4)} AS build_rate,
    {r("changed * restate_blind_pct / 100 / months", 4)} AS restate_rate FROM pair_table""",
)
def e12(spark, sf):
    return V.monthly_rates(pair_table(spark, sf))


HALF_SQL = (
    PAIR_SQL
    + """, numbered AS (SELECT *, row_number() OVER (ORDER BY month) AS i, count(*) OVER () AS n FROM pair_table),
half AS (SELECT """
    + ", ".join(
        f"{fn}({v}) FILTER (WHERE {cond}) AS {v}_{h}_{nm}"
        for v in ("build_blind_pct", "restate_blind_pct")
        for h, cond in (("first", "i <= n // 2"), ("second", "i > n // 2"))
        for fn, nm in (("avg", "mean"), ("var_samp", "var"), ("count", "n"))
    )
    + " FROM numbered)"
)


@query(
    "f16_half_means",
    f"WITH {HALF_SQL} SELECT "
    + ", ".join(
        f"{r(f'{v}_{h}_mean', 6)} AS {v}_{h}_mean, {r(f'{v}_{h}_var', 6)} AS {v}_{h}_var, {v}_{h}_n"
        for v in ("build_blind_pct", "restate_blind_pct")
        for h in ("first", "second")
    )
    + " FROM half",
)
def f16(spark, sf):
    h = V.halves(pair_table(spark, sf), "month", ["build_blind_pct", "restate_blind_pct"])
    return h.select(
        *[
            (F.col(c) if c.endswith("_n") else half_up(F.col(c), 6)).alias(c) for c in h.columns
        ]
    )


S14_SQL = (
    HALF_SQL
    + """, w AS (SELECT build_blind_pct_first_mean - build_blind_pct_second_mean AS dm,
   build_blind_pct_first_var / build_blind_pct_first_n AS qa, build_blind_pct_second_var / build_blind_pct_second_n AS qb,
   build_blind_pct_first_n AS na, build_blind_pct_second_n AS nb FROM half),
tr AS (SELECT regr_slope(build_blind_pct, i - 1) AS slope, regr_sxx(build_blind_pct, i - 1) AS sxx,
   regr_syy(build_blind_pct, i - 1) AS syy, count(*) AS n FROM numbered),
co AS (SELECT corr(build_blind_pct, months) AS rho, count(*) AS n FROM numbered),
tests AS (
  SELECT 'welch' AS test, dm AS estimate, dm / sqrt(qa + qb) AS t,
         (qa + qb) * (qa + qb) / (qa * qa / (na - 1) + qb * qb / (nb - 1)) AS df FROM w
  UNION ALL SELECT 'trend', slope, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx), n - 2 FROM tr
  UNION ALL SELECT 'corr', rho, rho * sqrt((n - 2) / (1.0 - rho * rho)), n - 2 FROM co)
"""
)


def tests(spark, sf):
    from pyspark.sql import Window

    p = materialise(pair_table(spark, sf))
    h = V.halves(p, "month", ["build_blind_pct"])
    w = Window.partitionBy(F.lit(0)).orderBy("month")
    numbered = p.select(
        F.col("build_blind_pct").alias("y"), "months",
        (F.row_number().over(w) - 1).alias("x"),
    )
    return (
        stats.welch(h, "build_blind_pct")
        .unionByName(stats.trend(numbered, "y", "x"))
        .unionByName(stats.correlation_test(numbered, "y", "months"))
    )


@query(
    "s14_trend_tests",
    f"WITH {S14_SQL} SELECT test, {r('estimate', 6)} AS estimate, {r('t', 6)} AS t, {r('df', 6)} AS df FROM tests",
)
def s14(spark, sf):
    t = tests(spark, sf)
    return t.select("test", *[half_up(F.col(c), 6).alias(c) for c in ("estimate", "t", "df")])


# the p-values by Simpson's rule on the density, as the SQL has no incomplete beta either
@query(
    "s15_p_values",
    f"""WITH {S14_SQL}, g AS (SELECT unnest(generate_series(0, 20000)) AS i),
    v AS (SELECT test, estimate, t, df, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) AS c,
      sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + t * t * (i / 20000.0) * (i / 20000.0) / df, -(df + 1) / 2)) AS area
      FROM tests, g GROUP BY test, estimate, t, df)
    SELECT test, {r('estimate', 6)} AS estimate, {r('t', 6)} AS t, {r('df', 6)} AS df, {r('1 - 2 * c * abs(t) / 60000 * area', 6)} AS p FROM v""",
)
def s15(spark, sf):
    t = tests(spark, sf).withColumn("p", stats.two_sided_p("t", "df"))
    return t.select("test", *[half_up(F.col(c), 6).alias(c) for c in ("estimate", "t", "df", "p")])


PATHS_SQL = (
    S.EDGES_SQL
    + """, path_row AS (
  SELECT 'P' || s AS unit, 'S' || p AS party, share_old AS a, share_new AS b, q_old IS NOT NULL AS in_old,
    q_new IS NOT NULL AS in_new,
    CASE WHEN p >= 9 THEN 'S' || (p // 9) || ' -> S' || (p // 3) || ' [60.0%] -> S' || p || ' [60.0%] -> P' || s
         ELSE 'S' || (p // 3) || ' -> S' || p || ' [60.0%] -> P' || s END
      || coalesce(' [' || printf('%.2f', share_old) || '%]', '') AS path_old,
    CASE WHEN (s + p) % 5 = 0 THEN 'H' || (p % 7) || ' -> ' ELSE '' END ||
    CASE WHEN p >= 9 AND (s + p) % 7 <> 0
         THEN 'S' || (p // 9) || ' -> S' || (p // 3) || ' [60.0%] -> S' || p || ' [60.0%] -> P' || s
         ELSE 'S' || (p // 3) || ' -> S' || p || ' [60.0%] -> P' || s END
      || coalesce(' [' || printf('%.2f', share_new) || '%]', '') AS path_new
  FROM edge_both),
path_depth AS (
  SELECT *, (length(path_old) - length(replace(path_old, '->', ''))) // 2 AS depth_old,
         (length(path_new) - length(replace(path_new, '->', ''))) // 2 AS depth_new FROM path_row)
"""
)


def paths(spark, sf):
    e = S._edge_both(spark, sf)
    s = F.substring("subject", 2, 20).cast("long")
    p = F.substring("party", 2, 20).cast("long")
    e = e.withColumn("s", s).withColumn("p", p)
    tail = lambda c: F.coalesce(
        F.concat(F.lit(" ["), F.when(F.col(c).isNotNull(), F.format_string("%.2f", c)), F.lit("%]")),
        F.lit(""),
    )
    long = F.expr(
        "concat('S', p div 9, ' -> S', p div 3, ' [60.0%] -> S', p, ' [60.0%] -> P', s)"
    )
    short = F.expr("concat('S', p div 3, ' -> S', p, ' [60.0%] -> P', s)")
    head = F.when((F.col("s") + F.col("p")) % 5 == 0, F.concat(F.lit("H"), F.col("p") % 7, F.lit(" -> ")))
    return e.select(
        F.col("subject").alias("unit"), "party", F.col("share_old").alias("a"),
        F.col("share_new").alias("b"), F.col("q_old").isNotNull().alias("in_old"),
        F.col("q_new").isNotNull().alias("in_new"),
        F.concat(F.when(F.col("p") >= 9, long).otherwise(short), tail("share_old")).alias("path_old"),
        F.concat(
            F.coalesce(head, F.lit("")),
            F.when((F.col("p") >= 9) & ((F.col("s") + F.col("p")) % 7 != 0), long).otherwise(short),
            tail("share_new"),
        ).alias("path_new"),
    ).withColumns(
        {"depth_old": chain_depth(F.col("path_old")), "depth_new": chain_depth(F.col("path_new"))}
    )


@query(
    "e13_chain_crosstab",
    f"""WITH {PATHS_SQL}, t AS (SELECT CASE WHEN depth_new > depth_old THEN 'lengthened'
      WHEN depth_new = depth_old THEN 'same' ELSE 'shortened' END AS chain,
      coalesce(floor(abs(a - b) * 1000000.0 + 0.5) / 1000000.0 > 1, false) AS big
      FROM path_depth WHERE in_old AND in_new)
    SELECT chain, count(*) FILTER (WHERE big) AS moved, count(*) FILTER (WHERE NOT big) AS stable,
    {r("100.0::DOUBLE * count(*) FILTER (WHERE big) / count(*)", 4)} AS moved_pct FROM t GROUP BY chain""",
)
def e13(spark, sf):
    return V.chain_crosstab(paths(spark, sf).filter("in_old and in_new"))


@query(
    "e14_mean_chain_depth",
    f"""WITH {PATHS_SQL} SELECT {r("avg(depth_old) FILTER (WHERE in_old)", 6)} AS depth_old,
    {r("avg(depth_new) FILTER (WHERE in_new)", 6)} AS depth_new FROM path_depth""",
)
def e14(spark, sf):
    p = V.mean_depths(paths(spark, sf))
    return p.select(*[half_up(F.col(c), 6).alias(c) for c in p.columns])


@query(
    "b12_b13_b14_path_rules",
    f"""WITH {PATHS_SQL}, x AS (SELECT unit, party, depth_old,
      list_transform(regexp_extract_all(path_old, '\\[([0-9.]+)%\\]', 1), lambda v: CAST(v AS DOUBLE)) AS v FROM path_depth)
    SELECT unit, party, CAST(depth_old AS INTEGER) AS depth, v[-1] / 100 AS last_hop,
    {r("CASE len(v) WHEN 1 THEN 100.0::DOUBLE * v[1] / 100 WHEN 2 THEN 100.0::DOUBLE * v[1] / 100 * v[2] / 100 "
       "WHEN 3 THEN 100.0::DOUBLE * v[1] / 100 * v[2] / 100 * v[3] / 100 END", 6)} AS product FROM x""",
)
def b12(spark, sf):
    p = paths(spark, sf)
    return p.select(
        "unit", "party", F.col("depth_old").alias("depth"), last_hop(F.col("path_old")).alias("last_hop"),
        half_up(path_product(F.col("path_old")), 6).alias("product"),
    )


@query(
    "e15_entity_churn",
    """WITH k AS (
      SELECT 'C' || c_custkey AS entity, c_custkey % 19 <> 7 AS o, c_custkey % 37 <> 4 AS n,
             c_acctbal > 3000 AS fo, c_acctbal > 3000 + (c_custkey % 5) * 100 - 200 AS fn FROM customer)
    SELECT count(*) FILTER (WHERE o) AS n_old, count(*) FILTER (WHERE n) AS n_new,
      count(*) FILTER (WHERE o AND n) AS n_both, count(*) FILTER (WHERE o AND NOT n) AS n_gone,
      count(*) FILTER (WHERE n AND NOT o) AS n_added,
      count(*) FILTER (WHERE o AND n AND fo AND NOT fn) AS true_to_false,
      count(*) FILTER (WHERE o AND n AND NOT fo AND fn) AS false_to_true FROM k WHERE o OR n""",
)
def e15(spark, sf):
    c = S.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    keys = c.select(
        F.concat(F.lit("C"), k).alias("entity"),
        F.inline(
            F.filter(
                F.array(
                    F.struct(F.lit(S.OLD).alias("release"), (bal > 3000).alias("listed"), (k % 19 != 7).alias("on")),
                    F.struct(F.lit(S.NEW).alias("release"), (bal > 3000 + (k % 5) * 100 - 200).alias("listed"), (k % 37 != 4).alias("on")),
                ),
                lambda x: x["on"],
            )
        ),
    )
    return V.key_churn(keys, S.OLD, S.NEW, "listed")


WRITTEN_SQL = (
    S.EDGES_SQL
    + """, written AS (
  SELECT 'P' || s AS subject, 'S' || p AS party, coalesce(printf('%.2f%%', share_old), '') AS a_text,
         printf('%.1f', share_new) AS b_text
  FROM edge_both WHERE q_old IS NOT NULL AND q_new IS NOT NULL)
"""
)


def written(spark, sf):
    return S._edge_both(spark, sf).filter("q_old is not null and q_new is not null").select(
        "subject", "party",
        F.coalesce(
            F.when(F.col("share_old").isNotNull(), F.format_string("%.2f%%", "share_old")), F.lit("")
        ).alias("a_text"),
        F.format_string("%.1f", "share_new").alias("b_text"),
    )


DEC_SQL = "length(rtrim(regexp_extract({0}, '\\.(\\d*)', 1), '0'))"


@query(
    "e16_precision_loss",
    f"""WITH {WRITTEN_SQL}, w AS (SELECT try_cast(replace(a_text, '%', '') AS DOUBLE) AS a,
      try_cast(b_text AS DOUBLE) AS b, {DEC_SQL.format("replace(a_text, '%', '')")} AS da,
      {DEC_SQL.format("b_text")} AS db FROM written),
    x AS (SELECT *, {r("a", 6)} <> {r("b", 6)} AS differs, floor(abs(a - b) * 1000000.0 + 0.5) / 1000000.0 AS d,
      {r("round_even(a * 10.0, 0) / 10.0", 6)} = {r("b", 6)} AS rounds FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT count(*) AS matched, count(*) FILTER (WHERE da >= 2) AS old_two_places,
      count(*) FILTER (WHERE db >= 2) AS new_two_places, count(*) FILTER (WHERE differs) AS differs,
      count(*) FILTER (WHERE differs AND da > 1 AND rounds) AS strict,
      count(*) FILTER (WHERE differs AND ((da > 1 AND rounds) OR abs(a - b) < 0.05)) AS broad,
      count(*) FILTER (WHERE differs AND d <= 0.06) AS suppressed,
      count(*) FILTER (WHERE differs AND d > 0.06) AS survives FROM x""",
)
def e16(spark, sf):
    return V.precision_loss(written(spark, sf))


NAMES_SQL = """, names_old AS (SELECT CASE WHEN s_suppkey % 23 = 5 THEN 'O' ELSE 'S' END || s_suppkey AS entity, s_name AS name FROM supplier),
names_new AS (SELECT CASE WHEN s_suppkey % 5 = 2 THEN 'N' ELSE 'S' END || s_suppkey AS entity,
   CASE WHEN s_suppkey % 6 = 1 THEN 'Small Shareholder(s)' ELSE s_name || ' Ltd' END AS name
   FROM supplier),
names AS (SELECT coalesce(n.entity, o.entity) AS entity, coalesce(n.name, o.name) AS name
   FROM names_old o FULL JOIN names_new n ON o.entity = n.entity)
"""


def name_map(spark, sf):
    from tidemark.operators.joins import later_wins

    s = S.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    k = F.col("s_suppkey")
    e = lambda other, head: F.concat(F.when(other, head).otherwise("S"), k).alias("entity")
    old = s.select(e(k % 23 == 5, "O"), F.col("s_name").alias("name"))
    new = s.select(
        e(k % 5 == 2, "N"),
        F.when(F.col("s_suppkey") % 6 == 1, "Small Shareholder(s)")
        .otherwise(F.concat("s_name", F.lit(" Ltd"))).alias("name"),
    )
    return later_wins(old, new, "entity", "name")


@query("c10_later_name_wins", "WITH " + NAMES_SQL[2:] + "SELECT entity, name FROM names")
def c10(spark, sf):
    return name_map(spark, sf)


@query(
    "e17_restricted_ratio",
    f"""WITH {DIFF_SQL} {NAMES_SQL}, c AS (SELECT bucket, n.name,
      coalesce(regexp_matches(lower(n.name), 'small shareholder|natural person|other shareholder|unknown|various'), false) AS res
      FROM cls LEFT JOIN names n ON cls.party = n.entity WHERE bucket <> 'UNCHANGED'),
    s AS (SELECT count(*) FILTER (WHERE bucket = 'BUILD-OUT') AS build,
      count(*) FILTER (WHERE bucket = 'BUILD-OUT' AND res) AS build_residual,
      count(*) FILTER (WHERE bucket = 'RESTATEMENT') AS restate,
      count(*) FILTER (WHERE bucket = 'RESTATEMENT' AND res) AS restate_residual,
      count(*) FILTER (WHERE bucket = 'METHODOLOGY') AS method,
      count(*) FILTER (WHERE bucket = 'METHODOLOGY' AND res) AS method_residual,
      count(*) FILTER (WHERE name IS NULL) AS unnamed FROM c),
    t AS (SELECT *, (restate + method)::DOUBLE / (build + restate + method) AS r0,
      (restate + method - restate_residual - method_residual)::DOUBLE /
      (build + restate + method - build_residual - restate_residual - method_residual) AS r1 FROM s)
    SELECT build, build_residual, restate, restate_residual, method, method_residual, unnamed,
      {r("r0", 6)} AS r, {r("r1", 6)} AS r_restricted, r1 >= 0.25 AS clears FROM t""",
)
def e17(spark, sf):
    return V.restricted_ratio(classified(spark, sf), name_map(spark, sf))


WILSON_SQL = """greatest(0.0, (({k}) + 1.9208) / (({n}) + 3.8416) - 1.96 / (({n}) + 3.8416) *
  sqrt(({k})::DOUBLE * (({n}) - ({k})) / ({n}) + 0.9604))"""
WILSON_HI_SQL = """least(1.0, (({k}) + 1.9208) / (({n}) + 3.8416) + 1.96 / (({n}) + 3.8416) *
  sqrt(({k})::DOUBLE * (({n}) - ({k})) / ({n}) + 0.9604))"""

VERDICT_SQL = """verdicts AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k1,
         count(*) FILTER (WHERE l_returnflag <> 'A') AS k2 FROM lineitem)
"""


def verdicts(spark, sf):
    """Verdict counts of a validated sample: R = real, N = real but misdated."""
    return S.table(spark, sf, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k1"),
        F.count_if(F.col("l_returnflag") != "A").alias("k2"),
    )


@query(
    "s16_wilson_interval",
    f"""WITH g AS (SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT brand, n, k, {r(WILSON_SQL.format(k='k', n='n'), 6)} AS low, {r(WILSON_HI_SQL.format(k='k', n='n'), 6)} AS high FROM g""",
)
def s16(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag")
    part = S.table(spark, sf, "part").select("p_partkey", "p_brand")
    g = (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    )
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("brand", "n", "k", half_up(low, 6).alias("low"), half_up(high, 6).alias("high"))


@query(
    "e18_ratio_ladder",
    f"""WITH {DIFF_SQL} {BUCKETS_SQL}, {VERDICT_SQL}, readings AS (
      SELECT 'not applied' AS reading, 0.0::DOUBLE AS v UNION ALL
      SELECT 'in window', k1::DOUBLE / n FROM verdicts UNION ALL
      SELECT 'strict', k2::DOUBLE / n FROM verdicts UNION ALL
      SELECT 'strict, upper bound', {WILSON_HI_SQL.format(k='k2', n='n')} FROM verdicts)
    SELECT 'pinned' AS release, reading, {r("v", 6)} AS v,
      {r("(restate * (1 - v) + method) / (build + restate + method)", 6)} AS r,
      CASE WHEN (restate * (1 - v) + method) / (build + restate + method) >= 0.25 THEN 'clears' ELSE 'FAILS' END AS verdict
    FROM b, readings""",
)
def e18(spark, sf):
    c = V.ratio_and_ceiling(classified(spark, sf)).select(
        F.lit("pinned").alias("release"), "build", "restate", "method"
    )
    v = verdicts(spark, sf)
    _, high = stats.wilson(F.col("k2"), F.col("n"))
    row = lambda name, x: F.struct(F.lit(name).alias("reading"), x.cast("double").alias("v"))
    readings = v.select(
        F.inline(
            F.array(
                row("not applied", F.lit(0.0)), row("in window", F.col("k1") / F.col("n")),
                row("strict", F.col("k2") / F.col("n")), row("strict, upper bound", high),
            )
        )
    )
    return V.ladder(c, readings)


@query(
    "d09_owner_set_changes",
    """WITH o AS (SELECT p_type AS sector, l_partkey AS unit, 'immediate' AS kind, l_suppkey AS owner,
      l_shipdate < TIMESTAMP '1999-01-01' AS old FROM lineitem JOIN part ON l_partkey = p_partkey),
    rows AS (SELECT * FROM o UNION ALL SELECT sector, unit, 'parent', CAST(owner // 20 AS BIGINT), old FROM o),
    rel AS (SELECT 1 AS release, sector, unit, kind, owner FROM rows WHERE old
            UNION ALL SELECT 2, sector, unit, kind, owner FROM rows),
    sets AS (SELECT release, sector, unit, kind, list_sort(list(DISTINCT owner)) AS owners FROM rel GROUP BY ALL),
    j AS (SELECT a.sector, a.kind, a.owners <> b.owners AS chg FROM sets a JOIN sets b ON a.release = 1
      AND b.release = 2 AND a.sector = b.sector AND a.unit = b.unit AND a.kind = b.kind)
    SELECT sector, count(*) FILTER (WHERE kind = 'parent') AS assets,
      count(*) FILTER (WHERE kind = 'parent' AND chg) AS parent_changed,
      count(*) FILTER (WHERE kind = 'immediate' AND chg) AS immediate_changed FROM j GROUP BY sector""",
)
def d09(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    part = S.table(spark, sf, "part").select("p_partkey", "p_type")
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    o = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("sector"), F.col("l_partkey").alias("unit"), "l_suppkey",
        F.explode(F.when(early, F.array(F.lit(S.OLD), F.lit(S.NEW))).otherwise(F.array(F.lit(S.NEW)))).alias("release"),
    )
    rows = o.select(
        "sector", "unit", "release",
        F.inline(
            F.array(
                F.struct(F.lit("immediate").alias("kind"), F.col("l_suppkey").alias("owner")),
                F.struct(F.lit("parent").alias("kind"), F.expr("l_suppkey div 20").alias("owner")),
            )
        ),
    )
    return V.owner_set_changes(rows, S.OLD, S.NEW)


@query(
    "e44_schema_drift",
    f"""WITH {S.SEQ_SQL}, lay AS (SELECT month, CASE WHEN has_sheet THEN 2 ELSE 1 END AS sheets,
      CASE WHEN rel < 4 THEN 'Full Entity ID' ELSE 'Entity ID' END AS entity_key,
      CASE WHEN has_sheet THEN CASE WHEN has_flag THEN 4 ELSE 3 END ELSE 0 END AS ownership_cols, rel >= 6 AS has_review FROM seq_catalog)
    SELECT *, (SELECT count(DISTINCT entity_key) FROM lay) AS distinct_keys, (SELECT count(DISTINCT ownership_cols) FROM lay) AS distinct_widths,
      (SELECT count(DISTINCT has_review) FROM lay) AS distinct_reviews FROM lay""",
)
def e44(spark, sf):
    edges, names = S.release_seq(spark, sf), S.table(spark, sf, "part")
    releases = {}
    for c in sorted(S.seq_catalog(spark, sf).collect()):  # one row per release
        entities = names.select(F.concat(F.lit("P"), "p_partkey").alias("Full Entity ID" if c["rel"] < 4 else "Entity ID"), "p_name")
        if c["rel"] >= 6:
            entities = entities.withColumn(V.REVIEW, F.lit(c["month"]))
        releases[c["month"]] = {"entities": entities}
        if c["has_sheet"]:
            here = edges.filter(F.col("rel") == c["rel"])
            releases[c["month"]]["ownership"] = here.select("subject", "party", "share", *(["imputed"] if c["has_flag"] else []))
    return V.schema_drift(V.layouts(spark, releases))


@query(
    "q02_self_checks",
    f"""WITH {DIFF_SQL} SELECT 'both releases without blanks agree' AS name,
      count(*) FILTER (WHERE share IS NULL) = 0 AS pass FROM edge_new
    UNION ALL SELECT 'buckets add up', count(*) = count(bucket) FROM cls
    UNION ALL SELECT 'shares do not exceed the whole', count(*) = 0 FROM
      (SELECT subject FROM edge_old GROUP BY subject HAVING sum(share) > 100.5)""",
)
def q02(spark, sf):
    from tidemark.operators.audit import expectations

    e = S.edges(spark, sf)
    blanks = e.filter(F.col("release") == S.NEW).agg(
        (F.count_if(F.col("share").isNull()) == 0).alias("both releases without blanks agree")
    )
    adds = classified(spark, sf).agg((F.count(F.lit(1)) == F.count("bucket")).alias("buckets add up"))
    over = (
        e.filter(F.col("release") == S.OLD).groupBy("subject").agg(F.sum("share").alias("t"))
        .agg((F.count_if(F.col("t") > 100.5) == 0).alias("shares do not exceed the whole"))
    )
    return expectations(blanks, adds, over)


@query(
    "q03_threshold_verdicts",
    f"""WITH {S.EDGES_SQL}, g AS (SELECT subject, count(*)::DOUBLE AS n, count(share)::DOUBLE AS k FROM edge_old GROUP BY 1)
    SELECT CASE WHEN 1 - k / n >= 0.25 THEN 'GO' WHEN 1 - k / n < 0.10 THEN 'NO-GO' ELSE 'JUDGEMENT' END AS verdict,
    count(*) AS subjects FROM g GROUP BY 1""",
)
def q03(spark, sf):
    g = (
        S.edges(spark, sf).filter(F.col("release") == S.OLD).groupBy("subject")
        .agg((1 - F.count("share") / F.count(F.lit(1))).alias("blank"))
    )
    return g.groupBy(V.verdict(F.col("blank")).alias("verdict")).agg(F.count(F.lit(1)).alias("subjects"))
