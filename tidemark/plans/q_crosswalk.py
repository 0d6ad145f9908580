"""Queries on identifiers, listings and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.functions import identifiers as I
from tidemark.functions.cleaning import half_up
from tidemark.operators import crosswalk as W
from tidemark.operators import names as N
from tidemark.operators.ordering import quantiles
from tidemark.plans import standins as S
from tidemark.plans.q_graph import rounded
from tidemark.plans.registry import query, r
from tidemark.session import materialise

# ---------------------------------------------------------------- text rules on entity rows
ENTITY_SQL = """entity AS (SELECT 'C' || c_custkey AS entity, c_name AS name, c_nationkey AS hq,
  CASE c_custkey % 11 WHEN 3 THEN 'not found' WHEN 4 THEN '' WHEN 5 THEN ' None ' WHEN 6 THEN 'L123'
    ELSE 'L' || lpad(CAST(c_custkey AS VARCHAR), 19, '0') END AS lei,
  CASE WHEN c_custkey % 3 = 0 THEN 'nan' ELSE 'P' || c_custkey END AS permid,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '000' || c_custkey END AS cik,
  CASE WHEN c_acctbal > 5000 THEN ' True ' ELSE 'false' END AS listed,
  CASE c_custkey % 5 WHEN 0 THEN printf('%.2f%%', c_acctbal) WHEN 1 THEN '1,234.5' WHEN 2 THEN 'n/a' WHEN 3 THEN '51.30'
    ELSE CAST(c_custkey AS VARCHAR) END AS share_text,
  CASE c_custkey % 4 WHEN 0 THEN 'Operating|retired' WHEN 1 THEN 'operating pre-retirement' WHEN 2 THEN 'mothballed' ELSE 'Shelved|Operating ' END AS status,
  c_acctbal FROM customer)"""


def entity(spark, sf):
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    m = k % 11
    return S.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), k).alias("entity"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("hq"),
        F.when(m == 3, "not found").when(m == 4, "").when(m == 5, " None ").when(m == 6, "L123")
        .otherwise(F.concat(F.lit("L"), F.lpad(k.cast("string"), 19, "0"))).alias("lei"),
        F.when(k % 3 == 0, "nan").otherwise(F.concat(F.lit("P"), k)).alias("permid"),
        F.when(k % 4 != 1, F.concat(F.lit("000"), k)).alias("cik"),
        F.when(bal > 5000, " True ").otherwise("false").alias("listed"),
        F.when(k % 5 == 0, F.format_string("%.2f%%", bal)).when(k % 5 == 1, "1,234.5").when(k % 5 == 2, "n/a")
        .when(k % 5 == 3, "51.30").otherwise(k.cast("string")).alias("share_text"),
        F.when(k % 4 == 0, "Operating|retired").when(k % 4 == 1, "operating pre-retirement")
        .when(k % 4 == 2, "mothballed").otherwise("Shelved|Operating ").alias("status"),
        "c_acctbal",
    )


BLANK = "({c} IS NULL OR trim({c}) = '' OR lower(trim({c})) IN ('not found', 'not applicable', 'none', 'nan'))"


@query(
    "b02_b05_identifier_flags",
    f"""WITH {ENTITY_SQL} SELECT entity, {BLANK.format(c='lei')} AS lei_blank, lower(trim(listed)) = 'true' AS listed,
      NOT {BLANK.format(c='lei')} AND length(trim(lei)) = 20 AS has_lei, NOT {BLANK.format(c='permid')} AS has_permid,
      NOT {BLANK.format(c='lei')} OR NOT {BLANK.format(c='permid')} AS identified, NOT {BLANK.format(c='cik')} AS has_cik FROM entity""",
)
def b02(spark, sf):
    e = entity(spark, sf)
    return e.select(
        "entity", C.blank(F.col("lei")).alias("lei_blank"), I.flag(F.col("listed")).alias("listed"),
        I.has_lei(F.col("lei")).alias("has_lei"), (~C.blank(F.col("permid"))).alias("has_permid"),
        I.identified(F.col("lei"), F.col("permid")).alias("identified"), (~C.blank(F.col("cik"))).alias("has_cik"),
    )


@query(
    "b03_b04_b11_number_rules",
    f"""WITH {ENTITY_SQL} SELECT entity, coalesce(try_cast(rtrim(trim(share_text), '%') AS DOUBLE), 0) / 100 AS fraction,
      try_cast(regexp_replace(share_text, '[,%]', '', 'g') AS DOUBLE) AS number,
      CASE WHEN try_cast(rtrim(share_text, '%') AS DOUBLE) IS NOT NULL
           THEN CAST(length(rtrim(regexp_extract(rtrim(share_text, '%'), '\\.(\\d*)', 1), '0')) AS INTEGER) END AS places FROM entity""",
)
def b03(spark, sf):
    t = F.col("share_text")
    return entity(spark, sf).select(
        "entity", C.fraction(t).alias("fraction"), C.number(t).alias("number"), C.decimals(t).alias("places")
    )


@query(
    "b06_operating_status",
    f"""WITH {ENTITY_SQL} SELECT status, count(*) AS n, list_has_any(string_split(lower(trim(status)), '|'), ['operating', 'operating pre-retirement']) AS operating
    FROM entity GROUP BY status""",
)
def b06(spark, sf):
    return entity(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "operating", I.operating(F.col("status"))
    )


@query(
    "b07_region_members",
    """SELECT 'C' || c_custkey AS entity FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('AMERICA', 'EUROPE'))""",
)
def b07(spark, sf):
    keep = S.table(spark, sf, "nation").join(
        S.table(spark, sf, "region").filter(F.col("r_name").isin("AMERICA", "EUROPE")),
        F.col("n_regionkey") == F.col("r_regionkey"),
    ).select(F.col("n_nationkey").alias("c_nationkey"))
    return S.table(spark, sf, "customer").join(keep, "c_nationkey", "left_semi").select(
        F.concat(F.lit("C"), "c_custkey").alias("entity")
    )


# ---------------------------------------------------------------- security codes
CODES_SQL = f"""{S.CANDIDATES_SQL}, code AS (SELECT entity, symbol, lei, hq, exchange, dollar_vol, bars, share_vol, c_name, s_name,
   CASE WHEN hq % 4 = 0 THEN 'US' ELSE 'N' || chr(65 + hq) END AS home_iso,
   CASE WHEN exchange % 4 = 0 THEN 'US' ELSE 'N' || chr(65 + exchange) END || lpad(CAST((CAST(entity[2:] AS BIGINT) * 7919 + CAST(symbol[2:] AS BIGINT) * 104729) % 100000000 AS VARCHAR), 8, '0')
     || CASE WHEN CAST(symbol[2:] AS BIGINT) % 3 = 0 THEN 'A0' WHEN CAST(symbol[2:] AS BIGINT) % 3 = 1 THEN '00' ELSE '05' END AS isin FROM candidate),
usable_code AS (SELECT *, isin[1:2] = home_iso AS domestic, CASE WHEN isin[1:2] <> 'US' THEN true ELSE regexp_matches(substr(isin, 9, 2), '^[0-9]0$') END AS equity FROM code)"""


def codes(spark, sf):
    iso = lambda c: F.when(F.col(c) % 4 == 0, "US").otherwise(F.concat(F.lit("N"), F.char(65 + F.col(c))))
    e = F.substring("entity", 2, 20).cast("long")
    s = F.substring("symbol", 2, 20).cast("long")
    body = F.lpad(((e * 7919 + s * 104729) % 100000000).cast("string"), 8, "0")
    tail = F.when(s % 3 == 0, "A0").when(s % 3 == 1, "00").otherwise("05")
    c = S.candidates(spark, sf).withColumns(
        {"home_iso": iso("hq"), "isin": F.concat(iso("exchange"), body, tail)}
    )
    return c.withColumns(
        {"domestic": I.domestic(F.col("isin"), F.col("home_iso")), "equity": I.equity_issue(F.col("isin"))}
    )


@query(
    "b08_b09_code_rules",
    f"WITH {CODES_SQL} SELECT domestic, equity, isin[1:2] = 'US' AS us, count(*) AS n, count(DISTINCT entity) AS firms FROM usable_code GROUP BY ALL",
)
def b08(spark, sf):
    return codes(spark, sf).groupBy("domestic", "equity", (F.substring("isin", 1, 2) == "US").alias("us")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("firms")
    )


@query(
    "c05_c06_semi_and_anti",
    f"""WITH {CODES_SQL} SELECT 'in codes' AS side, count(*) AS n FROM customer WHERE 'C' || c_custkey IN (SELECT entity FROM usable_code WHERE domestic AND equity)
    UNION ALL SELECT 'not in codes', count(*) FROM customer WHERE 'C' || c_custkey NOT IN (SELECT entity FROM usable_code WHERE domestic AND equity)""",
)
def c05(spark, sf):
    firms = S.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("entity"))
    good = codes(spark, sf).filter("domestic and equity").select("entity").distinct()
    n = lambda how, side: firms.join(good, "entity", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n("left_semi", "in codes").unionByName(n("left_anti", "not in codes"))


@query(
    "e05_candidate_bands",
    f"""WITH {CODES_SQL}, k AS (SELECT entity, count(*) AS c FROM usable_code WHERE domestic AND equity GROUP BY 1)
    SELECT CASE WHEN c = 1 THEN '1' WHEN c <= 3 THEN '2-3' ELSE 'more than 3' END AS band, count(*) AS firms FROM k GROUP BY 1""",
)
def e05(spark, sf):
    return W.candidate_bands(codes(spark, sf).filter("domestic and equity"), "entity")


@query(
    "e06_survival_by_country",
    f"""WITH {ENTITY_SQL}, {CODES_SQL}, f AS (SELECT hq, NOT {BLANK.format(c='lei')} AND length(trim(lei)) = 20 AS lei_ok, NOT {BLANK.format(c='cik')} AS cik_ok,
      entity IN (SELECT entity FROM usable_code) AS any_code, entity IN (SELECT entity FROM usable_code WHERE domestic AND equity) AS good FROM entity)
    SELECT n_name AS country, count(*) AS firms, count(*) FILTER (WHERE lei_ok) AS with_lei, count(*) FILTER (WHERE cik_ok) AS with_cik,
      count(*) FILTER (WHERE any_code) AS in_list, count(*) FILTER (WHERE good) AS with_code, {r('100.0::DOUBLE * count(*) FILTER (WHERE good) / count(*)', 4)} AS pct_code
    FROM f JOIN nation ON hq = n_nationkey GROUP BY 1""",
)
def e06(spark, sf):
    c = codes(spark, sf).select("entity", (F.col("domestic") & F.col("equity")).alias("good"))
    e = entity(spark, sf).join(
        S.table(spark, sf, "nation"), F.col("hq") == F.col("n_nationkey")
    )
    return rounded(W.survival_by_country(e, c, "entity", "n_name"), "pct_code", places=4)


@query(
    "e07_prefix_counts",
    f"""WITH {CODES_SQL}, want AS (SELECT DISTINCT CASE WHEN n_nationkey % 4 = 0 THEN 'US' ELSE 'N' || chr(65 + n_nationkey) END AS prefix FROM nation UNION SELECT 'XS')
    SELECT prefix, count(isin) AS n FROM want LEFT JOIN usable_code ON isin[1:2] = prefix GROUP BY 1""",
)
def e07(spark, sf):
    n = S.table(spark, sf, "nation")
    want = n.select(
        F.explode(
            F.array(
                F.when(F.col("n_nationkey") % 4 == 0, "US").otherwise(F.concat(F.lit("N"), F.char(65 + F.col("n_nationkey")))),
                F.lit("XS"),
            )
        ).alias("prefix")
    ).distinct()
    return W.prefix_counts(codes(spark, sf), "isin", want)


@query("e08_value_counts", "SELECT c_mktsegment AS segment, c_nationkey AS hq, count(*) AS n FROM customer GROUP BY ALL")
def e08(spark, sf):
    from tidemark.operators.vintage import value_counts_of

    c = S.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("hq"))
    return value_counts_of(c, "segment", "hq")


# ---------------------------------------------------------------- routes to one listing
ROUTE_SQL = f"""{S.CANDIDATES_SQL}, alive AS (SELECT * FROM candidate WHERE dollar_vol > 0 AND bars > 30),
near AS (SELECT * FROM (SELECT *, max(dollar_vol) OVER (PARTITION BY lei) AS top FROM alive WHERE NOT {BLANK.format(c='lei')}) WHERE dollar_vol >= top / 3),
route1 AS (SELECT lei, symbol, exchange, dollar_vol, share_vol FROM (SELECT *, row_number() OVER (PARTITION BY lei ORDER BY share_vol DESC, dollar_vol DESC, symbol DESC) AS i FROM near) WHERE i = 1),
firm AS (SELECT 'C' || c_custkey AS entity, c_name, c_nationkey AS hq,
   CASE WHEN c_custkey % 9 IN (4, 5) THEN NULL ELSE 'L' || c_custkey END AS lei, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 'K' || c_custkey END AS cik FROM customer),
route2 AS (SELECT cik, arg_max(symbol, struct_pack(d := dollar_vol, s := symbol)) AS symbol, arg_max(exchange, struct_pack(d := dollar_vol, s := symbol)) AS exchange,
   max(dollar_vol) AS dollar_vol FROM alive WHERE NOT {BLANK.format(c='cik')} GROUP BY cik),
chosen AS (SELECT f.entity, f.c_name, f.hq, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.exchange, b.exchange) AS exchange,
   coalesce(a.dollar_vol, b.dollar_vol) AS dollar_vol, CASE WHEN a.symbol IS NOT NULL THEN 'first' WHEN b.symbol IS NOT NULL THEN 'second' END AS route
   FROM firm f LEFT JOIN route1 a ON f.lei = a.lei LEFT JOIN route2 b ON f.cik = b.cik AND a.symbol IS NULL)"""


def firms(spark, sf):
    k = F.col("c_custkey")
    return S.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), k).alias("entity"), "c_name", F.col("c_nationkey").alias("hq"),
        F.when(k % 9 == 4, "not found").when(k % 9 == 5, "").otherwise(F.concat(F.lit("L"), k)).alias("lei"),
        F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("K"), k)).alias("cik"),
    )


def route_one(candidates):
    return W.best_listing(candidates.withColumn("lei", C.present_or_null(F.col("lei"))), "lei")


def chosen(spark, sf):
    """Both routes: the first identifier where it resolves, the second elsewhere."""
    c = materialise(S.candidates(spark, sf))
    one = materialise(W.null_safe_lookup(firms(spark, sf), route_one(c).drop("share_vol"), "lei"))
    found = one.filter("symbol is not null").withColumn("route", F.lit("first"))
    open_ = one.filter("symbol is null").drop("symbol", "exchange", "dollar_vol")
    two = W.second_route(open_, c, "cik").withColumn(
        "route", F.when(F.col("symbol").isNotNull(), "second")
    )
    return found.unionByName(two)


@query("b26_priceable", f"WITH {S.CANDIDATES_SQL} SELECT entity, symbol FROM candidate WHERE dollar_vol > 0 AND bars > 30")
def b26(spark, sf):
    return W.priceable(S.candidates(spark, sf)).select("entity", "symbol")


@query("f05_best_listing", f"WITH {ROUTE_SQL} SELECT lei, symbol, exchange, {r('dollar_vol', 2)} AS dollar_vol, share_vol FROM route1")
def f05(spark, sf):
    return rounded(route_one(materialise(S.candidates(spark, sf))), "dollar_vol", places=2)


@query(
    "c02_c08_null_safe_lookup",
    f"WITH {ROUTE_SQL} SELECT f.entity, f.lei, a.symbol FROM firm f LEFT JOIN route1 a ON f.lei = a.lei",
)
def c08(spark, sf):
    return W.null_safe_lookup(firms(spark, sf), route_one(materialise(S.candidates(spark, sf))), "lei").select("entity", "lei", "symbol")


@query("c21_second_route", f"WITH {ROUTE_SQL} SELECT entity, symbol, route, exchange, {r('dollar_vol', 2)} AS dollar_vol FROM chosen")
def c21(spark, sf):
    return rounded(chosen(spark, sf).select("entity", "symbol", "route", "exchange", "dollar_vol"), "dollar_vol", places=2)


@query(
    "c18_double_claims",
    f"""WITH {ROUTE_SQL} SELECT symbol, count(*) AS entities, max(claims) AS claims FROM (
      SELECT symbol, count(*) OVER (PARTITION BY symbol) AS claims FROM chosen WHERE symbol IS NOT NULL) WHERE claims > 1 GROUP BY symbol""",
)
def c18(spark, sf):
    return W.double_claims(materialise(chosen(spark, sf))).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("entities"), F.max("claims").alias("claims")
    )


HOME_SQL = f"""{ROUTE_SQL}, home AS (SELECT c.entity, arg_max(c.symbol, struct_pack(d := c.dollar_vol, s := c.symbol)) AS hs, max(c.dollar_vol) AS hv
  FROM candidate c WHERE c.bars > 30 AND c.exchange = c.hq GROUP BY c.entity),
cur AS (SELECT entity, symbol, dollar_vol / CASE WHEN CAST(entity[2:] AS BIGINT) % 2 = 0 THEN 4 ELSE 1 END AS dollar_vol FROM chosen WHERE symbol IS NOT NULL),
switched AS (SELECT cur.entity, CASE WHEN hv > greatest(dollar_vol * 3, 1.0) THEN hs ELSE symbol END AS symbol,
  CASE WHEN hv > greatest(dollar_vol * 3, 1.0) THEN hv ELSE dollar_vol END AS dollar_vol, coalesce(hv > greatest(dollar_vol * 3, 1.0), false) AS moved
  FROM cur LEFT JOIN home USING (entity))"""


@query("c19_home_switch", f"WITH {HOME_SQL} SELECT entity, symbol, {r('dollar_vol', 4)} AS dollar_vol, moved FROM switched")
def c19(spark, sf):
    cur = chosen(spark, sf).filter("symbol is not null").select(
        "entity", "symbol",
        (F.col("dollar_vol") / F.when(F.substring("entity", 2, 20).cast("long") % 2 == 0, 4).otherwise(1)).alias("dollar_vol"),
    )
    home = S.candidates(spark, sf).filter("exchange = hq").select("entity", "symbol", "dollar_vol", "bars")
    return rounded(W.home_switch(cur, home, "entity"), "dollar_vol", places=4)


OVER_SQL = f"""{ROUTE_SQL}, over AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN c_name || ' ' ELSE 'Nobody ' || s_suppkey END AS c_name,
   CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'OV' || s_suppkey END AS symbol FROM supplier JOIN customer ON c_custkey = s_suppkey)"""


def overrides(spark, sf):
    s = S.table(spark, sf, "supplier").select("s_suppkey")
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    k = F.col("s_suppkey")
    return s.join(c, "s_suppkey").select(
        F.when(k % 2 == 0, F.concat("c_name", F.lit(" "))).otherwise(F.concat(F.lit("Nobody "), k)).alias("c_name"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("OV"), k)).alias("symbol"),
    )


@query(
    "c20_overrides",
    f"""WITH {OVER_SQL} SELECT f.entity, o.c_name IS NOT NULL AS overridden, CASE WHEN o.c_name IS NOT NULL THEN nullif(trim(o.symbol), '') ELSE f.symbol END AS symbol
    FROM chosen f LEFT JOIN over o ON trim(f.c_name) = trim(o.c_name)""",
)
def c20(spark, sf):
    return W.apply_overrides(chosen(spark, sf), overrides(spark, sf), "c_name").select("entity", "overridden", "symbol")


@query("c20_unused_overrides", f"WITH {OVER_SQL} SELECT trim(c_name) AS c_name FROM over WHERE trim(c_name) NOT IN (SELECT c_name FROM customer)")
def c20_unused(spark, sf):
    return W.unused_overrides(chosen(spark, sf), overrides(spark, sf), "c_name").select("c_name")


@query(
    "e47_results_by_route",
    f"""WITH {ROUTE_SQL} SELECT n_name AS country, coalesce(route, 'none') AS route, count(*) AS firms, count(symbol) AS listed,
      coalesce(CAST(sum(CASE WHEN symbol IS NOT NULL THEN 1 + hq END) AS BIGINT), 0) AS assets_listed FROM chosen JOIN nation ON hq = n_nationkey GROUP BY 1, 2""",
)
def e47(spark, sf):
    c = chosen(spark, sf).join(S.table(spark, sf, "nation"), F.col("hq") == F.col("n_nationkey"))
    keys = [F.col("n_name").alias("country"), F.coalesce("route", F.lit("none")).alias("route")]
    return W.results_by(c, keys, 1 + F.col("hq"))


@query(
    "g06_thinnest_lines",
    f"WITH {ROUTE_SQL} SELECT entity, symbol, {r('dollar_vol', 2)} AS dollar_vol FROM chosen WHERE symbol IS NOT NULL ORDER BY chosen.dollar_vol, entity LIMIT 15",
)
def g06(spark, sf):
    """A top-k report: the limit is the feature."""
    return rounded(
        chosen(spark, sf).filter("symbol is not null").orderBy("dollar_vol", "entity").limit(15).select("entity", "symbol", "dollar_vol"),
        "dollar_vol", places=2,
    )


@query(
    "g03_candidate_waves",
    f"""WITH {CODES_SQL}, x AS (SELECT entity, equity AND bars > 40 AS hit, row_number() OVER (PARTITION BY entity ORDER BY domestic DESC, isin, symbol) AS i FROM usable_code),
    w AS (SELECT *, CASE WHEN i <= 20 THEN 1 WHEN i <= 100 THEN 2 WHEN i <= 500 THEN 3 ELSE 4 END AS wave FROM x)
    SELECT entity, count(*) AS candidates, max(wave) AS waves, min(wave) FILTER (WHERE hit) AS resolved_wave FROM w GROUP BY entity""",
)
def g03(spark, sf):
    c = codes(spark, sf).withColumn("hit", F.col("equity") & (F.col("bars") > 40)).select("entity", "domestic", "isin", "symbol", "hit")
    return W.candidate_waves(c, "entity", [F.col("domestic").desc(), F.col("isin"), F.col("symbol")], "hit")


# ---------------------------------------------------------------- names
TRADE_NAMES_SQL = """trade_name AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Holdings Inc.' WHEN 1 THEN ', PLC' WHEN 2 THEN ' & Co. Group' ELSE ' SA' END AS name FROM part)"""
FORMS = r"\b(" + "|".join(I.LEGAL_FORMS) + r")\b\.?"
PLAIN_SQL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({{c}}), '{FORMS}', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
NAMED_SQL = f"""{S.CANDIDATES_SQL}, named AS (SELECT *, regexp_replace(c_name, 'Customer#0+', 'Firm ') || ' Inc' AS name,
  CASE WHEN CAST(symbol[2:] AS BIGINT) % 5 = 0 THEN regexp_replace(c_name, 'Customer#0+', 'Firm ') ||
    CASE WHEN CAST(symbol[2:] AS BIGINT) % 2 = 0 THEN ' Holdings' ELSE ' Energy Ltd' END ELSE s_name END AS other FROM candidate),
plain AS (SELECT *, {PLAIN_SQL.format(c='name')} AS x, {PLAIN_SQL.format(c='other')} AS y FROM named),
scored AS (SELECT *, CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS score FROM plain)"""


def trade_names(spark, sf):
    k = F.col("p_partkey")
    return S.table(spark, sf, "part").select(
        k.alias("k"),
        F.concat("p_name", F.when(k % 4 == 0, " Holdings Inc.").when(k % 4 == 1, ", PLC").when(k % 4 == 2, " & Co. Group").otherwise(" SA")).alias("name"),
    )


@query(
    "b17_plain_names",
    f"""WITH {TRADE_NAMES_SQL} SELECT k, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{FORMS}', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM trade_name""",
)
def b17(spark, sf):
    return trade_names(spark, sf).select("k", I.plain_name(F.col("name")).alias("plain"))


@query(
    "b17_name_tokens",
    f"""WITH {TRADE_NAMES_SQL} SELECT k, array_to_string(list_sort(list_filter(list_distinct(string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +')),
      lambda w: length(w) > 1 AND w NOT IN ({', '.join(repr(w) for w in I.STOP_WORDS)}))), ' ') AS tokens FROM trade_name""",
)
def b17_tokens(spark, sf):
    return trade_names(spark, sf).select("k", F.array_join(F.array_sort(I.name_tokens(F.col("name"))), " ").alias("tokens"))


def name_candidates(spark, sf):
    """Search hits per firm: one row for each supplier it traded with, under a name to score."""
    c = S.candidates(spark, sf)
    s = F.substring("symbol", 2, 20).cast("long")
    near = F.concat(F.regexp_replace("c_name", "Customer#0+", "Firm "), F.when(s % 2 == 0, " Holdings").otherwise(" Energy Ltd"))
    return c.withColumn("name", F.concat(F.regexp_replace("c_name", "Customer#0+", "Firm "), F.lit(" Inc"))).withColumn(
        "other", F.when(s % 5 == 0, near).otherwise(F.col("s_name"))
    )


@query("b18_name_similarity", f"WITH {NAMED_SQL} SELECT entity, symbol, {r('score', 6)} AS score FROM scored")
def b18(spark, sf):
    return name_candidates(spark, sf).select("entity", "symbol", half_up(W.similarity("name", "other"), 6).alias("score"))


@query(
    "c22_name_route",
    f"""WITH {NAMED_SQL}, best AS (SELECT entity, arg_max(struct_pack(symbol := symbol, score := score, dollar_vol := dollar_vol),
      struct_pack(a := score, b := dollar_vol, c := symbol)) AS w FROM scored WHERE bars > 30 AND score >= 0.7 GROUP BY entity)
    SELECT entity, w.symbol AS symbol, {r('w.score', 4)} AS score, {r('w.dollar_vol', 4)} AS dollar_vol FROM best""",
)
def c22(spark, sf):
    return rounded(W.name_route(name_candidates(spark, sf), "entity", "name", "other"), "score", "dollar_vol", places=4)


FIRM_SQL = f"""firm AS (SELECT c_custkey AS k, p_name || ' ' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 6) AS base
  FROM customer JOIN part ON p_partkey = c_custkey % 200),
traded AS (SELECT l_suppkey, count(*) AS bars, CAST(sum(l_quantity) AS DOUBLE) AS dollar_vol FROM lineitem GROUP BY 1),
line AS (SELECT 'L' || s_suppkey AS symbol, coalesce(bars, 0) AS bars, dollar_vol,
  replace(base, 'e', 'a') || CASE WHEN s_suppkey % 2 = 0 THEN ' Holdings' ELSE ' Energy Ltd' END AS other
  FROM supplier JOIN firm ON k = (s_suppkey * 13) % 150 LEFT JOIN traded ON l_suppkey = s_suppkey),
plain AS (SELECT k, {PLAIN_SQL.format(c="base || ' Inc'")} AS x FROM firm),
of_line AS (SELECT symbol, dollar_vol, {PLAIN_SQL.format(c='other')} AS y FROM line WHERE bars > 30),
scored AS (SELECT k, symbol, dollar_vol, CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0::DOUBLE
  ELSE 1.0::DOUBLE - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END AS score FROM plain CROSS JOIN of_line)"""


@query(
    "c22_name_search",
    f"""WITH {FIRM_SQL}, best AS (SELECT k, arg_max(struct_pack(symbol := symbol, score := score, dollar_vol := dollar_vol),
      struct_pack(a := score, b := dollar_vol, c := symbol)) AS w FROM scored WHERE score >= 0.7 GROUP BY k)
    SELECT 'F' || k AS entity, w.symbol AS symbol, {r('w.score', 4)} AS score, {r('w.dollar_vol', 4)} AS dollar_vol FROM best""",
)
def c22_search(spark, sf):
    t = lambda name: S.table(spark, sf, name)
    k = F.col("c_custkey")
    base = F.concat("p_name", F.lit(" "), F.substring(F.md5(k.cast("string")), 1, 6))
    firms = t("customer").join(t("part"), F.col("p_partkey") == k % 200).select(k.alias("k"), base.alias("base"))
    traded = t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("l_quantity").cast("double").alias("dollar_vol")
    )
    ending = F.when(F.col("s_suppkey") % 2 == 0, " Holdings").otherwise(" Energy Ltd")
    lines = (
        t("supplier").join(firms, F.col("k") == F.col("s_suppkey") * 13 % 150).join(traded, "s_suppkey", "left")
        .select(
            F.concat(F.lit("L"), "s_suppkey").alias("symbol"), F.coalesce("bars", F.lit(0)).alias("bars"), "dollar_vol",
            F.concat(F.replace("base", F.lit("e"), F.lit("a")), ending).alias("other"),
        )
    )
    named = firms.select(F.concat(F.lit("F"), "k").alias("entity"), F.concat("base", F.lit(" Inc")).alias("name"))
    return rounded(N.search_by_name(named, lines), "score", "dollar_vol", places=4)


@query(
    "b16_residual_names",
    """SELECT p_type AS kind, count(*) FILTER (WHERE regexp_matches(lower(nm), 'small shareholder|natural person|other shareholder|unknown|various')) AS residual, count(*) AS n
    FROM (SELECT p_type, CASE p_partkey % 7 WHEN 0 THEN 'Small Shareholder(s)' WHEN 1 THEN 'Natural persons' WHEN 2 THEN 'UNKNOWN' ELSE p_name END AS nm FROM part) GROUP BY 1""",
)
def b16(spark, sf):
    k = F.col("p_partkey") % 7
    nm = F.when(k == 0, "Small Shareholder(s)").when(k == 1, "Natural persons").when(k == 2, "UNKNOWN").otherwise(F.col("p_name"))
    return S.table(spark, sf, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count_if(I.residual(nm)).alias("residual"), F.count(F.lit(1)).alias("n")
    )


SYMBOL_SQL = """sym AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'AB' || '-P' WHEN 1 THEN 'WXPRA' WHEN 2 THEN '0AB' || (p_size % 10) || '.L' WHEN 3 THEN 'BAS.F'
   WHEN 4 THEN 'DOW' WHEN 5 THEN 'X' || p_partkey || '.DE' ELSE 'CD-PB.MU' END AS symbol FROM part)"""


@query(
    "b19_suspect_symbols",
    f"""WITH {SYMBOL_SQL}, w AS (SELECT symbol, CASE WHEN regexp_matches(split_part(symbol, '.', 1), '-P[A-Z]?$') THEN 'preferred share'
      WHEN regexp_matches(split_part(symbol, '.', 1), '^[A-Z]{{1,4}}PR[A-Z]?$') THEN 'preferred series' WHEN regexp_matches(split_part(symbol, '.', 1), '^0[A-Z0-9]{{3}}$') THEN 'international line'
      WHEN regexp_matches(symbol, '\\.(F|BE|MU|SG|DU|HM)$') THEN 'regional floor' END AS why FROM sym) SELECT symbol, why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY 1, 2""",
)
def b19(spark, sf):
    k = F.col("p_partkey")
    m = k % 7
    symbol = (
        F.when(m == 0, "AB-P").when(m == 1, "WXPRA").when(m == 2, F.concat(F.lit("0AB"), F.col("p_size") % 10, F.lit(".L")))
        .when(m == 3, "BAS.F").when(m == 4, "DOW").when(m == 5, F.concat(F.lit("X"), k, F.lit(".DE"))).otherwise("CD-PB.MU")
    )
    w = S.table(spark, sf, "part").select(symbol.alias("symbol")).withColumn("why", I.suspect_symbol(F.col("symbol")))
    return w.filter("why is not null").groupBy("symbol", "why").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b20_currency_pairs",
    """WITH cur AS (SELECT DISTINCT ['AUD', 'CHF', 'DKK', 'EUR', 'GBp', 'ILA', 'NOK', 'SEK', 'USD'][c_nationkey % 9 + 1] AS code FROM customer),
    m AS (SELECT code, CASE code WHEN 'GBp' THEN 'GBP' WHEN 'ILA' THEN 'ILS' ELSE code END AS major, CASE WHEN code IN ('GBp', 'ILA') THEN 100.0 ELSE 1.0 END::DOUBLE AS divisor FROM cur)
    SELECT code, major, divisor, major || base AS pair FROM m, (SELECT unnest(['USD', 'EUR']) AS base) WHERE major <> base""",
)
def b20(spark, sf):
    codes_ = F.array(*[F.lit(c) for c in ("AUD", "CHF", "DKK", "EUR", "GBp", "ILA", "NOK", "SEK", "USD")])
    cur = S.table(spark, sf, "customer").select(F.element_at(codes_, (F.col("c_nationkey") % 9 + 1).cast("int")).alias("code")).distinct()
    return W.currency_pairs(cur)


RECORD_SQL = """rec AS (SELECT l_partkey AS k, l_suppkey AS s, CASE WHEN l_linenumber % 3 = 0 THEN 'Corp' ELSE 'Equity' END AS sector,
   CASE l_linenumber % 4 WHEN 0 THEN 'Preferred' WHEN 1 THEN 'Common Stock' WHEN 2 THEN 'Depositary Receipt' ELSE 'Warrant' END AS kind,
   CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'T' || l_suppkey END AS ticker, 'X' || (l_suppkey % 9) AS exchange FROM lineitem)"""


def records(spark, sf):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return S.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("k"), s.alias("s"), F.when(n % 3 == 0, "Corp").otherwise("Equity").alias("sector"),
        F.when(n % 4 == 0, "Preferred").when(n % 4 == 1, "Common Stock").when(n % 4 == 2, "Depositary Receipt").otherwise("Warrant").alias("kind"),
        F.when(s % 5 != 0, F.concat(F.lit("T"), s)).alias("ticker"), F.concat(F.lit("X"), s % 9).alias("exchange"),
    )


@query(
    "b25_equity_records",
    f"""WITH {RECORD_SQL} SELECT kind, exchange, count(*) AS n FROM rec WHERE sector = 'Equity' AND kind IN ('Common Stock', 'Depositary Receipt') AND ticker IS NOT NULL GROUP BY ALL""",
)
def b25(spark, sf):
    x = records(spark, sf)
    ok = I.equity_record(F.col("sector"), F.col("kind"), F.col("ticker"), F.col("exchange"))
    return x.filter(ok).groupBy("kind", "exchange").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a18_candidate_rows",
    f"""WITH {RECORD_SQL} SELECT DISTINCT k, ticker, exchange, kind FROM (SELECT k, ticker, exchange, kind FROM rec
    UNION ALL SELECT k, ticker, 'OTC', kind FROM rec) WHERE ticker IS NOT NULL""",
)
def a18(spark, sf):
    """Each response holds a short list of records; they are exploded and made distinct."""
    from tidemark.sources.payloads import explode_records

    one = lambda ex: F.struct("ticker", ex.alias("exchange"), "kind")
    nested = records(spark, sf).select("k", F.array(one(F.col("exchange")), one(F.lit("OTC"))).alias("data"))
    return explode_records(nested, "k", "data", ["ticker", "exchange", "kind"]).filter("ticker is not null")


@query(
    "c07_fallback_lookup",
    """WITH rows_ AS (SELECT DISTINCT l_partkey, l_suppkey, 'A' || l_partkey AS asset, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'A' || l_partkey || '-' || l_suppkey END AS unit FROM lineitem),
    t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END || p_partkey AS gid, 'asset' AS source, p_size::DOUBLE AS cap FROM part
      UNION ALL SELECT DISTINCT CASE WHEN l_suppkey % 4 = 0 THEN 'A' ELSE 'B' END || l_partkey || '-' || l_suppkey, 'unit', (l_suppkey % 7)::DOUBLE FROM lineitem)
    SELECT asset, unit, coalesce(u.source, a.source) AS source, CASE WHEN u.gid IS NOT NULL THEN u.cap ELSE a.cap END AS cap
    FROM (SELECT DISTINCT asset, unit FROM rows_) r LEFT JOIN t u ON r.unit = u.gid AND r.unit <> '' LEFT JOIN t a ON r.asset = a.gid""",
)
def c07(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    a = F.concat(F.lit("A"), "l_partkey")
    u = F.concat(a, F.lit("-"), "l_suppkey")
    rows = line.select(a.alias("asset"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(u).alias("unit")).distinct()
    head = lambda kept: F.when(kept, "A").otherwise("B")
    assets = S.table(spark, sf, "part").select(
        F.concat(head(F.col("p_partkey") % 2 == 0), "p_partkey").alias("gid"), F.lit("asset").alias("source"), F.col("p_size").cast("double").alias("cap")
    )
    unit = line.select(
        F.concat(head(F.col("l_suppkey") % 4 == 0), "l_partkey", F.lit("-"), "l_suppkey").alias("gid"), F.lit("unit").alias("source"),
        (F.col("l_suppkey") % 7).cast("double").alias("cap"),
    )
    return W.fallback_lookup(rows, assets.unionByName(unit), ["unit", "asset"], ["source", "cap"])


@query(
    "c09_map_lookup",
    "SELECT 'C' || c_custkey AS entity, n_name AS country, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def c09(spark, sf):
    """Nations and regions are fixed lists of a few rows: safe to broadcast."""
    n = S.table(spark, sf, "nation").join(S.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return S.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.concat(F.lit("C"), "c_custkey").alias("entity"), F.col("n_name").alias("country"), F.col("r_name").alias("region")
    )


@query(
    "c11_parent_in_panel",
    """WITH panel AS (SELECT c_custkey AS k, c_custkey // 3 AS parent FROM customer WHERE c_acctbal > 1000)
    SELECT 'C' || a.k AS entity, b.k IS NOT NULL AS parent_in_panel FROM panel a LEFT JOIN panel b ON a.parent = b.k""",
)
def c11(spark, sf):
    p = S.table(spark, sf, "customer").filter("c_acctbal > 1000").select(
        F.col("c_custkey").alias("k"), F.expr("c_custkey div 3").alias("parent")
    )
    up = p.select(F.col("k").alias("parent"), F.lit(True).alias("_in"))
    return p.join(up, "parent", "left").select(
        F.concat(F.lit("C"), "k").alias("entity"), F.coalesce("_in", F.lit(False)).alias("parent_in_panel")
    )


@query(
    "e46_register_checks",
    f"""WITH {ENTITY_SQL}, reg AS (SELECT CASE WHEN c_custkey % 17 <> 0 THEN 'L' || lpad(CAST(c_custkey AS VARCHAR), 19, '0') END AS lei, CASE WHEN c_custkey % 13 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS state,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FUND' ELSE 'GENERAL' END AS category FROM customer)
    SELECT count(*) AS entities, count(reg.lei) AS found, count(*) FILTER (WHERE reg.lei IS NULL) AS absent, count(*) FILTER (WHERE state <> 'ACTIVE') AS not_active,
      count(*) FILTER (WHERE category <> 'GENERAL') AS not_general FROM entity LEFT JOIN reg ON entity.lei = reg.lei
    WHERE NOT {BLANK.format(c='entity.lei')} AND length(trim(entity.lei)) = 20""",
)
def e46(spark, sf):
    reg = S.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 17 != 0, F.concat(F.lit("L"), F.lpad(F.col("c_custkey").cast("string"), 19, "0"))).alias("lei"),
        F.when(F.col("c_custkey") % 13 == 0, "INACTIVE").otherwise("ACTIVE").alias("state"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "FUND").otherwise("GENERAL").alias("category"),
    )
    return W.register_checks(entity(spark, sf), reg)


@query(
    "e34_decile_floor",
    f"WITH {ROUTE_SQL} SELECT count(dollar_vol) AS n, {r('quantile_cont(dollar_vol, 0.10)', 2)} AS floor FROM chosen",
)
def e34(spark, sf):
    return rounded(quantiles(chosen(spark, sf), "dollar_vol", {"floor": 0.10}), "floor", places=2)


@query(
    "e24_currency_mix",
    f"""WITH {ROUTE_SQL} SELECT coalesce(CAST(exchange AS VARCHAR), 'empty') AS venue, count(*) AS firms, count(*) FILTER (WHERE symbol IS NULL) AS empty FROM chosen GROUP BY 1""",
)
def e24(spark, sf):
    c = chosen(spark, sf)
    return c.groupBy(F.coalesce(F.col("exchange").cast("string"), F.lit("empty")).alias("venue")).agg(
        F.count(F.lit(1)).alias("firms"), F.count_if(F.col("symbol").isNull()).alias("empty")
    )
