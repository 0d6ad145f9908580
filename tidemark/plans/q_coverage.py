"""Queries on pulls, membership, coverage windows, delistings and record lags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import COVERED_MONTHS
from tidemark.functions.cleaning import half_up
from tidemark.functions.identifiers import STOP_WORDS
from tidemark.operators import coverage as V
from tidemark.operators import membership as M
from tidemark.operators import panel as P
from tidemark.operators.calendar import sessions, sessions_between
from tidemark.operators.ordering import quantiles
from tidemark.plans import q_panel as QP
from tidemark.plans import q_vintage as QV
from tidemark.plans import standins as S
from tidemark.plans.q_graph import rounded
from tidemark.plans.registry import query, r

STOPS = ", ".join(repr(w) for w in STOP_WORDS)

# ---------------------------------------------------------------- ledger
LATEST_SQL = f"""{S.LEDGER_SQL}, wrote AS (SELECT * FROM ledger WHERE disposition IN ('WROTE_NEW', 'WROTE_BESIDE')),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, symbol ORDER BY line DESC) AS i FROM wrote) WHERE i = 1)"""


def latest(spark, sf):
    return V.latest_entries(S.ledger(spark, sf))


def requested(spark, sf):
    """Every user at each of the five endpoints."""
    u = S.table(spark, sf, "events").select(F.concat(F.lit("U"), "user_id").alias("symbol")).distinct()
    ends = F.array(*[F.lit(x) for x in ("click", "view", "signup", "purchase", "error", "profile")])
    return u.select("symbol", F.explode(ends).alias("endpoint"))


@query(
    "a07_latest_ledger_entry",
    f"WITH {LATEST_SQL} SELECT endpoint, symbol, n_rows, CAST(date_min AS VARCHAR) AS date_min, CAST(date_max AS VARCHAR) AS date_max, line FROM latest",
)
def a07(spark, sf):
    return latest(spark, sf).select(
        "endpoint", "symbol", "n_rows", F.col("date_min").cast("string").alias("date_min"),
        F.col("date_max").cast("string").alias("date_max"), "line",
    )


@query(
    "e26_completeness",
    f"""WITH {LATEST_SQL}, u AS (SELECT DISTINCT 'U' || user_id AS symbol FROM events),
    q AS (SELECT symbol, endpoint FROM u, (SELECT unnest(['click', 'view', 'signup', 'purchase', 'error', 'profile']) AS endpoint))
    SELECT q.endpoint, count(*) AS requested, count(*) FILTER (WHERE n_rows > 0) AS usable, count(*) FILTER (WHERE line IS NOT NULL AND NOT n_rows > 0) AS "empty",
      count(*) FILTER (WHERE line IS NULL) AS missing, {r('100.0::DOUBLE * count(*) FILTER (WHERE n_rows > 0) / count(*)', 4)} AS pct
    FROM q LEFT JOIN latest l ON q.symbol = l.symbol AND q.endpoint = l.endpoint GROUP BY 1""",
)
def e26(spark, sf):
    return rounded(V.completeness(requested(spark, sf), latest(spark, sf)), "pct", places=4)


@query(
    "e27_pulled_windows",
    f"WITH {LATEST_SQL} SELECT endpoint, symbol, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(min(date_min) AS VARCHAR) AS date_min, CAST(max(date_max) AS VARCHAR) AS date_max, count(*) AS files FROM wrote GROUP BY 1, 2",
)
def e27(spark, sf):
    p = V.pulled(S.ledger(spark, sf))
    return p.select(
        "endpoint", "symbol", "n_rows", F.col("date_min").cast("string").alias("date_min"),
        F.col("date_max").cast("string").alias("date_max"), "files",
    )


@query(
    "e28_start_clusters",
    f"""WITH {LATEST_SQL}, c AS (SELECT endpoint, CAST(year(date_min) AS INTEGER) AS year, count(*) AS symbols FROM latest GROUP BY 1, 2)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY endpoint ORDER BY symbols DESC, year) AS INTEGER) AS place FROM c) WHERE place <= 3""",
)
def e28(spark, sf):
    return V.start_clusters(latest(spark, sf))


@query(
    "e28_late_starters",
    f"WITH {LATEST_SQL} SELECT endpoint, symbol, CAST(date_min AS VARCHAR) AS date_min FROM latest WHERE date_min > DATE '2020-01-01'",
)
def e28_late(spark, sf):
    return latest(spark, sf).filter(F.col("date_min") > F.lit("2020-01-01").cast("date")).select(
        "endpoint", "symbol", F.col("date_min").cast("string").alias("date_min")
    )


# ---------------------------------------------------------------- delistings
DELISTED_SQL = """listing AS (SELECT 'O' || o_orderkey AS symbol, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS delisted_on,
   CASE WHEN o_orderkey % 50 = 7 THEN 'not a date' WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS delisted_text,
   c_nationkey AS venue, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey)"""


def listing(spark, sf):
    o = S.table(spark, sf, "orders")
    c = S.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    day = F.col("o_orderdate").cast("date")
    f = F.col("o_orderstatus") == "F"
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("O"), "o_orderkey").alias("symbol"), F.when(f, day).alias("delisted_on"),
        F.when(F.col("o_orderkey") % 50 == 7, "not a date").when(f, day.cast("string")).alias("delisted_text"),
        F.col("c_nationkey").alias("venue"), F.col("o_totalprice").alias("value"),
    )


@query(
    "b30_date_coercion",
    f"WITH {DELISTED_SQL} SELECT delisted_text IS NULL AS blank, try_cast(delisted_text AS DATE) IS NULL AS no_date, count(*) AS n FROM listing GROUP BY ALL",
)
def b30(spark, sf):
    from tidemark.functions.cleaning import to_date

    x = listing(spark, sf)
    return x.groupBy(F.col("delisted_text").isNull().alias("blank"), to_date(F.col("delisted_text")).isNull().alias("no_date")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("e29_delistings_by_year", f"WITH {DELISTED_SQL} SELECT CAST(year(delisted_on) AS INTEGER) AS year, count(*) AS n FROM listing WHERE delisted_on IS NOT NULL GROUP BY 1")
def e29(spark, sf):
    return V.by_year(listing(spark, sf), "delisted_on")


@query(
    "e29_recency_ratio",
    f"""WITH {DELISTED_SQL}, s AS (SELECT count(*) FILTER (WHERE year(delisted_on) BETWEEN 1995 AND 1996) AS early, count(*) FILTER (WHERE year(delisted_on) BETWEEN 1999 AND 2000) AS late,
      count(*) FILTER (WHERE year(delisted_on) < 1997) AS before, count(*) AS n FROM listing WHERE delisted_on IS NOT NULL)
    SELECT early, late, before, n, {r('late::DOUBLE / early', 6)} AS ratio, {r('before::DOUBLE / n', 6)} AS share_before FROM s""",
)
def e29_ratio(spark, sf):
    return rounded(V.recency(listing(spark, sf), "delisted_on", (1995, 1996), (1999, 2000), 1997), "ratio", "share_before")


@query(
    "e30_delisting_rates",
    f"""WITH {DELISTED_SQL}, floor_ AS (SELECT quantile_cont(value, 0.10) AS f FROM listing WHERE delisted_on IS NULL),
    v AS (SELECT DISTINCT s_nationkey AS venue FROM supplier WHERE s_acctbal > 8000),
    t AS (SELECT count(*)::DOUBLE AS n, count(delisted_on)::DOUBLE AS d, count(*) FILTER (WHERE venue IN (SELECT venue FROM v))::DOUBLE AS nm,
      count(delisted_on) FILTER (WHERE venue IN (SELECT venue FROM v))::DOUBLE AS dm, count(*) FILTER (WHERE delisted_on >= DATE '2000-01-01')::DOUBLE AS recent,
      count(*) FILTER (WHERE value >= f)::DOUBLE AS ns, count(delisted_on) FILTER (WHERE value >= f)::DOUBLE AS ds FROM listing, floor_)
    SELECT {r('d / n', 6)} AS crude, {r('dm / nullif(nm, 0)', 6)} AS matched, {r('recent / n', 6)} AS recent, {r('ds / ns', 6)} AS size_matched, {r('ds / ns * nm', 2)} AS implied FROM t""",
)
def e30(spark, sf):
    x = listing(spark, sf)
    floor = quantiles(x.filter("delisted_on is null"), "value", {"f": 0.10}).select("f")
    v = S.table(spark, sf, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("venue"))
    t = V.delisting_rates(x, v, floor, "2000-01-01")
    return rounded(rounded(t, "crude", "matched", "recent", "size_matched"), "implied", places=2)


@query(
    "e31_share_with_error",
    f"""WITH {DELISTED_SQL}, s AS (SELECT venue, count(*)::DOUBLE AS n, count(delisted_on)::DOUBLE / count(*) AS p FROM listing GROUP BY venue)
    SELECT venue, CAST(n AS BIGINT) AS n, {r('p', 6)} AS share, {r('1.96 * sqrt(p * (1 - p) / n)', 6)} AS margin FROM s""",
)
def e31(spark, sf):
    s = V.share_with_error(listing(spark, sf), "venue", F.col("delisted_on").isNotNull())
    return rounded(s, "share", "margin")


@query(
    "e32_size_bands",
    f"""WITH {QP.SPAN_SQL}, liq AS (SELECT symbol, median(price * volume) AS dv FROM prices GROUP BY symbol),
    b AS (SELECT CASE WHEN dv < 52000 THEN 'small' WHEN dv < 54000 THEN 'middle' ELSE 'large' END AS band, gap FROM gap JOIN liq USING (symbol))
    SELECT band, count(*) AS n, {r('median(gap)', 6)} AS gap, {r('count(*) FILTER (WHERE gap < 0)::DOUBLE / count(*)', 6)} AS share_below FROM b GROUP BY band""",
)
def e32(spark, sf):
    liq = P.liquidity(S.prices(spark, sf)).select("symbol", "dollar_vol")
    band = F.when(F.col("dollar_vol") < 52000, "small").when(F.col("dollar_vol") < 54000, "middle").otherwise("large")
    g = QP.gaps(spark, sf).join(liq, "symbol").select(band.alias("band"), "gap")
    med = quantiles(g, "gap", {"m": 0.5}, ["band"]).select("band", F.col("m").alias("gap"))
    n = g.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("gap") < 0) / F.count(F.lit(1))).alias("share_below")
    )
    return rounded(n.join(med, "band"), "gap", "share_below")


ENDS_SQL = """ends AS (SELECT 'S' || l_suppkey AS symbol, CASE WHEN l_suppkey % 5 <> 0 THEN max(CAST(l_shipdate AS DATE)) FILTER (WHERE l_returnflag = 'A') END AS e,
   CASE WHEN l_suppkey % 7 <> 0 THEN max(CAST(l_shipdate AS DATE)) FILTER (WHERE l_returnflag IS DISTINCT FROM 'A') END AS l FROM lineitem GROUP BY l_suppkey),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) WHERE dayofweek(date) BETWEEN 1 AND 5),
run AS (SELECT symbol, e, l, CASE WHEN e IS NULL OR l IS NULL THEN NULL WHEN pe IS NOT NULL AND pl IS NOT NULL THEN abs(pe - pl) ELSE abs(e - l) * 5 // 7 END AS sessions
  FROM (SELECT *, (SELECT min(pos) FROM cal WHERE date >= e) AS pe, (SELECT min(pos) FROM cal WHERE date >= l) AS pl FROM ends))"""


def ends(spark, sf):
    s, d = F.col("l_suppkey"), F.col("l_shipdate").cast("date")
    g = S.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.max(F.when(F.col("l_returnflag") == "A", d)).alias("e"),
        F.max(F.when(~F.col("l_returnflag").eqNullSafe("A"), d)).alias("l"),
    )
    return g.select(
        F.concat(F.lit("S"), s).alias("symbol"), F.when(s % 5 != 0, F.col("e")).alias("end"), F.when(s % 7 != 0, F.col("l")).alias("last")
    )


def calendar(spark, sf):
    d = S.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return sessions(d.filter(F.dayofweek("date").between(2, 6)))


@query(
    "c13_sessions_between",
    f"WITH {ENDS_SQL} SELECT symbol, CAST(l AS VARCHAR) AS last, CAST(e AS VARCHAR) AS \"end\", CAST(sessions AS INTEGER) AS sessions FROM run",
)
def c13(spark, sf):
    x = sessions_between(ends(spark, sf), "last", "end", calendar(spark, sf), "sessions")
    return x.select("symbol", F.col("last").cast("string").alias("last"), F.col("end").cast("string").alias("end"), F.col("sessions").cast("int").alias("sessions"))


@query(
    "e39_run_to_delisting",
    f"""WITH {ENDS_SQL}, s AS (SELECT CAST(month(e) AS INTEGER) AS year, CASE WHEN l IS NULL THEN 'none' WHEN sessions <= 10 THEN 'ok' WHEN l > e THEN 'late' ELSE 'early' END AS s FROM run WHERE e IS NOT NULL)
    SELECT year, count(*) AS listed, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'late') AS late, count(*) FILTER (WHERE s = 'early') AS early,
      count(*) FILTER (WHERE s = 'none') AS no_bars, {r("100.0::DOUBLE * count(*) FILTER (WHERE s = 'ok') / count(*)", 4)} AS pct,
      {r("100.0::DOUBLE * count(*) FILTER (WHERE s = 'ok') / greatest(1, count(*) FILTER (WHERE s <> 'none'))", 4)} AS pct_priced FROM s GROUP BY year""",
)
def e39(spark, sf):
    x = V.run_to_end(ends(spark, sf).filter("`end` is not null"), calendar(spark, sf), F.month("end"))
    return rounded(x, "pct", "pct_priced", places=4)


# ---------------------------------------------------------------- membership
SPAN_SQL = f"""{S.MEMBERS_SQL}, lim AS (SELECT min(date) AS lo, DATE '2024-03-05' AS hi FROM member_event),
adds AS (SELECT DISTINCT added AS symbol, date FROM member_event WHERE added <> ''),
rems AS (SELECT DISTINCT removed AS symbol, date FROM member_event WHERE removed <> ''),
mspan AS (SELECT c.symbol, coalesce((SELECT max(date) FROM adds a WHERE a.symbol = c.symbol), lo) AS f, hi AS t FROM member_current c, lim
  UNION ALL SELECT r.symbol, coalesce((SELECT max(a.date) FROM adds a WHERE a.symbol = r.symbol AND a.date < r.date), lo), r.date FROM rems r, lim),
mperiod AS (SELECT DISTINCT symbol, CAST(unnest(generate_series(f, t, INTERVAL 1 DAY)) AS DATE) AS period FROM mspan)"""


def until():
    """End of the window, some weeks after the last logged change."""
    return F.lit("2024-03-05").cast("date")


def spans(spark, sf):
    return M.spans(S.member_events(spark, sf), S.member_current(spark, sf), until=until())


@query(
    "c15_spans_before_window",
    f"""WITH {SPAN_SQL} SELECT count(*) AS spans, count(DISTINCT symbol) AS symbols FROM mspan WHERE t < DATE '2024-01-10'""",
)
def c15_before(spark, sf):
    return M.spans_before(S.member_events(spark, sf), S.member_current(spark, sf), F.lit("2024-01-10").cast("date"), until())


@query("c15_membership_spans", f"WITH {SPAN_SQL} SELECT symbol, CAST(f AS VARCHAR) AS \"from\", CAST(t AS VARCHAR) AS \"to\" FROM mspan")
def c15(spark, sf):
    return spans(spark, sf).select("symbol", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


@query(
    "c15_membership_clamped",
    f"""WITH {SPAN_SQL} SELECT symbol, CAST(greatest(f, DATE '2024-01-10') AS VARCHAR) AS "from", CAST(t AS VARCHAR) AS "to" FROM mspan WHERE t >= DATE '2024-01-10'""",
)
def c15_clamped(spark, sf):
    x = M.spans(S.member_events(spark, sf), S.member_current(spark, sf), F.lit("2024-01-10").cast("date"), until())
    return x.select("symbol", F.col("from").cast("string").alias("from"), F.col("to").cast("string").alias("to"))


@query("c15_membership_months", f"WITH {SPAN_SQL} SELECT symbol, strftime(date_trunc('month', period), '%Y-%m') AS month FROM mperiod GROUP BY ALL")
def c15_months(spark, sf):
    return M.periods(spans(spark, sf), "month").select("symbol", F.date_format("period", "yyyy-MM").alias("month"))


@query(
    "e40_covered_members",
    f"""WITH {SPAN_SQL}, have AS (SELECT DISTINCT 'U' || user_id AS symbol, CAST(ts AS DATE) AS period FROM events WHERE event_type NOT IN ('signup', 'error')),
    per AS (SELECT CAST(day(period) // 3 AS INTEGER) AS bucket, m.symbol, count(h.symbol)::DOUBLE / count(*) AS share FROM mperiod m LEFT JOIN have h USING (symbol, period) GROUP BY 1, 2)
    SELECT bucket, count(*) AS members, count(*) FILTER (WHERE share >= 0.90) AS covered, {r('100.0::DOUBLE * count(*) FILTER (WHERE share >= 0.90) / count(*)', 4)} AS pct FROM per GROUP BY 1""",
)
def e40(spark, sf):
    return rounded(coverage_by_bucket(spark, sf), "pct", places=4)


def coverage_by_bucket(spark, sf):
    m = M.periods(spans(spark, sf), "day").withColumn("bucket", F.floor(F.dayofmonth("period") / 3).cast("int"))
    have = S.table(spark, sf, "events").filter(~F.col("event_type").isin("signup", "error")).select(
        F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("date").alias("period")
    )
    return M.covered_members(m, have, "bucket", COVERED_MONTHS)


@query(
    "f10_earliest_start",
    f"""WITH {SPAN_SQL}, have AS (SELECT DISTINCT 'U' || user_id AS symbol, CAST(ts AS DATE) AS period FROM events WHERE event_type NOT IN ('signup', 'error')),
    per AS (SELECT CAST(day(period) // 3 AS INTEGER) AS bucket, m.symbol, count(h.symbol)::DOUBLE / count(*) AS share FROM mperiod m LEFT JOIN have h USING (symbol, period) GROUP BY 1, 2),
    b AS (SELECT bucket, CASE WHEN bucket % 4 = 2 THEN NULL ELSE 100.0 * count(*) FILTER (WHERE share >= 0.90) / count(*) >= CASE WHEN bucket < 4 THEN 101 ELSE 1 END END AS ok FROM per GROUP BY 1),
    o AS (SELECT *, bool_and(coalesce(ok, true)) OVER (ORDER BY bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM b)
    SELECT min(bucket) FILTER (WHERE onward) AS starts, count(*) FILTER (WHERE onward AND ok IS NULL) AS silent FROM o""",
)
def f10(spark, sf):
    b = coverage_by_bucket(spark, sf)
    need = F.when(F.col("bucket") < 4, 101).otherwise(1)
    t = b.select("bucket", F.when(F.col("bucket") % 4 != 2, F.col("pct") >= need).alias("ok"))
    return M.earliest_start(t, "bucket", "ok")


BACK_SQL = f"""{S.MEMBERS_SQL}, pe AS (SELECT *, CAST(day(date) AS INTEGER) AS period FROM member_event),
named AS (SELECT period, date, added, removed, removed AS symbol, 0 AS k FROM pe WHERE removed <> '' UNION ALL SELECT period, date, added, removed, added, 1 FROM pe WHERE added <> ''),
cuts AS (SELECT unnest(generate_series((SELECT min(period) FROM pe), (SELECT max(period) FROM pe))) AS period),
syms AS (SELECT symbol FROM named UNION SELECT symbol FROM member_current),
st AS (SELECT c.period, s.symbol, (SELECT arg_min(k, struct_pack(a := date, b := added, c := removed, d := k)) FROM named n WHERE n.symbol = s.symbol AND n.period > c.period) AS k FROM cuts c, syms s)"""


def period_events(spark, sf):
    return S.member_events(spark, sf).withColumn("period", F.dayofmonth("date"))


@query(
    "f11_members_backward",
    f"""WITH {BACK_SQL} SELECT CAST(period AS BIGINT) AS period, count(*) FILTER (WHERE CASE WHEN k IS NULL THEN symbol IN (SELECT symbol FROM member_current) ELSE k = 0 END) AS members FROM st GROUP BY period""",
)
def f11(spark, sf):
    return M.members_at(period_events(spark, sf), S.member_current(spark, sf))


SPARSE_SQL = """sparse AS (SELECT CAST(floor(epoch(ts) / 600) AS BIGINT) AS period, count(*) AS n FROM events GROUP BY 1),
dense AS (SELECT p AS period, coalesce(n, 0) AS rows FROM (SELECT unnest(generate_series((SELECT min(period) FROM sparse), (SELECT max(period) FROM sparse))) AS p) LEFT JOIN sparse ON p = period)"""


def sparse_counts(spark, sf):
    e = S.table(spark, sf, "events").withColumn("period", F.expr("unix_seconds(cast(ts AS timestamp)) div 600"))
    return M.rows_per_period(e)


@query(
    "e38_rows_per_period",
    f"""WITH {SPARSE_SQL} SELECT period, rows, bool_and(rows > 0) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM dense""",
)
def e38(spark, sf):
    t = sparse_counts(spark, sf).withColumn("ok", F.col("rows") > 0)
    return M.onward(t, "period", "ok").drop("ok")


@query(
    "f09_rolling_density",
    f"""WITH {SPARSE_SQL}, w AS (SELECT *, CASE WHEN count(*) OVER x = 3 THEN CAST(sum(rows) OVER x AS BIGINT) END AS rolling FROM dense WINDOW x AS (ORDER BY period ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT period, rows, rolling, rows > 0 AND coalesce(rolling >= 6, true) AS ok FROM w""",
)
def f09(spark, sf):
    return M.dense_enough(sparse_counts(spark, sf), "period", 3, 6)


@query(
    "e41_symbols_without_data",
    """SELECT DISTINCT 'C' || c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
)
def e41(spark, sf):
    o = S.table(spark, sf, "orders")
    sym = F.concat(F.lit("C"), "o_custkey").alias("symbol")
    u = S.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return V.without_any(u, o.filter("o_orderstatus = 'F'").select(sym).distinct(), o.filter("o_totalprice > 400000").select(sym).distinct())


@query(
    "e42_current_against_history",
    f"""WITH {S.MEMBERS_SQL}, cur AS (SELECT CASE WHEN CAST(symbol[2:] AS BIGINT) % 7 = 0 THEN 'R' || symbol ELSE symbol END AS symbol FROM member_current UNION SELECT CASE WHEN user_id % 7 = 1 THEN 'U' ELSE 'E' END || user_id FROM events UNION SELECT 'X' || s_suppkey FROM supplier),
    h AS (SELECT symbol, max(date) FILTER (WHERE k = 'a') AS a, max(date) FILTER (WHERE k = 'r') AS r FROM (SELECT added AS symbol, date, 'a' AS k FROM member_event WHERE added <> '' UNION ALL
      SELECT removed, date, 'r' FROM member_event WHERE removed <> '') GROUP BY symbol),
    j AS (SELECT coalesce(h.symbol, cur.symbol) AS symbol, a, r, cur.symbol IS NOT NULL AS here FROM h FULL JOIN cur ON h.symbol = cur.symbol)
    SELECT * FROM (SELECT symbol, CAST(a AS VARCHAR) AS last_add, CAST(r AS VARCHAR) AS last_remove, CASE WHEN NOT here AND a IS NOT NULL AND a > coalesce(r, DATE '0001-01-01') THEN 'omission'
      WHEN here AND coalesce(r, DATE '0001-01-01') > coalesce(a, DATE '0001-01-01') THEN 'stale' WHEN here AND a IS NULL AND r IS NULL THEN 'never' END AS finding FROM j) WHERE finding IS NOT NULL""",
)
def e42(spark, sf):
    renamed = F.substring("symbol", 2, 20).cast("long") % 7 == 0
    c = S.member_current(spark, sf).select(F.when(renamed, F.concat(F.lit("R"), "symbol")).otherwise(F.col("symbol")).alias("symbol"))
    e = S.table(spark, sf, "events").select(F.concat(F.when(F.col("user_id") % 7 == 1, "U").otherwise("E"), "user_id").alias("symbol"))
    x = S.table(spark, sf, "supplier").select(F.concat(F.lit("X"), "s_suppkey").alias("symbol"))
    cur = c.union(e).union(x).distinct()
    f = M.against_current(S.member_events(spark, sf), cur)
    return f.select("symbol", F.col("last_add").cast("string").alias("last_add"), F.col("last_remove").cast("string").alias("last_remove"), "finding")


NAMED_SQL = """named_row AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, p_name AS name, l_partkey AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
seen AS (SELECT symbol, min(d) AS first_seen, arg_max(name, struct_pack(d := d, k := k)) AS latest_name FROM named_row GROUP BY symbol)"""


def seen(spark, sf):
    line = S.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("d"))
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    rows = line.join(part, "l_partkey").withColumn("symbol", F.concat(F.lit("S"), "l_suppkey"))
    return V.first_and_latest(rows, "symbol", "name", "d", "l_partkey")


@query("e43_first_and_latest", f"WITH {NAMED_SQL} SELECT symbol, CAST(first_seen AS VARCHAR) AS first_seen, latest_name FROM seen")
def e43(spark, sf):
    return seen(spark, sf).select("symbol", F.col("first_seen").cast("string").alias("first_seen"), "latest_name")


@query(
    "s23_reused_symbols",
    f"""WITH {NAMED_SQL}, p AS (SELECT 'S' || s_suppkey AS symbol, p_name || CASE s_suppkey % 4 WHEN 0 THEN ' ETF' WHEN 1 THEN ' Inc' ELSE '' END AS pname, DATE '1995-01-01' + CAST(s_suppkey % 9 AS INTEGER) AS ipo,
        CASE WHEN s_suppkey % 3 = 0 THEN '00' || s_suppkey ELSE '' END AS list_id, CASE WHEN s_suppkey % 6 = 0 THEN '0' || (s_suppkey + 1) ELSE '0000' || s_suppkey END AS profile_id, s_acctbal > 5000 AS cont
      FROM supplier JOIN part ON p_partkey = s_suppkey),
    t AS (SELECT p.*, first_seen, list_filter(list_distinct(string_split_regex(regexp_replace(lower(latest_name), '[^a-z0-9 ]', ' ', 'g'), ' +')), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS th,
      list_filter(list_distinct(string_split_regex(regexp_replace(lower(pname), '[^a-z0-9 ]', ' ', 'g'), ' +')), lambda w: length(w) > 1 AND w NOT IN ({STOPS})) AS tp FROM p JOIN seen USING (symbol)),
    c AS (SELECT *, len(th) > 0 AND len(tp) > 0 AND NOT list_has_any(th, tp) AS clash, cont OR contains(pname, 'ETF') AS backed FROM t)
    SELECT symbol, clash, CASE WHEN clash AND backed THEN 1 WHEN clash THEN 2 END AS tier, ipo > first_seen AS listed_after_seen, ipo > first_seen AND clash AS seen_and_clash,
      ltrim(list_id, '0') <> '' AND ltrim(profile_id, '0') <> '' AND ltrim(list_id, '0') <> ltrim(profile_id, '0') AS id_differs FROM c""",
)
def s23(spark, sf):
    s = S.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    part = S.table(spark, sf, "part").select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    k = F.col("s_suppkey")
    p = s.join(part, "s_suppkey").select(
        F.concat(F.lit("S"), k).alias("symbol"),
        F.concat("p_name", F.when(k % 4 == 0, " ETF").when(k % 4 == 1, " Inc").otherwise("")).alias("profile_name"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 9).cast("int")).alias("ipo"),
        F.when(k % 3 == 0, F.concat(F.lit("00"), k)).otherwise("").alias("list_id"),
        F.when(k % 6 == 0, F.concat(F.lit("0"), k + 1)).otherwise(F.concat(F.lit("0000"), k)).alias("profile_id"),
        (F.col("s_acctbal") > 5000).alias("continues_after"),
    )
    return V.reused_symbols(p.join(seen(spark, sf).withColumnRenamed("latest_name", "history_name"), "symbol"))


# ---------------------------------------------------------------- lags of records
LAG_SQL = """rel AS (SELECT DISTINCT strftime(date_trunc('quarter', o_orderdate), '%Y-%m') AS month FROM orders),
cases AS (SELECT o_orderkey AS "case", CAST(o_orderdate AS DATE) AS d, (SELECT min(month) FROM rel WHERE month > strftime(o_orderdate + to_months(CAST(1 + o_orderkey % 17 AS INTEGER)), '%Y-%m') AND month > '1996-01') AS carried
  FROM orders),
c2 AS (SELECT *, (SELECT min(month) FROM rel WHERE month > strftime(d, '%Y-%m') AND month > '1996-01') AS fp, (SELECT max(month) FROM rel) AS lastm FROM cases WHERE carried IS NOT NULL)"""


def lag_cases(spark, sf):
    o = S.table(spark, sf, "orders")
    rel = o.select(F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM").alias("month")).distinct()
    target = F.date_format(F.add_months("o_orderdate", (1 + F.col("o_orderkey") % 17).cast("int")), "yyyy-MM")
    after = F.filter("_rel", lambda m: (m > F.col("_t")) & (m > "1996-01"))
    cases = (
        o.select(F.col("o_orderkey").alias("case"), F.col("o_orderdate").cast("date").alias("happened"), target.alias("_t"))
        .crossJoin(F.broadcast(V.release_array(rel)))
        .withColumn("carried", F.when(F.size(after) > 0, F.element_at(after, 1)))
        .filter("carried is not null").drop("_rel", "_t")
    )
    return V.record_lags(cases, rel, "1996-01")


@query(
    "c12_f14_s21_record_lags",
    """WITH """ + LAG_SQL + """ SELECT "case", CAST(d AS VARCHAR) AS happened, carried, fp AS first_possible, CAST(CAST(carried || '-01' AS DATE) - d AS INTEGER) AS lag_days,
      CAST(CAST(carried || '-01' AS DATE) - CAST(fp || '-01' AS DATE) AS INTEGER) AS days_after_first,
      (SELECT count(*) FROM rel WHERE month <= carried) - (SELECT count(*) FROM rel WHERE month <= fp) + 1 AS position, d < DATE '1996-01-01' AS before_base,
      CAST(CASE WHEN d < DATE '1996-01-01' THEN CAST(fp || '-01' AS DATE) - d ELSE CAST(lastm || '-01' AS DATE) - d END AS INTEGER) AS bound_days,
      CASE WHEN CAST(carried || '-01' AS DATE) - d <= 120 THEN 'fast' ELSE 'slow' END AS speed FROM c2""",
)
def s21(spark, sf):
    return lag_cases(spark, sf)


EVIDENCE_SQL = S.EDGES_SQL + """, samp AS (SELECT 'P' || s AS subject, 'S' || p AS party, CASE (s + p) % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'NO EVENT' ELSE 'UNCLEAR' END AS verdict,
   '2026-0' || (1 + s % 9) || '-15' AS stamp FROM edge_both WHERE q_old IS NOT NULL),
evid AS (SELECT 'P' || s AS subject, 'S' || p AS party, CASE (s + p) % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'NO EVENT' ELSE CASE WHEN s % 10 = 0 THEN 'REAL' ELSE 'UNCLEAR' END END AS verdict,
   CASE WHEN p % 11 = 0 THEN '2025' ELSE '2026-0' || (1 + s % 9) END AS stamp FROM edge_both WHERE q_new IS NOT NULL)"""


@query(
    "c16_evidence_problems",
    f"""WITH {EVIDENCE_SQL}, j AS (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.party, b.party) AS party, CASE WHEN b.subject IS NULL THEN 'missing' WHEN a.subject IS NULL THEN 'extra'
      WHEN a.verdict <> b.verdict THEN 'verdict differs' WHEN NOT starts_with(a.stamp, b.stamp) THEN 'stamp differs' END AS problem FROM samp a FULL JOIN evid b ON a.subject = b.subject AND a.party = b.party)
    SELECT * FROM j WHERE problem IS NOT NULL""",
)
def c16(spark, sf):
    e = S._edge_both(spark, sf).withColumns(
        {"s": F.substring("subject", 2, 20).cast("long"), "p": F.substring("party", 2, 20).cast("long")}
    )
    m = (F.col("s") + F.col("p")) % 3
    stamp = F.concat(F.lit("2026-0"), 1 + F.col("s") % 9)
    v = F.when(m == 0, "REAL").when(m == 1, "NO EVENT")
    sample = e.filter("q_old is not null").select("subject", "party", v.otherwise("UNCLEAR").alias("verdict"), F.concat(stamp, F.lit("-15")).alias("stamp"))
    evidence = e.filter("q_new is not null").select(
        "subject", "party", v.otherwise(F.when(F.col("s") % 10 == 0, "REAL").otherwise("UNCLEAR")).alias("verdict"),
        F.when(F.col("p") % 11 == 0, "2025").otherwise(stamp).alias("stamp"),
    )
    return V.evidence_problems(sample, evidence)


# ---------------------------------------------------------------- small reports
@query("g02_largest_pairs", f"WITH {QV.PAIR_SQL} SELECT prev_month, month, changed FROM pair_table ORDER BY changed DESC, month LIMIT 3")
def g02(spark, sf):
    """A top-k report: the limit is the feature."""
    return QV.pair_table(spark, sf).orderBy(F.col("changed").desc(), "month").limit(3).select("prev_month", "month", "changed")


@query(
    "g05_recent_distinct",
    """WITH x AS (SELECT o_custkey AS c, max(struct_pack(d := o_orderdate, k := o_orderkey)) AS m FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT 'C' || c AS symbol, CAST(CAST(m.d AS DATE) AS VARCHAR) AS date FROM x ORDER BY m DESC LIMIT 3""",
)
def g05(spark, sf):
    """Most recent three distinct names that meet a predicate."""
    o = S.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    m = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return m.orderBy(F.col("m").desc()).limit(3).select(
        F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.col("m.o_orderdate").cast("date").cast("string").alias("date")
    )
