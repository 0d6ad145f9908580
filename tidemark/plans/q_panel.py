"""Queries on prices, returns, portfolios and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import (
    ANNUAL_PCT_DAILY, ANNUAL_PCT_MONTHLY, NW_LAGS_DAILY, NW_LAGS_MONTHLY_FACTOR,
    NW_LAGS_SPREAD, POWER_80, QUANTILE_LEGS, T_CONVENTIONAL, T_NEW_FACTOR,
)
from tidemark.functions.cleaning import half_up
from tidemark.operators import panel as P
from tidemark.operators import regression as R
from tidemark.operators.calendar import month_of
from tidemark.operators.ordering import legs, quantiles
from tidemark.plans import standins as S
from tidemark.plans.q_graph import rounded
from tidemark.plans.registry import query, r
from tidemark.session import materialise

MONTHLY_SQL = (
    S.PRICES_SQL
    + """, month_end AS (SELECT symbol, strftime(date, '%Y-%m') AS month, arg_max(price, date) AS price
  FROM prices GROUP BY 1, 2),
monthly AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY month) - 1 AS ret FROM month_end),
kept AS (SELECT * FROM monthly WHERE ret BETWEEN -0.9 AND 2.0)
"""
)
DAILY_SQL = (
    S.BRAND_SQL
    + """, daily AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM prices)
"""
)


def monthly(spark, sf):
    return P.row_returns(P.month_end_prices(S.prices(spark, sf)), "month")


def daily(spark, sf):
    return P.row_returns(S.brand_prices(spark, sf), "date")


@query("f01_month_end_price", f"WITH {MONTHLY_SQL} SELECT symbol, month, {r('price', 4)} AS price FROM month_end")
def f01(spark, sf):
    return rounded(P.month_end_prices(S.prices(spark, sf)), "price", places=4)


@query("f02_row_returns", f"WITH {MONTHLY_SQL} SELECT symbol, month, {r('ret', 6)} AS ret FROM monthly")
def f02(spark, sf):
    return rounded(monthly(spark, sf), "ret").drop("price")


@query(
    "b23_return_range",
    f"""WITH {MONTHLY_SQL} SELECT count(ret) AS returns, count(*) FILTER (WHERE ret BETWEEN -0.9 AND 2.0) AS kept,
    count(*) FILTER (WHERE ret NOT BETWEEN -0.9 AND 2.0) AS dropped FROM monthly""",
)
def b23(spark, sf):
    return P.range_counts(monthly(spark, sf))


@query(
    "b24_extreme_moves",
    f"""WITH {DAILY_SQL}, x AS (SELECT symbol, count(*) FILTER (WHERE abs(ret) > 0.5) AS n_extreme,
      max(abs(ret)) FILTER (WHERE abs(ret) > 0.5) AS worst FROM daily GROUP BY symbol)
    SELECT symbol, n_extreme, {r('worst', 6)} AS worst FROM x WHERE n_extreme > 0""",
)
def b24(spark, sf):
    return rounded(P.extreme_symbols(daily(spark, sf)), "worst")


@query(
    "b24_symbols_kept",
    f"""WITH {DAILY_SQL} SELECT symbol, count(ret) AS returns FROM daily GROUP BY symbol
    HAVING count(*) FILTER (WHERE abs(ret) > 0.5) < 900""",
)
def b24_kept(spark, sf):
    return P.without_broken(daily(spark, sf), 900).groupBy("symbol").agg(F.count("ret").alias("returns"))


@query(
    "e35_compounded_month",
    f"""WITH {DAILY_SQL} SELECT symbol, strftime(date, '%Y-%m') AS month,
    {r('exp(sum(ln(1 + ret))) - 1', 6)} AS ret FROM daily WHERE ret IS NOT NULL GROUP BY 1, 2""",
)
def e35(spark, sf):
    d = daily(spark, sf).withColumn("month", month_of(F.col("date")))
    return rounded(P.compounded(d, "month"), "ret")


WEIGHT_SQL = """weight AS (SELECT symbol, cap, dv,
    CASE WHEN cap > 0 THEN cap WHEN dv > 0 THEN dv END AS weight,
    CASE WHEN cap > 0 THEN 'market value' WHEN dv > 0 THEN 'traded value' ELSE 'none' END AS source
  FROM (SELECT symbol, median(price * volume) AS dv FROM prices GROUP BY symbol)
  LEFT JOIN (SELECT p_brand AS symbol, sum(p_retailprice) FILTER (WHERE p_size > 25) AS cap
             FROM part WHERE substr(p_brand, -1) <> '3' GROUP BY 1) USING (symbol))"""


def weight_table(spark, sf):
    dv = P.liquidity(S.brand_prices(spark, sf)).select("symbol", F.col("dollar_vol").alias("dv"))
    cap = (
        S.table(spark, sf, "part").filter(~F.col("p_brand").endswith("3"))
        .groupBy(F.col("p_brand").alias("symbol"))
        .agg(F.sum(F.when(F.col("p_size") > 25, F.col("p_retailprice"))).alias("cap"))
    )
    return P.weights(dv.join(cap, "symbol", "left"), "cap", "dv")


@query(
    "e37_weight_source",
    f"""WITH {S.BRAND_SQL}, {WEIGHT_SQL} SELECT source, count(*) AS symbols, {r('sum(weight)', 2)} AS weight
    FROM weight GROUP BY source""",
)
def e37(spark, sf):
    w = weight_table(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("weight").alias("weight")
    )
    return rounded(w, "weight", places=2)


PORT_SQL = f"""{DAILY_SQL}, {WEIGHT_SQL},
ewd AS (SELECT date AS period, avg(ret) AS port FROM daily WHERE ret IS NOT NULL GROUP BY 1),
vwd AS (SELECT date AS period, sum(weight * ret) / sum(weight) AS port FROM daily JOIN weight USING (symbol)
        WHERE ret IS NOT NULL AND weight IS NOT NULL GROUP BY 1),
cm AS (SELECT symbol, strftime(date, '%Y-%m') AS period, exp(sum(ln(1 + ret))) - 1 AS ret
       FROM daily WHERE ret IS NOT NULL GROUP BY 1, 2),
ewm AS (SELECT period, avg(ret) AS port FROM cm GROUP BY 1),
vwm AS (SELECT period, sum(weight * ret) / sum(weight) AS port FROM cm JOIN weight USING (symbol)
        WHERE weight IS NOT NULL GROUP BY 1),
ports AS (SELECT 'EW' AS weighting, 'D' AS freq, CAST(period AS VARCHAR) AS period, port FROM ewd
  UNION ALL SELECT 'VW', 'D', CAST(period AS VARCHAR), port FROM vwd
  UNION ALL SELECT 'EW', 'M', period, port FROM ewm UNION ALL SELECT 'VW', 'M', period, port FROM vwm)"""


def portfolios(spark, sf):
    """Four portfolio series: equal and value weights, daily and monthly."""
    d = daily(spark, sf)
    d = d.join(weight_table(spark, sf).select("symbol", "weight"), "symbol")
    d = materialise(d.withColumn("month", month_of(F.col("date"))))
    m = P.compounded(d, "month", ["weight"])
    out = []
    for freq, frame, period in (("D", d, "date"), ("M", m, "month")):
        for label, w in (("EW", None), ("VW", "weight")):
            out.append(
                P.portfolio(frame, period, w).select(
                    F.lit(label).alias("weighting"), F.lit(freq).alias("freq"),
                    F.col(period).cast("string").alias("period"), "port",
                )
            )
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("e36_portfolios", f"WITH {PORT_SQL} SELECT weighting, freq, period, {r('port', 6)} AS port FROM ports")
def e36(spark, sf):
    return rounded(portfolios(spark, sf), "port")


# ---------------------------------------------------------------- legs and spreads
ARMS = ["2025_zero", "2025_impute", "2026_zero", "2026_impute"]
ARM_SQL = """arm_wide AS (
  SELECT 'S' || l_suppkey AS symbol,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1999-01-01') AS a,
    sum(l_quantity) FILTER (WHERE l_returnflag IS DISTINCT FROM 'R' AND l_shipdate < TIMESTAMP '1999-01-01') AS b,
    sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS c,
    sum(l_quantity) FILTER (WHERE l_returnflag IS DISTINCT FROM 'R') AS d FROM lineitem GROUP BY 1),
arm_long AS (
  SELECT symbol, '2025_zero' AS arm, coalesce(a, 0) AS mw FROM arm_wide
  UNION ALL SELECT symbol, '2025_impute', coalesce(a, 0) + 0.5 * coalesce(b, 0) FROM arm_wide
  UNION ALL SELECT symbol, '2026_zero', coalesce(c, 0) FROM arm_wide
  UNION ALL SELECT symbol, '2026_impute', coalesce(c, 0) + 0.5 * coalesce(d, 0) FROM arm_wide),
arm_rank AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY mw DESC, symbol) AS i,
  count(*) OVER (PARTITION BY arm) AS n FROM arm_long WHERE mw > 0),
leg AS (SELECT symbol, arm, mw, greatest(1, n // 5) AS k,
  CASE WHEN i <= greatest(1, n // 5) THEN 'top' WHEN i > n - greatest(1, n // 5) THEN 'bottom' END AS leg FROM arm_rank)"""


def arm_table(spark, sf):
    q, early = F.col("l_quantity"), F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    stated = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    zero = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0.0))
    w = S.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).agg(
        zero(stated & early).alias("a"), zero(~stated & early).alias("b"), zero(stated).alias("c"), zero(~stated).alias("d"),
    )
    row = lambda arm, x: F.struct(F.lit(arm).alias("arm"), x.alias("mw"))
    return w.select(
        "symbol",
        F.inline(
            F.array(
                row("2025_zero", F.col("a")), row("2025_impute", F.col("a") + 0.5 * F.col("b")),
                row("2026_zero", F.col("c")), row("2026_impute", F.col("c") + 0.5 * F.col("d")),
            )
        ),
    )


def leg_table(spark, sf):
    return legs(arm_table(spark, sf).filter("mw > 0"), "mw", "symbol", QUANTILE_LEGS, ["arm"])


@query("f04_legs", f"WITH {ARM_SQL} SELECT arm, symbol, mw, k, leg FROM leg WHERE leg IS NOT NULL")
def f04(spark, sf):
    return leg_table(spark, sf).filter("leg is not null").select("arm", "symbol", "mw", "k", "leg")


SPREAD_SQL = f"""{MONTHLY_SQL}, {ARM_SQL}, spread AS (SELECT * FROM (
  SELECT arm, month, avg(ret) FILTER (WHERE leg = 'top') - avg(ret) FILTER (WHERE leg = 'bottom') AS spread
  FROM kept JOIN leg USING (symbol) WHERE leg IS NOT NULL GROUP BY 1, 2) WHERE spread IS NOT NULL)"""


def spread(spark, sf):
    return P.leg_spread(
        P.plausible(monthly(spark, sf)).select("symbol", "month", "ret"),
        leg_table(spark, sf).select("arm", "symbol", "leg"), ["arm"],
    )


@query("s11_leg_spread", f"WITH {SPREAD_SQL} SELECT arm, month, {r('spread', 6)} AS spread FROM spread")
def s11(spark, sf):
    return rounded(spread(spark, sf), "spread")


def nw_sql(name: str, source: str, group: str, order: str, value: str, lags: int) -> str:
    lag_cols = ", ".join(f"lag(e, {k}) OVER (PARTITION BY {group} ORDER BY {order}) AS e{k}" for k in range(1, lags + 1))
    total = "sum(e * e) / max(n)" + "".join(
        f" + {2.0 * (1.0 - k / (lags + 1.0))!r}::DOUBLE * coalesce(sum(e * e{k}), 0) / max(n)" for k in range(1, lags + 1)
    )
    return f"""{name}_e AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {group}) AS e,
  avg({value}) OVER (PARTITION BY {group}) AS mu, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
{name}_l AS (SELECT *, {lag_cols} FROM {name}_e),
{name} AS (SELECT {group}, n, mean, mean / nullif(sqrt(g0 / (n - 1)), 0) AS t_ols, mean / se_nw AS t_nw, se_nw FROM (
  SELECT {group}, max(n) AS n, max(mu) AS mean, sum(e * e) / max(n) AS g0,
    sqrt(greatest({total}, 1e-18) / max(n)) AS se_nw FROM {name}_l GROUP BY {group}))"""


NW_SQL = f"{SPREAD_SQL}, {nw_sql('nw', 'spread', 'arm', 'month', 'spread', NW_LAGS_SPREAD)}"


@query(
    "s04_newey_west_mean",
    f"WITH {NW_SQL} SELECT arm, n, {r('mean', 6)} AS mean, {r('t_ols', 6)} AS t_ols, {r('t_nw', 6)} AS t_nw, {r('se_nw', 6)} AS se_nw FROM nw",
)
def s04(spark, sf):
    t = R.newey_west_mean(spread(spark, sf), ["arm"], "month", "spread", NW_LAGS_SPREAD)
    return rounded(t, "mean", "t_ols", "t_nw", "se_nw")


LAGGED_SQL = f"""{SPREAD_SQL}, ce AS (SELECT arm, month, spread - avg(spread) OVER (PARTITION BY arm) AS e FROM spread),
cl AS (SELECT *, lag(e, 1) OVER (PARTITION BY arm ORDER BY month) AS e1, lag(e, 2) OVER (PARTITION BY arm ORDER BY month) AS e2,
  lag(e, 3) OVER (PARTITION BY arm ORDER BY month) AS e3 FROM ce)"""


@query(
    "f12_lagged_products",
    f"""WITH {LAGGED_SQL} SELECT arm, {r('sum(e * e)', 6)} AS s0, {r('coalesce(sum(e * e1), 0)', 6)} AS s1,
    {r('coalesce(sum(e * e2), 0)', 6)} AS s2, {r('coalesce(sum(e * e3), 0)', 6)} AS s3 FROM cl GROUP BY arm""",
)
def f12(spark, sf):
    c = R.centred(spread(spark, sf), ["arm"], "month", "spread").drop("mean", "n")
    return rounded(R.lagged_products(c, ["arm"], "month", "e", 3), "s0", "s1", "s2", "s3")


PAIR_SQL = f"""{SPREAD_SQL}, pair AS (SELECT b.arm[6:] AS rule, b.month, a.spread AS x, b.spread AS y, b.spread - a.spread AS d
  FROM spread a JOIN spread b ON a.month = b.month AND a.arm[6:] = b.arm[6:] AND a.arm[1:4] = '2025' AND b.arm[1:4] = '2026')"""


def split_arm(df):
    return df.withColumns({"release": F.substring("arm", 1, 4), "rule": F.substring("arm", 6, 20)})


def spread_pairs(series):
    return P.aligned(split_arm(series), ["rule", "month"], "release", "2025", "2026", "spread")


@query("c17_aligned_series", f"WITH {PAIR_SQL} SELECT rule, month, {r('x', 6)} AS x, {r('y', 6)} AS y FROM pair")
def c17(spark, sf):
    return rounded(spread_pairs(materialise(spread(spark, sf))), "x", "y").drop("d")


@query(
    "s05_newey_west_difference",
    f"WITH {PAIR_SQL}, {nw_sql('nw', 'pair', 'rule', 'month', 'd', NW_LAGS_SPREAD)} SELECT rule, n, {r('mean', 6)} AS mean, {r('se_nw', 6)} AS se_nw FROM nw",
)
def s05(spark, sf):
    t = R.newey_west_mean(spread_pairs(materialise(spread(spark, sf))), ["rule"], "month", "d", NW_LAGS_SPREAD)
    return rounded(t, "mean", "se_nw").select("rule", "n", "mean", "se_nw")


@query(
    "s12_spread_verdict",
    f"""WITH {PAIR_SQL}, {nw_sql('nw', 'spread', 'arm', 'month', 'spread', NW_LAGS_SPREAD)},
    c AS (SELECT rule, corr(x, y) AS rho FROM pair GROUP BY rule),
    v AS (SELECT b.arm[6:] AS rule, b.mean - a.mean AS diff, greatest(a.se_nw, b.se_nw) AS se FROM nw a JOIN nw b
      ON a.arm[6:] = b.arm[6:] AND a.arm[1:4] = '2025' AND b.arm[1:4] = '2026')
    SELECT rule, {r('diff', 6)} AS diff, {r('se', 6)} AS se, {r('rho', 6)} AS rho,
      CASE WHEN abs(diff) < se AND rho > 0.95 THEN 'ROBUST' WHEN abs(diff) >= se OR rho < 0.90 THEN 'FRAGILE'
           ELSE 'MIXED' END AS verdict FROM v JOIN c USING (rule)""",
)
def s12(spark, sf):
    series = materialise(spread(spark, sf))
    means = split_arm(R.newey_west_mean(series, ["arm"], "month", "spread", NW_LAGS_SPREAD))
    v = P.spread_verdict(means, spread_pairs(series), "rule", "release", "2025", "2026")
    return rounded(v, "diff", "se", "rho")


@query(
    "s13_detectable_effect",
    f"""WITH {NW_SQL}, h AS (SELECT 'conventional' AS hurdle, 1.96::DOUBLE AS t UNION ALL SELECT 'new factor', 3.0::DOUBLE
      UNION ALL SELECT 'new factor, 80% power', 3.84::DOUBLE)
    SELECT arm, n, hurdle, {r('t * se_nw', 6)} AS mde, {r('pow(t * se_nw * sqrt(n) / 0.01::DOUBLE, 2)', 2)} AS needed,
      {r('t * se_nw / 0.01::DOUBLE', 6)} AS power_ratio FROM nw, h""",
)
def s13(spark, sf):
    t = R.newey_west_mean(spread(spark, sf), ["arm"], "month", "spread", NW_LAGS_SPREAD)
    hurdles = spark.createDataFrame(
        [
            ("conventional", T_CONVENTIONAL), ("new factor", T_NEW_FACTOR),
            ("new factor, 80% power", T_NEW_FACTOR + POWER_80),
        ],
        "name string, t double",
    )
    d = R.detectable(t.select("arm", "n", "se_nw"), "se_nw", "n", hurdles, 0.01)
    return rounded(rounded(d, "mde", "power_ratio"), "needed", places=2)


@query(
    "s13_power_grid",
    f"""WITH {NW_SQL}, h AS (SELECT 'conventional' AS hurdle, 1.96::DOUBLE AS t UNION ALL SELECT 'new factor', 3.0::DOUBLE),
      s AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS sd_times), k AS (SELECT unnest([1, 2, 5, 10])::BIGINT AS n_times),
      g AS (SELECT arm, sd_times, n * n_times AS n, hurdle, t * se_nw * sqrt(n::DOUBLE) * sd_times / sqrt((n * n_times)::DOUBLE) AS mde FROM nw, h, s, k)
    SELECT arm, sd_times, n, hurdle, {r('mde', 6)} AS mde, {r('mde', 6)} <= 0.01::DOUBLE AS detects FROM g""",
)
def s13_grid(spark, sf):
    t = R.newey_west_mean(spread(spark, sf), ["arm"], "month", "spread", NW_LAGS_SPREAD)
    hurdles = spark.createDataFrame([("conventional", T_CONVENTIONAL), ("new factor", T_NEW_FACTOR)], "name string, t double")
    t = t.select("arm", "n", (F.col("se_nw") * F.sqrt("n")).alias("sd"))
    g = rounded(R.power_grid(t, "sd", "n", hurdles, (0.5, 1.0, 2.0), (1, 2, 5, 10), 0.01), "mde")
    return g.withColumn("detects", F.col("mde") <= 0.01)


@query(
    "s03_arm_correlations",
    f"""WITH {SPREAD_SQL}, j AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.spread AS x, b.spread AS y
      FROM spread a JOIN spread b USING (month) WHERE a.arm < b.arm)
    SELECT arm_a, arm_b, count(*) AS months, {r('corr(x, y)', 6)} AS rho FROM j GROUP BY 1, 2""",
)
def s03(spark, sf):
    return rounded(P.arm_correlations(spread(spark, sf), "month", "arm", "spread", ARMS), "rho")


@query(
    "h05_h06_leg_turnover",
    f"""WITH {ARM_SQL}, t AS (SELECT arm, symbol, k FROM leg WHERE leg = 'top')
    SELECT rule, count(*) FILTER (WHERE a AND NOT b) AS left_top, count(*) FILTER (WHERE b AND NOT a) AS entered_top,
      count(*) FILTER (WHERE a <> b) AS differing, {r('count(*) FILTER (WHERE b AND NOT a)::DOUBLE / max(k)', 6)} AS turnover
    FROM (SELECT arm[6:] AS rule, symbol, bool_or(arm[1:4] = '2025') AS a, bool_or(arm[1:4] = '2026') AS b, max(k) AS k
      FROM t GROUP BY 1, 2) GROUP BY rule""",
)
def h05(spark, sf):
    t = split_arm(leg_table(spark, sf).filter("leg = 'top'"))
    return rounded(P.leg_turnover(t, "rule", "2025", "2026"), "turnover")


# ---------------------------------------------------------------- factor regressions
EXCESS_SQL = f"""{DAILY_SQL}, {S.FACTORS_SQL},
ew AS (SELECT date, avg(ret) AS port, count(ret) AS firms FROM daily WHERE ret IS NOT NULL GROUP BY 1),
excess AS (SELECT date, port - rf / 100 AS y, mkt / 100 AS mkt, smb / 100 AS smb, hml / 100 AS hml
  FROM ew JOIN factors USING (date))"""


def factor_days(spark, sf):
    f = S.factors(spark, sf)
    return f.select("date", *[(F.col(c) / 100).alias(c) for c in ("mkt", "smb", "hml", "rf")])


def excess(spark, sf):
    ew = P.portfolio(daily(spark, sf), "date")
    j = ew.join(F.broadcast(factor_days(spark, sf)), "date")
    return j.withColumn("y", F.col("port") - F.col("rf"))


@query("c01_inner_join_on_date", f"WITH {EXCESS_SQL} SELECT CAST(date AS VARCHAR) AS date, {r('y', 6)} AS y, {r('mkt', 6)} AS mkt FROM excess")
def c01(spark, sf):
    return rounded(
        excess(spark, sf).select(F.col("date").cast("string").alias("date"), "y", "mkt"), "y", "mkt"
    )


L = NW_LAGS_DAILY
OLS1_SQL = f"""{EXCESS_SQL},
b AS (SELECT regr_slope(y, mkt) AS b1, regr_intercept(y, mkt) AS b0, count(*)::DOUBLE AS n, sum(mkt) AS sx,
   sum(mkt * mkt) AS sxx, regr_r2(y, mkt) AS r2 FROM excess),
e AS (SELECT date, y - b0 - b1 * mkt AS e, (y - b0 - b1 * mkt) * mkt AS ex FROM excess, b),
el AS (SELECT e, ex, {', '.join(f'lag(e, {k}) OVER (ORDER BY date) AS e{k}, lag(ex, {k}) OVER (ORDER BY date) AS x{k}' for k in range(1, L + 1))} FROM e),
m AS (SELECT sum(e * e) {''.join(f' + {2 * (1 - k / (L + 1))!r}::DOUBLE * sum(e * e{k})' for k in range(1, L + 1))} AS s00,
   sum(e * ex) {''.join(f' + {1 - k / (L + 1)!r}::DOUBLE * (sum(e * x{k}) + sum(ex * e{k}))' for k in range(1, L + 1))} AS s01,
   sum(ex * ex) {''.join(f' + {2 * (1 - k / (L + 1))!r}::DOUBLE * sum(ex * x{k})' for k in range(1, L + 1))} AS s11 FROM el),
v AS (SELECT *, n * sxx - sx * sx AS det FROM b, m),
o AS (SELECT *, sqrt((sxx * (sxx * s00 - sx * s01) - sx * (sxx * s01 - sx * s11)) / (det * det)) AS se0,
   sqrt((sx * (sx * s00 - n * s01) - n * (sx * s01 - n * s11)) / (det * det)) AS se1 FROM v)"""


@query(
    "s06_ols_newey_west_one_factor",
    f"""WITH {OLS1_SQL} SELECT 'EW' AS model, CAST(n AS BIGINT) AS n, {r('r2', 6)} AS r2, 'const' AS term, {r('b0', 6)} AS coef, {r('se0', 6)} AS se, {r('b0 / se0', 4)} AS t FROM o
    UNION ALL SELECT 'EW', CAST(n AS BIGINT), {r('r2', 6)}, 'mkt', {r('b1', 6)}, {r('se1', 6)}, {r('b1 / se1', 4)} FROM o""",
)
def s06(spark, sf):
    d = excess(spark, sf).withColumn("model", F.lit("EW"))
    t = R.ols_newey_west(d, ["model"], "date", "y", ["mkt"], NW_LAGS_DAILY, 250)
    return rounded(rounded(t, "r2", "coef", "se"), "t", places=4)


def ols_sql(name: str, source: str, group: str, order: str, xs: tuple[str, ...], lags: int, min_rows: int) -> str:
    """SQL of the least squares of ``y`` on a constant and ``xs`` by group, eliminated beside the unit matrix."""
    z, k = ["1.0::DOUBLE", *xs], len(xs) + 1
    ks = range(k)
    cross = [f"sum({z[i]} * {z[j]}) AS m{i}_{j}" for i in ks for j in ks] + [f"{float(i == j)}::DOUBLE AS m{i}_{j + k}" for i in ks for j in ks]
    ctes = [
        f"{name}_d AS (SELECT {group}, {order} AS o, y, {', '.join(xs)} FROM {source} WHERE y IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in xs)})",
        f"{name}_p AS (SELECT {group}, count(*) AS n, var_pop(y) AS vy, {', '.join(f'sum({z[i]} * y) AS c{i}' for i in ks)}, {', '.join(cross)}"
        f" FROM {name}_d GROUP BY {group} HAVING count(*) >= {min_rows})",
    ]
    before = f"{name}_p"
    for p in ks:
        cells = [
            (f"m{p}_{j} / m{p}_{p}" if i == p else f"m{i}_{j} - m{i}_{p} / m{p}_{p} * m{p}_{j}") + f" AS m{i}_{j}"
            for i in ks for j in range(2 * k)
        ]
        ctes.append(f"{name}_p{p} AS (SELECT {group}, n, vy, {', '.join(f'c{i}' for i in ks)}, {', '.join(cells)} FROM {before})")
        before = f"{name}_p{p}"
    coef = ", ".join(" + ".join(f"m{i}_{j + k} * c{j}" for j in ks) + f" AS b{i}" for i in ks)
    lagged = [
        f"u{i}" + "".join(f" + {2 * (1 - g / (lags + 1.0))!r}::DOUBLE * coalesce(lag(u{i}, {g}) OVER w, 0)" for g in range(1, lags + 1)) + f" AS s{i}"
        for i in ks
    ]
    form = lambda i: " + ".join(f"m{i}_{a + k} * q{a}_{b} * m{i}_{b + k}" for a in ks for b in ks)
    ctes += [
        f"{name}_b AS (SELECT *, {coef} FROM {before})",
        f"{name}_e AS (SELECT d.*, y - ({' + '.join(f'b{i} * {z[i]}' for i in ks)}) AS e FROM {name}_d d JOIN {name}_b USING ({group}))",
        f"{name}_u AS (SELECT {group}, o, e, {', '.join(f'e * {z[i]} AS u{i}' for i in ks)} FROM {name}_e)",
        f"{name}_l AS (SELECT *, {', '.join(lagged)} FROM {name}_u WINDOW w AS (PARTITION BY {group} ORDER BY o))",
        f"{name}_s AS (SELECT {group}, sum(e * e) AS sse, {', '.join(f'sum(u{i} * s{j}) AS q{i}_{j}' for i in ks for j in ks)} FROM {name}_l GROUP BY {group})",
        f"{name} AS ("
        + " UNION ALL ".join(
            f"SELECT {group}, n, 1 - sse / nullif(vy * n, 0) AS r2, '{term}' AS term, b{i} AS coef, sqrt(greatest(0, {form(i)})) AS se"
            f" FROM {name}_b JOIN {name}_s USING ({group})"
            for i, term in enumerate(("const", *xs))
        )
        + ")",
    ]
    return ",\n".join(ctes)


FACTOR_COLS = ("mkt", "smb", "hml")
TERM_SQL = f"CAST(n AS BIGINT) AS n, {r('r2', 6)} AS r2, term, {r('coef', 6)} AS coef, {r('se', 6)} AS se, {r('coef / nullif(se, 0)', 6)} AS t"


def alpha_sql(year) -> str:
    return f"{r(f'CASE WHEN term = {chr(39)}const{chr(39)} THEN coef * {float(year)!r}::DOUBLE END', 6)} AS alpha_pct_year"


@query(
    "s07_factor_regression",
    f"""WITH {EXCESS_SQL}, one AS (SELECT 'EW' AS model, * FROM excess), {ols_sql('fit', 'one', 'model', 'date', FACTOR_COLS, NW_LAGS_DAILY, 250)}
    SELECT model, {TERM_SQL}, {alpha_sql(ANNUAL_PCT_DAILY)} FROM fit""",
)
def s07(spark, sf):
    d = excess(spark, sf).withColumn("model", F.lit("EW"))
    t = R.ols_newey_west(d, ["model"], "date", "y", ["mkt", "smb", "hml"], NW_LAGS_DAILY, 250)
    return rounded(
        t.withColumn(
            "alpha_pct_year", F.when(F.col("term") == "const", F.col("coef") * ANNUAL_PCT_DAILY)
        ),
        "r2", "coef", "se", "t", "alpha_pct_year",
    )


@query(
    "s08_symbol_betas",
    f"""WITH {DAILY_SQL}, {S.FACTORS_SQL} SELECT symbol, count(*) AS days,
      {r('regr_slope(ret - rf / 100, mkt / 100)', 4)} AS beta FROM daily JOIN factors USING (date) WHERE ret IS NOT NULL GROUP BY symbol""",
)
def s08(spark, sf):
    return rounded(P.symbol_betas(daily(spark, sf), factor_days(spark, sf)), "beta", places=4)


@query(
    "s09_sub_period_regressions",
    f"""WITH {EXCESS_SQL}, cut AS (SELECT CASE WHEN year(date) <= 1996 THEN '1995-1996' WHEN year(date) <= 1998 THEN '1997-1998' ELSE '1999-2001' END AS period, *
      FROM excess), {ols_sql('fit', 'cut', 'period', 'date', FACTOR_COLS, NW_LAGS_DAILY, 250)} SELECT period, {TERM_SQL} FROM fit""",
)
def s09(spark, sf):
    d = excess(spark, sf).withColumn(
        "period",
        F.when(F.year("date") <= 1996, "1995-1996").when(F.year("date") <= 1998, "1997-1998").otherwise("1999-2001"),
    )
    t = R.ols_newey_west(d, ["period"], "date", "y", ["mkt", "smb", "hml"], NW_LAGS_DAILY, 250)
    return rounded(t, "r2", "coef", "se", "t")


GROWN_SQL = ", ".join(f"exp(sum(ln(1 + {c} / 100))) - 1 AS {c}" for c in (*FACTOR_COLS, "rf"))


@query(
    "s10_weighting_by_frequency",
    f"""WITH {PORT_SQL}, {S.FACTORS_SQL},
    fall AS (SELECT 'D' AS freq, CAST(date AS VARCHAR) AS period, mkt / 100 AS mkt, smb / 100 AS smb, hml / 100 AS hml, rf / 100 AS rf FROM factors
      UNION ALL SELECT 'M', strftime(date, '%Y-%m'), {GROWN_SQL} FROM factors GROUP BY 2),
    over AS (SELECT weighting, freq, period, port - rf AS y, mkt, smb, hml FROM ports JOIN fall USING (freq, period)),
    overd AS (SELECT * FROM over WHERE freq = 'D'), overm AS (SELECT * FROM over WHERE freq = 'M'),
    {ols_sql('fd', 'overd', 'weighting', 'period', FACTOR_COLS, NW_LAGS_DAILY, 60)}, {ols_sql('fm', 'overm', 'weighting', 'period', FACTOR_COLS, NW_LAGS_MONTHLY_FACTOR, 60)}
    SELECT weighting, {TERM_SQL}, 'D' AS freq, {alpha_sql(ANNUAL_PCT_DAILY)} FROM fd UNION ALL SELECT weighting, {TERM_SQL}, 'M', {alpha_sql(ANNUAL_PCT_MONTHLY)} FROM fm""",
)
def s10(spark, sf):
    f = factor_days(spark, sf)
    fd = f.select(F.lit("D").alias("freq"), F.col("date").cast("string").alias("period"), "mkt", "smb", "hml", "rf")
    grow = lambda c: (F.exp(F.sum(F.log1p(c))) - 1).alias(c)
    fm = f.groupBy(month_of(F.col("date")).alias("period")).agg(*[grow(c) for c in ("mkt", "smb", "hml", "rf")])
    fm = fm.select(F.lit("M").alias("freq"), "period", "mkt", "smb", "hml", "rf")
    ports = materialise(portfolios(spark, sf))
    parts = []
    for freq, facs, lags, year in (
        ("D", fd, NW_LAGS_DAILY, ANNUAL_PCT_DAILY), ("M", fm, NW_LAGS_MONTHLY_FACTOR, ANNUAL_PCT_MONTHLY),
    ):
        d = ports.filter(F.col("freq") == freq).drop("freq").join(F.broadcast(facs.drop("freq")), "period")
        d = d.withColumn("y", F.col("port") - F.col("rf"))
        t = R.ols_newey_west(d, ["weighting"], "period", "y", ["mkt", "smb", "hml"], lags, 60)
        parts.append(
            t.withColumn("freq", F.lit(freq)).withColumn(
                "alpha_pct_year", F.when(F.col("term") == "const", F.col("coef") * year)
            )
        )
    return rounded(parts[0].unionByName(parts[1]), "r2", "coef", "se", "t", "alpha_pct_year")


# ---------------------------------------------------------------- spans, gaps and conventions
MARKET_SQL = "market AS (SELECT date, avg(price) AS price FROM prices GROUP BY date)"
SPAN_SQL = f"""{S.PRICES_SQL}, {MARKET_SQL},
last_day AS (SELECT symbol, max(date) AS e FROM prices GROUP BY symbol),
span AS (SELECT symbol, min(date) AS lo, max(date) AS hi, count(*) AS bars,
   arg_max(price, date) / arg_min(price, date) - 1 AS ret FROM prices JOIN last_day USING (symbol)
   WHERE date >= e - 365 GROUP BY symbol HAVING count(*) >= 60),
gap AS (SELECT s.symbol, s.lo, s.hi, s.bars, s.ret, x.mkt, s.ret - x.mkt AS gap FROM span s,
  LATERAL (SELECT arg_max(price, date) / arg_min(price, date) - 1 AS mkt, count(*) AS c FROM market m
           WHERE m.date BETWEEN s.lo AND s.hi) x WHERE x.c >= 2)"""


def market(prices):
    return prices.groupBy("date").agg(F.avg("price").alias("price"))


def gaps(spark, sf):
    p = materialise(S.prices(spark, sf))
    return materialise(P.gap_to_market(P.span_returns(p, 365, 60), market(p)))


@query(
    "f03_span_returns",
    f"WITH {SPAN_SQL} SELECT symbol, CAST(lo AS VARCHAR) AS lo, CAST(hi AS VARCHAR) AS hi, bars, {r('ret', 6)} AS ret FROM span",
)
def f03(spark, sf):
    s = P.span_returns(S.prices(spark, sf), 365, 60)
    return rounded(
        s.select("symbol", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), "bars", "ret"), "ret"
    )


@query("c14_market_in_span", f"WITH {SPAN_SQL} SELECT symbol, {r('ret', 6)} AS ret, {r('mkt', 6)} AS mkt, {r('gap', 6)} AS gap FROM gap")
def c14(spark, sf):
    return rounded(gaps(spark, sf).select("symbol", "ret", "mkt", "gap"), "ret", "mkt", "gap")


@query(
    "s24_survivorship_gap",
    f"""WITH {SPAN_SQL} SELECT count(*) AS n, {r('median(ret)', 6)} AS firm, {r('median(mkt)', 6)} AS market,
    {r('median(gap)', 6)} AS gap, {r('avg(CASE WHEN gap < 0 THEN 1.0 ELSE 0.0 END)', 6)} AS share_below FROM gap""",
)
def s24(spark, sf):
    g = gaps(spark, sf).withColumn("all", F.lit(1))
    med = lambda c: quantiles(g, c, {c: 0.5}).select(F.lit(1).alias("all"), c)
    base = g.groupBy("all").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("gap") < 0) / F.count(F.lit(1))).alias("share_below")
    )
    j = base.join(med("ret"), "all").join(med("mkt"), "all").join(med("gap"), "all")
    return rounded(
        j.select("n", F.col("ret").alias("firm"), F.col("mkt").alias("market"), "gap", "share_below"),
        "firm", "market", "gap", "share_below",
    )


@query("f17_annual_returns", f"""WITH {S.BRAND_SQL} SELECT symbol, CAST(year(date) AS INTEGER) AS year, {r('arg_max(price, date) / arg_min(price, date) - 1', 6)} AS ret, count(*) AS bars
  FROM prices GROUP BY 1, 2 HAVING count(*) > 200""")
def f17(spark, sf):
    return rounded(P.annual_returns(S.brand_prices(spark, sf)), "ret")


@query(
    "s22_tracking_difference",
    f"""WITH {S.BRAND_SQL}, {MARKET_SQL}, a AS (SELECT symbol, year(date) AS y, arg_max(price, date) / arg_min(price, date) - 1 AS ret FROM prices GROUP BY 1, 2 HAVING count(*) > 200),
    b AS (SELECT year(date) AS y, arg_max(price, date) / arg_min(price, date) - 1 AS mkt FROM market GROUP BY 1 HAVING count(*) > 200),
    d AS (SELECT symbol, abs((ret - mkt) * 10000) AS bp FROM a JOIN b USING (y)),
    s AS (SELECT symbol, list_sort(list(bp)) AS l FROM d GROUP BY symbol)
    SELECT symbol, len(l) AS years, {r('l[len(l) // 2 + 1]', 4)} AS median_bp FROM s""",
)
def s22(spark, sf):
    p = materialise(S.brand_prices(spark, sf))
    a = P.annual_returns(p)
    m = market(p).withColumn("symbol", F.lit("market"))
    b = P.annual_returns(m).select("year", F.col("ret").alias("mkt"))
    return rounded(P.tracking_difference(a, b), "median_bp", places=4)


@query(
    "f15_step_ratio",
    f"""WITH {S.BRAND_SQL}, d AS (SELECT symbol, min(date) + 400 AS day FROM prices GROUP BY symbol)
    SELECT symbol, CAST(day AS VARCHAR) AS day, {r('arg_max(price, date) FILTER (WHERE date < day) / arg_min(price, date) FILTER (WHERE date >= day)', 6)} AS step
    FROM prices JOIN d USING (symbol) GROUP BY symbol, day""",
)
def f15(spark, sf):
    return rounded(steps(spark, sf).select("symbol", F.col("day").cast("string").alias("day"), "step"), "step")


def steps(spark, sf):
    p = materialise(S.brand_prices(spark, sf))
    days = p.groupBy("symbol").agg(F.date_add(F.min("date"), 400).alias("day"))
    return P.step_ratio(p, days)


@query(
    "q12_split_convention",
    f"""WITH {S.BRAND_SQL}, d AS (SELECT symbol, min(date) + 400 AS day FROM prices GROUP BY symbol),
    x AS (SELECT symbol, 2.0::DOUBLE AS ratio, arg_max(price, date) FILTER (WHERE date < day) / arg_min(price, date) FILTER (WHERE date >= day) AS step
    FROM prices JOIN d USING (symbol) GROUP BY symbol, day)
    SELECT CASE WHEN step IS NULL THEN 'no bars' WHEN abs(step - 1) <= 0.25 THEN 'adjusted' WHEN abs(step / ratio - 1) <= 0.25 THEN 'not adjusted' ELSE 'unclear' END AS convention,
      count(*) AS n FROM x GROUP BY 1""",
)
def q12(spark, sf):
    s = P.split_convention(steps(spark, sf).withColumn("ratio", F.lit(2.0)))
    return s.groupBy("convention").agg(F.count(F.lit(1)).alias("n"))


@query("e23_coverage_by_symbol", f"WITH {S.PRICES_SQL} SELECT symbol, count(*) AS bars, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM prices GROUP BY symbol")
def e23(spark, sf):
    c = P.coverage_by_symbol(S.prices(spark, sf))
    return c.select("symbol", "bars", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"))


@query(
    "e25_adjustment_evidence",
    "WITH " + DAILY_SQL + " ".join(
        f"{'UNION ALL' if i else ''} SELECT {t}::DOUBLE AS threshold, count(*) AS moves, count(DISTINCT symbol) AS symbols FROM daily WHERE abs(ret) > {t}"
        for i, t in enumerate((0.25, 0.5, 0.9))
    ),
)
def e25(spark, sf):
    return P.adjustment_evidence(daily(spark, sf), [0.25, 0.5, 0.9])


@query(
    "e33_liquidity",
    f"WITH {S.PRICES_SQL} SELECT symbol, {r('median(price * volume)', 2)} AS dollar_vol, count(*) AS bars, median(volume) AS share_vol FROM prices GROUP BY symbol",
)
def e33(spark, sf):
    return rounded(P.liquidity(S.prices(spark, sf)), "dollar_vol", places=2)
