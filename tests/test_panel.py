import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators import regression as R
from tidemark.operators.calendar import sessions, sessions_between


def nw(x, lags):
    e = x - x.mean()
    n = len(x)
    s = e @ e / n
    for L in range(1, min(lags, n - 1) + 1):
        s += 2 * (1 - L / (lags + 1)) * (e[L:] @ e[:-L]) / n
    return x.mean(), x.mean() / np.sqrt(max(s, 1e-18) / n)


def test_mean_with_robust_error(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=40).cumsum(), "b": rng.normal(size=4), "c": np.array([1.0, 2.0]), "d": np.ones(5)}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "s string, t int, x double")
    got = {r["s"]: r for r in R.newey_west_mean(df, ["s"], "t", "x", 6).collect()}
    for k in ("a", "b"):
        mean, t = nw(data[k], 6)
        assert (got[k]["mean"], got[k]["t_nw"]) == pytest.approx((mean, t))
    assert got["c"]["t_nw"] is None and got["d"]["t_ols"] is None


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for m, n in (("x", 80), ("y", 120), ("short", 5)):
        x = rng.normal(size=(n, 3))
        y = 0.1 + x @ [0.9, -0.2, 0.3] + rng.normal(size=n)
        rows += [(m, i, float(y[i]), *map(float, x[i])) for i in range(n)]
        Z = np.column_stack([np.ones(n), x])
        b, *_ = np.linalg.lstsq(Z, y, rcond=None)
        u = Z * (y - Z @ b)[:, None]
        S = u.T @ u
        for L in range(1, 6):
            G = u[L:].T @ u[:-L]
            S += (1 - L / 6) * (G + G.T)
        inv = np.linalg.inv(Z.T @ Z)
        want[m] = (b, np.sqrt(np.diag(inv @ S @ inv)), 1 - ((y - Z @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    df = spark.createDataFrame(rows, "m string, t int, y double, f1 double, f2 double, f3 double")
    got = R.ols_newey_west(df, ["m"], "t", "y", ["f1", "f2", "f3"], 5, 60).toPandas()
    assert set(got.m) == {"x", "y"}
    for m in ("x", "y"):
        g = got[got.m == m].set_index("term").loc[["const", "f1", "f2", "f3"]]
        assert np.allclose(g.coef, want[m][0]) and np.allclose(g.se, want[m][1]) and np.allclose(g.r2, want[m][2])


def test_a_term_that_others_add_up_to_is_left_out(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=100)
    rows = [("m", i, float(y[i]), float(x[i, 0]), float(3 - 2 * x[i, 0]), float(x[i, 1])) for i in range(100)]
    df = spark.createDataFrame(rows, "m string, t int, y double, f1 double, twin double, f2 double")
    whole = {r["term"]: r for r in R.ols_newey_west(df, ["m"], "t", "y", ["f1", "twin", "f2"], 3, 10).collect()}
    short = {r["term"]: r for r in R.ols_newey_west(df, ["m"], "t", "y", ["f1", "f2"], 3, 10).collect()}
    assert whole["twin"]["coef"] == 0 and whole["twin"]["se"] == 0 and whole["twin"]["t"] is None
    for term, r in short.items():
        assert whole[term]["coef"] == pytest.approx(r["coef"]) and whole[term]["se"] == pytest.approx(r["se"])


def test_returns_skip_no_row_and_range_is_closed(spark):
    d = dt.date
    rows = [("a", d(2020, 1, 2), 10.0), ("a", d(2020, 1, 30), 20.0), ("a", d(2020, 3, 31), 60.0), ("a", d(2020, 4, 1), 6.0), ("b", d(2020, 1, 1), 5.0)]
    m = P.row_returns(P.month_end_prices(spark.createDataFrame(rows, "symbol string, date date, price double")), "month")
    got = {(r["symbol"], r["month"]): r["ret"] for r in m.collect()}
    assert got[("a", "2020-03")] == 2.0 and got[("a", "2020-04")] == pytest.approx(-0.9) and got[("b", "2020-01")] is None
    assert P.plausible(m).count() == 2
    r = P.range_counts(m).first()
    assert (r["returns"], r["kept"], r["dropped"]) == (2, 2, 0)


def test_sessions_and_fallback(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(31)]
    cal = sessions(spark.createDataFrame([(x,) for x in days if x.weekday() < 5], "date date"))
    rows = [("week", dt.date(2024, 1, 5), dt.date(2024, 1, 8)), ("weekend", dt.date(2024, 1, 6), dt.date(2024, 1, 8)),
            ("back", dt.date(2024, 1, 10), dt.date(2024, 1, 3)), ("after", dt.date(2024, 1, 10), dt.date(2024, 2, 20)),
            ("before", dt.date(2023, 12, 1), dt.date(2024, 1, 2)), ("null", None, dt.date(2024, 1, 2))]
    df = spark.createDataFrame(rows, "k string, a date, b date")
    got = {r["k"]: r["gap"] for r in sessions_between(df, "a", "b", cal, "gap").collect()}
    assert got == {"week": 1, "weekend": 0, "back": 5, "after": 41 * 5 // 7, "before": 1, "null": None}


def test_step_ratio_and_convention(spark):
    p = spark.createDataFrame([("a", dt.date(2024, 1, 1), 100.0), ("a", dt.date(2024, 1, 3), 50.0), ("b", dt.date(2024, 1, 1), 10.0)], "symbol string, date date, price double")
    s = spark.createDataFrame([("a", dt.date(2024, 1, 2)), ("b", dt.date(2024, 1, 2))], "symbol string, day date")
    got = {r["symbol"]: (r["step"], r["convention"]) for r in P.split_convention(P.step_ratio(p, s).withColumn("ratio", F.lit(2.0))).collect()}
    assert got == {"a": (2.0, "not adjusted"), "b": (None, "no bars")}


def test_market_gap_uses_sessions_inside_the_span(spark):
    m = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(i), 100.0 + i) for i in (0, 3, 6, 9)], "date date, price double")
    s = spark.createDataFrame([("a", dt.date(2024, 1, 2), dt.date(2024, 1, 8), 0.5), ("b", dt.date(2024, 1, 5), dt.date(2024, 1, 6), 0.1)], "symbol string, lo date, hi date, ret double")
    got = {r["symbol"]: r["mkt"] for r in P.gap_to_market(s, m).collect()}
    assert got == {"a": pytest.approx(106 / 103 - 1)}
