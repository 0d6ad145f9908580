import re

import pytest

from tidemark.functions import stats
from tidemark.operators import coverage, vintage as V

EDGE = "release string, subject string, party string, share double, imputed boolean, ord int"


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE)


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "entity string")


def test_every_bucket_by_hand(spark):
    o, n = "old", "new"
    rows = [
        (n, "A", "B", 10.0, False, 0),                                   # both ends known before
        (n, "A", "Z", 10.0, False, 0),                                   # party is new
        (o, "A", "C", 5.0, False, 0),                                    # gone
        (o, "D", "C", 5.0, False, 0),                                    # gone, subject was a duplicate
        (o, "A", "E", None, False, 0), (n, "A", "E", 7.0, True, 0),      # filled by the rule
        (o, "A", "F", None, False, 0), (n, "A", "F", 7.0, False, 0),     # filled by research
        (o, "A", "G", 7.0, False, 0), (n, "A", "G", None, False, 0),     # emptied: no comparable value
        (o, "A", "H", 50.0, False, 0), (n, "A", "H", 50.06, False, 0),   # exactly at the tolerance
        (o, "A", "I", 50.0, False, 0), (n, "A", "I", 50.07, False, 0),   # small
        (o, "A", "J", 50.0, False, 0), (n, "A", "J", 51.0, False, 0),    # exactly one point is small
        (o, "A", "K", 50.0, False, 0), (n, "A", "K", 51.01, False, 0),   # material
        (o, "A", "L", 50.0, False, 0), (n, "A", "L", 60.0, True, 0),     # imputed and moved
        (o, "A", "M", 1.0, False, 0), (o, "A", "M", 2.0, False, 1), (n, "A", "M", 2.0, False, 0),  # last wins
    ]
    known = frame(spark, list("ABCDEFGHIJKLM"))
    d = V.compare_releases(edges(spark, rows), o, n)
    c = V.classify(d, known, frame(spark, ["D", "D"]))
    got = {r["party"] + r["subject"]: (r["bucket"], r["detail"]) for r in c.collect()}
    assert got["BA"] == (V.BUILD, "new link between covered entities")
    assert got["ZA"] == (V.BUILD, "entity newly covered")
    assert got["CA"] == (V.RESTATE, "link removed")
    assert got["CD"] == (V.METHOD, "entity removed as duplicate")
    assert got["EA"] == (V.METHOD, "blank filled by imputation")
    assert got["FA"] == (V.BUILD, "blank filled by research")
    assert got["GA"] == (V.SAME, "no comparable value")
    assert got["HA"] == (V.SAME, "same or rounding only")
    assert got["IA"] == (V.RESTATE, "share revised, small")
    assert got["JA"] == (V.RESTATE, "share revised, small")
    assert got["KA"] == (V.RESTATE, "share revised, material")
    assert got["LA"] == (V.METHOD, "imputed share moved")
    assert got["MA"] == (V.SAME, "same or rounding only")
    totals = {(r["bucket"], r["detail"]): r["edges"] for r in V.change_buckets(c).collect()}
    assert totals[("ALL", "TOTAL")] == 10
    assert totals[(V.RESTATE, "TOTAL")] == 4
    r = V.ratio_and_ceiling(c).first()
    assert (r["build"], r["restate"], r["method"], r["unchanged"]) == (3, 4, 3, 3)
    assert r["r"] == pytest.approx(0.7) and r["verdict"] == "GO"


def test_pairs_skip_missing_sheet_and_keep_zero_change_as_predecessor(spark):
    cat = spark.createDataFrame(
        [(1, "2025-01", True, False), (2, "2025-02", False, False), (3, "2025-04", True, False), (4, "2025-05", True, True), (5, "2025-06", True, True)],
        "rel int, month string, has_sheet boolean, has_flag boolean",
    )
    e = spark.createDataFrame(
        [(1, "A", "B", None, False), (3, "A", "B", 5.0, False), (4, "A", "B", 5.0, True), (5, "A", "B", 9.0, True), (5, "A", "C", 1.0, False)],
        "rel int, subject string, party string, share double, imputed boolean",
    )
    got = V.decompose_pairs(e, cat, frame(spark, [])).orderBy("month").collect()
    assert [(r["prev_month"], r["month"], r["months"], r["changed"]) for r in got] == [("2025-01", "2025-04", 3, 1), ("2025-05", "2025-06", 1, 2)]
    assert got[0]["unattr_aware_pct"] == 100.0
    assert got[1]["method_aware_pct"] == 50.0 and got[1]["restate_blind_pct"] == 50.0


PUBLISHED = [
    ("2025-05", 2, 87.3, 11.6, 1.1), ("2025-07", 2, 84.8, 12.6, 1.1), ("2025-08", 1, 67.4, 28.1, 1.9), ("2025-09", 1, 75.1, 21.3, 1.5),
    ("2025-10", 1, 47.5, 46.7, 1.8), ("2025-11", 1, 56.4, 39.2, 0.7), ("2025-12", 1, 2.8, 0.8, 0.0), ("2026-01", 1, 50.3, 43.3, 6.4),
    ("2026-02", 1, 36.5, 63.5, 0.0), ("2026-03", 1, 27.5, 71.9, 0.6), ("2026-07", 2, 59.5, 39.7, 0.8), ("2026-08", 1, 77.5, 21.2, 1.4),
]


def test_halves_and_tests_on_a_published_series(spark):
    s = spark.createDataFrame(PUBLISHED, "month string, months int, build double, restate double, method double")
    h = V.halves(s, "month", ["build", "restate"]).first()
    assert round(h["build_first_mean"], 1) == 69.8 and round(h["build_second_mean"], 1) == 42.4
    assert round(h["restate_first_mean"], 1) == 26.6 and round(h["restate_second_mean"], 1) == 40.1
    one = s.filter("months = 1 and month <> '2025-12'")
    w = stats.welch(V.halves(one, "month", ["build"]), "build")
    from pyspark.sql import Window, functions as F

    x = one.withColumn("x", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month")) - 1)
    t = stats.trend(x, "build", "x")
    c = stats.correlation_test(s, "build", "months")
    rows = {
        r["test"]: r for r in w.unionByName(t).unionByName(c).withColumn("p", stats.two_sided_p("t", "df")).collect()
    }
    assert (round(rows["welch"]["t"], 2), round(rows["welch"]["df"], 1), round(rows["welch"]["p"], 2)) == (1.09, 4.7, 0.33)
    assert (round(rows["trend"]["estimate"], 2), round(rows["trend"]["t"], 2), round(rows["trend"]["p"], 2)) == (-2.46, -0.87, 0.42)
    assert (round(rows["corr"]["estimate"], 2), round(rows["corr"]["p"], 2)) == (0.51, 0.09)


def test_p_values_of_all_degrees(spark):
    """Closed forms at 1, 2 and 4 degrees of freedom, the normal tail at very many, tiny tails to their last digits."""
    from math import atan, erfc, gamma, pi, sqrt

    import numpy as np

    exact = {
        1: lambda t: 1 - 2 * atan(t) / pi,
        2: lambda t: 1 - t / sqrt(2 + t * t),
        4: lambda t: 1 - (t / sqrt(4 + t * t)) * (1 + 2 / (4 + t * t)),
    }
    values = (0.0, 1e-6, 0.3, 1.0, 1.96, 5.0, 20.0)
    rows = [(t * sign, float(df), exact[df](t)) for df in exact for t in values for sign in (1, -1)]
    rows += [(t, df, erfc(t / sqrt(2))) for t in values for df in (1e11, 1e13)]
    got = spark.createDataFrame(rows, "t double, df double, p double").withColumn("got", stats.two_sided_p("t", "df")).collect()
    for r in got:
        assert abs(r["got"] - r["p"]) < 1e-9, r
    far = [r for r in got if r["df"] == 1e13 and r["t"] == 20.0][0]
    assert abs(far["got"] / far["p"] - 1) < 1e-6
    odd = [(None, 3.0), (1.0, None), (1.0, 0.0), (1.0, -2.0), (float("nan"), 3.0), (1.0, float("nan"))]
    empty = spark.createDataFrame(odd, "t double, df double").select(stats.two_sided_p("t", "df").alias("p")).collect()
    assert [r["p"] for r in empty] == [None] * len(odd)
    half = spark.createDataFrame([(1.0, 0.5)], "t double, df double").select(stats.two_sided_p("t", "df").alias("p")).first()["p"]
    x = np.linspace(0, 1, 200_001)
    inside = np.trapezoid((1 + x * x / 0.5) ** -0.75, x)
    assert abs(half - (1 - 2 * inside * gamma(0.75) / gamma(0.25) / sqrt(0.5 * pi))) < 1e-9


def test_wilson_and_ladder(spark):
    from pyspark.sql import functions as F

    w = spark.createDataFrame([(2, 19), (6, 19), (12, 19), (0, 0)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [(r[0], r[1]) for r in w.select(lo, hi).collect()]
    assert [tuple(round(v, 3) for v in g) for g in got[:3]] == [(0.029, 0.314), (0.154, 0.540), (0.410, 0.809)]
    assert got[3] == (None, None)
    b = spark.createDataFrame([("V1", 8135, 2543, 2039), ("V2", 8641, 2756, 1978)], "release string, build int, restate int, method int")
    v = spark.createDataFrame([("rule", 6 / 19), ("none", 0.0), ("upper", 0.5399)], "reading string, v double")
    got = {(r["release"], r["reading"]): (r["r"], r["verdict"]) for r in V.ladder(b, v).collect()}
    assert got[("V1", "rule")] == (0.297157, "clears") and got[("V2", "none")] == (0.353944, "clears")
    assert got[("V2", "upper")][1] == "FAILS" and got[("V1", "upper")][1] == "clears"


def test_record_lags_on_published_cases(spark):
    from pyspark.sql import functions as F

    held = "2025-03 2025-05 2025-07 2025-08 2025-09 2025-10 2025-11 2025-12 2026-01 2026-02 2026-03 2026-05 2026-07 2026-08".split()
    rel = spark.createDataFrame([(m,) for m in held], "month string")
    cases = spark.createDataFrame(
        [(19, "2025-09-19", "2025-10"), (11, "2025-10-22", "2026-01"), (1, "2024-09-30", "2026-08"), (7, "2023-04-24", "2026-07"),
         (17, "2023-05-17", "2026-08"), (10, "2021-12-31", "2026-08")],
        "case int, happened string, carried string",
    ).withColumn("happened", F.to_date("happened"))
    got = {r["case"]: r for r in coverage.record_lags(cases, rel, "2025-03").collect()}
    assert [got[c]["lag_days"] for c in (19, 11, 1, 7, 17, 10)] == [12, 71, 670, 1164, 1172, 1674]
    assert [got[c]["position"] for c in (19, 11, 1, 7, 17, 10)] == [1, 3, 13, 12, 13, 13]
    assert [got[c]["bound_days"] for c in (19, 11, 1, 7, 17, 10)] == [316, 283, 213, 738, 715, 1217]
    assert [got[c]["days_after_first"] for c in (19, 11, 1, 7, 17, 10)] == [0, 61, 457, 426, 457, 457]
    assert sum(r["speed"] == "fast" for r in got.values()) == 2


def test_detectable_effects(spark):
    from tidemark.operators.regression import detectable

    s = spark.createDataFrame([("a", 120, 2.0 / 120**0.5), ("b", 120, 1.0 / 120**0.5)], "series string, n int, se double")
    h = spark.createDataFrame([("t3", 3.0), ("t3 at 80%", 3.84)], "name string, t double")
    got = {(r["series"], r["hurdle"]): round(r["needed"]) for r in detectable(s, "se", "n", h, 2.0 / 12).collect()}
    assert got == {("a", "t3"): 1296, ("b", "t3"): 324, ("a", "t3 at 80%"): 2123, ("b", "t3 at 80%"): 531}


def test_precision_loss_rounds_half_even(spark):
    w = spark.createDataFrame(
        [("a", "b", "51.25%", "51.2"), ("a", "c", "51.26", "51.3"), ("a", "d", "51.30", "51.3"), ("a", "e", "", "1.0"), ("a", "f", "10.00", "12.0")],
        "subject string, party string, a_text string, b_text string",
    )
    r = V.precision_loss(w).first()
    assert (r["matched"], r["differs"], r["strict"], r["suppressed"], r["survives"]) == (4, 3, 2, 2, 1)


def test_owner_sets_ignore_order_and_repeats(spark):
    rows = [("o", "coal", "u1", "parent", "A"), ("o", "coal", "u1", "parent", "B"), ("n", "coal", "u1", "parent", "B"), ("n", "coal", "u1", "parent", "A"),
            ("n", "coal", "u1", "parent", "A"), ("o", "coal", "u2", "parent", "A"), ("n", "coal", "u2", "parent", "C"), ("o", "coal", "u3", "parent", None), ("n", "coal", "u3", "parent", "C"),
            ("o", "coal", "u1", "immediate", "A"), ("n", "coal", "u1", "immediate", "C")]
    d = spark.createDataFrame(rows, "release string, sector string, unit string, kind string, owner string")
    r = V.owner_set_changes(d, "o", "n").first()
    assert (r["assets"], r["parent_changed"], r["immediate_changed"]) == (2, 1, 1)


def test_evidence_and_claims(spark):
    s = spark.createDataFrame([("a", "b", "REAL", "2026-01-15"), ("a", "c", "REAL", "2026-02-01"), ("a", "d", "REAL", "2026-03-01")], "subject string, party string, verdict string, stamp string")
    e = spark.createDataFrame([("a", "b", "REAL", "2026-01"), ("a", "c", "NO EVENT", "2026-02"), ("a", "x", "REAL", "2026")], "subject string, party string, verdict string, stamp string")
    got = {r["party"]: r["problem"] for r in coverage.evidence_problems(s, e).collect()}
    assert got == {"c": "verdict differs", "d": "missing", "x": "extra"}


def shuffles(df):
    """Names of the columns that the plan of ``df`` shuffles by."""
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_of_edges_laid_by_subject_are_not_shuffled_again(spark):
    e = spark.createDataFrame([(1, "A", "X", 10.0, False), (2, "A", "X", 10.0, False), (2, "B", "Y", 5.0, False), (3, "B", "Y", 9.0, True)], "rel int, subject string, party string, share double, imputed boolean")
    cat = spark.createDataFrame([(k, f"2025-0{k}", True, True) for k in (1, 2, 3)], "rel int, month string, has_sheet boolean, has_flag boolean")
    out = V.decompose_pairs(e.repartition(3, "subject"), cat, frame(spark, ["X"]))
    by = shuffles(out)
    assert not [c for c in by if "subject" in c and "party" in c and "kind" not in c], by
    got = {r["month"]: r for r in out.collect()}
    assert got["2025-02"]["changed"] == 1 and got["2025-02"]["build_blind_pct"] == 100.0
    # A's link to X left and X was removed as a duplicate; B's share moved by rule
    assert got["2025-03"]["changed"] == 2 and got["2025-03"]["method_aware_pct"] == 100.0 and got["2025-03"]["restate_blind_pct"] == 50.0
