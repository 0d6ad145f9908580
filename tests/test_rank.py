import hashlib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators import rank as K


def every_order(a, b, k):
    def tops(v):
        cut = sorted(v.values(), reverse=True)[k - 1]
        sure = {f for f in v if v[f] > cut}
        tied = sorted(f for f in v if v[f] == cut)
        return [sure | set(c) for c in itertools.combinations(tied, k - len(sure))]

    counts = [len(x & y) for x in tops(a) for y in tops(b)]
    return min(counts), max(counts)


def test_bounds_equal_every_order_of_ties(spark):
    rng = random.Random(11)
    for k in (1, 2, 3, 4):
        rows, want = [], {}
        for case in range(40):
            n = rng.randint(k, 8)
            a = {f"f{i}": rng.choice([0.0, 0.5, 1.0, 1.0]) for i in range(n)}
            b = {f"f{i}": rng.choice([0.0, 0.5, 1.0, 1.0]) for i in range(n)}
            rows += [(case, f, a[f], b[f]) for f in a]
            want[case] = every_order(a, b, k)
        df = spark.createDataFrame(rows, "case int, firm string, a double, b double")
        got = {r["case"]: (r["lowest"], r["highest"]) for r in K.overlap_bounds(df, "a", "b", k=k, group=["case"]).collect()}
        assert got == want


def test_published_overlap_cases(spark):
    a = [1, 1, 1, 1, 0.5, 0.5, 0.2, 0, 0]
    b = [1, 0.5, 1, 0.2, 1, 1, 0.5, 0, 0]
    df = spark.createDataFrame([(c, float(x), float(y)) for c, x, y in zip("abcdefghi", a, b)], "firm string, a double, b double")
    r = K.overlap_bounds(df, "a", "b", k=3).first()
    assert (r["tied_a"], r["places_a"], r["tied_b"], r["places_b"], r["lowest"], r["highest"], r["has_ties"]) == (4, 3, 4, 3, 0, 2, True)
    df = spark.createDataFrame([(5.0, 5.0), (4.0, 3.0), (3.0, 4.0), (2.0, 1.0), (1.0, 2.0)], "a double, b double")
    r = K.overlap_bounds(df, "a", "b", k=2).first()
    assert (r["lowest"], r["highest"], r["has_ties"]) == (1, 1, False)
    df = spark.createDataFrame([(1.0, 1.0)] * 6, "a double, b double")
    r = K.overlap_bounds(df, "a", "b", k=2).first()
    assert (r["lowest"], r["highest"]) == (0, 2)


def test_ranks_quantiles_and_cuts_with_a_hot_group(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.7, "hot", "cold"), "v": rng.integers(0, 60, 3000).astype(float)})
    pdf.loc[pdf.index % 3 == 0, "v"] = 7.0
    pdf.loc[pdf.index % 101 == 0, "v"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double").withColumn("id", F.monotonically_increasing_id())
    want = pdf.groupby("g").v.rank()
    got = O.average_rank(df, "v", ["g"]).orderBy("id").toPandas()["rank"]
    assert np.allclose(got.fillna(-1), want.fillna(-1))
    q = {r["g"]: r for r in O.quantiles(df, "v", {"q1": 0.25, "m": 0.5, "d": 0.1}, ["g"]).collect()}
    for g, x in pdf.groupby("g").v:
        assert (q[g]["q1"], q[g]["m"], q[g]["d"]) == pytest.approx((x.quantile(0.25), x.median(), x.quantile(0.1)))
        assert q[g]["n"] == x.count()
    c = {r["g"]: r for r in O.cut_values(df, "v", F.floor(F.col("n") / 5), ["g"]).collect()}
    for g, x in pdf.groupby("g").v:
        k = x.count() // 5
        cut = x.sort_values(ascending=False).iloc[k - 1]
        assert (c[g]["cut"], c[g]["sure"], c[g]["tied"], c[g]["places"]) == (cut, (x > cut).sum(), (x == cut).sum(), k - (x > cut).sum())


def test_positions_and_legs(spark):
    df = spark.createDataFrame([(f"s{i:02d}", float(i // 2)) for i in range(12)], "s string, v double")
    pos = [r["s"] for r in O.positions(df, [F.col("v").desc(), F.col("s")]).orderBy("pos").collect()]
    assert pos[:3] == ["s10", "s11", "s08"]
    legs = {r["s"]: r["leg"] for r in O.legs(df, "v", "s", 5).collect() if r["leg"]}
    assert legs == {"s10": "top", "s11": "top", "s00": "bottom", "s01": "bottom"}
    one = O.legs(spark.createDataFrame([("a", 1.0)], "s string, v double"), "v", "s", 5).first()
    assert (one["k"], one["leg"]) == (1, "top")


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0), ("b", 1, 2.0)], "k string, ord int, v double")
    assert {r["k"]: r["v"] for r in O.first_wins(df, ["k"], ["ord"]).collect()} == {"a": None, "b": 2.0}
    assert {r["k"]: r["v"] for r in O.last_wins(df, ["k"], ["ord"]).collect()} == {"a": 7.0, "b": 2.0}


def test_spearman_is_null_for_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "a double, b double")
    assert K.spearman(df, "a", "b").first()["spearman"] is None


def test_degenerate_share(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(0.97,), (None,)], "v double")
    r = K.degeneracy(df, "v").first()
    assert r["degenerate"] and r["n"] == 9 and r["at_one"] == pytest.approx(8 / 9)


def test_null_groups_stay(spark):
    from tidemark.operators import audit, ordering

    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0)], "g string, v double")
    got = sorted(((r["g"], r["pos"]) for r in ordering.positions(rows, [F.col("v")], ["g"]).collect()), key=repr)
    assert got == [("a", 1), ("a", 2), (None, 1)]
    assert {r["g"]: r["n"] for r in ordering.quantiles(rows, "v", {"m": 0.5}, ["g"]).collect()} == {"a": 2, None: 1}
    assert {r["g"]: r["cut"] for r in ordering.cut_values(rows, "v", F.lit(1), ["g"]).collect()} == {"a": 2.0, None: 3.0}
    assert ordering.legs(rows, "v", "g", 5, ["g"]).count() == 3
    assert ordering.average_rank(rows, "v", ["g"]).filter("rank is null").count() == 0
    assert audit.stratified_sample(rows, "g", ["v"], 3, 1).count() == 3


def test_sample_evaluates_its_frame_once(spark):
    from tidemark.operators import audit

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(300).selectExpr("CASE WHEN id % 10 = 0 THEN 'a' WHEN id < 290 THEN 'b' END AS g", "id AS v").mapInPandas(passed, "g string, v long")
    got = audit.stratified_sample(rows, "g", ["v"], 20, 7).collect()
    assert seen.value == 300
    drawn = {g: sorted((hashlib.md5(f"{v}|7".encode()).hexdigest(), v) for v in range(300) if (("a" if v % 10 == 0 else "b" if v < 290 else None) == g)) for g in (None, "a", "b")}
    want = [(g, v) for g, k in ((None, 1), ("a", 2), ("b", 17)) for _, v in drawn[g][:k]]
    assert [(r["g"], r["v"]) for r in got] == want
