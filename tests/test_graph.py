import random
import re

import pytest

from tidemark.operators import exposure as X
from tidemark.operators import graph as G


def brute(edges, listed, source, cap=10**6):
    """All simple paths by recursion, each stopped at its first listed entity."""
    out = {}

    def go(node, weight, path):
        if len(path) > cap:
            return
        for s, p, w in edges:
            if s != node:
                continue
            if p in listed:
                out[p] = out.get(p, 0.0) + weight * w
            elif p not in path:
                go(p, weight * w, path + [p])

    go(source, 1.0, [source])
    return out


def frames(spark, edges, listed, nodes):
    e = spark.createDataFrame(edges, "subject string, party string, weight double")
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "entity string")
    return e, one(listed), one(nodes)


@pytest.mark.parametrize("seed", [1, 4])
def test_walk_equals_all_simple_paths_on_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(9)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([0.0, 0.2, 0.5, 1.0])) for _ in range(20)]
    listed = rng.sample(nodes, 2)
    e, l, s = frames(spark, edges, listed, nodes)
    got = {(r["source"], r["parent"]): r["weight"] for r in G.nearest_listed(e, l, s).collect()}
    want = {(n, p): w for n in nodes if n not in listed for p, w in brute(edges, listed, n).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


@pytest.mark.parametrize("cap", [4])
def test_a_cap_counts_the_steps_inside_components(spark, cap):
    rng = random.Random(cap)
    nodes = [f"n{i}" for i in range(8)]
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([0.25, 0.5, 1.0])) for _ in range(20)]
    e, l, s = frames(spark, edges, ["n7"], nodes)
    got = {(r["source"], r["parent"]): r["weight"] for r in G.nearest_listed(e, l, s, cap).collect()}
    want = {(n, p): w for n in nodes[:7] for p, w in brute(edges, ["n7"], n, cap).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_components(edges):
    nodes = {x for s, p, *_ in edges for x in (s, p)}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for s, p, *_ in edges:
            reach[s] |= reach[p]
    return {n: max(c) for n in nodes if len(c := [m for m in reach[n] if n in reach[m]]) > 1}


@pytest.mark.parametrize("seed", [2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes), 1.0) for _ in range(34 + 4 * seed)]
    got, n = G.strong_components(spark.createDataFrame(edges, "subject string, party string, weight double"))
    want = plain_components(edges)
    assert {r["node"]: r["comp"] for r in got.collect()} == want and n == len(want)


def test_a_dense_component_is_walked_once_for_all_sources(spark):
    """25 nodes on cycles, nine of them linked with each other, and 60 sources that enter at two of them."""
    rng = random.Random(9)
    dense = [f"d{i}" for i in range(9)]
    ring = [f"r{i:02}" for i in range(16)]
    edges = [(a, b, rng.choice([0.125, 0.25])) for a in dense for b in dense if a != b]
    edges += [(a, b, 0.5) for a, b in zip(ring, ring[1:])] + [("d0", "r00", 0.5), ("r15", "d1", 0.5)]
    edges += [("d5", "L", 0.5), ("r07", "L", 0.25), ("r07", "M", 0.5)]
    sources = [f"s{i}" for i in range(60)]
    edges += [(s, ("d2", "r03")[k % 2], 0.5) for k, s in enumerate(sources)]
    assert len(plain_components(edges)) == 25
    e, l, s = frames(spark, edges, ["L", "M"], sources)
    got = {(r["source"], r["parent"]): r["weight"] for r in G.nearest_listed(e, l, s).collect()}
    want = [brute(edges, ["L", "M"], x) for x in sources[:2]]
    assert len(got) == 120
    for k, x in enumerate(sources):
        for p, w in want[k % 2].items():
            assert got[x, p] == pytest.approx(w)


def test_cap_zero_weight_and_parallel_edges(spark):
    chain = [(f"c{i}", f"c{i + 1}", 1.0) for i in range(14)]
    edges = chain + [("a", "L", 0.0), ("b", "L", 0.25), ("b", "L", 0.25)]
    e, l, s = frames(spark, edges, ["L", "c12", "c14"], ["a", "b", "c0", "c13"])
    got = {(r["source"], r["parent"]): r["weight"] for r in G.nearest_listed(e, l, s).collect()}
    assert got == {("a", "L"): 0.0, ("b", "L"): 0.5, ("c0", "c12"): 1.0, ("c13", "c14"): 1.0}
    far = lambda cap: {(r["source"], r["parent"]) for r in G.nearest_listed(e, frames(spark, edges, ["c14"], ["x"])[1], s, cap).collect()}
    assert far(12) == {("c13", "c14")}, "only an explicit depth leaves out longer paths"
    assert far(None) == {("c13", "c14"), ("c0", "c14")}
    held = {(r["source"], r["parent"]): r["weight"] for r in G.holders(e, l, frames(spark, edges, ["L"], ["L", "b"])[2]).collect()}
    assert held == {("L", "L"): 1.0, ("b", "L"): 0.5}


def test_long_chains_and_a_way_through_a_cycle(spark):
    chain = [(f"c{i:02}", f"c{i + 1:02}", 0.5) for i in range(20)]
    loop = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "c00", 0.5), ("b", "c00", 0.25)]
    e, l, s = frames(spark, chain + loop, ["c20"], ["a", "c00"])
    got = {(r["source"], r["parent"]): r["weight"] for r in G.nearest_listed(e, l, s).collect()}
    assert got == {("c00", "c20"): pytest.approx(0.5**20), ("a", "c20"): pytest.approx(0.75 * 0.5**20)}
    ends = {r["parent"] for r in G.listed_ancestors(e, l, frames(spark, chain, ["c20"], ["a"])[2]).collect()}
    assert ends == {"c20"}
    assert G.closure(e, frames(spark, chain, ["c20"], ["a"])[2]).count() == 24


def test_no_listed_parent_gives_no_rows(spark):
    e, l, s = frames(spark, [("a", "b", 1.0), ("b", "a", 1.0)], ["z"], ["a", "b"])
    assert G.nearest_listed(e, l, s).count() == 0


def test_ancestors_and_closure_with_a_cycle(spark):
    e, l, s = frames(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "L", 1.0), ("L", "M", 1.0)], ["L", "M"], ["a"])
    assert {(r["source"], r["node"]) for r in G.closure(e, s).collect()} == {("a", x) for x in ["b", "c", "a", "L", "M"]}
    assert {r["parent"] for r in G.listed_ancestors(e, l, s).collect()} == {"L", "M"}
    assert {r["parent"] for r in G.listed_ancestors(e, l, s, cap=3).collect()} == {"L"}


def test_blank_rules(spark):
    rows = [("a", "x", 0.7), ("a", "y", None), ("a", "z", None), ("b", "x", None), ("c", "x", 0.8), ("c", "y", 0.4), ("c", "z", None)]
    e = spark.createDataFrame(rows, "subject string, party string, weight double")
    imp = {(r["subject"], r["party"]): r["weight"] for r in G.fill_blanks(e, "impute").collect()}
    assert imp[("a", "y")] == pytest.approx(0.15) and imp[("b", "x")] == 1.0 and imp[("c", "z")] == 0.0
    assert {r["weight"] for r in G.fill_blanks(e, "zero").filter("subject = 'b'").collect()} == {0.0}
    with pytest.raises(ValueError):
        G.fill_blanks(e, "guess")


def test_taint_reaches_a_fixed_point(spark):
    uses = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "e")], "item string, upstream string")
    got = {r["item"] for r in G.tainted(uses, spark.createDataFrame([("a",)], "item string")).collect()}
    assert got == {"a", "b", "c"}


def test_entrant_split_of_published_cases(spark):
    mw = [("e1", "u1", 100.0), ("e1", "u2", 50.0), ("e2", "u4", 40.0), ("e2", "u5", 8.0), ("e3", "u3", 20.0), ("e4", "n1", 12.5), ("e4", "n2", 2.5),
          ("e5", "u1", 100.0), ("e5", "u2", 50.0), ("e5", "u3", 25.0), ("e5", "new", 10.0)]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    out = X.split_entrants(
        frame(mw, "firm string, unit string, mw double"), frame([(f"u{i}",) for i in range(1, 6)], "unit string"),
        frame([("u1", "P"), ("u2", "P"), ("u3", "P"), ("u3", "Q"), ("u4", "Q")], "unit string, holder string"),
        frame([("e1", "P"), ("e1", "G"), ("e2", "P"), ("e3", "P"), ("e5", "P")], "firm string, holder string"), frame([("e3",)], "firm string"),
    )
    got = {r["firm"]: (r["mw_part_1"], r["mw_part_2"], r["mw_part_3"], r["adds_up"]) for r in out.collect()}
    assert got == {"e1": (150.0, 0.0, 0.0, True), "e2": (0.0, 48.0, 0.0, True), "e3": (0.0, 20.0, 0.0, True), "e4": (0.0, 0.0, 15.0, True),
                   "e5": (175.0, 0.0, 10.0, True)}


def split_brute(mw, old_units, old_holders, owners, listed_old):
    """firm: mw, units, units carried, units of part 1 and the three parts, row by row."""
    out, add = {}, lambda a, b: a if b is None else b + (a or 0.0)
    for firm, unit, x in mw:
        carried = unit is not None and unit in old_units
        above = {h for f, h in owners if f == firm and h != firm and h is not None}
        under = firm is not None and firm not in listed_old and any(h in above for u, h in old_holders if u == unit)
        part = 3 if not carried else 1 if under else 2
        r = out.setdefault(firm, [None, 0, 0, 0, None, None, None])
        r[0], r[1], r[2], r[3] = add(r[0], x), r[1] + 1, r[2] + carried, r[3] + (part == 1)
        for p in (1, 2, 3):
            r[3 + p] = add(r[3 + p], x if p == part else 0.0)
    return {f: tuple(r) for f, r in out.items()}


@pytest.mark.parametrize("a_row", [1_000, 2])
def test_entrant_split_equals_brute_force_with_nulls_and_repeats(spark, monkeypatch, a_row):
    monkeypatch.setattr(X, "HOLDERS_A_ROW", a_row, raising=False)  # sets of several rows, too
    rng = random.Random(7)
    firms, holders, units = [None, *(f"f{i}" for i in range(9))], [None, *(f"h{i}" for i in range(14)), "f1", "f2"], [None, *(f"u{i}" for i in range(12))]
    mw = [(rng.choice(firms), rng.choice(units), rng.choice([None, 1.0, 2.0, 8.0])) for _ in range(120)]
    old_units = [rng.choice(units[:9]) for _ in range(20)]
    old_holders = [(rng.choice(units), rng.choice(holders)) for _ in range(45)]
    owners, listed = [(rng.choice(firms), rng.choice(holders)) for _ in range(40)], [None, "f3", "f3", "f8"]
    frame = spark.createDataFrame
    out = X.split_entrants(
        frame(mw, "firm string, unit string, mw double"), frame([(u,) for u in old_units], "unit string"),
        frame(old_holders, "unit string, holder string"), frame(owners, "firm string, holder string"), frame([(f,) for f in listed], "firm string"),
    )
    columns = ["mw", "units", "units_carried", "units_part_1", "mw_part_1", "mw_part_2", "mw_part_3"]
    want = split_brute(mw, old_units, old_holders, owners, listed)
    assert {r["firm"]: tuple(r[c] for c in columns) for r in out.collect()} == want
    assert any(r[3] for r in want.values()) and any(r[2] > r[3] for r in want.values())


def test_entrants_and_holders_that_only_share_a_unit_make_no_rows(spark):
    frame = spark.createDataFrame
    firms, holders, units = [f"f{i}" for i in range(30)], [f"h{i}" for i in range(40)], [f"u{i}" for i in range(5)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = X.split_entrants(
            frame([(f, u, 1.0) for f in firms for u in units], "firm string, unit string, mw double"), frame([(u,) for u in units], "unit string"),
            frame([(u, h) for u in units for h in holders], "unit string, holder string"),
            frame([("f0", "h0"), ("f1", "x")], "firm string, holder string"), frame([], "firm string"),
        )
        assert {r["firm"]: r["units_part_1"] for r in out.collect()} == {f: 5 * (f == "f0") for f in firms}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # 6,000 pairs share a unit; nothing is dealt by or joined on an entrant and a holder
    assert not re.search(r"(?:Join|hashpartitioning) ?[\[(][^\])]*firm#[^\])]*holder#", plan), plan
