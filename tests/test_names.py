import random

import pytest

from tidemark.operators import names as N


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def score(x, y):
    longer = max(len(x), len(y))
    return 1.0 if not longer else 1.0 - edits(x, y) / longer


def some_names(rng, n):
    out = {"", "a", "ab", "aaaaaaaa"}
    while len(out) < n:
        base = "".join(rng.choice("aab c") for _ in range(rng.randint(1, 14)))
        out.add(base)
        out.add(base[: rng.randint(0, len(base))] + rng.choice("abx") + base[rng.randint(0, len(base)) :])
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 3])
@pytest.mark.parametrize("floor", [0.7, 0.85])
def test_search_finds_every_pair_above_the_floor(spark, monkeypatch, hot, floor):
    monkeypatch.setattr(N, "HOT", hot)
    rng = random.Random(int(100 * floor) + hot)
    left = some_names(rng, 60)
    right = sorted({*left[::2], *some_names(rng, 60)})
    one = lambda rows, c: spark.createDataFrame([(x,) for x in [*rows, None, rows[0]]], f"{c} string")
    got = {(r["x"], r["y"]): r["score"] for r in N.similar_names(one(left, "x"), one(right, "y"), floor).collect()}
    want = {(x, y): s for x in left for y in right if (s := score(x, y)) >= floor}
    assert got == want and len(want) > 20


def test_best_line_of_a_similar_name(spark):
    entities = spark.createDataFrame([(1, "Alpha Power Inc."), (2, "alpha power"), (3, "Zeta"), (4, None)], "entity int, name string")
    lines = [("a", "Alpha Power", 40, 5.0), ("b", "ALPHA POWER LTD", 40, 9.0), ("c", "Alpha Powar", 99, 50.0), ("d", "alpha power", 30, 99.0), ("e", None, 99, 1.0)]
    got = {tuple(r) for r in N.search_by_name(entities, spark.createDataFrame(lines, "symbol string, other string, bars int, dollar_vol double")).collect()}
    assert got == {(1, "b", 1.0, 9.0), (2, "b", 1.0, 9.0)}


def test_nothing_to_search(spark):
    assert N.similar_names(spark.createDataFrame([], "x string"), spark.createDataFrame([], "y string")).collect() == []
