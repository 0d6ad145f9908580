import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import coverage as V
from tidemark.operators import membership as M

EV = "date date, added string, removed string"


def test_backward_counts_equal_undoing_rows_one_by_one(spark):
    rng = random.Random(4)
    names = ["A", "B", "C", "D", "E"]
    rows = []
    for _ in range(60):
        day = dt.date(1990 + rng.randint(0, 7), rng.randint(1, 12), rng.randint(1, 3))
        a, r = rng.choice(names + [""]), rng.choice(names + [""])
        if a or r:
            rows.append((day, a, r))
    current = {"A", "C", "X"}
    years = range(min(x[0].year for x in rows), max(x[0].year for x in rows) + 1)
    want, members, todo = {}, set(current), sorted(rows, reverse=True)
    for y in sorted(years, reverse=True):
        while todo and todo[0][0] > dt.date(y, 12, 31):
            _, a, r = todo.pop(0)
            members.discard(a)
            if r:
                members.add(r)
        want[y] = len(members)
    ev = spark.createDataFrame(rows, EV).withColumn("period", F.year("date"))
    cur = spark.createDataFrame([(c,) for c in current], "symbol string")
    assert {r["period"]: r["members"] for r in M.members_at(ev, cur).collect()} == want


def test_spans_months_and_clamp(spark):
    d = dt.date
    ev = spark.createDataFrame(
        [(d(2020, 1, 10), "A", ""), (d(2020, 3, 5), "", "A"), (d(2020, 6, 1), "A", "B"), (d(2020, 6, 1), "A", ""), (d(2020, 9, 9), "Z", None)], EV
    )
    cur = spark.createDataFrame([("A",), ("N",)], "symbol string")
    end = F.lit("2020-11-20").cast("date")
    got = sorted((r["symbol"], str(r["from"]), str(r["to"])) for r in M.spans(ev, cur.union(cur), until=end).collect())
    assert got == [("A", "2020-01-10", "2020-03-05"), ("A", "2020-06-01", "2020-11-20"), ("B", "2020-01-10", "2020-06-01"), ("N", "2020-01-10", "2020-11-20")]
    months = M.periods(M.spans(ev, cur, until=end)).filter("symbol = 'A'").orderBy("period").collect()
    assert [r["period"].month for r in months] == [1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert {str(r["to"]) for r in M.spans(ev, cur).filter("symbol = 'N'").collect()} == {str(ev.select(F.current_date()).first()[0])}
    before = M.spans_before(ev, cur, F.lit("2020-06-02").cast("date"), end).first()
    assert (before["spans"], before["symbols"]) == (2, 2)
    clamped = {(r["symbol"], str(r["from"])) for r in M.spans(ev, cur, F.lit("2020-04-01").cast("date")).collect()}
    assert clamped == {("A", "2020-06-01"), ("B", "2020-04-01"), ("N", "2020-04-01")}
    assert {r["symbol"] for r in M.universe(ev, cur).collect()} == {"A", "B", "N", "Z"}


def test_density_and_onward_windows(spark):
    n = spark.createDataFrame([(y, c) for y, c in zip(range(2000, 2008), [9, 0, 9, 9, 9, 1, 9, 9])], "period int, rows int")
    t = M.dense_enough(n, "period", 3, 15)
    ok = {r["period"]: r["ok"] for r in t.collect()}
    assert ok == {2000: True, 2001: False, 2002: True, 2003: True, 2004: True, 2005: True, 2006: True, 2007: True}
    assert M.earliest_start(t.select("period", "ok"), "period", "ok").first()["starts"] == 2002
    gate = spark.createDataFrame([(1, False), (2, None), (3, True), (4, None)], "p int, ok boolean")
    r = M.earliest_start(gate, "p", "ok").first()
    assert (r["starts"], r["silent"]) == (2, 2)


def test_current_against_history(spark):
    d = dt.date
    ev = spark.createDataFrame([(d(2020, 1, 1), "A", ""), (d(2020, 2, 1), "B", "C"), (d(2020, 3, 1), "C", "B")], EV)
    cur = spark.createDataFrame([("B",), ("C",), ("N",)], "symbol string")
    assert {r["symbol"]: r["finding"] for r in M.against_current(ev, cur).collect()} == {"A": "omission", "B": "stale", "N": "never"}


def test_ledger_latest_and_completeness(spark):
    led = spark.createDataFrame(
        [("p", "A", 1, "WROTE_NEW", 5), ("p", "A", 2, "WROTE_BESIDE", 0), ("p", "B", 3, "HTTP_ERROR", 9), ("p", "C", 4, "WROTE_NEW", 7)],
        "endpoint string, symbol string, line int, disposition string, n_rows bigint",
    ).withColumns({"date_min": F.lit("2020-01-01").cast("date"), "date_max": F.lit("2020-01-02").cast("date")})
    req = spark.createDataFrame([("p", s) for s in "ABC"], "endpoint string, symbol string")
    r = V.completeness(req, V.latest_entries(led)).first()
    assert (r["requested"], r["usable"], r["empty"], r["missing"]) == (3, 1, 1, 1)


def test_reused_symbols(spark):
    rows = [("a", "Apache Corp", "APA Trust", dt.date(2000, 1, 1), dt.date(2010, 1, 1), "001", "2", False), ("b", "Ford Motor Co", "Ford Inc", dt.date(2000, 1, 1), None, "1", "01", True),
            ("c", "Inc", "Acme", None, None, None, None, None), ("d", "Old Mine", "New Bakery", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "symbol string, history_name string, profile_name string, first_seen date, ipo date, list_id string, profile_id string, continues_after boolean")
    got = {r["symbol"]: (r["tier"], r["seen_and_clash"], r["id_differs"]) for r in V.reused_symbols(df).collect()}
    assert got == {"a": (1, True, True), "b": (None, False, False), "c": (None, False, False), "d": (2, False, False)}
