"""Stand-ins account for every row of the tables they are made of."""

from pyspark.sql import functions as F

from tidemark.plans import q_vintage
from tidemark.plans import standins as S

FOLDER = "/root/testdata/sf0.001"


def test_every_event_is_a_membership_change(spark):
    events = S.table(spark, FOLDER, "events")
    changes = S.member_events(spark, FOLDER)
    assert changes.count() == events.count()
    assert changes.filter((F.col("added") == "") == (F.col("removed") == "")).count() == 0
    kinds = events.join(changes, "event_id").groupBy("event_type").agg(F.count_distinct(F.col("added") != "").alias("n"))
    assert {r["n"] for r in kinds.collect()} == {1}


def test_current_members_are_those_last_added(spark):
    last = {}
    for r in S.table(spark, FOLDER, "events").orderBy("ts", "event_id").collect():
        last[f"U{r['user_id']}"] = r["event_type"] not in ("error", "click")
    assert {r["symbol"] for r in S.member_current(spark, FOLDER).collect()} == {u for u, here in last.items() if here}


def test_every_supplier_is_named_in_both_releases(spark):
    keys = {r["s_suppkey"] for r in S.table(spark, FOLDER, "supplier").collect()}
    want = {("O" if k % 23 == 5 else "S") + str(k) for k in keys} | {("N" if k % 5 == 2 else "S") + str(k) for k in keys}
    assert {r["entity"] for r in q_vintage.name_map(spark, FOLDER).collect()} == want


def test_lines_of_units_are_shuffled_once(spark):
    plan = S.units(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # the lines by unit, and at most the parts that join them
    assert plan.count("Exchange hashpartitioning") <= 2, plan
