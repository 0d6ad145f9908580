import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.functions import identifiers as I
from tidemark.operators import audit as A
from tidemark.operators import crosswalk as W
from tidemark.sources import files as S
from tidemark.sources import payloads as P
from tidemark.sources import releases as L
from tidemark.streaming import ingest as T


def test_text_rules(spark):
    df = spark.createDataFrame([("51.30%",), ("1,234.5",), ("not found",), (" ",), (None,), ("0",), ("-99.99",)], "t string")
    t = F.col("t")
    rows = df.select(C.blank(t), C.number(t), C.fraction(t), C.decimals(t), C.coded_number(t)).collect()
    assert [r[0] for r in rows] == [False, False, True, True, True, False, False]
    assert [r[1] for r in rows] == [51.3, 1234.5, None, None, None, 0.0, -99.99]
    assert [r[2] for r in rows][:3] == [0.513, 0.0, 0.0]
    assert [r[3] for r in rows] == [1, None, None, None, None, 0, 2]
    assert rows[6][4] is None and rows[5][4] == 0.0
    p = spark.createDataFrame([("A -> B [50%] -> C [20.0%]",), ("A",)], "p string").select(
        C.last_hop(F.col("p")), C.chain_depth(F.col("p")), C.path_product(F.col("p"))
    ).collect()
    assert (p[0][0], p[0][1]) == (0.2, 2) and p[0][2] == pytest.approx(10.0) and tuple(p[1]) == (None, 0, None)


def test_identifier_rules(spark):
    df = spark.createDataFrame([("US0378331005",), ("US037833AB05",), ("GB0000000000",)], "c string")
    assert [r[0] for r in df.select(I.equity_issue(F.col("c"))).collect()] == [True, False, True]
    s = spark.createDataFrame([("BRK-PA",), ("DOW",), ("0AB1.L",), ("BAS.F",), ("ABPRC",)], "s string")
    assert [r[0] for r in s.select(I.suspect_symbol(F.col("s"))).collect()] == ["preferred share", None, "international line", "regional floor", "preferred series"]
    n = spark.createDataFrame([("The Acme Holdings, Inc.",)], "n string").select(I.plain_name(F.col("n")), I.name_tokens(F.col("n"))).first()
    assert n[0] == "acme" and n[1] == ["acme"]


def test_aliases_stop_on_an_unknown_layout(spark):
    df = spark.createDataFrame([("x", "y")], "`Owner ID` string, `Full Name` string")
    out = L.canonical(df, {"name": ["Name", "Full Name"], "seen": ["Seen"]}, {"seen"}, "entities")
    assert out.first().asDict() == {"name": "y", "seen": None}
    with pytest.raises(ValueError, match="entities"):
        L.canonical(df, {"entity": ["Entity ID"]}, set(), "entities")


def test_wide_file_checks_its_header(spark, tmp_path):
    src = f"file://{tmp_path}/wide"
    spark.createDataFrame([("a", "b", "c")], "LEI string, Name string, Country string").write.option("header", True).csv(src)
    got = L.slim_wide(spark, src, {"lei": (0, "LEI"), "hq": (2, "Country")}, f"file://{tmp_path}/slim")
    assert got.first().asDict() == {"lei": "a", "hq": "c"}
    with pytest.raises(ValueError, match="column 1"):
        L.slim_wide(spark, src, {"hq": (1, "Country")}, f"file://{tmp_path}/no")


def test_dated_text_with_preamble(spark, tmp_path):
    f = tmp_path / "factors.csv"
    f.write_text("Made by hand, 2020.\n\n,Mkt-RF, RF\n20200102, 0.50, 0.01\n20200103,-99.99,0.01\n\n202001, 9, 9\nCopyright\n")
    got = L.read_dated_text(spark, f"file://{f}", ["Mkt-RF", "RF"]).orderBy("date").collect()
    assert [(str(r["date"]), r["Mkt-RF"], r["RF"]) for r in got] == [("2020-01-02", 0.5, 0.01), ("2020-01-03", -99.99, 0.01)]


def test_raw_tree_shapes_and_overlapping_windows(spark, tmp_path):
    d = tmp_path / "prices"
    d.mkdir()
    put = lambda name, obj: (d / name).write_bytes(gzip.compress(json.dumps(obj).encode()))
    put("AAA__2020.json.gz", [{"date": "2020-01-01", "close": 1.0}, {"date": "2020-01-02", "close": 2.0}])
    put("AAA__2021.json.gz", {"historical": [{"date": "2020-01-02", "close": 9.0}]})
    put("BBB.json.gz", {"date": "2020-01-05", "adjClose": 3.0})
    raw = P.read_raw_tree(spark, f"file://{tmp_path}")
    rows = raw.select("endpoint", "symbol", "file", F.inline(P.rows_of(F.col("payload"), "struct<date: date, close: double, adjClose: double>")))
    rows = rows.withColumn("close", P.first_field(rows, "close", "adjClose", "absent"))
    got = {(r["endpoint"], r["symbol"], str(r["date"])): r["close"] for r in P.merge_windows(rows).collect()}
    assert got == {("prices", "AAA", "2020-01-01"): 1.0, ("prices", "AAA", "2020-01-02"): 2.0, ("prices", "BBB", "2020-01-05"): 3.0}


def test_sinks_never_overwrite_and_records_are_checked(spark, tmp_path):
    base = f"file://{tmp_path}/pulls"
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    S.write_once(df, base, "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_once(df, base, "1")
    S.write_once(df.limit(1), base, "2")
    assert S.latest_pull(spark, base).count() == 1
    out = f"file://{tmp_path}/csv"
    S.write_sorted_csv(df, out, ["k"])
    found = S.fingerprints(spark, out, "*.csv")
    record = S.provenance(found.withColumn("role", F.col("name")), "script", {"old": "2025-03"}, {})
    assert {r["state"] for r in S.check_provenance(record, found).collect()} == {"OK"}
    assert {r["state"] for r in S.check_provenance(record, found.withColumn("sha256", F.lit("x"))).collect()} == {"MISMATCH"}
    assert {r["state"] for r in S.check_provenance(record, found.limit(0)).collect()} == {"absent"}
    with pytest.raises(ValueError, match="reserved"):
        S.provenance(found.withColumn("role", F.col("name")), "script", {}, {"inputs": "x"})


def test_a_killed_write_leaves_no_visible_pull(spark, tmp_path):
    base = f"file://{tmp_path}/pulls"
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    S.write_once(df, base, "1")
    # killed before its commit record: part of the rows, the newest stamp
    df.limit(1).write.parquet(f"{base}/pull=9")
    assert {(r["k"], r["v"], r["pull"]) for r in S.latest_pull(spark, base).collect()} == {(2, "b", "1"), (1, "a", "1")}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        S.write_once(df, base, "9")
    S.write_once(df.limit(0), base, "91")
    assert S.latest_pull(spark, base).count() == 0
    assert {tuple(r) for r in S.committed_pulls(spark, base).collect()} == {("1", 2), ("91", 0)}
    df.write.mode("append").parquet(f"{base}/pull=91")
    with pytest.raises(ValueError, match="holds 2 rows"):
        S.latest_pull(spark, base)


def test_files_of_any_size_are_fingerprinted_in_blocks(spark, tmp_path):
    d = tmp_path / "big files"
    (d / "sub").mkdir(parents=True)
    with open(d / "sparse.bin", "wb") as f:
        f.truncate(40 << 20)  # forty times what a row may hold below
    (d / "empty.bin").write_bytes(b"")
    (d / "sub" / "zeros.bin.gz").write_bytes(gzip.compress(bytes(3 << 20)))
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, 1 << 20)
    try:
        got = {r["name"]: (r["bytes"], r["sha256"]) for r in S.fingerprints(spark, f"file://{d}").collect()}
    finally:
        spark.conf.unset(key)
    sha = lambda n: hashlib.sha256(bytes(n)).hexdigest()
    assert got["sparse.bin"] == (40 << 20, sha(40 << 20)) and got["empty.bin"] == (0, sha(0))
    assert got["sub/zeros.bin.gz"][1] == sha(3 << 20) and len(got) == 3


def test_fingerprint_adds_whole_hashes(spark):
    rows = [(k, f"v{k}" if k % 3 else None) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, v string")
    body = [json.dumps({"k": k, "v": v}, separators=(",", ":")) for k, v in rows]
    total = sum(int(hashlib.sha256(x.encode()).hexdigest(), 16) for x in body) % 2**256
    assert tuple(A.fingerprint(df).first()) == (50, f"{total:064x}")
    assert tuple(A.fingerprint(df.limit(0)).first()) == (0, "0" * 64)
    swapped = df.withColumn("v", F.when(F.col("k") == 1, "v2").when(F.col("k") == 2, "v1").otherwise(F.col("v")))
    assert not A.may_promote(df, swapped).first()["may_promote"]
    # microseconds, nulls against the word, and columns that trade their values all count
    at = lambda x: spark.sql(f"SELECT {x}")
    for a, b in (
        ("timestamp'2020-01-01 00:00:00.000001' t", "timestamp'2020-01-01 00:00:00.000002' t"),
        ("cast(null as string) v", "'null' v"), ("'a' x, 'b' y", "'b' x, 'a' y"),
    ):
        assert A.fingerprint(at(a)).first()["content"] != A.fingerprint(at(b)).first()["content"]


def test_fingerprint_ignores_order_only(spark):
    a = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "k int, v string")
    assert A.may_promote(a, a.orderBy(F.col("k").desc())).first()["may_promote"]
    assert not A.may_promote(a, a.distinct()).first()["may_promote"]
    assert not A.may_promote(a, a.withColumnRenamed("v", "w")).first()["may_promote"]


def test_secret_lines_and_checks(spark):
    text = "fine\nkey " + "AKIA" + "A" * 16 + "\nfine\n-----BEGIN " + "PRIVATE KEY-----"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    assert {(r["id"], r["line"], r["shape"]) for r in A.secret_lines(df, "id", "text").collect()} == {(1, 2, "access key id"), (1, 4, "private key")}
    checks = A.expectations(spark.createDataFrame([(True, False)], "good boolean, bad boolean"))
    with pytest.raises(AssertionError, match="bad"):
        A.require_all(checks)
    A.require_all(checks.filter("pass"))


def test_best_listing_and_overrides(spark):
    rows = [("L1", "A", 1, 100.0, 1.0, 40), ("L1", "B", 1, 40.0, 9.0, 40), ("L1", "C", 1, 30.0, 99.0, 40), ("L1", "D", 1, 900.0, 5.0, 30), ("L2", "E", 1, 0.0, 5.0, 99), (None, "F", 1, 5.0, 5.0, 99)]
    df = spark.createDataFrame(rows, "lei string, symbol string, exchange int, dollar_vol double, share_vol double, bars int")
    assert {r["lei"]: r["symbol"] for r in W.best_listing(df, "lei").collect()} == {"L1": "B"}
    left = spark.createDataFrame([("x", "not found"), ("y", "L1"), ("z", None)], "e string, lei string")
    right = spark.createDataFrame([("not found", "bad"), ("L1", "good"), (None, "bad")], "lei string, s string")
    assert {r["e"]: r["s"] for r in W.null_safe_lookup(left, right, "lei").collect()} == {"x": None, "y": "good", "z": None}
    ch = spark.createDataFrame([("x", "Acme ", "A"), ("y", "Beta", "B")], "e string, name string, symbol string")
    ov = spark.createDataFrame([("Acme", ""), ("Gone", "G")], "name string, symbol string")
    assert {r["e"]: r["symbol"] for r in W.apply_overrides(ch, ov, "name").collect()} == {"x": None, "y": "B"}
    assert [r["name"] for r in W.unused_overrides(ch, ov, "name").collect()] == ["Gone"]


def test_name_ratio_and_name_route(spark):
    rows = [("e1", "Acme Energy Inc", "ACME ENERGY PLC", "A", 5.0, 40), ("e1", "Acme Energy Inc", "Acme Energy Holdings", "B", 9.0, 40),
            ("e1", "Acme Energy Inc", "Acme Energy", "C", 99.0, 30), ("e2", "Beta Power", "Gamma Mines", "D", 5.0, 40), ("e2", "Beta Power", None, "E", 5.0, 40),
            ("e3", "Delta Coal", "Delta Coals", "F", 1.0, 31)]
    df = spark.createDataFrame(rows, "e string, name string, other string, symbol string, dollar_vol double, bars int")
    got = {r["symbol"]: r["s"] for r in df.withColumn("s", W.similarity("name", "other")).collect()}
    assert got["A"] == 1.0 and got["E"] is None
    assert got["D"] == pytest.approx(3 / 11) and got["F"] == pytest.approx(10 / 11)
    best = {r["e"]: r["symbol"] for r in W.name_route(df, "e", "name", "other").collect()}
    assert best == {"e1": "B", "e3": "F"}


def test_home_switch_needs_three_times_the_value(spark):
    cur = spark.createDataFrame([("x", "X", 10.0), ("y", "Y", 10.0), ("z", "Z", None)], "e string, symbol string, dollar_vol double")
    home = spark.createDataFrame([("x", "XH", 30.0, 40), ("y", "YH", 30.5, 40), ("y", "YT", 99.0, 30), ("z", "ZH", 2.0, 40)], "e string, symbol string, dollar_vol double, bars int")
    got = {r["e"]: (r["symbol"], r["moved"]) for r in W.home_switch(cur, home, "e").collect()}
    assert got == {"x": ("X", False), "y": ("YH", True), "z": ("ZH", True)}


def test_waves_have_an_uncapped_last_pass(spark):
    df = spark.createDataFrame([("hot", i, i == 550) for i in range(600)] + [("one", 0, True), ("none", 0, False)], "firm string, i int, hit boolean")
    got = {r["firm"]: (r["candidates"], r["waves"], r["resolved_wave"]) for r in W.candidate_waves(df, "firm", [F.col("i")], "hit").collect()}
    assert got == {"hot": (600, 4, 4), "one": (1, 1, 1), "none": (1, 1, None)}


def test_stream_reads_unseen_files_only_and_newest_row_wins(spark, tmp_path):
    base = f"file://{tmp_path}"
    raw = lambda rows: spark.createDataFrame(rows, T.RAW.replace("date date", "date string")).coalesce(1)
    run = lambda: T.ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state").awaitTermination()
    raw([("p", "A", "2020-01-01", 1.0), ("p", "B", "2020-01-01", 2.0)]).write.json(f"{base}/in", mode="append")
    run()
    run()
    assert spark.read.parquet(f"{base}/ledger").count() == 1
    raw([("p", "A", "2020-01-01", 5.0)]).write.json(f"{base}/in", mode="append")
    run()
    table = spark.read.parquet(f"{base}/table")
    assert table.count() == 3 and spark.read.parquet(f"{base}/ledger").count() == 2
    got = {r["symbol"]: r["value"] for r in T.newest_rows(table).collect()}
    assert got == {"A": 5.0, "B": 2.0}
    raw([("p", "B", "2020-01-01", 7.0)]).write.json(f"{base}/in", mode="append")
    run()
    assert {r["symbol"]: r["value"] for r in T.newest_rows(spark.read.parquet(f"{base}/table")).collect()} == {"A": 5.0, "B": 7.0}


def test_every_file_has_a_ledger_row(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    line = lambda s, v: json.dumps({"endpoint": "p", "symbol": s, "date": "2020-01-01", "value": v}) + "\n"
    (d / "good [1].json").write_text(line("A", 1.0) + line("B", 2.0))
    (d / "broken.json").write_text(line("C", 3.0) + "{no json\n")
    (d / "blank.json").write_text("\n\n")
    (d / "empty.json").write_bytes(b"")
    base = f"file://{tmp_path}"
    run = lambda: T.ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state").awaitTermination()
    ledger = lambda: sorted(
        (r["file"].rsplit("/", 1)[1], r["bytes"], r["n_rows"], r["n_broken"], r["state"]) for r in T.read_ledger(spark, f"{base}/ledger").collect()
    )
    run()
    size = lambda name: (d / name).stat().st_size
    first = [
        ("blank.json", 2, 0, 0, "no rows"), ("broken.json", size("broken.json"), 1, 1, "broken"), ("empty.json", 0, 0, 0, "empty"),
        ("good%20%5B1%5D.json", size("good [1].json"), 2, 0, "ok"),
    ]
    assert ledger() == first
    assert [r["line"] for r in spark.read.parquet(f"{base}/ledger-broken").collect()] == ["{no json"]
    run()  # nothing new: nothing is noted twice
    assert len(ledger()) == 4
    (d / "late.json").write_text(line("D", 4.0))
    run()
    assert ("late.json", size("late.json"), 1, 0, "ok") in ledger() and len(ledger()) == 5
    # a batch whose ledger was never written does not count
    spark.read.parquet(f"{base}/table/batch=0").write.parquet(f"{base}/table/batch=7")
    got = T.committed_rows(spark, f"{base}/table", f"{base}/ledger")
    assert sorted(r["symbol"] for r in got.collect()) == ["A", "B", "C", "D"]


def test_newest_rows_by_state_equal_the_batch_form(spark, tmp_path):
    base = f"file://{tmp_path}"
    arrivals = [
        [("p", "A", "2020-01-01", 1.0), ("p", "B", "2020-01-01", 2.0), (None, None, None, 3.0)],
        [("p", "A", "2020-01-01", 5.0), ("p", "C", "2020-01-02", None)],
        [("p", "C", "2020-01-02", 8.0), (None, None, None, 9.0), ("q", "A", "2020-01-01", 0.0)],
    ]
    key = lambda rows: sorted(((r["endpoint"], r["symbol"], r["date"], r["value"], r["batch"]) for r in rows), key=repr)
    for k, rows in enumerate(arrivals):
        spark.createDataFrame(rows, "endpoint string, symbol string, date string, value double").write.json(f"{base}/in", mode="append")
        T.ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state").awaitTermination()
        # a new query each time: it knows the earlier rows from its checkpoint alone
        T.replace_newest(spark, f"{base}/table", f"{base}/changes", f"{base}/newest").awaitTermination()
        assert key(T.read_newest(spark, f"{base}/changes").collect()) == key(T.newest_rows(spark.read.parquet(f"{base}/table")).collect())
        touched = spark.read.parquet(f"{base}/changes/change={k}").count()
        assert touched == len(rows)  # only keys with new rows are written


def test_shared_dir_is_read_from_the_session(spark):
    from types import SimpleNamespace as N

    from tidemark import session

    fake = lambda value, master: N(conf=N(get=lambda key, default: value), sparkContext=N(master=master, applicationId="app-x"))
    assert session.shared_dir(fake("hdfs://shared/ckpt/", "spark://host")) == "hdfs://shared/ckpt"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(None, "spark://host"))
    local = session.shared_dir(fake(None, "local[8]"))
    assert local.startswith("file:///") and session.shared_dir(fake(None, "local[8]")) == local
    df, n = session.counted(spark.range(5).repartition(2))
    assert n == 5 and df.count() == 5
