"""Queries on sources, sinks, text scans, samples and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import cleaning as C
from tidemark.functions import identifiers as I
from tidemark.functions.cleaning import half_up
from tidemark.operators import audit as A
from tidemark.plans import q_vintage as QV
from tidemark.plans import standins as S
from tidemark.plans.q_graph import rounded
from tidemark.plans.registry import query, r
from tidemark.session import shared_dir
from tidemark.sources import files as files_
from tidemark.sources import payloads as P
from tidemark.sources import releases as L


def scratch(spark, name):
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scans
@query("a01_release_as_text", f"WITH {QV.WRITTEN_SQL} SELECT subject, party, a_text, b_text FROM written")
def a01(spark, sf):
    base = scratch(spark, "release")
    QV.written(spark, sf).withColumn("release", F.lit(S.OLD)).write.partitionBy("release").parquet(f"{base}/ownership")
    return L.as_text(L.read_sheet(spark, base, "ownership", S.OLD).drop("release"))


@query(
    "a02_missing_sheets",
    f"WITH {S.SEQ_SQL} SELECT month AS release, sheet FROM seq_catalog, (SELECT unnest(['entities', 'ownership']) AS sheet) WHERE sheet = 'ownership' AND NOT has_sheet",
)
def a02(spark, sf):
    from tidemark.operators.vintage import missing_sheets

    c = S.seq_catalog(spark, sf)
    expected = c.select(F.col("month").alias("release"), F.explode(F.array(F.lit("entities"), F.lit("ownership"))).alias("sheet"))
    held = c.select(F.col("month").alias("release"), F.lit("entities").alias("sheet")).unionByName(
        c.filter("has_sheet").select(F.col("month").alias("release"), F.lit("ownership").alias("sheet"))
    )
    return missing_sheets(expected, held)


@query("a03_a11_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def a03(spark, sf):
    """A sorted CSV is written once and read back under a declared schema."""
    path = scratch(spark, "csv")
    files_.write_sorted_csv(S.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, ["c_custkey"])
    return L.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")


@query("a04_pruned_scan", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def a04(spark, sf):
    return (
        S.table(spark, sf, "lineitem").filter(F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))
        .groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("a05_slim_wide_file", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def a05(spark, sf):
    wide, slim = scratch(spark, "wide"), scratch(spark, "slim")
    S.table(spark, sf, "orders").write.option("header", True).csv(wide)
    return L.slim_wide(
        spark, wide, {"id": (0, "o_orderkey"), "status": (2, "o_orderstatus"), "priority": (5, "o_orderpriority")}, slim
    )


@query(
    "a06_b21_dated_text_table",
    f"""WITH {S.FACTORS_SQL} SELECT CAST(date AS VARCHAR) AS date, CASE WHEN dayofmonth(date) = 13 THEN NULL ELSE {r('floor(mkt * 10000 + 0.5) / 10000 / 100', 6)} END AS mkt,
      CASE WHEN dayofmonth(date) = 14 THEN NULL ELSE 0.01::DOUBLE / 100 END AS rf FROM factors""",
)
def a06(spark, sf):
    """A factor file with a preamble and a footer is written from the factor rows and parsed back."""
    path = scratch(spark, "factors")
    f = S.factors(spark, sf)
    day = F.dayofmonth("date")
    mkt = F.when(day == 13, F.lit("-99.99")).otherwise(F.format_string("%.4f", half_up(F.col("mkt"), 4)))
    rf = F.when(day == 14, F.lit("-999")).otherwise(F.lit("0.01"))
    row = F.concat_ws(",", F.date_format("date", "yyyyMMdd"), F.concat(F.lit("  "), mkt), rf)
    # one line per calendar day, so the text of the file is bounded by the calendar
    body = f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x), "\n").alias("body"))
    body.select(
        F.concat(F.lit("This file was made from daily rows.\n\nMissing data are -99.99 or -999.\n\n,Mkt-RF,RF\n"), "body", F.lit("\n\nEnd of file 2001\n")).alias("value")
    ).write.text(path)
    t = L.read_dated_text(spark, path, ["Mkt-RF", "RF"])
    return t.select(
        F.col("date").cast("string").alias("date"),
        half_up(C.coded_number(F.col("Mkt-RF").cast("string")), 6).alias("mkt"), C.coded_number(F.col("RF").cast("string")).alias("rf"),
    )


PAYLOAD_SQL = """pay AS (SELECT event_type AS endpoint, 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, event_id AS id, value FROM events),
merged AS (SELECT endpoint, symbol, date, arg_min(value, id) AS close FROM pay GROUP BY 1, 2, 3)"""


def payload_rows(spark, sf):
    e = S.table(spark, sf, "events")
    field = F.when(F.col("event_id") % 2 == 0, "close").otherwise("adjClose")
    rec = F.concat(
        F.lit('{"date": "'), F.col("ts").cast("date").cast("string"), F.lit('", "'), field, F.lit('": '), F.col("value").cast("string"), F.lit("}")
    )
    m = F.col("event_id") % 4
    text = (
        F.when(m == 0, F.concat(F.lit("["), rec, F.lit("]")))
        .when(m == 1, F.concat(F.lit('{"symbol": "x", "historical": ['), rec, F.lit("]}")))
        .when(m == 2, F.concat(F.lit('{"data": ['), rec, F.lit("]}"))).otherwise(rec)
    )
    raw = e.select(
        F.col("event_type").alias("endpoint"), F.concat(F.lit("U"), "user_id").alias("symbol"),
        F.lpad(F.col("event_id").cast("string"), 18, "0").alias("file"), text.alias("payload"),
    )
    rows = raw.select("endpoint", "symbol", "file", F.inline(P.rows_of(F.col("payload"), "struct<date: date, close: double, adjClose: double>")))
    return rows.withColumn("close", P.first_field(rows, "price", "close", "adjClose")).drop("adjClose")


@query("a09_a10_payload_shapes", f"WITH {PAYLOAD_SQL} SELECT endpoint, symbol, id, CAST(date AS VARCHAR) AS date, value AS close FROM pay")
def a09(spark, sf):
    return payload_rows(spark, sf).select(
        "endpoint", "symbol", F.col("file").cast("long").alias("id"), F.col("date").cast("string").alias("date"), "close"
    )


@query("a08_merged_windows", f"WITH {PAYLOAD_SQL} SELECT endpoint, symbol, CAST(date AS VARCHAR) AS date, close FROM merged")
def a08(spark, sf):
    return P.merge_windows(payload_rows(spark, sf)).select("endpoint", "symbol", F.col("date").cast("string").alias("date"), "close")


@query("a12_panel_by_year", f"WITH {S.PRICES_SQL} SELECT symbol, count(*) AS bars FROM prices WHERE year(date) = 1999 GROUP BY symbol")
def a12(spark, sf):
    path = scratch(spark, "panel")
    files_.write_panel(S.prices(spark, sf), path)
    return spark.read.parquet(path).filter("year = 1999").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


@query("a13_latest_pull", "SELECT c_nationkey AS hq, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def a13(spark, sf):
    base, c = scratch(spark, "pulls"), S.table(spark, sf, "customer")
    files_.write_once(c, base, "20240101T000000")
    files_.write_once(c.filter("c_acctbal > 0"), base, "20240201T000000")
    return files_.latest_pull(spark, base).groupBy(F.col("c_nationkey").alias("hq")).agg(F.count(F.lit(1)).alias("n"))


NAME_SQL = """fname AS (SELECT DISTINCT 'Ownership-Tracker-' || monthname(o_orderdate) || '-' || year(o_orderdate) ||
   CASE o_custkey % 3 WHEN 1 THEN '-V1' WHEN 2 THEN '-V2' ELSE '' END || '.xlsx' AS name, strftime(o_orderdate, '%Y-%m') AS month FROM orders)"""


def file_names(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_custkey") % 3
    return S.table(spark, sf, "orders").select(
        F.concat(
            F.lit("Ownership-Tracker-"), F.date_format(d, "MMMM"), F.lit("-"), F.year(d),
            F.when(k == 1, "-V1").when(k == 2, "-V2").otherwise(""), F.lit(".xlsx"),
        ).alias("name")
    ).distinct()


@query(
    "a15_one_file_per_month",
    f"""WITH {NAME_SQL} SELECT month, arg_max(name, struct_pack(pin := CASE WHEN month = '1998-03' AND contains(name, 'V1') THEN 1 ELSE 0 END,
      v2 := CASE WHEN contains(name, 'V2') THEN 1 ELSE 0 END, n := name)) AS name FROM fname GROUP BY month""",
)
def a15(spark, sf):
    f = file_names(spark, sf)
    pinned = f.filter((L.month_of_name(F.col("name")) == "1998-03") & F.col("name").contains("V1"))
    return L.one_file_per_month(f, pinned)


@query(
    "a14_pinned_catalog",
    f"""WITH {NAME_SQL}, pins AS (SELECT month AS key, CASE WHEN month < '1996-01' THEN 'gone-' || month ELSE name END AS name FROM fname WHERE contains(name, 'V2') OR month > '2001-01'),
    c AS (SELECT key, count(f.name) AS files, max(f.name) AS file FROM pins p LEFT JOIN fname f ON p.name = f.name GROUP BY key)
    SELECT key, files, file, CASE WHEN files = 1 THEN 'resolved' WHEN files = 0 THEN 'absent' ELSE 'ambiguous' END AS state FROM c""",
)
def a14(spark, sf):
    f = file_names(spark, sf).withColumn("key", L.month_of_name(F.col("name")))
    pins = f.filter(F.col("name").contains("V2") | (F.col("key") > "2001-01")).select(
        "key", F.when(F.col("key") < "1996-01", F.concat(F.lit("gone-"), "key")).otherwise(F.col("name")).alias("name")
    )
    return L.resolve_pins(pins, f.select("name"))


BODY_SQL = """body AS (SELECT 'bucket=' || c_custkey % 16 AS folder, c_custkey % 2 = 0 AS even,
  sha256(string_agg(c_custkey || ',' || c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY 1, 2)"""


def stored(spark, sf):
    """Compressed files derived from the customer table, one in each folder, for fingerprints and manifests."""
    path = scratch(spark, "stored")
    k = F.col("c_custkey")
    S.table(spark, sf, "customer").select((k % 16).alias("bucket"), "c_custkey", F.concat_ws(",", k, "c_name").alias("line")).repartition(
        "bucket"
    ).sortWithinPartitions("bucket", "c_custkey").select("bucket", "line").write.partitionBy("bucket").option("compression", "gzip").text(path)
    return files_.fingerprints(spark, path, "*.gz")


def folder(name="name"):
    return F.substring_index(name, "/", 1)


@query("a16_file_fingerprints", f"WITH {BODY_SQL} SELECT folder, sha256 FROM body")
def a16(spark, sf):
    return stored(spark, sf).select(folder().alias("folder"), "sha256")


@query(
    "a17_q06_provenance",
    f"""WITH {BODY_SQL}, runs AS (SELECT 'as recorded' AS run, 'OK' AS state FROM body UNION ALL
      SELECT 'after a change', CASE WHEN even THEN 'MISMATCH' ELSE 'OK' END FROM body)
    SELECT 'change_decomposition' AS script, state, count(*) AS n, run FROM runs GROUP BY run, state""",
)
def a17(spark, sf):
    from tidemark.session import materialise

    f = materialise(stored(spark, sf))
    rec = files_.provenance(f.withColumn("role", folder()), "change_decomposition", {"old": S.OLD}, {"note": "first run"})
    path = scratch(spark, "provenance")
    files_.write_provenance(rec, path)
    rec = files_.read_provenance(spark, path)
    good = files_.check_provenance(rec, f)
    even = F.regexp_extract("name", "bucket=([0-9]+)", 1).cast("long") % 2 == 0
    spoilt = files_.check_provenance(rec, f.withColumn("sha256", F.when(even, F.lit("0")).otherwise(F.col("sha256"))))
    n = lambda d, run: d.groupBy("script", "state").agg(F.count(F.lit(1)).alias("n")).withColumn("run", F.lit(run))
    return n(good, "as recorded").unionByName(n(spoilt, "after a change"))


@query(
    "q05_manifest_check",
    f"""WITH {BODY_SQL}, states AS (SELECT CASE folder WHEN 'bucket=0' THEN 'unlisted' WHEN 'bucket=1' THEN 'second copy' WHEN 'bucket=2' THEN 'mismatched' ELSE 'ok' END AS state FROM body
      UNION ALL SELECT 'missing' FROM body WHERE folder = 'bucket=3')
    SELECT state, count(*) AS n FROM states GROUP BY state""",
)
def q05(spark, sf):
    from tidemark.session import materialise

    f = materialise(stored(spark, sf).withColumn("at", folder()))
    listed = f.filter("at <> 'bucket=0'").withColumn("sha256", F.when(F.col("at") == "bucket=2", F.lit("0")).otherwise(F.col("sha256")))
    listed = listed.unionByName(f.filter("at = 'bucket=3'").withColumn("name", F.lit("lost.csv")))
    twice = f.unionByName(f.filter("at = 'bucket=1'"))
    return files_.check_manifest(listed, twice).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("b01_names_resolved", "SELECT 'C' || c_custkey AS entity_id, c_name AS name, CAST(NULL AS VARCHAR) AS reviewed FROM customer")
def b01(spark, sf):
    raw = S.table(spark, sf, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("Owner Entity ID"), F.col("c_name").alias("Full Name")
    )
    aliases = {"entity_id": ["Entity ID", "Owner Entity ID"], "name": ["Name", "Full Name"], "reviewed": ["Last Review Date"]}
    return L.canonical(raw, aliases, {"reviewed"}, "entities")


@query("b10_composite_key", "SELECT l_partkey || '|' || l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1")
def b10(spark, sf):
    return S.table(spark, sf, "lineitem").groupBy(C.key_of(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )


SIGNED = "'?X-Amz-Algorithm=AWS4&X-Amz-Expires=' || (60 * (1 + page_id % 4))"
LINK_SQL = f"link AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN split_part(url, '?', 1) || {SIGNED} ELSE url END AS url, html FROM pages)"


def links(spark, sf):
    k = F.col("page_id")
    signed = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("?X-Amz-Algorithm=AWS4&X-Amz-Expires="), (60 * (1 + k % 4)).cast("string"))
    return S.table(spark, sf, "pages").select("page_id", F.when(k % 3 == 0, signed).otherwise(F.col("url")).alias("url"), "html")


@query(
    "b15_unsigned_links",
    f"WITH {LINK_SQL} SELECT page_id, CASE WHEN regexp_matches(url, '(?i)[?&](X-Amz-|AWSAccessKeyId=|Signature=|Expires=)') THEN split_part(url, '?', 1) || '{I.SIGNED_NOTE}' ELSE url END AS url FROM link",
)
def b15(spark, sf):
    return links(spark, sf).select("page_id", I.unsigned_link(F.col("url")).alias("url"))


@query(
    "b28_signed_expiries",
    f"WITH {LINK_SQL}, t AS (SELECT html || ' ' || replace(url, '&', '&amp;') || ' ' || url AS body FROM link), x AS (SELECT unnest(regexp_extract_all(body, '(?:[?&]|&amp;)X-Amz-Expires=(\\d{{1,7}})', 1)) AS e FROM t) SELECT CAST(e AS INTEGER) AS expires, count(*) AS n FROM x GROUP BY 1",
)
def b28(spark, sf):
    body = F.concat_ws(" ", "html", F.replace("url", F.lit("&"), F.lit("&amp;")), "url")
    return A.signed_expiries(links(spark, sf).select(body.alias("body")), "body")


SHAPES_SQL = " UNION ALL ".join(
    f"SELECT doc_id, line, '{n}' AS shape FROM numbered WHERE regexp_matches(body, '{s.replace(chr(39), chr(39) * 2)}')" for n, s in I.SECRET_SHAPES
)


@query(
    "b27_secret_scan",
    f"""WITH t AS (SELECT doc_id, string_split(text || CASE WHEN doc_id % 97 = 5 THEN chr(10) || 'key ' || 'AKIA' || 'ABCDEFGH12345678' ELSE '' END, chr(10)) AS parts FROM documents),
    numbered AS (SELECT doc_id, unnest(parts) AS body, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line FROM t) {SHAPES_SQL}""",
)
def b27(spark, sf):
    d = S.table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.when(F.col("doc_id") % 97 == 5, F.lit("\nkey " + "AKIA" + "ABCDEFGH12345678")).otherwise("")).alias("text"),
    )
    return A.secret_lines(d, "doc_id", "text")


@query(
    "b22_period_keys",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade, count(*) AS n FROM orders GROUP BY ALL",
)
def b22(spark, sf):
    from tidemark.operators.calendar import month_of

    d = F.col("o_orderdate")
    return S.table(spark, sf, "orders").groupBy(
        month_of(d).alias("month"), F.year(d).alias("year"), (F.floor(F.year(d) / 10) * 10).cast("int").alias("decade")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("b29_fingerprint", "SELECT count(*) AS n_rows, true AS same_after_a_shuffle, count(*) = 0 AS same_after_a_change FROM lineitem")
def b29(spark, sf):
    """The fingerprint does not depend on the order of rows and columns, and changes with one value."""
    t = S.table(spark, sf, "lineitem")
    first = t.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("_f"))
    hit = (F.col("l_orderkey") == F.col("_f.l_orderkey")) & (F.col("l_linenumber") == F.col("_f.l_linenumber"))
    changed = t.crossJoin(F.broadcast(first)).withColumn("l_tax", F.when(hit, F.col("l_tax") + 1).otherwise(F.col("l_tax"))).drop("_f")
    moved = t.repartition("l_partkey").select(*reversed(t.columns))
    named = lambda d, s: A.fingerprint(d).select(*[F.col(c).alias(f"{c}_{s}") for c in ("n_rows", "content")])
    row = named(t, "a").crossJoin(F.broadcast(named(moved, "b"))).crossJoin(F.broadcast(named(changed, "c")))
    same = lambda s: F.expr(f"n_rows_a = n_rows_{s} AND content_a = content_{s}")
    return row.select(
        F.col("n_rows_a").alias("n_rows"), same("b").alias("same_after_a_shuffle"), same("c").alias("same_after_a_change")
    )


@query("q11_promotion_guard", "SELECT 'reordered' AS candidate, true AS same_columns, true AS same_rows, true AS may_promote UNION ALL SELECT 'one value changed', true, true, false UNION ALL SELECT 'rows lost', true, count(*) FILTER (WHERE l_quantity <> 1) = count(*), false FROM lineitem")
def q11(spark, sf):
    old = S.table(spark, sf, "lineitem")
    changed = old.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    g = lambda new, name: A.may_promote(old, new).select(F.lit(name).alias("candidate"), "*")
    return (
        g(old.orderBy("l_partkey"), "reordered").unionByName(g(changed, "one value changed"))
        .unionByName(g(old.filter("l_quantity <> 1"), "rows lost"))
    )


# ---------------------------------------------------------------- samples
FRAME_SQL = QV.DIFF_SQL + ", frame AS (SELECT subject, party, detail AS subtype FROM cls WHERE bucket = 'RESTATEMENT')"


def frame(spark, sf):
    return QV.classified(spark, sf).filter("bucket = 'RESTATEMENT'").select("subject", "party", F.col("detail").alias("subtype"))


@query(
    "s19_stratified_sample",
    f"""WITH {FRAME_SQL}, x AS (SELECT *, md5(subject || '|' || party || '|42') AS h, row_number() OVER (PARTITION BY subtype ORDER BY md5(subject || '|' || party || '|42'), subject, party) AS i,
      count(*) OVER (PARTITION BY subtype) AS sz, count(*) OVER () AS tot FROM frame),
    k AS (SELECT * FROM x WHERE i <= greatest(1.0, round_even(20::DOUBLE * sz / tot, 0)) ORDER BY subtype, i LIMIT 20)
    SELECT subject, party, subtype FROM k""",
)
def s19(spark, sf):
    """A sample of 20: the limit is the feature."""
    return A.stratified_sample(frame(spark, sf), "subtype", ["subject", "party"], 20, 42).select("subject", "party", "subtype")


@query("s20_key_sample", "SELECT symbol FROM (SELECT DISTINCT 'S' || l_suppkey AS symbol FROM lineitem) ORDER BY md5(symbol || '|42'), symbol LIMIT 25")
def s20(spark, sf):
    x = S.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"))
    return A.key_sample(x, "symbol", 25, 42)


# ---------------------------------------------------------------- checks
@query(
    "q01_panel_expectations",
    f"""WITH {S.FACTORS_SQL}, {S.PRICES_SQL}, f AS (SELECT count(*) AS n, count(DISTINCT date) AS nd, count(*) FILTER (WHERE dayofweek(date) IN (0, 6)) AS we,
      max(greatest(abs(mkt), abs(smb), abs(hml))) AS mx, min(rf) AS lo, count(mkt) = count(*) AND count(smb) = count(*) AND count(hml) = count(*) AND count(rf) = count(*) AS full_ FROM factors),
    p AS (SELECT count(*) AS n, count(DISTINCT (symbol, date)) AS nd, min(price) AS lo, count(DISTINCT symbol) AS syms, count(*) FILTER (WHERE symbol = 'S1') AS bench FROM prices),
    req AS (SELECT count(*) AS missing FROM supplier WHERE 'S' || s_suppkey NOT IN (SELECT symbol FROM prices)),
    o AS (SELECT count(*) AS shared FROM (SELECT date FROM factors INTERSECT SELECT date FROM prices WHERE symbol = 'S1'))
    SELECT 'factors: all four columns filled' AS name, full_ AS pass FROM f UNION ALL SELECT 'factors: no duplicate dates', n = nd FROM f UNION ALL SELECT 'factors: dates increase', n = nd FROM f
    UNION ALL SELECT 'factors: no weekend dates', we = 0 FROM f UNION ALL SELECT 'factors: magnitudes fit percent', mx < 25 FROM f UNION ALL SELECT 'factors: risk-free rate not negative', lo >= 0 FROM f
    UNION ALL SELECT 'prices: unique by symbol and date', n = nd FROM p UNION ALL SELECT 'prices: price column present', true FROM p UNION ALL SELECT 'prices: all positive', lo > 0 FROM p
    UNION ALL SELECT 'prices: one price field', true FROM p UNION ALL SELECT 'prices: benchmark present', bench > 0 FROM p UNION ALL SELECT 'prices: every requested symbol returned', missing = 0 FROM req
    UNION ALL SELECT 'prices: one return convention', true FROM p UNION ALL SELECT 'prices: convention is total return', true FROM p UNION ALL SELECT 'benchmark: a total-return series exists', bench > 0 FROM p
    UNION ALL SELECT 'overlap: more than 2000 shared days', shared > 2000 FROM o""",
)
def q01(spark, sf):
    f = S.factors(spark, sf)
    p = S.prices(spark, sf).withColumns({"price_field": F.lit("adjClose"), "series": F.lit("dividend-adjusted")})
    n = F.count(F.lit(1))
    fc = f.agg(
        F.every(F.col("mkt").isNotNull() & F.col("smb").isNotNull() & F.col("hml").isNotNull() & F.col("rf").isNotNull()).alias("factors: all four columns filled"),
        (n == F.count_distinct("date")).alias("factors: no duplicate dates"),
        (n == F.count_distinct("date")).alias("factors: dates increase"),
        (F.count_if(F.dayofweek("date").isin(1, 7)) == 0).alias("factors: no weekend dates"),
        (F.max(F.greatest(F.abs("mkt"), F.abs("smb"), F.abs("hml"))) < 25).alias("factors: magnitudes fit percent"),
        (F.min("rf") >= 0).alias("factors: risk-free rate not negative"),
    )
    bench = F.col("symbol") == "S1"
    # duplicates are counted by one aggregate on the key, which merges map-side
    keys = p.groupBy("symbol", "date").agg(
        n.alias("c"), F.min("price").alias("price"), F.min("price_field").alias("pf"), F.max("price_field").alias("pf2"),
        F.min("series").alias("s1"), F.max("series").alias("s2"),
    )
    pc = keys.agg(
        (F.max("c") == 1).alias("prices: unique by symbol and date"), F.lit("price" in p.columns).alias("prices: price column present"),
        (F.min("price") > 0).alias("prices: all positive"), (F.min("pf") == F.max("pf2")).alias("prices: one price field"),
        (F.count_if(bench) > 0).alias("prices: benchmark present"), (F.min("s1") == F.max("s2")).alias("prices: one return convention"),
        ((F.min("s1") == "dividend-adjusted") & (F.max("s2") == "dividend-adjusted")).alias("prices: convention is total return"),
        (F.count_if(bench & (F.col("s1") == "dividend-adjusted")) > 0).alias("benchmark: a total-return series exists"),
    )
    want = S.table(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"))
    lost = want.join(p.select("symbol").distinct(), "symbol", "left_anti").agg((n == 0).alias("prices: every requested symbol returned"))
    shared = f.select("date").join(p.filter(bench).select("date"), "date", "left_semi").agg((n > 2000).alias("overlap: more than 2000 shared days"))
    return A.expectations(fc, pc, lost, shared)


RECON_SQL = f"""{S.LEDGER_SQL}, stored AS (SELECT 'f' || line AS file, CASE WHEN line % 23 = 0 THEN 0 ELSE 100 END AS bytes, CASE WHEN line % 29 = 0 THEN n_rows + 1 ELSE n_rows END AS n_rows, date_min,
   CASE WHEN line % 31 = 0 THEN date_max + 1 ELSE date_max END AS date_max FROM ledger),
entry AS (SELECT 'f' || line AS file, n_rows, date_min, date_max FROM ledger WHERE disposition LIKE 'WROTE%')"""


@query(
    "q04_ledger_reconciliation",
    f"""WITH {RECON_SQL}, w AS (SELECT CASE WHEN e.file IS NULL THEN 'no ledger entry' WHEN bytes = 0 THEN 'zero bytes' WHEN s.n_rows <> e.n_rows THEN 'row count differs'
      WHEN s.date_min <> e.date_min OR s.date_max <> e.date_max THEN 'date range differs' ELSE 'kept' END AS why FROM stored s LEFT JOIN entry e ON s.file = e.file) SELECT why, count(*) AS files FROM w GROUP BY why""",
)
def q04(spark, sf):
    led = S.ledger(spark, sf).withColumn("file", F.concat(F.lit("f"), "line"))
    k = F.col("line")
    st = led.select(
        "file", F.when(k % 23 == 0, 0).otherwise(100).alias("bytes"), F.when(k % 29 == 0, F.col("n_rows") + 1).otherwise(F.col("n_rows")).alias("n_rows"),
        "date_min", F.when(k % 31 == 0, F.date_add("date_max", 1)).otherwise(F.col("date_max")).alias("date_max"),
    )
    entry = led.filter(F.col("disposition").startswith("WROTE")).select("file", "n_rows", "date_min", "date_max")
    return A.reconcile_files(st, entry).groupBy("why").agg(F.count(F.lit(1)).alias("files"))


CLAIM_SQL = """result AS (SELECT p_brand AS source, p_type AS metric, count(*) AS value FROM part GROUP BY 1, 2
   UNION ALL SELECT p_brand, 'total', count(*) FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'total', count(*) + 5 FROM part WHERE p_brand LIKE '%1' GROUP BY 1),
claim AS (SELECT 'section ' || (p_partkey % 3) AS section, CASE WHEN p_partkey % 10 = 0 THEN 'lost' ELSE p_brand END AS source, CASE WHEN p_partkey % 4 = 0 THEN 'total' ELSE p_type END AS metric,
   count(*) OVER (PARTITION BY p_brand, p_type) + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS value, p_partkey FROM part),
prov AS (SELECT DISTINCT p_brand AS source FROM part WHERE p_brand NOT LIKE '%2')"""


def claims_and_results(spark, sf):
    part = S.table(spark, sf, "part")
    by = part.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("value"))
    tot = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("value"))
    results = (
        by.select(F.col("p_brand").alias("source"), F.col("p_type").alias("metric"), "value")
        .unionByName(tot.select(F.col("p_brand").alias("source"), F.lit("total").alias("metric"), "value"))
        .unionByName(tot.filter("p_brand like '%1'").select(F.col("p_brand").alias("source"), F.lit("total").alias("metric"), (F.col("value") + 5).alias("value")))
    )
    k = F.col("p_partkey")
    claims = part.join(by, ["p_brand", "p_type"]).select(
        F.concat(F.lit("section "), k % 3).alias("section"), F.when(k % 10 == 0, "lost").otherwise(F.col("p_brand")).alias("source"),
        F.when(k % 4 == 0, "total").otherwise(F.col("p_type")).alias("metric"), (F.col("value") + F.when(k % 9 == 0, 1).otherwise(0)).alias("value"),
    )
    prov = part.filter("p_brand not like '%2'").select(F.col("p_brand").alias("source")).distinct()
    return claims, results, prov


@query(
    "q07_claim_status",
    f"""WITH {CLAIM_SQL}, s AS (SELECT section, CASE WHEN source NOT IN (SELECT source FROM result) THEN 'NO SOURCE'
      WHEN NOT EXISTS (SELECT 1 FROM result x WHERE x.source = c.source AND x.metric = c.metric AND x.value = c.value) THEN 'UNTRACEABLE'
      WHEN source NOT IN (SELECT source FROM prov) THEN 'NO-PROV' ELSE 'OK' END AS state FROM claim c) SELECT section, state, count(*) AS claims FROM s GROUP BY 1, 2""",
)
def q07(spark, sf):
    return A.claim_status(*claims_and_results(spark, sf))


@query(
    "q08_unresolved_claims",
    f"""WITH {CLAIM_SQL}, n AS (SELECT c.source, c.metric, (SELECT count(*) FROM result x WHERE x.source = c.source AND x.metric = c.metric) AS "values" FROM (SELECT DISTINCT source, metric FROM claim) c)
    SELECT * FROM n WHERE "values" <> 1""",
)
def q08(spark, sf):
    c, res, _ = claims_and_results(spark, sf)
    return A.unresolved_claims(c, res)


@query(
    "q10_publish_gate",
    f"""WITH RECURSIVE {S.GRAPH_SQL}, cls AS (SELECT CASE WHEN s_suppkey % 9 = 4 THEN 'Z' ELSE 'S' END || s_suppkey AS item, CASE WHEN s_suppkey % 8 = 5 THEN 'licensed' ELSE 'public' END AS class FROM supplier
      UNION ALL SELECT CASE WHEN s_suppkey % 16 = 3 THEN 'S' ELSE 'Y' END || s_suppkey, 'licensed' FROM supplier),
    bad(item) AS (SELECT item FROM cls WHERE class = 'licensed' UNION SELECT subject FROM bad JOIN graph_edge ON party = item),
    o AS (SELECT 'S' || s_suppkey AS item FROM supplier), g AS (SELECT o.item, CASE WHEN count(c.class) = 0 THEN 'unknown' WHEN min(c.class) <> max(c.class) THEN 'mixed' ELSE min(c.class) END AS class
      FROM o LEFT JOIN cls c ON o.item = c.item GROUP BY o.item)
    SELECT item, class, item IN (SELECT item FROM bad) AS tainted, class NOT IN ('unknown', 'mixed', 'licensed') AND item NOT IN (SELECT item FROM bad) AS publish FROM g""",
)
def q10(spark, sf):
    from tidemark.operators.graph import tainted

    s, k = S.table(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey")
    item = F.concat(F.lit("S"), k).alias("item")
    named = lambda other, head: F.concat(F.when(other, head).otherwise("S"), k).alias("item")
    inputs = s.select(named(k % 9 == 4, "Z"), F.when(k % 8 == 5, "licensed").otherwise("public").alias("class")).unionByName(
        s.select(named(k % 16 != 3, "Y"), F.lit("licensed").alias("class"))
    )
    uses = S.graph_edges(spark, sf).select(F.col("subject").alias("item"), F.col("party").alias("upstream"))
    bad = tainted(uses, inputs.filter("class = 'licensed'").select("item"))
    return A.publish_gate(s.select(item), inputs, bad)


@query("w01_stream_ingest", "SELECT event_type AS endpoint, count(*) AS n_rows, count(DISTINCT user_id) AS symbols FROM events GROUP BY 1")
def w01(spark, sf):
    """Files of raw rows are written, streamed into a table with a ledger, and counted."""
    from tidemark.streaming.ingest import committed_rows, ingest_new_files

    base = scratch(spark, "stream")
    S.table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "value"
    ).repartition(4, "symbol").write.json(f"{base}/in")
    ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state").awaitTermination()
    t = committed_rows(spark, f"{base}/table", f"{base}/ledger")
    return t.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("symbol").alias("symbols"))


@query("w01_ledger", """SELECT event_type || '.json' AS file, count(*) AS n_rows, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max,
      'ok' AS state FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def w01_ledger(spark, sf):
    """One ledger row for each file of a batch: a file for each kind of event, taken in as a stream."""
    from tidemark.streaming.ingest import ingest_new_files, read_ledger

    base = scratch(spark, "ledger")
    kind = F.col("event_type")
    S.table(spark, sf, "events").filter(kind.isNotNull()).select(
        kind.alias("kind"), kind.alias("endpoint"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "value"
    ).repartition("kind").write.partitionBy("kind").json(f"{base}/in")
    ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state").awaitTermination()
    name = F.concat(F.regexp_extract("file", "kind=([^/]*)/", 1), F.lit(".json")).alias("file")
    return read_ledger(spark, f"{base}/ledger").select(name, "n_rows", "date_min", "date_max", "state")


@query(
    "w02_newest_rows",
    """WITH x AS (SELECT event_type AS endpoint, 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, event_id // 1000 AS batch, event_id, value FROM events)
    SELECT endpoint, symbol, CAST(date AS VARCHAR) AS date, arg_max(value, event_id) AS value FROM x GROUP BY endpoint, symbol, date""",
)
def w02(spark, sf):
    """Pulls are written as files, streamed into the table, and the newest row of each key is read from it."""
    from tidemark.streaming.ingest import RAW, ingest_new_files, newest_rows

    base = scratch(spark, "pulls")
    S.table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "value",
        F.col("event_id").alias("seq"),
    ).repartition(4, "symbol").write.json(f"{base}/in")
    ingest_new_files(
        spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state", RAW + ", seq long"
    ).awaitTermination()
    newest = newest_rows(spark.read.parquet(f"{base}/table"), ("batch", "seq"))
    return newest.select("endpoint", "symbol", F.col("date").cast("string").alias("date"), "value")


@query(
    "w02_newest_by_state",
    """WITH x AS (SELECT event_type AS endpoint, 'U' || user_id AS symbol, CAST(ts AS DATE) AS date, event_id, value FROM events)
    SELECT endpoint, symbol, CAST(date AS VARCHAR) AS date, arg_max(value, event_id) AS value FROM x GROUP BY endpoint, symbol, date""",
)
def w02_by_state(spark, sf):
    """Two arrivals, each streamed into the table and from there into the newest rows; the second goes on from the first one's state."""
    from tidemark.streaming.ingest import ARRIVED, RAW, ingest_new_files, read_newest, replace_newest

    base = scratch(spark, "arrivals")
    e = S.table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"), F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("ts").cast("date").alias("date"), "value",
        F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("early"),
    ).repartition(4, "symbol")
    for part in (~F.col("early"), F.col("early")):  # the later arrival has newer and older rows
        e.filter(part).drop("early").write.mode("append").json(f"{base}/in")
        ingest_new_files(spark, f"{base}/in", f"{base}/table", f"{base}/ledger", f"{base}/state", RAW + ", seq long").awaitTermination()
        replace_newest(
            spark, f"{base}/table", f"{base}/changes", f"{base}/newest", ARRIVED + ", seq long", ("seq",)
        ).awaitTermination()
    return read_newest(spark, f"{base}/changes").select("endpoint", "symbol", F.col("date").cast("string").alias("date"), "value")
