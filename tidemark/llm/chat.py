"""Chat formatting: snapshots of one conversation collapse to the longest, and that one is rendered.

A message is (turn, role, text). A conversation is a prefix of another when its messages are exactly the
other's messages up to its own last turn. Every message gets two 63-bit hashes; their running sums over
the turns are the hashes of all prefixes, so the test is an equality of sums. One group-by leaves a single
conversation of those that are equal, one anti-join takes out those whose whole is a proper prefix elsewhere.

Defined cases: a null text or role counts as empty; a null turn comes before any number; messages that share
a turn are ordered by role, then text; repeated messages count each time; rows without conv_id form one
conversation; of equal conversations the smallest conv_id stays. An empty table gives an empty result. Other columns
are ignored. A conversation is rendered in segments of ``SEGMENT`` messages, numbered from 0 in its order, one row each, so that
one with any number of messages is held by many tasks, also if all of them share a turn number or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

SEGMENT = 64
LEAST = -(2**63)
MASK = 2**63 - 1


def messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LEAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def prefix_hashes(msgs: DataFrame) -> DataFrame:
    """conv_id, turn, n, h1, h2: count and hash sums of all messages up to each turn."""
    part = lambda salt: F.xxhash64(F.lit(salt), "turn", "role", "text").bitwiseAND(F.lit(MASK)).cast("decimal(19,0)")
    turns = msgs.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n"), F.sum(part(1)).cast("decimal(38,0)").alias("h1"), F.sum(part(2)).cast("decimal(38,0)").alias("h2")
    )
    laid = materialise(turns.sort("conv_id", "turn").withColumn("part", F.spark_partition_id()))
    return running(laid, ("turn",), {"n": "long", "h1": "decimal(38,0)", "h2": "decimal(38,0)"})


def running(laid: DataFrame, order: tuple[str, ...], sums: dict[str, str], carried: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, the columns of ``order`` and ``carried``, and running sums along the order.

    ``laid``: rows in parts, by range over (conv_id, order). The parts are stitched with one row per (part, conversation), so a
    long conversation is spread over many parts.
    """
    inside = Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("part", "conv_id").agg(*[F.sum(c).alias(c) for c in sums])
    starts = starts.select(
        F.col("part").alias("_part"),
        F.col("conv_id").alias("_conv"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums],
    )
    own = laid.select("part", "conv_id", *order, *carried, *[F.sum(c).over(inside).alias(c) for c in sums])
    return own.join(starts, (own.part == starts._part) & own.conv_id.eqNullSafe(starts._conv)).select(
        "conv_id", *order, *carried, *[(F.col(c) + F.col(f"_{c}")).cast(kind).alias(c) for c, kind in sums.items()]
    )


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per conversation that stays: conv_id, n_messages, n_copies."""
    states = materialise(prefix_hashes(messages(conversations)))
    # the last state of a conversation is its whole; counts grow strictly with the turns
    whole = states.groupBy("conv_id").agg(F.max("n").alias("total"), F.max("turn").alias("last"))
    joined = states.alias("s").join(whole.alias("w"), F.expr("s.conv_id <=> w.conv_id"))
    key = ["n", "h1", "h2"]
    ends = joined.filter("turn = last").groupBy(*key).agg(
        F.min("w.conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")
    )
    longer = joined.filter("turn < last").select(*key).distinct()
    return ends.join(longer, key, "left_anti").select("conv_id", F.col("n").alias("n_messages"), "n_copies")


def numbered(conversations: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, last, copies, n_messages, n_copies: the different messages of the kept conversations.

    ``copies``: how often a message occurs; ``last``: the number of messages up to its last copy, in the order of turn, role
    and text. Equal messages are counted before they are sorted, so a message with very many copies is one row.
    """
    order = ("turn", "role", "text")
    wanted = kept.select(F.col("conv_id").alias("_c"), "n_messages", "n_copies")
    msgs = messages(conversations).alias("m").join(wanted.alias("k"), F.expr("m.conv_id <=> k._c")).drop("_c")
    about = ("n_messages", "n_copies")
    once = msgs.groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in about])
    laid = materialise(once.withColumn("last", F.col("copies")).sort("conv_id", *order).withColumn("part", F.spark_partition_id()))
    return running(laid, order, {"last": "long"}, ("copies", *about))


def render(conversations: DataFrame, kept: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment, n_messages, n_copies, rendered: the kept conversations as chat markup.

    A message goes to every segment that its copies reach, as often as it stands there.
    """
    first = F.col("last") - F.col("copies")  # number of the first copy, from 0
    at = numbered(conversations, kept).select(
        "*", F.explode(F.sequence(F.floor(first / segment), F.floor((F.col("last") - 1) / segment))).alias("segment")
    )
    here = F.least("last", (F.col("segment") + 1) * segment) - F.greatest(first, F.col("segment") * segment)
    body = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    return (
        at.select("conv_id", "segment", "last", "n_messages", "n_copies", F.repeat(body, here.cast("int")).alias("body"))
        .groupBy("conv_id", "segment")
        .agg(
            F.first("n_messages").alias("n_messages"),
            F.first("n_copies").alias("n_copies"),
            F.array_sort(F.collect_list(F.struct("last", "body"))).alias("msgs"),
        )
        .select("conv_id", "segment", "n_messages", "n_copies", F.array_join(F.col("msgs.body"), "").alias("rendered"))
    )


def format_chats(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    return render(conversations, materialise(collapse(conversations)), segment)


SQL = f"""
WITH m AS (SELECT conv_id, coalesce(turn, {LEAST}) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations),
t AS (SELECT conv_id, turn, count(*) AS c,
             string_agg(md5(turn || chr(1) || role || chr(1) || text), ',' ORDER BY role, text) AS body FROM m GROUP BY conv_id, turn),
s AS (SELECT conv_id, turn, sum(c) OVER w AS n, md5(string_agg(body, ';') OVER w) AS h,
             max(turn) OVER (PARTITION BY conv_id) AS last
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_copies FROM s WHERE turn = last GROUP BY n, h),
k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.n = e.n AND s.h = e.h AND s.turn < s.last))
SELECT conv_id, segment, CAST(any_value(n) AS BIGINT) AS n_messages, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM (SELECT m.*, k.n, k.n_copies, (row_number() OVER (PARTITION BY m.conv_id ORDER BY turn, role, text) - 1) // {SEGMENT} AS segment
      FROM m JOIN k ON m.conv_id IS NOT DISTINCT FROM k.conv_id)
GROUP BY conv_id, segment
"""
