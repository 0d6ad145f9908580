"""Exact Jaccard join of documents on five-word shingles, through a token-group matrix.

A document's set is its distinct shingles; documents with the same set are one set from the start. Two sets link when
100 * common >= 80 * union. The steps:

1. Each set gives its prefix: so many of its tokens, in one order for all sets, that sets which link have l of them in
   common, where l is 1 and a twentieth of the smaller set. The order puts tokens that many prefixes hold (counted over all
   sets) last; it decides cost, never results.
2. Tokens that two sets' prefixes share are kept. Sets with fewer such tokens than l for their smallest partner link with
   nothing and go.
3. Similar sets are partitioned into groups: of its ``KEYS`` minimal hashes, a set goes by the one that most sets have;
   groups are dealt into chunks of about ``CHUNK`` sets. Inside a chunk all links are found at once, through an index of its tokens.
4. The token-group matrix has a row for each token that several groups hold and each of these groups, whatever their number of chunks.
   Counting the tokens of a set (the query) that a group holds bounds its overlap with any member from above; only groups that reach the
   bound are opened, and there the query meets all members through their token index, chunk by chunk. Chunks of one group open each other.

The minimal hashes come with the documents' sizes, so who meets whom is known before any whole set moves: only sets that meet another
move, once to their copies and once to each of their meetings.

Every link between different sets is found once, also between sets that are connected already. ``links`` gives them all. The
documents' own counts come from the same meetings: a task adds up the links of its sets and passes on, of the links themselves, as
many as connect the same, so that a family of k near copies moves k counts a chunk and not k * k rows. Tokens and
sets are told apart by 64-bit hashes.

n_links counts the other documents that a document links with; those with the same set are among them.

Defined cases: a null or empty text, or one without words, has no shingles, no links and is a component of its own; a text of fewer
than five words is one shingle; a null doc_id counts as no id (its component is named by the other members, or null); repeated rows
share their set; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tallies, words
from tidemark.llm.components import components
from tidemark.llm.words import released
from tidemark.session import counted, materialise

WORDS = 5
NEAR = 80  # percent
EXTRA = 20
COMMON = 32  # prefixes that hold a token before it counts as common
CHUNK = 512
PIECE = 256 << 10  # bytes of text that a task hashes at once
KEYS = 8
BITS = 1 << 26
ODD = words.mixed(np.arange(11, 11 + WORDS, dtype=np.uint64) * words.GOLD) | np.uint64(1)
LEAST = [f"least_{k}" for k in range(KEYS)]
SALTS = words.mixed(np.arange(101, 101 + KEYS, dtype=np.uint64) * words.GOLD)


#: Tokens that a set's prefix must share for any link: l of the smallest set that it can link with.
LEAST_SQL = f"1 + (({NEAR} * n + 99) div 100) div {EXTRA}"


def shingles(column: pa.Array):
    """The sorted distinct shingle hashes of every row."""
    h, rows = words.of_rows(column)
    n = np.diff(rows)
    with np.errstate(over="ignore"):
        runs = sum((h[k : max(0, len(h) - WORDS + 1 + k)] * ODD[k] for k in range(WORDS)), np.uint64(0)) if len(h) >= WORDS else h[:0]
        runs = words.mixed(runs)
        for at, size in zip(rows[:-1].tolist(), n.tolist()):
            if size >= WORDS:
                yield np.unique(runs[at : at + size - WORDS + 1])
            elif size:
                yield words.mixed(np.atleast_1d((h[at : at + size] * ODD[:size]).sum() ^ np.uint64(size)))
            else:
                yield h[:0]


def set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)))


def prefix(tokens: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """The first n - ceil(0.8 n) + l tokens, common ones last, with l = 1 + n // EXTRA. ``often`` marks common ones.

    Sets that link have at least the smaller of their l in common there.
    """
    n = len(tokens)
    most = n - (NEAR * n + 99) // 100 + 1 + n // EXTRA
    if often is None or not often.any():
        return tokens[:most]
    rare = tokens[~often]
    return rare[:most] if len(rare) >= most else np.concatenate((rare, tokens[often][: most - len(rare)]))


def least_hashes(tokens: np.ndarray) -> np.ndarray:
    """The ``KEYS`` minimal hashes of a set."""
    if len(tokens) < 1 << 14:
        return words.mixed(tokens ^ SALTS[:, None]).min(axis=1)
    return np.array([words.mixed(tokens ^ salt).min() for salt in SALTS], dtype=np.uint64)


def signed(tokens: np.ndarray) -> pa.Array:
    return pa.array(tokens.view(np.int64))


def over_sets(docs: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on an iterator of (doc_id, tokens) of a part's documents."""

    def rows(batches):
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                yield from zip(piece.column(0).to_pylist(), shingles(piece.column(1)))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(released(lambda batches: work(rows(batches))), schema)


def in_batches(rows, names: list[str], most: int = 20_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.record_batch([pa.array(c) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.record_batch([pa.array(c) for c in zip(*held)], names=names)


def set_table(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, n, set, minimal hashes of every document, and its key if there is one; set and hashes are null without shingles."""
    carried = [] if key is None else ["key"]
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if key is None else [key.alias("key")])
    )

    def work(batches):
        for batch in batches:
            for piece in words.pieces(batch, "text", PIECE):
                sizes, sets, least = [], [], np.zeros((piece.num_rows, KEYS), dtype=np.uint64)
                for k, tokens in enumerate(shingles(piece.column(1))):
                    sizes.append(len(tokens))
                    sets.append(set_id(tokens) if len(tokens) else None)
                    if len(tokens):
                        least[k] = least_hashes(tokens)
                none = np.array([n == 0 for n in sizes], dtype=bool)
                hashes = [pa.array(least[:, k].copy().view(np.int64), mask=none) for k in range(KEYS)]
                columns = [piece.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), *hashes, *piece.columns[2:]]
                yield pa.record_batch(columns, names=["doc_id", "n", "set", *LEAST, *carried])

    return texts.mapInArrow(released(work), "doc_id long, n long, set long" + "".join(f", {c} long" for c in LEAST) + "".join(f", {c} binary" for c in carried))


def common_tokens(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Hash partitions and bit table (see ``tallies``) of tokens that may be in the plain prefixes of ``COMMON`` sets."""
    seen: set[int] = set()  # of a task

    def hashes(batch):
        for piece in words.pieces(batch, "text", PIECE):
            for tokens in shingles(piece.column(0)):
                if len(tokens) and (key := set_id(tokens)) not in seen:
                    seen.add(key)
                    yield prefix(tokens)

    texts = docs.select(F.col("text").cast("string").alias("text"))
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = tallies.partitions(docs, letters // 20)
    return parts, tallies.candidates(texts, hashes, parts, COMMON, BITS)


def postings(docs: DataFrame, parts: int, common: np.ndarray) -> DataFrame:
    """token, set: the prefixes of the sets, each set once per part."""

    def prefixes(held: list[np.ndarray], sets: list[int]) -> pa.RecordBatch:
        every = np.concatenate(held)
        often = np.zeros(len(every), dtype=bool)
        often[tallies.may_be_frequent(every, parts, common)] = True
        cuts = np.cumsum([len(t) for t in held])[:-1]
        tokens = [prefix(t, o) for t, o in zip(held, np.split(often, cuts))]
        return pa.record_batch(
            [signed(np.concatenate(tokens)), pa.array(np.repeat(np.array(sets, dtype=np.int64), [len(t) for t in tokens]))], names=["token", "set"]
        )

    def work(rows):
        seen, held, sets, size = set(), [], [], 0
        for _, tokens in rows:
            if not len(tokens) or (key := set_id(tokens)) in seen:
                continue
            seen.add(key)
            held.append(tokens)
            sets.append(key)
            size += len(tokens)
            if size > 200_000:
                yield prefixes(held, sets)
                held, sets, size = [], [], 0
        if size:
            yield prefixes(held, sets)

    return over_sets(docs, work, "token long, set long")


def shared_postings(docs: DataFrame, table: DataFrame) -> DataFrame:
    """The postings of tokens that different sets hold, of sets that hold enough of them. ``table``: set, n, each set once.

    Counting and keeping read one exchange.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings(docs, *common_tokens(docs)).repartition(n, "token")
    several = dealt.groupBy("token").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).filter("lo < hi").select("token")
    shared = materialise(dealt.join(several.hint("merge"), "token").distinct())
    enough = (
        shared.groupBy("set").agg(F.count(F.lit(1)).alias("held"))
        .join(table.select("set", "n"), "set")
        .filter(F.col("held") >= F.expr(LEAST_SQL)).select("set")
    )
    return materialise(shared.join(enough, "set", "left_semi"))


def bit_table(sets: DataFrame) -> np.ndarray:
    """Bits of the hashed set ids, or-ed over all parts: 8 MB at any size, so every task can have it. A task holds no more either."""
    parts, width = 64, BITS // 8 // 64

    def mark(batches):
        packed = np.zeros(BITS // 8, dtype=np.uint8)
        for batch in batches:
            place = np.asarray(batch.column(0)).view(np.uint64) % np.uint64(BITS)
            np.bitwise_or.at(packed, (place >> np.uint64(3)).astype(np.int64), np.right_shift(np.uint8(128), (place & np.uint64(7)).astype(np.uint8)))
        packed = packed.reshape(parts, width)
        some = np.flatnonzero(packed.any(axis=1))
        if len(some):
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some])], names=["part", "bits"])

    def either(table: pa.Table) -> pa.Table:
        out = np.zeros(width, dtype=np.uint8)
        for x in table.column("bits"):
            out |= np.frombuffer(x.as_py(), dtype=np.uint8)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([out.tobytes()])})

    # few, full parts: what is or-ed together is as many rows as tasks
    marked = sets.coalesce(64).mapInArrow(released(mark), "part int, bits binary")
    bits = np.zeros((parts, width), dtype=np.uint8)
    for part, row in marked.groupBy("part").applyInArrow(either, "part int, bits binary").collect():
        bits[part] = np.frombuffer(row, dtype=np.uint8)
    return bits.ravel()


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, tokens: the whole sets that are wanted, each once, dealt by set; sets that share a bit with a wanted one may come too."""
    bits = bit_table(wanted.select("set"))

    def work(rows):
        def kept():
            seen = set()
            for _, tokens in rows:
                if not len(tokens) or (key := set_id(tokens)) in seen:
                    continue
                place = key % BITS
                if bits[place >> 3] >> (7 - (place & 7)) & 1:
                    seen.add(key)
                    yield key, tokens.tobytes()

        yield from in_batches(kept(), ["set", "tokens"], 500)

    return over_sets(docs, work, "set long, tokens binary").dropDuplicates(["set"])


def grouped(sets: DataFrame) -> DataFrame:
    """set, n, copies, key, chunk, grp: every set in the group of the minimal hash that most sets share with it, and its chunk there."""
    keyed = sets.select("set", "n", "copies", F.posexplode(F.array(*LEAST)).alias("k", "v")).select("set", "n", "copies", F.xxhash64("k", "v").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    # a third of all sets may share a key: the sets' side of this join can be split
    chosen = keyed.join(sizes, "key").groupBy("set").agg(
        F.first("n").alias("n"), F.first("copies").alias("copies"), F.max_by("key", F.struct("size", "key")).alias("key")
    )
    chosen = materialise(chosen)
    taken = chosen.groupBy("key").agg(F.count(F.lit(1)).alias("taken"))
    chunk = F.expr(f"pmod(xxhash64(set), 1 + taken div {CHUNK})")
    return materialise(
        chosen.join(taken, "key").select("set", "n", "copies", "key", chunk.alias("chunk")).withColumn("grp", F.xxhash64("key", "chunk"))
    )


class TokenIndex:
    """Tokens of a bounded number of sets, to find those that link with a query."""

    def __init__(self, tokens: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in tokens])
        every = np.concatenate(tokens)
        order = np.argsort(every, kind="stable")
        self.tokens, self.owner = every[order], np.repeat(np.arange(len(tokens)), self.sizes)[order]

    def linked(self, query: np.ndarray) -> np.ndarray:
        """Places of the sets that link with the query."""
        lo, hi = np.searchsorted(self.tokens, query), np.searchsorted(self.tokens, query, side="right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= NEAR * (self.sizes + len(query) - both))


def arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(t.as_py(), dtype=np.uint64) for t in column]


class Meetings:
    """Links that a task found between its sets: all of them, or their counts and as many as connect the same."""

    def __init__(self, table: pa.Table, every: bool):
        self.sets, self.copies = (np.asarray(table.column(c).combine_chunks()) for c in ("set", "copies"))
        self.every, self.n, self.label = every, np.zeros(len(self.sets), dtype=np.int64), np.arange(len(self.sets))
        self.a, self.b = [self.label[:0]], [self.label[:0]]

    def add(self, k: int, others: np.ndarray) -> None:
        self.n[k] += self.copies[others].sum()
        self.n[others] += self.copies[k]
        if not self.every:
            labels = self.label[others]
            new, first = np.unique(labels, return_index=True)
            apart = new != self.label[k]
            self.label[np.isin(self.label, new[apart])] = self.label[k]
            others = others[first[apart]]
        self.a.append(np.full(len(others), k))
        self.b.append(others)

    def table(self) -> pa.Table:
        """set, other of links, and set, null, n of sets that have some."""
        a, b, some = np.concatenate(self.a), np.concatenate(self.b), np.flatnonzero(self.n)
        met = pa.table({"set": self.sets[a], "other": self.sets[b], "n": pa.nulls(len(a), pa.int64())})
        counts = {"set": self.sets[some], "other": pa.nulls(len(some), pa.int64()), "n": self.n[some]}
        return met if self.every else pa.concat_tables([met, pa.table(counts)])


MET = "set long, other long, n long"
INSIDE, QUERY, MEMBER = 0, 1, 2  # roles in a meeting: of a chunk's own sets, and of a query and those that it meets


def apart(rows: DataFrame) -> DataFrame:
    """The postings of tokens that different groups hold, of sets that still have enough for a link into another group."""
    mixed = rows.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("token")
    rows = materialise(rows.join(mixed, "token"))
    enough = rows.groupBy("set").agg(F.count(F.lit(1)).alias("held"), F.first("n").alias("n")).filter(F.col("held") >= F.expr(LEAST_SQL))
    return materialise(rows.join(enough.select("set"), "set", "left_semi"))


def queries(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """set, grp: the chunks that a set may have a link into: of groups after its own by the token-group matrix, and all later chunks
    of its own group, whose sets are similar by choice. Either way only chunks with sets of a fitting size.
    """
    matrix = rows.select("token", F.col("key").alias("other")).distinct()
    chunks = materialise(placed.groupBy("key", "chunk", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi")))
    sizes = chunks.groupBy(F.col("key").alias("other")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    lo, hi = F.greatest("lo", F.col("n") * 0.8), F.least("hi", F.col("n") * 1.25)
    small, large = F.least("n", lo), F.greatest("n", hi)
    into = (
        rows.select("token", "set", "n", "key").join(matrix, "token").filter("key < other")
        .groupBy("set", "n", "other").agg(F.count(F.lit(1)).alias("c")).join(sizes, "other")
        .filter((lo <= hi) & (F.col("c") >= 1 + F.floor(small / EXTRA)) & (F.col("c") * 360 >= small * 160 - large * 110 - 361))
        .select("set", "n", F.col("other").alias("key"), F.lit(-1).cast("long").alias("after"))
    )
    several = chunks.filter("chunk > 0").select("key").distinct()
    own = placed.join(several, "key", "left_semi").select("set", "n", "key", F.col("chunk").alias("after"))
    return into.union(own).join(chunks, "key").filter((F.col("chunk") > F.col("after")) & (lo <= hi)).select("set", "grp")


def places(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """set, copies, grp, block, role: the sets of each meeting. Block -1 of a chunk is the chunk itself, if it has several sets. A chunk's
    queries are dealt into blocks from 0 on; each of these has all members.
    """
    several = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("grp")
    inside = placed.join(several, "grp").select("set", "copies", "grp", F.lit(-1).cast("long").alias("block"), F.lit(INSIDE).alias("role"))
    counts = asked.groupBy("grp").agg((1 + F.floor(F.count(F.lit(1)) / CHUNK)).alias("blocks"))
    block = F.expr("pmod(xxhash64(set), blocks)")
    asking = asked.join(counts, "grp").select("set", "copies", "grp", block.alias("block"), F.lit(QUERY).alias("role"))
    answering = placed.join(counts, "grp").select(
        "set", "copies", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(MEMBER).alias("role")
    )
    return inside.union(asking).union(answering)


def met(rows: DataFrame, every: bool) -> DataFrame:
    """set, other, n: the links of each meeting. ``rows``: of ``places`` with tokens."""

    def work(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role").combine_chunks())
        tokens, found = arrays(table.column("tokens")), Meetings(table, every)
        members = np.flatnonzero(role != QUERY)
        if len(members):
            index = TokenIndex([tokens[k] for k in members])
            for k in np.flatnonzero(role != MEMBER):
                others = members[index.linked(tokens[k])]
                found.add(k, others[others > k] if role[k] == INSIDE else others)
        return found.table()

    return rows.groupBy("grp", "block").applyInArrow(work, MET)


def copies_of(table: DataFrame) -> DataFrame:
    """set, n, copies, least: size, documents and smallest doc_id of every set; and its minimal hashes."""
    return table.filter("set IS NOT NULL").groupBy("set").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in LEAST]
    )


def meetings(docs: DataFrame, table: DataFrame, every: bool) -> DataFrame:
    """set, other, n: see ``Meetings``; every link between different sets is met once. ``table``: of ``copies_of``."""
    shared = shared_postings(docs, table)
    placed = grouped(materialise(table.join(shared.select("set").distinct(), "set", "left_semi")))
    # what is known of a set is joined to its postings once
    rows = materialise(shared.join(placed, "set").select("token", "set", "n", "key"))
    asked = queries(apart(rows), placed).join(placed.select("set", "copies"), "set")
    found = materialise(places(placed, materialise(asked)))
    # each set moves to its copies and, from there, to its meetings: no table of whole sets is written
    return materialise(met(token_sets(docs, found).join(found.hint("merge"), "set"), every))


def links(docs: DataFrame) -> DataFrame:
    """a, b: all pairs of different sets that link, a < b; ``set_table`` has the documents of a set."""
    met = meetings(docs, materialise(copies_of(set_table(docs))), True)
    return met.select(F.least("set", "other").alias("a"), F.greatest("set", "other").alias("b"))


def set_components(docs: DataFrame, table: DataFrame) -> DataFrame:
    """set, n, comp, n_links, least of every set. ``table``: doc_id, n, set of the documents."""
    per_set = materialise(copies_of(table))
    met = meetings(docs, per_set, False)
    comps = components(met.filter("other IS NOT NULL").select(F.col("set").alias("a"), F.col("other").alias("b")))
    counts = met.filter("other IS NULL").groupBy("set").agg(F.sum("n").alias("met"))
    return materialise(
        per_set.join(comps.withColumnRenamed("node", "set"), "set", "left").join(counts, "set", "left").select(
            "set", "n", "least", F.coalesce("comp", "set").alias("comp"), (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links")
        )
    )


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every document."""
    table = materialise(set_table(docs))
    sets = set_components(docs, table)
    names = sets.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = materialise(sets.join(names, "comp").select("set", "component_id", "n_links"))
    # a set with a third of all rows: the rows' side of this join can be split
    some = table.filter("set IS NOT NULL").join(known, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    none = table.filter("set IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")
    )
    return some.union(none)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns as they were: the smallest doc_id stays, any before a null one.

    Rows are told apart by a digest of doc_id and text; of rows that repeat both, one stays. Documents without shingles all stay.
    """
    at = f"key_{uuid.uuid4().hex}"  # a name that no column of the documents can have
    own = [F.coalesce(F.col(c).cast(kind).cast("string"), F.lit("")) for c, kind in (("doc_id", "long"), ("text", "string"))]
    key = F.unhex(F.sha2(F.concat_ws(":", *own), 256))
    table = materialise(set_table(docs, key))
    comps = set_components(docs, table).select("set", "comp")
    rows = table.filter("set IS NOT NULL").join(comps, "set").groupBy("comp", "key").agg(
        F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")
    )
    rows = materialise(rows)
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("best"))
    # a component with a third of all rows: the rows' side of this join can be split
    marks = rows.join(best, "comp").select(F.col("key").alias(at), (F.col("key") == F.col("best")).alias("stays"), "n")
    marks = materialise(marks.filter("NOT stays OR n > 1"))
    left = docs.select("*", key.alias(at)).join(marks.filter("NOT stays").select(at), at, "left_anti")
    repeated, n = counted(marks.filter("stays").select(at))
    if n:
        once = left.join(repeated, at, "left_semi").dropDuplicates([at])
        left = left.join(repeated, at, "left_anti").unionByName(once)
    return left.select(*docs.columns)
