"""Conversation prefix trie: a z-fast trie over conversations, kept as tables of compacted nodes.

A prefix of d turns is named by ``(d, k1, k2)``, where k1 and k2 are XORs of 64-bit hashes of (position, role, text):
128 bits that two blocks of one conversation can compute apart. A compacted node stands for the depths (up, e]; its
handle is the prefix of the two-fattest depth in there. Conversations come in as turns narrowed to hashes, so texts are
read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplematch.llm.common import CRC_TABLE_SQL, crc32_sql, sorted_runs, store

BLOCK_BITS = 12     # turns of a conversation are summed up in blocks of 2^12
SALTS = 16          # copies of the unique side of a lookup whose other side may hold one key in a third of its rows
BATCHES = 3         # batches of inserts, each four times the one before
CHUNK = 8192        # members whose ids are joined before they are sent on to be digested
ID = ("e", "k1", "k2")


def _blk(d: Column) -> Column:
    return F.shiftright(d, BLOCK_BITS)


def _by_block(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row of ``df`` per block of depths that [first, last] touches; none if it is empty."""
    return df.filter(first <= last).withColumn("blk", F.explode(F.sequence(_blk(first), _blk(last))))


def _lookup(left: DataFrame, right: DataFrame, on: list[str], by: str, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, whose ``on`` is unique. Hot keys of the left spread over SALTS tasks."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(SALTS)).cast("int")).join(
        salted, [*on, "_salt"], how).drop("_salt")


def _before(df: DataFrame, part: list[str], order: str, out: str) -> DataFrame:
    """``df`` with the next smaller ``order`` of its ``part`` (null: none), block by block of the order."""
    d = df.withColumn("blk", _blk(F.col(order)))
    last = d.groupBy(*part, "blk").agg(F.max(order).alias("_last"))
    carry = last.select(*part, "blk", F.lag("_last").over(Window.partitionBy(*part).orderBy("blk")).alias("_carry"))
    d = d.withColumn("_lag", F.lag(order).over(Window.partitionBy(*part, "blk").orderBy(order)))
    return d.join(carry, [*part, "blk"]).withColumn(out, F.coalesce("_lag", "_carry")).drop("blk", "_lag", "_carry")


def fattest(a: Column, b: Column) -> Column:
    """The two-fattest number of (a, b], null if that is empty: the one that the highest power of two divides."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(a.bitwiseXOR(b).cast("double")))).cast("long")
    return F.when(a < b, b.bitwiseAND(-top))


# ---------------------------------------------------------------- conversations to prefixes


def rebuild(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (c), turns (c, d, h1, h2, words)) after the rule of shared beginnings.

    Conversation c takes the first h turns of conversation c - c % 20 (``%`` keeps the sign of c), h the crc32 of c in
    decimals modulo 4, then its own turns after its first h. Turns are ordered by turn, null first, then by role and by a
    hash of role and text, so rows that repeat are turns of their own. Null roles and texts are empty.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).filter(F.col("c").isNotNull())
    runs = sorted_runs(rows, [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")], "turns")
    part = runs.groupBy("c", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    earlier = F.sum("n").over(Window.partitionBy("c").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    part = part.withColumn("_earlier", F.coalesce(earlier, F.lit(0)))
    sizes = part.groupBy("c").agg(F.sum("n").alias("n"))
    convs = sizes.select("c", "n", (F.crc32(F.col("c").cast("string").cast("binary")) % 4).alias("h"),
                         (F.col("c") - F.col("c") % 20).alias("base"))
    convs = convs.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("n_base")), "base", "left").select(
        "c", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    at = (F.col("_at") - F.col("_first") + F.col("_earlier") + 1).alias("p")
    placed = runs.join(part.drop("n").join(convs, "c"), ["c", "_run"]).select("c", at, "h", "taken", "h1", "h2", "words")
    own = placed.filter(F.col("p") > F.col("h")).select(
        "c", (F.col("p") - F.col("h") + F.col("taken")).alias("d"), "h1", "h2", "words")
    heads = placed.filter((F.col("c") % 20 == 0) & (F.col("p") <= 3)).select(
        F.col("c").alias("base"), F.col("p").alias("d"), "h1", "h2", "words")
    shared = heads.join(convs.select("c", "base", "taken"), "base").filter(F.col("d") <= F.col("taken")).select(*own.columns)
    return convs.select("c"), own.unionByName(shared)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, d, blk, k1, k2, p1, p2, w, w0): every prefix's key, its parent's key, words up to it and before its last turn.

    Blocks are summed up apart and offset by the blocks before them, so a conversation of any length spreads.
    """
    t = turns.select("c", "d", _blk(F.col("d")).alias("blk"), F.xxhash64("d", "h1", F.lit(11)).alias("t1"),
                     F.xxhash64("d", "h2", F.lit(12)).alias("t2"), "words")
    inside = Window.partitionBy("c", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    per = t.groupBy("c", "blk").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("words").alias("xw"))
    per = per.select("c", "blk", *[F.coalesce(f(x).over(earlier), F.lit(0).cast("long")).alias(o)
                                   for f, x, o in ((F.bit_xor, "x1", "o1"), (F.bit_xor, "x2", "o2"), (F.sum, "xw", "ow"))])
    t = t.select("*", F.bit_xor("t1").over(inside).alias("i1"), F.bit_xor("t2").over(inside).alias("i2"),
                 F.sum("words").over(inside).alias("iw")).join(per, ["c", "blk"])
    k1, k2, w = F.col("i1").bitwiseXOR(F.col("o1")), F.col("i2").bitwiseXOR(F.col("o2")), F.col("iw") + F.col("ow")
    return t.select("c", "d", "blk", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("t1")).alias("p1"),
                    k2.bitwiseXOR(F.col("t2")).alias("p2"), w.alias("w"), (w - F.col("words")).alias("w0"))


def member_digests(ends: DataFrame) -> DataFrame:
    """(e, k1, k2, sha): SHA-256 of the ids of the conversations that end at a prefix, ascending, comma-joined.

    Ids are sorted in ranges and joined to chunks there; a digest then reads its node's chunks in order as a stream, so
    a node where a third of all conversations end holds one chunk at a time.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, ids):
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*key, ids[0])]
                                              + [pa.array([",".join(map(str, ids))])], [*ID, "first", "part"])
        key, ids, out = None, [], []
        for batch in batches:
            for e, k1, k2, c in zip(*(col.to_pylist() for col in batch.columns)):
                if (e, k1, k2) != key or len(ids) >= CHUNK:
                    if ids:
                        out.append(row(key, ids))
                    key, ids = (e, k1, k2), []
                ids.append(c)
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out = []
        if ids:
            yield row(key, ids)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []

        def flush():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3])], [*ID, "sha"])
        for batch in batches:
            for e, k1, k2, _, part in zip(*(col.to_pylist() for col in batch.columns)):
                if (e, k1, k2) != key:
                    if sha:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (e, k1, k2), hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
            if out:
                yield flush()
                out = []
        if sha:
            out.append((*key, sha.hexdigest()))
            yield flush()

    ordered = [*ID, "c"]
    parts = ends.select(*ordered).repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(
        chunks, "e long, k1 long, k2 long, first long, part string")
    return parts.repartition(*ID).sortWithinPartitions(*ID, "first").mapInArrow(digest, "e long, k1 long, k2 long, sha string")


# ---------------------------------------------------------------- the trie


def dictionary(nodes: DataFrame, paths: DataFrame, depth: Column) -> DataFrame:
    """Nodes keyed by their prefix (f, k1, k2) of a depth in (up, e], with n_fw, the words up to it, and the node's columns."""
    n = nodes.select("rep", depth.alias("f"), F.col("e").alias("n_e"), F.col("k1").alias("n_x1"), F.col("k2").alias("n_x2"),
                     F.col("up").alias("n_up"))
    keys = paths.select(F.col("c").alias("rep"), F.col("d").alias("f"), "k1", "k2", F.col("w").alias("n_fw"))
    return n.join(keys, ["rep", "f"]).withColumnRenamed("rep", "n_rep")


def locate(seqs: DataFrame, paths: DataFrame, own: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Exit node and depth ``ell`` at which each sequence leaves the trie, with the key there.

    A fat binary search: the interval (a, b] starts as (0, length]; the prefix of its two-fattest depth is looked up among
    the handles; a hit moves a to the end of that node, a miss moves b below the depth. Each round halves what is left,
    so ``rounds`` = log2 of the longest sequence. It ends at the exit node or at its parent, since the exit node's handle
    may lie beyond the sequence; one lookup among the nodes' first prefixes steps down to such a child. The depth
    within the exit node's edge follows by comparing the sequence's keys with those of the edge.
    """
    table = store(dictionary(nodes, paths, fattest(F.col("up"), F.col("e"))), "handles")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    node = ("e", "x1", "x2", "up", "rep", "fw")
    state = seqs.select("c", "len", zero.alias("a"), F.col("len").alias("b"), zero.alias("e"), zero.alias("x1"), zero.alias("x2"),
                        none.alias("up"), none.alias("rep"), zero.alias("fw"), zero.alias("at"), zero.alias("a1"), zero.alias("a2"))
    hit = F.col("n_e").isNotNull()
    found = {**{c: F.col(f"n_{c}") for c in node}, "at": F.col("f"), "a1": F.col("k1"), "a2": F.col("k2")}
    moved = [F.when(hit, v).otherwise(F.col(c)).alias(c) for c, v in found.items()]
    keys = own.select("c", F.col("d").alias("f"), "k1", "k2")
    for _ in range(rounds):
        probe = state.withColumn("f", fattest(F.col("a"), F.col("b"))).join(keys, ["c", "f"], "left")
        probe = _lookup(probe, table, ["f", "k1", "k2"], "c")
        state = store(probe.select("c", "len", F.when(hit, F.col("n_e")).otherwise(F.col("a")).alias("a"), *moved,
                                   F.when(hit | F.col("f").isNull(), F.col("b")).otherwise(F.col("f") - 1).alias("b")), "search")
    down = state.withColumn("f", F.col("e") + 1).join(keys, ["c", "f"], "left")
    down = _lookup(down, dictionary(nodes, paths, F.col("up") + 1), ["f", "k1", "k2"], "c")
    state = store(down.select("c", "len", *moved), "search")
    edges = state.filter(F.col("at") < F.col("e")).select("rep", "at", "e").distinct()
    edges = _by_block(edges, F.col("at") + 1, F.col("e")).withColumnRenamed("rep", "c")
    edge_keys = paths.join(edges, ["c", "blk"]).filter(F.col("d").between(F.col("at") + 1, F.col("e"))).select("d", "k1", "k2")
    rest = state.select("c", "at", F.least("e", "len").alias("to"))
    rest = own.join(_by_block(rest, F.col("at") + 1, F.col("to")), ["c", "blk"]).filter(
        F.col("d").between(F.col("at") + 1, F.col("to"))).select("c", "d", "k1", "k2", "w")
    along = _lookup(rest, edge_keys.distinct(), ["d", "k1", "k2"], "c", "inner").groupBy("c").agg(
        F.max(F.struct("d", "k1", "k2", "w")).alias("m"))
    pick = {"ell": ("d", "at"), "l1": ("k1", "a1"), "l2": ("k2", "a2"), "lw": ("w", "fw")}
    return state.join(along, "c", "left").select(
        "c", "len", "e", "x1", "x2", "up", "rep", *[F.coalesce(F.col(f"m.{m}"), F.col(s)).alias(o) for o, (m, s) in pick.items()])


NODE = ("e", "k1", "k2", "up", "rep", "w")


def insert(seqs: DataFrame, paths: DataFrame, own: DataFrame, nodes: DataFrame | None, rounds: int) -> DataFrame:
    """The nodes (e, k1, k2, up, rep, w) after a batch of sequences (c, len) came in.

    Only what lies beyond each sequence's exit is grouped: its prefixes, once per distinct one. Those that branch or
    end become nodes; exits inside an edge split it.
    """
    if nodes is None:
        spots = seqs.withColumn("ell", F.lit(0).cast("long"))
    else:
        spots = store(locate(seqs, paths, own, nodes, rounds), "exits")
    beyond = own.join(_by_block(spots.select("c", "len", "ell"), F.col("ell") + 1, F.col("len")), ["c", "blk"]).filter("d > ell")
    fresh = store(beyond.groupBy("d", "k1", "k2").agg(
        F.min("c").alias("rep"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("w").alias("w"),
        F.max((F.col("d") == F.col("len")).cast("int")).alias("ends")), "fresh")
    kids = fresh.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("kids"))
    # The smallest sequence of a prefix is that of a whole tail of its path, so a node's ancestor is the node before it on
    # that tail, or the parent of the tail's first prefix: that one branches, or ends, or is an exit.
    made = fresh.join(kids, ["d", "k1", "k2"], "left").filter((F.col("ends") == 1) | (F.col("kids") > 1))
    tails = fresh.groupBy("rep").agg((F.min("d") - 1).alias("top"))
    made = _before(made, ["rep"], "d", "prev").join(tails, "rep").select(
        F.col("d").alias("e"), "k1", "k2", F.coalesce("prev", "top").alias("up"), "rep", "w")
    if nodes is None:
        return store(made.select(*NODE), "nodes")
    cuts = spots.filter(F.col("ell") < F.col("e")).groupBy("e", "x1", "x2", "up", "rep", "ell").agg(
        F.min("l1").alias("l1"), F.min("l2").alias("l2"), F.min("lw").alias("lw"))
    ends = cuts.select("e", "x1", "x2", "up", "rep", F.col("e").alias("ell"), F.col("x1").alias("l1"), F.col("x2").alias("l2"),
                       F.lit(None).cast("long").alias("lw")).distinct()
    split = store(_before(cuts.unionByName(ends), ["e", "x1", "x2"], "ell", "prev").withColumn(
        "up", F.coalesce("prev", "up")), "splits")
    parts = split.filter(F.col("ell") < F.col("e")).select(F.col("ell").alias("e"), F.col("l1").alias("k1"), F.col("l2").alias("k2"),
                                                          "up", "rep", F.col("lw").alias("w"))
    lower = split.filter(F.col("ell") == F.col("e")).select("e", F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.col("up").alias("new_up"))
    old = nodes.join(lower, list(ID), "left").withColumn("up", F.coalesce("new_up", "up"))
    return store(old.select(*NODE).unionByName(parts.select(*NODE)).unionByName(made.select(*NODE)), "nodes")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """id, parent and (n, leaves, a, b, mc) of nodes, summed over their subtrees, by pointer doubling.

    Before round r a node holds the sums of its descendants at distance under 2^r, and points to its ancestor at distance
    2^r. So the rounds grow with the logarithm of the depth, and a node with many children is summed up map-side.
    """
    state = store(nodes.withColumn("jump", F.col("parent")), "sums")
    sums = ["n", "leaves", "a", "b"]
    while not state.filter(F.col("jump").isNotNull()).isEmpty():
        add = state.filter(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("id")).agg(
            *[F.sum(s).alias(f"_{s}") for s in sums], F.min("mc").alias("_mc"))
        hop = state.filter(F.col("jump").isNotNull()).select(F.col("id").alias("jump"), F.col("jump").alias("_jump"))
        hop = hop.join(add.select(F.col("id").alias("jump")), "jump", "left_semi")    # inner nodes alone
        state = store(_lookup(state.join(add, "id", "left"), hop, ["jump"], "id").select(
            "id", "parent", "rep", "w", "w_up", F.col("_jump").alias("jump"), "kids", "m",
            *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums], F.least("mc", "_mc").alias("mc")), "sums")
    return state


def trie(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations (see :func:`rebuild`), the root included: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows whose conv_id is null take no part; null roles and texts are empty; conversations may have any number of
    turns, repeated ones too; equal conversations are inserted once and counted. An empty table gives no rows, not even a
    root. Extra columns change nothing.
    """
    convs, turns = rebuild(conversations)
    pre = store(prefixes(turns), "prefixes")
    tips = pre.groupBy("c").agg(F.max(F.struct("d", "k1", "k2", "w")).alias("m"))
    zero = F.lit(0).cast("long")
    ends = store(convs.join(tips, "c", "left").select("c", F.coalesce("m.d", zero).alias("e"), F.coalesce("m.k1", zero).alias("k1"),
                                                      F.coalesce("m.k2", zero).alias("k2")), "ends")
    slots = (4 ** batches - 1) // 3
    slot = F.pmod(F.xxhash64("rep", F.lit(77)), F.lit(slots))
    batch = sum(((slot >= (4 ** i - 1) // 3).cast("int") for i in range(1, batches)), F.lit(0))
    groups = store(ends.groupBy(*ID).agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("m")).withColumn("batch", batch), "groups")
    seqs = groups.filter("e > 0").select(F.col("rep").alias("c"), F.col("e").alias("len"), "batch")
    paths = store(pre.join(_by_block(seqs, F.lit(1).cast("long"), F.col("len")).select("c", "blk", "batch"), ["c", "blk"]), "paths")
    longest = seqs.agg(F.max("len")).first()[0] or 0
    nodes = None
    for i in range(batches):
        mine = seqs.filter(F.col("batch") == i)
        if longest and not mine.isEmpty():
            nodes = insert(mine.drop("batch"), paths, paths.filter(F.col("batch") == i), nodes, longest.bit_length())
    return expand(nodes, paths, groups, ends)


def expand(nodes: DataFrame | None, paths: DataFrame, groups: DataFrame, ends: DataFrame) -> DataFrame:
    """The compacted nodes' subtree sums, and their edges as one row per depth."""
    spark = ends.sparkSession
    root = ends.select(*[F.lit(0).cast("long").alias(c) for c in ID], F.lit(None).cast("long").alias("up"),
                       F.lit(None).cast("long").alias("rep"), F.lit(0).cast("long").alias("w")).limit(1)
    if nodes is None:
        nodes = spark.createDataFrame([], root.schema)
    above = paths.select(F.col("c").alias("rep"), F.col("d").alias("up"), F.col("k1").alias("u1"), F.col("k2").alias("u2"),
                         F.col("w").alias("w_up"))
    zero = F.lit(0).cast("long")

    def name(*cols: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(cols, ID)])

    nodes = nodes.join(above, ["rep", "up"], "left").withColumn("parent", name(F.col("up"), F.coalesce("u1", zero), F.coalesce("u2", zero)))
    nodes = nodes.drop("u1", "u2").unionByName(root.withColumn("w_up", zero).withColumn(
        "parent", F.lit(None).cast("struct<e: bigint, k1: bigint, k2: bigint>")))
    nodes = nodes.join(groups.select(*ID, F.col("rep").alias("mc"), "m"), list(ID), "left").select(
        name(*map(F.col, ID)).alias("id"), "parent", "rep", "w", F.coalesce("w_up", zero).alias("w_up"), "mc",
        F.coalesce("m", zero).alias("m"))
    kids = nodes.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", zero))
    # saved_tokens of a prefix = words of its members from its last turn on, less those of its distinct prefixes.
    summed = subtree_sums(nodes.select("*", F.col("m").alias("n"), (F.col("kids") == 0).cast("long").alias("leaves"),
                                       (F.col("m") * F.col("w")).alias("a"), (F.col("w") - F.col("w_up")).alias("b")))
    owners = summed.filter("kids > 0").select(F.col("id").alias("parent"), F.col("mc").alias("parent_mc"))
    summed = _lookup(summed, owners, ["parent"], "id")
    shas = member_digests(ends).select(name(*map(F.col, ID)).alias("id"), "sha")
    summed = store(summed.join(shas, "id", "left"), "summed")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = summed.filter(F.col("parent").isNull()).select(
        F.col("mc").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("a") - F.col("b")).alias("saved_tokens"),
        F.coalesce("sha", none).alias("ends_sha256"))
    edge = _by_block(summed.filter(F.col("parent").isNotNull()).withColumn("low", F.col("parent.e") + 1),
                     F.col("low"), F.col("id.e")).withColumnRenamed("rep", "c")
    rows = paths.select("c", "blk", "d", "w0").join(edge, ["c", "blk"]).filter(F.col("d").between(F.col("low"), F.col("id.e")))
    last = F.col("d") == F.col("id.e")
    rows = rows.select(
        F.col("mc").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("low"), F.col("parent_mc")).otherwise(F.col("mc")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("a") - F.col("n") * F.col("w0") - F.col("b") - F.col("w_up") + F.col("w0")).alias("saved_tokens"),
        F.when(last, F.coalesce("sha", none)).otherwise(none).alias("ends_sha256"))
    return rows.unionByName(top).select(*out)


_WORDS = r"len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))"
ORACLE = f"""
WITH {CRC_TABLE_SQL},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql('conv_id::VARCHAR')} % 4 AS h, conv_id - conv_id % 20 AS base
      FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT c.conv_id, 0 AS own, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
      UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
o AS (SELECT conv_id, {_WORDS} AS words, sha256(role) || sha256(text) AS k,
             row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d FROM r),
path AS (SELECT conv_id, d, words, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM o
         UNION ALL SELECT conv_id, 0, 0, '' FROM c),
step AS (SELECT *, lag(k) OVER w AS pk, max(d) OVER (PARTITION BY conv_id) AS len FROM path WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
node AS (SELECT d, k, min(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
                coalesce(string_agg(CASE WHEN d = len THEN conv_id END::VARCHAR, ',' ORDER BY conv_id), '') AS ended
         FROM step GROUP BY d, k),
kid AS (SELECT d - 1 AS d, pk AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY ALL),
sub AS (SELECT a.d, a.k, sum((n.n - 1) * n.words)::BIGINT AS saved, count(*) FILTER (WHERE kid.kids IS NULL) AS leaves
        FROM node n LEFT JOIN kid USING (d, k) JOIN path a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM node n JOIN sub USING (d, k) LEFT JOIN kid USING (d, k) LEFT JOIN node p ON p.d = n.d - 1 AND p.k = n.pk
"""
