"""N-gram Jaccard join: a grouped prefix join with exact verification, down to connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplematch.llm.common import cut, fresh, gram_hashes, id_text, maybe_member, member_bitmap, own_columns, word_hashes
from triplematch.operators.windows import number_sorted

SKETCH_BITS = 20     # the shingle frequency sketch has 2^20 counters, a fixed size of 4 MB
SKETCH = 1 << SKETCH_BITS
SKETCH_BLOCKS = 64   # ranges of cells that are summed up apart
BINS = 512           # cells of a set's histogram
PARITY = 8           # longs of the parity bitmap of a set

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``.
    A text with fewer words has its whole sequence as one shingle, a text without words none."""
    w = word_hashes(text.encode("utf-8", "replace").translate(_LOWER))
    return np.unique(gram_hashes(w, min(words, len(w)))) if len(w) else w


def _cell(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_classes(rows: DataFrame, words: int) -> np.ndarray:
    """A coarse frequency class for each of SKETCH cells of shingle hashes, counted over all documents.

    Each task adds up one array of SKETCH counters over its rows and sends it in SKETCH_BLOCKS ranges of cells, each
    in the narrowest integers that hold its counts; the ranges are summed up by as many tasks, each streaming one
    range of every input task. The driver receives SKETCH numbers. The classes only order the shingles: rare cells come first in a prefix. Any order gives the same
    links, so cells shared by chance cost time, not results.
    """
    width = SKETCH // SKETCH_BLOCKS

    def ranges(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
            [c.astype(np.min_scalar_type(c.max()).newbyteorder("<")).tobytes() for c in total.values()], pa.binary())],
            ["block", "counts"])

    def counters(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{len(raw) // width}").astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, _cell(shingles(text, words)), 1)
        yield ranges({i: c for i in range(SKETCH_BLOCKS) if (c := total[i * width:(i + 1) * width]).any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[i] = total.get(i, 0) + counters(raw.as_py())
        yield ranges(total)

    parts = rows.select("text").mapInArrow(count, "block int, counts binary")
    counts = np.zeros(SKETCH, np.int64)
    for i, raw in parts.repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect():
        counts[i * width:(i + 1) * width] = counters(raw)
    typical = max(1.0, float(np.median(counts)))
    return np.floor(2 * np.log2(np.maximum(counts / typical, 1))).astype(np.uint8)


def set_table(rows: DataFrame, words: int, percent: int, classes: np.ndarray) -> DataFrame:
    """doc_id, n (set size), digest of the set, prefix tokens in global order, parity bitmap.

    Two sets whose Jaccard similarity reaches ``percent`` share a token among the first
    n - ceil(percent * n / 100) + 1 of either. Bit h of the bitmap is the parity of the set's elements that hash
    to h, so the bits in which two bitmaps differ never outnumber the elements in which the sets differ.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, tokens, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                g = shingles(text, words)
                n = len(g)
                sizes.append(n)
                digests.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                order = np.lexsort((g, classes[_cell(g)]))
                tokens.append(g[order[:n + (-percent * n // 100) + 1 if n else 0]].view(np.int64))
                odd = np.bincount((g & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 _list(tokens), _list(bits)], ["doc_id", "n", "digest", "tokens", "bits"])

    return rows.mapInArrow(run, "doc_id long, n long, digest binary, tokens array<long>, bits array<long>")


def _list(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _near(a: str, b: str, percent: int) -> Column:
    """False where the bitmaps prove that two sets differ in too many elements; true where one bitmap is null."""
    differ = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(PARITY)), F.lit(0))
    return F.coalesce(differ * (100 + percent) <= (F.col(f"{a}n") + F.col(f"{b}n")) * (100 - percent), F.lit(True))


def _fits(a: str, b: str, percent: int) -> Column:
    """Length filter and position filter (what can still be shared from these positions on)."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    least, most = F.least(na, nb), F.greatest(na, nb)
    shared = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (least * 100 >= most * percent) & (shared * (100 + percent) >= (na + nb) * percent)


def _renamed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns))


def verify(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole texts reach the similarity. Only texts of documents in a pair are
    shuffled: the others fall to a bitmap of fixed size in the scan.

    Before texts meet, pairs meet on histograms of their sets (BINS counts, 1 KB): the sum of the differences of
    two histograms never exceeds the number of elements in which the sets differ. For long documents that is a
    far sharper bound than the parities, and it spares them the shuffle of their texts.
    """
    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            bins = [np.minimum(np.bincount((g & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 65535) for g in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(g) for g in sets], pa.int64()),
                 pa.array([b.astype("<u2").tobytes() for b in bins], pa.binary())], ["id", "n", "bins"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                differ = np.abs(np.frombuffer(x, "<u2").astype(np.int64) - np.frombuffer(y, "<u2")).sum()
                ok.append(bool((100 + percent) * differ <= (100 - percent) * (n + m)))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    def among(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        return maybe_member(rows, "doc_id", member_bitmap(ids, "id"), how="keep").select("doc_id", "text")

    shape = cut(among(pairs).mapInArrow(histograms, "id long, n long, bins binary"))
    pairs = cut(pairs.join(shape.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bins").alias("ba")), "a")
                .join(shape.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bins").alias("bb")), "b")
                .select("a", "b", "na", "nb", "ba", "bb").mapInArrow(close, "a long, b long").distinct())
    texts = among(pairs)
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, last, held = [], None, None
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tb != last:
                    last, held = tb, shingles(tb, words)
                x = shingles(ta, words)
                common = len(np.intersect1d(x, held, assume_unique=True))
                ok.append(common > 0 and 100 * common >= percent * (len(x) + len(held) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id reachable over ``links`` (a, b), for every id in a link.

    Each round takes the smallest label among the neighbours and then follows labels of labels, so paths halve;
    rounds end when no label changes. Every round is checkpointed; only the number of changes returns.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        heard = (edges.join(labels.select(F.col("id").alias("b"), "label"), "b")
                 .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard")))
        lower = labels.join(heard, "id", "left").select(
            "id", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("old"))
        onward = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(lower.join(onward, "label", "left").select(
            "id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links).

    Documents link when the Jaccard similarity of their sets of distinct ``words``-word shingles is at least
    ``percent`` percent; a document without words links with nothing.

    1. Documents with equal sets collapse into one class, classes with equal size and prefix into one group.
    2. Groups meet on prefix tokens that occur more than once. First every group meets one group per token, the
       one with the most shared tokens (as a rule the original of its copies), and every member its group's
       first: a number of pairs linear in the tokens. Verified links give provisional components.
    3. Then all pairs of groups that share a token and are not yet of one component pass the length, position
       and bitmap filters; survivors expand to members of different components, which are verified. A link left
       out at 2. either joins two documents that are connected already or is found here, so components are exact,
       and a group of near copies is never expanded into all its pairs.

    Prefixes and bitmaps stay with the row that stands for its group: classes and groups are found on digests and
    hashes, the prefixes of other rows are left out in the scan, and only tokens that groups share are shuffled with
    their group. Bitmaps of sets join the postings for step 3 only.

    Nothing is capped: frequent tokens are only ordered last. Null texts count as empty. Rows without a doc_id are
    left out; rows that repeat a doc_id are one document in the graph, with the links of each. An empty table
    gives no rows.
    """
    rows = id_text(docs)
    table = cut(set_table(rows, words, percent, frequency_classes(rows, words)).withColumn("rid", F.monotonically_increasing_id()))
    stands = F.min(F.struct("doc_id", "rid", "bits", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2")))
    classes = cut(table.filter("n > 0").groupBy("digest", "n").agg(stands.alias("r"))
                  .select("digest", "n", F.col("r.doc_id").alias("id"), "r.rid", "r.bits", "r.k1", "r.k2"))
    groups = (classes.groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "rid")).alias("g"), F.count(F.lit(1)).alias("members"))
              .select("n", "k1", "k2", F.col("g.id").alias("gid"), F.col("g.rid").alias("first"), "members"))
    member = cut(classes.select("id", "rid", "n", "k1", "k2", "bits").join(groups, ["n", "k1", "k2"])
                 .select("id", "gid", "members", "n", "bits", (F.col("rid") == F.col("first")).alias("heads"), "rid"))

    # postings of the groups: tokens that more than one group has
    heads = member.filter("heads").select("rid", "gid", "n")
    key = F.xxhash64("rid").alias("key")
    firsts = maybe_member(table.filter("n > 0").select("rid", "tokens", key), "key", member_bitmap(heads.select(key), "key"), how="keep")
    common = firsts.select(F.explode("tokens").alias("token")).groupBy("token").count().filter("count > 1")
    posted = maybe_member(firsts.select("rid", F.posexplode("tokens").alias("pos", "token")), "token",
                          member_bitmap(common, "token"), how="keep")
    postings = cut(posted.join(heads, "rid").select(
        "token", "gid", "n", "pos", F.count(F.lit(1)).over(Window.partitionBy("rid")).alias("shared")))

    # one hub per token, and the first member of each group
    hubs = postings.groupBy("token").agg(F.max(F.struct("shared", (-F.col("gid")).alias("neg"), "n", "pos")).alias("h"),
                                       F.count(F.lit(1)).alias("c")).filter("c > 1")
    hubs = hubs.select("token", (-F.col("h.neg")).alias("h_gid"), F.col("h.n").alias("h_n"), F.col("h.pos").alias("h_pos"))
    star = (_renamed(postings, "g_", ("token",)).join(hubs, "token").filter(F.col("g_gid") != F.col("h_gid"))
            .filter(_fits("g_", "h_", percent)).select(F.col("g_gid").alias("x"), F.col("h_gid").alias("y")).distinct())
    inside = member.filter("members > 1 AND id <> gid").select(F.col("id").alias("x"), F.col("gid").alias("y"))
    bits = member.select("id", "n", "bits")
    star = (star.union(inside).join(_renamed(bits, "x_").withColumnRenamed("x_id", "x"), "x")
            .join(_renamed(bits, "y_").withColumnRenamed("y_id", "y"), "y").filter(_near("x_", "y_", percent))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    first_links = cut(verify(cut(star), rows, words, percent))
    provisional = components(first_links)

    # everything that is not connected yet
    labelled = cut(member.join(provisional, "id", "left").withColumn("label", F.coalesce("label", "id")))
    spans = labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                        F.when(F.count(F.lit(1)) == 1, F.max("bits")).alias("bits"))
    spanned = cut(postings.join(spans, "gid").select("token", "gid", "n", "bits", "pos", "low", "high"))
    left, right = _renamed(spanned, "x_", ("token",)), _renamed(spanned, "y_", ("token",))
    one = (F.col("x_low") == F.col("x_high")) & (F.col("y_low") == F.col("y_high")) & (F.col("x_low") == F.col("y_low"))
    met = (left.join(right, (left["token"] == right["token"]) & (F.col("x_gid") < F.col("y_gid")) & ~one
                     & _fits("x_", "y_", percent) & _near("x_", "y_", percent)).select("x_gid", "y_gid").distinct())
    own = spans.filter("low <> high").select(F.col("gid").alias("x_gid"), F.col("gid").alias("y_gid"))
    parts = labelled.select("id", "gid", "n", "bits", "label")
    rest = (met.union(own).join(_renamed(parts, "x_"), "x_gid").join(
                _renamed(parts, "y_").withColumnRenamed("y_gid", "yg"),
                (F.col("y_gid") == F.col("yg")) & (F.col("x_label") != F.col("y_label"))
                & ((F.col("x_gid") != F.col("y_gid")) | (F.col("x_id") < F.col("y_id"))) & _near("x_", "y_", percent))
            .select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct())
    last_links = cut(verify(cut(rest), rows, words, percent))
    labels = components(first_links.union(last_links))

    class_label = classes.select("digest", "n", "id").join(labels, "id", "left").select(
        "digest", "n", F.coalesce("label", "id").alias("component_id"))
    found = table.filter("n > 0").select("doc_id", "n", "digest").join(cut(class_label), ["digest", "n"])
    empty = table.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def _parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose doc_id is not among ``ids`` (doc_id), and those whose is; all columns. Only rows that
    the bitmap of ``ids`` holds back are shuffled: the rest is told apart in the scan."""
    own = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.struct(*own_columns(docs)).alias("row"))
    ids = ids.select(F.col("doc_id").cast("long").alias("id"))
    flagged = maybe_member(own, "id", member_bitmap(ids, "id"))
    held = flagged.filter("_maybe")
    clear = flagged.filter("NOT _maybe").select("row.*")
    return clear.union(held.join(ids, "id", "left_anti").select("row.*")), held.join(ids, "id", "left_semi").select("row.*")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns kept (the
    pipeline's stage). Rows without a doc_id go.

    Different texts under one doc_id are documents of their own: each but the first (by digest) joins the graph under
    a number beyond all ids. Rows that repeat doc_id and text are reduced to the first by the digest of their columns.
    Rows are shuffled only where they may go or share their doc_id.
    """
    repeated = cut(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if repeated.isEmpty():
        gone = cut(jaccard_components(docs, words, percent).filter("doc_id <> component_id").select("doc_id"))
        return _parted(docs, gone)[0]
    sha, node = fresh(docs, "_sha"), fresh(docs, "_node")
    single, several = _parted(docs, repeated)
    keyed = several.withColumn(sha, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    texts = keyed.select("doc_id", sha).distinct()
    firsts = texts.groupBy("doc_id").agg(F.min(sha).alias(sha))
    others = texts.join(firsts, ["doc_id", sha], "left_anti").withColumn("_order", F.concat_ws(" ", sha, "doc_id"))
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    others = cut(number_sorted(cut(others), "_order", "_n").select("doc_id", sha, (F.col("_n") + 1 + F.lit(top)).alias(node)))
    named = keyed.join(others, ["doc_id", sha], "left").withColumn(node, F.coalesce(node, F.col("doc_id").cast("long")))
    every = single.select(F.col("doc_id").cast("long").alias("doc_id"), "text").union(named.select(F.col(node).alias("doc_id"), "text"))
    found = jaccard_components(every, words, percent).withColumnRenamed("doc_id", node)
    own = found.join(others.select(node, F.col("doc_id").alias("_own")), node, "left")
    stay = cut(own.groupBy("component_id").agg(F.min(F.struct(F.coalesce("_own", node).alias("id"), F.col(node))).alias("least"))
               .select(F.col(f"least.{node}").alias(node)))
    kept = named.join(stay, node, "left_semi")
    gone = cut(found.select(F.col(node).alias("doc_id")).join(stay.select(F.col(node).alias("doc_id")), "doc_id", "left_anti").distinct())
    rest = [x for c, x in zip(docs.columns, own_columns(docs)) if c not in ("doc_id", "text")]
    order = F.sha2(F.to_json(F.struct(*rest)), 256) if rest else F.lit("")
    return _parted(single, gone)[0].union(
        kept.groupBy(node).agg(F.min_by(F.struct(*own_columns(docs)), order).alias("_row")).select("_row.*").select(*own_columns(docs)))
