"""Substring dedup over a compacted De Bruijn graph of word k-mers, with source coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import bitmap_array, id_text, is_member, maybe_member, member_bitmap, mix64, powers, store, word_hashes, word_spans

_MUL = 0x9FB21C651E98DF25
_PRIME = (1 << 31) - 1
_BASE = 1_000_003
_MODULAR: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _modular_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime, at least n of them; the last size asked for is kept."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _MODULAR:
        def series(x: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            have = 1
            while have < size:                        # x^(i + have) = x^i * x^have
                out[have:2 * have] = out[:have] * np.uint64(pow(x, have, _PRIME)) % np.uint64(_PRIME)
                have *= 2
            return out
        _MODULAR.clear()
        _MODULAR[size] = (series(_BASE), series(pow(_BASE, -1, _PRIME)))
    return _MODULAR[size]


def word_proofs(raw: bytes) -> np.ndarray:
    """A second hash per word: its bytes as a polynomial over the field of a prime, where ``word_hashes`` has one over the
    integers modulo 2^64. The two share neither modulus nor base. Linear in the text."""
    b, s, e = word_spans(raw)
    if not len(s):
        return np.zeros(0, np.uint64)
    p, q = _modular_powers(len(b) + 1)
    m = np.uint64(_PRIME)
    acc = np.zeros(len(b) + 1, np.uint64)
    terms = (b.astype(np.uint64) + np.uint64(1)) * p[:len(b)]          # below 2^39, so 2^24 of them add up in 64 bits
    np.cumsum(terms % m if len(b) > 1 << 24 else terms, out=acc[1:])
    h = (acc[e] - acc[s]) % m * q[s] % m
    return mix64(h ^ ((e - s).astype(np.uint64) << np.uint64(32)))


def span_hashes(words: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """One 64-bit hash of each span of ``size`` word hashes from ``start`` on, by prefix sums."""
    p, q = powers(len(words) + 1)
    acc = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[:len(words)], out=acc[1:])
    h = (acc[start + size] - acc[start]) * q[start]
    return mix64(h ^ np.atleast_1d(np.asarray(size, np.uint64)) * np.uint64(_MUL))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes (unmixed) of every run of n word hashes, by doubling: O(log n) passes."""
    def join(left: np.ndarray, a: int, right: np.ndarray, b: int) -> np.ndarray:
        count = max(0, min(len(left), len(right) - a))
        return left[:count] * np.uint64(pow(_MUL, b, 1 << 64)) + right[a:a + count]

    out, have, power, size = None, 0, words, 1
    while size <= n:
        if n & size:
            out, have = (power, size) if out is None else (join(out, have, power, size), have + size)
        power, size = join(power, size, power, size), 2 * size
    return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def paths(words: np.ndarray, k: int, core: int) -> tuple[np.ndarray, ...]:
    """The k-mer walk of one document, compacted: (first k-mer of each path, number of k-mers, its core, whether the
    core's run occurs twice in the document).

    A k-mer is an edge between its two (k-1)-mers. Its core is the smallest hash among its runs of ``core`` words.
    Consecutive k-mers of one core form a path: equal k-mers have equal cores, so every repeat of a path's k-mer
    lies in a path of the same core, whatever surrounds it. A path can hold a k-mer twice only if its core's run
    occurs twice.
    """
    if len(words) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.astype(bool)
    runs = mix64(_runs(words, core) ^ np.uint64(0x2545F4914F6CDD1D))
    least = _window_min(runs, k - core + 1)
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    runs = np.sort(runs)
    again = runs[1:][runs[1:] == runs[:-1]]
    twice = np.isin(least[start], again) if len(again) else np.zeros(len(start), bool)
    return start, np.diff(start, append=len(words) - k + 1), least[start], twice


def core_counts(rows: DataFrame, k: int, core: int) -> DataFrame:
    """(core, n): counted per batch first, then map-side, then by a shuffle of two numbers per core and task. A core
    whose run occurs twice in a document counts as two there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.concatenate((w[2], w[2][w[3]])) for w in
                     (paths(word_hashes(t.encode("utf-8", "replace")), k, core) for t in batch.column(0).to_pylist())]
            u, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["core", "n"])

    return rows.select("text").mapInArrow(run, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))


def path_rows(rows: DataFrame, k: int, core: int, with_kmers: bool = False, keep: np.ndarray | None = None) -> DataFrame:
    """One row per path of (doc_id, row, text): doc_id, row, start, core, size, path and proof (64-bit hashes of its words,
    by the two hashes of a word), twice (it may hold a k-mer twice); or doc_id, row, start, core, kmers, proofs.

    With ``keep``, a bitmap of cores, paths whose core is certainly not among them are left out before they are hashed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "replace")
                words = word_hashes(raw)
                start, size, least, twice = paths(words, k, core)
                if keep is not None and len(start):
                    start, size, least, twice = (x[hits] for hits in [is_member(keep, least)] for x in (start, size, least, twice))
                if not len(start):
                    continue
                n, second = len(start), word_proofs(raw)
                head = [pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(start.astype(np.int32)),
                        pa.array(least.view(np.int64))]
                if with_kmers:
                    each = np.arange(len(words) - k + 1)
                    at = pa.array(np.append(start, len(each)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*head, *(pa.ListArray.from_arrays(at, pa.array(span_hashes(w, each, k).view(np.int64))) for w in (words, second))],
                        ["doc_id", "row", "start", "core", "kmers", "proofs"])
                    continue
                path, proof = (span_hashes(w, start, size + (k - 1)) for w in (words, second))
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(size.astype(np.int32)), pa.array(path.view(np.int64)),
                     pa.array(proof.view(np.int64)), pa.array(twice)],
                    ["doc_id", "row", "start", "core", "size", "path", "proof", "twice"])

    schema = "doc_id long, row long, start int, core long, "
    return rows.select("doc_id", "row", "text").mapInArrow(run, schema + (
        "kmers array<long>, proofs array<long>" if with_kmers else "size int, path long, proof long, twice boolean"))


def repeated_kmers(rows: DataFrame, k: int, core: int) -> DataFrame:
    """(doc_id, row, start, size, later): the paths that hold a k-mer which also starts earlier (smaller doc_id, or the
    same document and a smaller position). ``later`` lists the places of those k-mers in the path, null: all."""
    seen = core_counts(rows, k, core).filter("n > 1")
    walks = store(path_rows(rows, k, core, keep=bitmap_array(member_bitmap(seen, "core"))), "walks")
    # Copies of a path compact into one, with the coordinates of its first source.
    unique = store(walks.groupBy("core", "path", "proof").agg(
        F.min(F.struct("doc_id", "row", "start")).alias("src"), F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"))
        .select("core", "path", "proof", F.col("src.doc_id").alias("src_doc"), F.col("src.row").alias("src_row"),
                F.col("src.start").alias("src_start"), "copies", "twice"),
        "paths")
    # Only where several paths share a core, or a path holds a k-mer twice, can a k-mer of a first source repeat.
    branching = unique.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("t")).filter("c > 1 OR t")
    open_paths = store(unique.join(branching, "core", "left_semi").select(
        "core", "path", "proof", F.col("src_doc").alias("doc_id"), F.col("src_row").alias("row"), F.col("src_start").alias("start")), "branching")
    spot = F.xxhash64("doc_id", "row", "start")
    some = maybe_member(rows, "row", member_bitmap(open_paths, "row"), how="keep")
    spelled = maybe_member(path_rows(some, k, core, with_kmers=True).withColumn("spot", spot), "spot",
                           member_bitmap(open_paths.select(spot.alias("spot")), "spot"), how="keep")
    edges = store(spelled.drop("spot").join(open_paths.select("path", "proof", "doc_id", "row", "start"),
                                             ["doc_id", "row", "start"]), "edges")
    edges = edges.select("core", "path", "proof", "doc_id", "row", "start", F.posexplode(F.arrays_zip("kmers", "proofs")).alias("i", "e")
                         ).select("*", F.col("e.kmers").alias("kmer"), F.col("e.proofs").alias("kmer_proof")).drop("e")
    place = F.struct("doc_id", "row", (F.col("start") + F.col("i")).alias("pos"))
    first = edges.groupBy("core", "kmer", "kmer_proof").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    marks = (edges.join(first, ["core", "kmer", "kmer_proof"]).filter(place != F.col("first"))
             .groupBy("core", "path", "proof").agg(F.collect_set("i").alias("later")))
    known = store(unique.join(marks, ["core", "path", "proof"], "left").filter((F.col("copies") > 1) | F.col("later").isNotNull())
                  .select("core", "path", "proof", "src_doc", "src_row", "src_start", "later"), "known")
    own = ((F.col("doc_id") == F.col("src_doc")) & (F.col("row") == F.col("src_row")) & (F.col("start") == F.col("src_start")))
    return (walks.select("core", "path", "proof", "doc_id", "row", "start", "size").join(known, ["core", "path", "proof"])
            .filter(~own | F.col("later").isNotNull())
            .select("doc_id", "row", "start", "size", F.when(own, F.col("later")).alias("later")))


def dedup_spans(docs: DataFrame, k: int = 20, core: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (start, end of the removed runs of words), text (the
    kept words joined by single blanks).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed when it is covered by a window of ``k``
    consecutive words whose sequence also starts earlier, in a smaller doc_id or earlier in the same document;
    windows are judged on the input.

    1. Each document's walk through the De Bruijn graph of k-mers is compacted at once into paths by core (see
       :func:`paths`): about one path per six words instead of one row per word. Cores are counted map-side first;
       those that occur twice become a bitmap of fixed size, and only paths with such a core travel on, as a hash.
    2. Equal paths compact into one row with the coordinates of its first source, aggregated map-side, so a passage
       that a third of all documents share is one row per task. Only cores with several distinct paths branch: their
       k-mers are spelled out at the first source of each path and looked up one by one. A join returns first
       sources to the paths, whose hot side AQE splits.
    3. Per document the marks unite to spans. k-mers are equal when the 64-bit hashes of the k-mer and of its core
       agree, paths when those of the core and of all k-mers in order do, and both only when a second hash agrees
       too, made of the words' polynomials over a prime field: what a source and its repeat share is verified by two
       hashes of unlike construction.

    A null or empty text has no words. Rows without a doc_id are left out. Rows that repeat a doc_id and its text are one
    source coordinate, and each is treated like the first of them; rows with one doc_id and other texts are documents of
    their own, in the order of a hash of the text. An empty table gives no rows.
    """
    rows = id_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    marks = store(repeated_kmers(rows, k, core), "marks")
    per_doc = marks.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "size", "later")).alias("marks"))
    # Texts without a mark need no join: a bitmap of fixed size tells them apart in the scan.
    flagged = maybe_member(rows, "row", member_bitmap(marks, "row"))
    cols = [F.col("text"), F.transform("marks", lambda m: m["start"]).alias("starts"),
            F.transform("marks", lambda m: m["size"]).alias("sizes"), F.transform("marks", lambda m: m["later"]).alias("laters")]
    marked = flagged.filter("_maybe").select("doc_id", "row", "text").join(per_doc, ["doc_id", "row"], "left").select("doc_id", *cols)
    plain = flagged.filter("NOT _maybe").select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in (
        ("starts", "array<int>"), ("sizes", "array<int>"), ("laters", "array<array<int>>"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, sizes, laters in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                words = text.encode("utf-8", "replace").split()
                n = len(words)
                depth = np.zeros(n + 1, np.int64)
                for start, size, later in zip(starts or (), sizes or (), laters or ()):
                    if later is None:                         # every k-mer of the path: one span
                        depth[start] += 1
                        depth[start + size - 1 + k] -= 1
                    else:
                        at = start + np.array(later)
                        np.add.at(depth, at, 1)
                        np.add.at(depth, at + k, -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if len(edge) else b" ".join(words)
                out.append((n, int(gone.sum()), [{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2])],
                            kept.decode("utf-8", "replace")))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[i] for o in out], t) for i, t in
                                    enumerate((pa.int64(), pa.int64(), spans, pa.string())))],
                ["doc_id", "n_words", "n_removed", "spans", "text"])

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
    return marked.mapInArrow(run, schema).unionByName(plain.mapInArrow(run, schema))
