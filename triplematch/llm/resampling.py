"""Target-distribution importance resampling: array-scored weights, then a distributed quickselect of the winners."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplematch.llm.common import CRC_TABLE_SQL, id_text, crc32_sql, sorted_runs, store

BUCKETS = 10000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
PIVOTS = 64                 # random keys a round of the quickselect; only the number of rounds depends on it
PIECE = 1 << 20             # bytes of a text whose words are held at once

# The bytes of words, [0-9a-z] after lower-casing and all bytes of characters beyond ASCII.
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def feature_buckets(raw: bytes, n: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to n words that end in them), piece by piece of a text in UTF-8."""
    text, at, carry = raw.lower().translate(_KEEP), 0, []
    while at < len(text):
        end = text.find(b" ", at + PIECE) if at + PIECE < len(text) else -1
        words = text[at:end if end >= 0 else len(text)].split()
        at = end if end >= 0 else len(text)
        grams = [zlib.crc32(w) for w in words]
        for k in range(2, n + 1):
            run = (carry[-(k - 1):] if carry else []) + words
            grams += [zlib.crc32(b" ".join(run[i:i + k])) for i in range(len(run) - k + 1)]
        carry = (carry + words)[-(n - 1):] if n > 1 else []
        yield len(words), np.array(grams, np.int64) % buckets


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of the text column ``text`` (null: none).

    Each task sums an array of fixed size over its rows and sends its non-zero entries once; they are added up by
    bucket. The driver receives ``buckets`` numbers, whatever the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                for _, b in feature_buckets(raw.as_py() or b"", n, buckets):
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    raw = texts.select(F.col("text").cast("string").cast("binary"))
    out = np.zeros(buckets, np.int64)
    for r in raw.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of the smoothed target share over the smoothed source share)."""
    m = len(source)
    S, T = float(source.sum() + m), float(target.sum() + m)
    return np.array([math.floor(1000 * math.log((t + 1.0) * S / ((s + 1.0) * T))) for s, t in zip(source.tolist(), target.tolist())],
                    np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight (the floored mean gain of a text's features; 0 without any). Row-local."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                words = features = total = 0
                for w, b in feature_buckets(raw.as_py(), n, buckets):
                    words, features, total = words + w, features + len(b), total + int(gain[b].sum())
                rows.append((words, features, total // features if features else 0))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return id_text(docs).select("doc_id", F.col("text").cast("binary")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256("<seed>:<doc_id>")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def _key() -> Column:
    return F.struct("order_1", "doc_id", "row")


def select_kth(keys: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest (from 1) of the composite keys (order_1, doc_id, row), all distinct; None if k < 1.

    Each round draws ``pivots`` random keys of the interval that still holds the k-th, counts exactly how many of the
    interval's keys lie below each pivot and how many equal it, and narrows the interval to the gap between two
    pivots, or stops at a pivot that is the k-th itself. Two small jobs a round over narrow rows; the driver sees
    ``pivots`` keys and counts. A round divides the interval by about ``pivots``.
    """
    low = high = None
    need, turn = k, 0
    while need >= 1:
        turn += 1
        inside = keys
        for bound, sign in ((low, 1), (high, -1)):
            if bound:
                at = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(bound, ("order_1", "doc_id", "row"))])
                coarse = F.col("order_1") >= bound[0] if sign > 0 else F.col("order_1") <= bound[0]   # reaches the scan
                inside = inside.filter(coarse).filter(_key() > at if sign > 0 else _key() < at)
        drawn = sorted(tuple(r) for r in inside.orderBy(F.xxhash64("row", "doc_id", F.lit(turn)), "row").limit(pivots)
                       .select("order_1", "doc_id", "row").collect())
        if not drawn:
            raise ValueError(f"{k} keys asked for, fewer given")
        below, equal = [], []
        for i, p in enumerate(drawn):
            at = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(p, ("order_1", "doc_id", "row"))])
            below.append(F.count(F.when(_key() < at, 1)).alias(f"below_{i}"))
            equal.append(F.count(F.when(_key() == at, 1)).alias(f"equal_{i}"))
        counted = inside.agg(*below, *equal).first()
        skipped = 0
        for i, p in enumerate(drawn):
            lo, eq = counted[f"below_{i}"], counted[f"equal_{i}"]
            if need <= lo:
                high = p
                break
            if need <= lo + eq:
                return p
            low, skipped = p, lo + eq
        need -= skipped
    return None


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n: int = 1,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... by falling score, then doc_id; null where not drawn).

    Draws ``percent`` per cent (floored) of the documents with at least ``min_words`` words, without replacement, in
    proportion to the likelihood ratio of ``target``'s texts over all ``docs`` (Gumbel top-k).

    Null and empty texts have no features and weight 0. Rows that repeat a doc_id are documents of their own; if they
    tie in score too, the one that comes first in the table goes first. Rows without an id are left out of the result, as
    are their texts' counts. Empty tables give an empty result; extra columns change nothing.

    Scores are written once as narrow rows; the quickselect and the ranking read those. Winners alone are sorted, in
    ranges, and ranked by a position in the range plus the sizes of the ranges before it (one row a range).
    """
    gain = gains(bucket_counts(id_text(docs), n, buckets), bucket_counts(target, n, buckets))
    scored = weights(docs, gain, n).withColumn("score", F.col("weight") + gumbel(seed))
    scored = store(scored.withColumn("order_1", -F.col("score")).withColumn("row", F.monotonically_increasing_id()), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    kth = select_kth(able, percent * able.count() // 100)
    cols = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long")
    if kth is None:
        return scored.select(*cols, none.alias("rank"))
    last = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(kth, ("order_1", "doc_id", "row"))])
    wins = (F.col("n_words") >= min_words) & (_key() <= last)
    runs = sorted_runs(scored.filter(wins), [F.col("order_1"), F.col("doc_id"), F.col("row")], "winners")
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_run", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    ranked = runs.join(F.broadcast(sizes), "_run").select(*cols, (F.col("_at") + F.col("_shift")).alias("rank"))
    return ranked.unionByName(scored.filter(~wins).select(*cols, none.alias("rank")))


ORACLE = f"""
WITH {CRC_TABLE_SQL},
word AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
    FROM documents WHERE doc_id IS NOT NULL),
tword AS (SELECT unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w
    FROM benchmark),
b AS (SELECT w, {crc32_sql('w')} % {BUCKETS} AS bucket
      FROM (SELECT w FROM word UNION SELECT w FROM tword), crc_table),
src AS (SELECT bucket, count(*) AS n FROM word JOIN b USING (w) GROUP BY bucket),
tgt AS (SELECT bucket, count(*) AS n FROM tword JOIN b USING (w) GROUP BY bucket),
gain AS (SELECT v AS bucket, floor(1000 * ln((coalesce(tgt.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM src) + {BUCKETS})::DOUBLE
             / ((coalesce(src.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM tgt) + {BUCKETS})::DOUBLE)))::BIGINT AS g
         FROM (SELECT unnest(range({BUCKETS})) AS v) LEFT JOIN src ON src.bucket = v LEFT JOIN tgt ON tgt.bucket = v),
w AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS total FROM word JOIN b USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
             coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             ('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT AS h
      FROM documents d LEFT JOIN w USING (doc_id) WHERE d.doc_id IS NOT NULL),
sc AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM s),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= {MIN_WORDS})
SELECT sc.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""
