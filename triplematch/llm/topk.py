"""Exact top-k inner products by norm-bucketed retrieval with length and coordinate pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplematch.llm.common import cut

BUCKET_RATIO = 1.05    # norms of one bucket differ by at most this factor
BLOCK = 4096           # expected vectors of a block; a bucket is dealt over as many blocks as that takes
QUERY_BLOCK = 256
FOCUS = 3              # coordinates tested by coordinate pruning
COORDINATE_FROM = 0.5  # local cosine thresholds from which coordinates are tested; below, lengths alone
SLACK = 1e-9           # bounds are loosened by this share, so that rounding never prunes a result


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>, dim, norm): floor(scale * x) for every component, x as double.

    Vectors that are null, empty or hold null or non-finite components are left out, and so are null ids. Rows
    that repeat a vec_id count once, with the greatest vector. |scale * x| must stay below 2^31.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    d = d.filter(F.coalesce(ok, F.lit(False)))
    d = d.select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    d = d.groupBy("vec_id").agg(F.max("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return d.select("vec_id", "v", F.size("v").alias("dim"), norm.alias("norm"))


def _blocks(vectors: DataFrame, key: list[str], size: int) -> DataFrame:
    """Rows of at most about ``size`` vectors: a group is dealt by a hash of vec_id over as many blocks as its
    count asks for. The counts are one row per group (dimension and norm bucket: a few hundred)."""
    sizes = vectors.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    dealt = vectors.join(F.broadcast(sizes), key).withColumn(
        "part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("_n") / F.lit(size)).cast("long")))
    return dealt.groupBy(*key, "part").agg(
        F.max("norm").alias("max_norm"), F.collect_list("vec_id").alias("ids"),
        F.flatten(F.collect_list("v")).alias("vs")).withColumn("block", F.xxhash64(*key, "part"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of an Arrow list column as numpy views, without Python objects for their items."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of every row of q with every row of v. Floating point is used only where every
    partial sum is below 2^53 and so exact."""
    if len(q) and len(v) and np.abs(q).max() * float(np.abs(v).max()) * q.shape[1] < 2.0 ** 52:
        return np.rint(q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def seed(q: np.ndarray, q_ids: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every query in one block; -inf where the block has fewer than k candidates."""
    s = _products(q, v).astype(np.float64)
    s[q_ids[:, None] == v_ids[None, :]] = -np.inf
    return np.partition(s, len(v_ids) - k, axis=1)[:, -k] if len(v_ids) >= k else np.full(len(s), -np.inf)


def search_block(q: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, v: np.ndarray, v_ids: np.ndarray,
                 k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in one block, none below the query's threshold.

    With t = theta / (|q| * longest vector) the local cosine threshold: t > 1 prunes the block; from
    COORDINATE_FROM on, a vector must have each of the query's FOCUS largest coordinates within
    c*t' +- sqrt((1 - t'^2)(1 - c^2)), t' being its own cosine threshold; below, vectors shorter than
    theta / |q| are pruned. What is left is verified by integer products.
    """
    norms = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    v, v_ids, norms = v[order], v_ids[order], norms[order]
    unit = v / np.maximum(norms, 1e-300)[:, None]
    out = []
    for i in range(len(q)):
        length = float(np.sqrt((q[i].astype(np.float64) ** 2).sum()))
        upto, mask = len(v), None
        if theta[i] > 0 and length > 0:
            least = theta[i] / length * (1 - SLACK)
            upto = int(np.searchsorted(-norms, -least, side="right"))
            if upto == 0:
                continue
            if least / norms[0] >= COORDINATE_FROM:
                t = np.minimum(least / norms[:upto], 1.0)
                rest = np.sqrt(1 - t * t)
                mask = np.ones(upto, bool)
                for f in np.argsort(-np.abs(q[i]))[:FOCUS]:
                    c = q[i, f] / length
                    half = rest * np.sqrt(max(0.0, 1 - c * c)) + 1e-7
                    mask &= np.abs(unit[:upto, f] - c * t) <= half if c * c <= t.min() ** 2 else (
                        unit[:upto, f] * np.sign(c) >= abs(c) * t - half)
        pick = np.flatnonzero(mask) if mask is not None else np.arange(upto)
        pick = pick[v_ids[pick] != q_ids[i]]
        if not len(pick):
            continue
        s = _products(q[i:i + 1], v[pick])[0]
        keep = s >= theta[i]
        pick, s = pick[keep], s[keep]
        out.extend((int(q_ids[i]), int(v_ids[pick[b]]), int(s[b])) for b in _best(v_ids[pick], s, k))
    return out


def exact_topk(rows: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k greatest integer inner products over all other rows.

    ``rows`` has vec_id and embedding; ``is_query`` (of vec_id) marks the queries. Ties go to the smaller vec_id;
    a query with fewer candidates returns all. See :func:`integer_vectors` for what takes part; vectors of unequal
    dimension are never compared. An empty table, or no query, gives no rows.

    Vectors are grouped into norm buckets and blocks of bounded size (a bucket that holds a third of all rows is
    dealt over blocks). The block of the longest vectors gives every query a first threshold. Query blocks then
    meet only blocks that some query of theirs can reach by length; each pair is searched in a task, and the
    partial results (k per query and block, above the threshold) are merged per query.
    """
    vectors = cut(integer_vectors(rows, scale))
    bucket = F.when(F.col("norm") > 0, F.floor(F.log(F.col("norm")) / F.lit(float(np.log(BUCKET_RATIO))))).otherwise(F.lit(-1))
    blocks = cut(_blocks(vectors.withColumn("bucket", bucket), ["dim", "bucket"], BLOCK))
    queries = _blocks(vectors.filter(is_query), ["dim"], QUERY_BLOCK).select(
        "dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vs").alias("qs"))
    longest = blocks.groupBy("dim").agg(F.max_by("block", F.struct("max_norm", "block")).alias("block"))
    first = blocks.join(longest, ["dim", "block"], "left_semi").select("dim", "ids", "vs")

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            col = {c: batch.column(c) for c in batch.schema.names}
            for dim, name, ids, q, v_ids, v in zip(col["dim"].to_pylist(), col["q_block"].to_pylist(),
                                                   *(_lists(col[c]) for c in ("q_ids", "qs", "ids", "vs"))):
                q = q.reshape(len(ids), -1)
                theta = seed(q, ids, v_ids, v.reshape(len(v_ids), -1), k)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                need = np.where((length > 0) & (theta > 0), theta / np.maximum(length, 1e-300) * (1 - SLACK), 0.0).min()
                got.append((dim, name, ids, q.ravel(), theta, float(need)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[i] for g in got], t) for i, t in enumerate(
                    (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()))],
                ["dim", "q_block", "q_ids", "qs", "theta", "need"])

    seeded = cut(queries.join(F.broadcast(first), "dim").mapInArrow(      # one block of bounded size per dimension
        thresholds, "dim int, q_block long, q_ids array<long>, qs array<long>, theta array<double>, need double"))
    reach = seeded.select("dim", "q_block", "need").join(blocks.select("dim", "block", "max_norm"), "dim")
    reach = reach.filter(F.col("max_norm") >= F.col("need")).select("q_block", "block")
    pairs = (reach.join(seeded.select("q_block", "q_ids", "qs", "theta"), "q_block")
             .join(blocks.select("block", "ids", "vs"), "block")
             .select("q_ids", "qs", "theta", "ids", "vs"))
    pairs = pairs.repartition(F.xxhash64("q_ids", "ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, theta, ids, v in zip(*(_lists(batch.column(c)) for c in ("q_ids", "qs", "theta", "ids", "vs"))):
                got = search_block(q.reshape(len(q_ids), -1), q_ids, theta, v.reshape(len(ids), -1), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(3)],
                                                 ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH f AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM f),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
