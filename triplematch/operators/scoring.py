"""Dialogue scoring: pair utterances, score answer triples against question triples.

Covers W7 (next-turn pairing), J1 (positional pairing), P3/P6 (fallback triple and gates),
J5-J7 + A7-A9 (scores v1/v2/v3), F6 (copy penalty), A10 (histogram), A11 (high-score rate)
and A20 (fallback counters).

Physical shape: pairing is one equi-join on a unique key (no window partitioned by conversation,
so a conversation holding a third of all turns still spreads over all tasks); scoring is a pure
row-local expression (no shuffle); the reports are two-phase aggregations over tiny group keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.functions import fixed
from triplematch.functions.similarity import best_alignments, punish
from triplematch.functions.text import _c, let, lower_words, pseudo_triples, triple_words
from triplematch.operators.windows import next_order

ColumnOrName = Column | str
Best = Callable[[Column, Column], Column]


# ---------------------------------------------------------------- pairing


def pair_turns(conversations: DataFrame, q_role: str | None = "user", a_role: str | None = "assistant",
               key: str = "conv_id", order: str = "turn", carry: list[str] | None = None) -> DataFrame:
    """Each turn paired with the next turn of the same conversation, whatever its number.

    The number of the next turn comes from a narrow pass over ``(conv_id, turn)``
    (:func:`next_order`); the texts are then paired by an equi-join on that key. Roles filter both
    text sides before the join (pushed to the scan).
    """
    carry = carry or []
    following = next_order(conversations, key, order, "_next")
    q = conversations.select(F.col(key), F.col(order), F.col("role").alias("q_role"), F.col("text").alias("q"),
                             *[F.col(c).alias(f"q_{c}") for c in carry])
    a = conversations.select(F.col(key), F.col(order).alias("_next"), F.col("role").alias("a_role"),
                             F.col("text").alias("a"), *[F.col(c).alias(f"a_{c}") for c in carry])
    if q_role is not None:
        q = q.filter(F.col("q_role") == q_role)
    if a_role is not None:
        a = a.filter(F.col("a_role") == a_role)
    pairs = q.join(following.filter(F.col("_next").isNotNull()), [key, order]).join(a, [key, "_next"]).drop("_next")
    return spread_for_scoring(pairs, key, order)


def spread_for_scoring(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute rows over ``spark.sql.shuffle.partitions`` before CPU-bound scoring.

    Scoring costs grow with words squared, not bytes, so a small table that the scan reads as one
    split (or a broadcast join that keeps it there) would score on a single core. When the rows
    were just shuffled on the same keys by a sort-merge join, Spark recognises the identical hash
    partitioning and drops this exchange, so at scale it costs nothing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def zip_by_position(left: DataFrame, right: DataFrame, pos: str = "line_no") -> DataFrame:
    """Positional zip of two line-numbered files; the shorter one truncates (inner join)."""
    return left.join(right, pos, "inner")


# ---------------------------------------------------------------- element lists


def _mean(arr: Column) -> Column:
    """Mean of a numeric array, summed left to right; NULL if any element is NULL."""
    return let(arr, lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v))


def _elements(triples: Column) -> Column:
    """Flatten triples into their elements, each element a list of lower-cased whitespace words."""
    return F.transform(F.flatten(triples), lower_words)


def score_v1(q_triples: ColumnOrName, a_triples: ColumnOrName, apply_punish: bool = True, best: Best = best_alignments) -> Column:
    """Mean over question triples of the best T1 against any answer triple; then F6.
    ``best`` is T1 over two arrays of word lists (H6: with the row's vectors)."""
    q, a = _c(q_triples), _c(a_triples)
    found = best(F.transform(q, triple_words), F.transform(a, triple_words))
    res = F.when((F.size(q) > 0) & (F.size(a) > 0), _mean(found))
    return let(res, lambda s: punish(s)) if apply_punish else res


def _score_elements(e1: Column, e2: Column, best: Best) -> Column:
    """Best match per question element, keep the top min(n1, n2), mean.

    Elements repeat (a fallback triple is one element per word); ``best`` looks each distinct one up once.
    """
    some = F.when((F.size(e1) > 0) & (F.size(e2) > 0), F.least(F.size(e1), F.size(e2)))
    return let(F.struct(best(e1, e2).alias("v"), some.alias("k")), lambda s: F.when(
        s["k"] > 0, _mean(F.slice(F.sort_array(s["v"], False), 1, s["k"]))))


def score_v2(q_triples: ColumnOrName, a_triples: ColumnOrName, apply_punish: bool = True, best: Best = best_alignments) -> Column:
    """Element-level alignment of the flattened triples; then F6."""
    res = _score_elements(_elements(_c(q_triples)), _elements(_c(a_triples)), best)
    return let(res, lambda s: punish(s)) if apply_punish else res


def score_v3(q_triples: ColumnOrName, a_triples: ColumnOrName, q_words: ColumnOrName, a_words: ColumnOrName,
             apply_punish: bool = True, best: Best = best_alignments) -> Column:
    """v2, but when either side has no triple, T1 of the two raw word lists; then F6."""
    q, a = _c(q_triples), _c(a_triples)
    none = (F.size(q) == 0) | (F.size(a) == 0)

    def whole(words: ColumnOrName) -> Column:
        return F.when(none, F.array(lower_words(F.array_join(_c(words), " "))))

    raw = F.get(best(whole(q_words), whole(a_words)), 0)
    res = F.when(none, raw).otherwise(_score_elements(_elements(q), _elements(a), best))
    return let(res, lambda s: punish(s)) if apply_punish else res


def score_pairs(df: DataFrame, q: str = "q_triples", a: str = "a_triples", mode: str = "v1",
                q_words: str | None = None, a_words: str | None = None, gate: str | None = None,
                out: str = "score", vectors: DataFrame | None = None, key: list[str] | None = None) -> DataFrame:
    """Score every row's answer triples against its question triples.

    H6: with ``vectors`` (``word, v`` of length 1) words that both have a vector compare by cosine, all others by edit
    distance; ``key`` then names the columns that identify a row.

    ``mode``: ``v1`` (A7), ``v2`` (A8), ``v3`` (A9, needs ``q_words``/``a_words``).
    ``gate`` (P6): ``"empty"`` -> -1 when every answer element is empty; ``"long"`` -> 0 when the
    first answer triple has more than three elements (a fallback triple); ``None`` -> no gate.
    """
    def scored(best: Best) -> Column:
        if mode == "v1":
            return score_v1(q, a, best=best)
        if mode == "v2":
            return score_v2(q, a, best=best)
        return score_v3(q, a, q_words, a_words, best=best)

    if mode not in ("v1", "v2", "v3"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "v3" and (q_words is None or a_words is None):
        raise ValueError("mode v3 needs q_words and a_words")
    if vectors is None:
        s = scored(best_alignments)
    else:
        from triplematch.operators.vectors import score_with_vectors

        def side(triples: str, words: str | None) -> Column:
            own = F.flatten(F.col(triples))
            return F.flatten(F.transform(F.concat(own, F.col(words)) if mode == "v3" else own, lower_words))

        s, plain = F.col("_score"), df.columns
        df = score_with_vectors(df, key, side(q, q_words), side(a, a_words), vectors, scored, "_score").select(*plain, "_score")
    if gate == "empty":
        s = F.when(F.forall(F.flatten(F.col(a)), lambda e: e == ""), F.lit(-1.0)).otherwise(s)
    elif gate == "long":
        s = F.when(F.coalesce(F.size(F.try_element_at(F.col(a), F.lit(1))), F.lit(0)) > 3, F.lit(0.0)).otherwise(s)
    elif gate is not None:
        raise ValueError(f"unknown gate {gate!r}")
    return df.withColumn(out, s).drop("_score") if out != "_score" else df.withColumn(out, s)


def with_fallback(df: DataFrame, triples: str, text: str, out: str | None = None) -> DataFrame:
    """P3 + the explicit flag the text form can only guess (D3)."""
    out = out or triples
    t = F.col(triples)
    return (df.withColumn(f"{out}_is_fallback", F.coalesce(F.size(t), F.lit(0)) == 0)
              .withColumn(out, pseudo_triples(t, text)))


# ---------------------------------------------------------------- reports


def score_histogram(scores: DataFrame, score: str = "score", by: list[str] | None = None) -> DataFrame:
    """A10: eleven buckets ``int(score * 10)`` (1.0 alone in bucket 10), zero-filled.

    Negative scores (the -1 gate) go to bucket -1 instead of wrapping around, and that row only
    appears when it is non-empty; NULL scores are not counted. The ratio divides by the true number
    of counted scores, not a fixed constant. One aggregation with map-side partial counts: each
    group emits its twelve counters as an array, which is then exploded.
    """
    by = by or []
    s = F.col(score)
    bucket = F.when(s < 0, F.lit(-1)).otherwise((s * 10).cast("int"))
    counts = F.array(*[F.sum(F.when(bucket == b, 1).otherwise(0)) for b in range(-1, 11)])
    # no filter on the score: it would be pushed below the scoring expression and evaluate it twice
    agg = scores.groupBy(*by).agg(counts.alias("counts"), F.count(s).alias("total")).filter("total > 0")
    out = agg.select(*by, F.posexplode("counts").alias("i", "n"), "total")
    return (out.select(*by, (F.col("i") - 1).alias("bucket"), F.col("n").cast("long").alias("n"),
                       F.round(F.col("n") / F.col("total"), 6).alias("ratio"))
               .filter((F.col("bucket") >= 0) | (F.col("n") > 0)))


def score_summary(scores: DataFrame, score: str = "score", by: list[str] | None = None,
                  fallback: str | None = None, high: float = fixed.HIGH_SCORE) -> DataFrame:
    """A11 + A20: per group, #scores, #high (score >= 0.6), high rate, sum, mean, #fallback, #NULL."""
    by = by or []
    s = F.col(score)
    aggs = [
        F.count(F.lit(1)).alias("n_pairs"),
        F.count(s).alias("n_scored"),
        F.sum(F.when(s >= high, 1).otherwise(0)).alias("n_high"),
        F.round(F.sum(F.when(s >= high, 1).otherwise(0)) / F.count(s), 6).alias("high_rate"),
        F.round(F.sum(s), 6).alias("score_sum"),
        F.round(F.avg(s), 6).alias("score_mean"),
    ]
    if fallback:
        aggs.append(F.sum(F.col(fallback).cast("int")).alias("n_fallback"))
    return scores.groupBy(*by).agg(*aggs)
