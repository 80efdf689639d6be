"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplematch.llm.common import cut, fresh, own_columns

#: One inversion table covers a mean of at most this; a larger mean is a sum of independent draws.
PIECE = 8.0
#: Entries of an inversion table. P(Poisson(8) >= 64) is below 1e-30, under the 2^-52 grid of the draws.
TABLE = 64
#: Rate tables of at most this many sources are broadcast (about 600 bytes a source); larger ones are joined.
BROADCAST_SOURCES = 10_000


def uniform(key: Column) -> Column:
    """A double in [0, 1): the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5,
                 epochs: float = 1.0) -> DataFrame:
    """One row per source: source, chars, weight, rate (mean copies of each of its documents).

    ``weights`` are target shares by source (sources not named get 0). Without them the target share is the
    natural share raised to ``temperature``, renormalised. The rates make the expected output ``epochs`` times
    the input's characters. Counted map-side over all rows, so a hot source is a few partial sums. A null source
    is a source of its own. A source without any characters gets rate 0.
    """
    t = docs.groupBy("source").agg(F.sum(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("chars"))
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(raw)
    t = t.withColumn("raw", F.when(F.col("chars") > 0, raw).otherwise(F.lit(0.0)))
    t = cut(t)  # a row per source, so that the text is scanned once
    all_chars, all_raw = t.agg(F.sum("chars"), F.sum("raw")).first()
    weight = F.col("raw") / F.lit(float(all_raw or 1.0))
    rate = F.when(F.col("chars") > 0, weight * F.lit(float(all_chars or 0)) * F.lit(float(epochs)) / F.col("chars"))
    return t.select("source", "chars", weight.alias("weight"), F.coalesce(rate, F.lit(0.0)).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Adds ``pieces`` (independent draws summed) and ``cdf`` (the inversion table of one draw)."""
    pieces = F.greatest(F.ceil(F.col("rate") / F.lit(PIECE)), F.lit(1)).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE - 1)),
        F.struct(F.exp(-F.col("mean")).alias("term"), F.array(F.exp(-F.col("mean"))).alias("cdf")),
        lambda acc, k: F.struct(
            (acc["term"] * F.col("mean") / k).alias("term"),
            F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["term"] * F.col("mean") / k)).alias("cdf")),
        lambda acc: acc["cdf"])
    return rates.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")).withColumn("cdf", steps)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0,
        seed: int = 17, copy: str = "copy") -> DataFrame:
    """Every column of ``docs`` (with ``doc_id``, ``text``, ``source``), replicated; plus ``copy`` (the number of the copy,
    under another name if ``copy`` says so) and ``order_key``.

    A document of source s appears Poisson(rate_s) times: the count inverts the Poisson distribution at a uniform
    number hashed from (seed, doc_id), so a recomputed task draws the same. ``order_key`` hashes (seed, doc_id,
    copy); rows are dealt to partitions by it and sorted by it within each, which is a global shuffle with one
    exchange and no sampling pass. The deal ignores the source, so a hot source is spread evenly.

    The rate table has one row per source. It is broadcast after its row count was checked against
    BROADCAST_SOURCES; a larger one goes through an ordinary join, whose skewed side AQE splits.
    Null texts have no characters but are replicated like their source. Rows without a doc_id are left out. Rows
    that repeat a doc_id draw the same count. Columns ``copy`` and ``order_key`` of the input are replaced.
    """
    rows = docs.filter(F.col("doc_id").isNotNull()).drop(copy, "order_key")
    source, pieces, cdf = (fresh(rows, n) for n in ("_source", "_pieces", "_cdf"))
    tables = poisson_tables(source_rates(rows, weights, temperature, epochs)).select(
        F.col("source").alias(source), F.col("pieces").alias(pieces), F.col("cdf").alias(cdf))
    if tables.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    d = rows.join(tables, F.col("source").eqNullSafe(F.col(source)))
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col(pieces)), F.lit(0),
        lambda acc, i: acc + F.size(F.filter(F.col(cdf), lambda c: c <= uniform(
            F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), i.cast("string"))))))
    copies = F.transform(F.array_repeat(F.lit(True), draw), lambda _, i: (i + 1).cast("long"))
    d = d.withColumn(copy, F.explode(copies))
    d = d.withColumn("order_key", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("doc_id").cast("string"),
                                                    F.col(copy).cast("string"))))
    return (d.select(*own_columns(rows), copy, "order_key")
            .repartition(F.col("order_key")).sortWithinPartitions("order_key"))


def oracle(temperature: float = 0.5, epochs: float = 1.0, seed: int = 17) -> str:
    return f"""
WITH RECURSIVE s AS (SELECT source, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents
           WHERE doc_id IS NOT NULL GROUP BY 1),
     r AS (SELECT source, chars, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {temperature}::DOUBLE) ELSE 0 END AS raw FROM s),
     t AS (SELECT sum(chars)::DOUBLE AS all_chars, sum(raw) AS all_raw FROM r),
     q AS (SELECT source, CASE WHEN chars > 0 AND all_raw > 0
                  THEN raw / all_raw * all_chars * {epochs}::DOUBLE / chars ELSE 0 END AS rate FROM r, t),
     m AS (SELECT source, greatest(ceil(rate / {PIECE}::DOUBLE), 1)::INT AS pieces FROM q),
     l AS (SELECT m.source, m.pieces, q.rate / m.pieces AS mean FROM m JOIN q ON m.source IS NOT DISTINCT FROM q.source),
     c(source, pieces, mean, k, term, cdf) AS (
         SELECT source, pieces, mean, 0, exp(-mean), exp(-mean) FROM l
         UNION ALL
         SELECT source, pieces, mean, k + 1, term * mean / (k + 1), cdf + term * mean / (k + 1) FROM c WHERE k < {TABLE - 1}),
     u AS (SELECT d.doc_id, l.source, i,
                  ('0x' || substr(md5('{seed}:' || d.doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE / {1 << 52}::DOUBLE AS u
           FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source, range(1, 1000) x(i)
           WHERE i <= l.pieces AND d.doc_id IS NOT NULL),
     n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY 1)
SELECT d.doc_id, d.source, d.text, y.copy::BIGINT AS copy,
       md5('{seed}/' || d.doc_id || '/' || y.copy) AS order_key
FROM documents d JOIN n ON d.doc_id = n.doc_id, range(1, 100000) y(copy) WHERE y.copy <= n.n
"""
