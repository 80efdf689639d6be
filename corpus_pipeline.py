"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return
the columns of ``documents``. :func:`run` writes every stage's rows as Parquet below the shared checkpoint folder
and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplematch.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from triplematch.llm.common import crc_mod, documents, fresh, own_columns, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon scores at 0.7 or more go. It learns from the labelled rows of the
    ``documents`` table outside the held-out fold."""
    model = toxicity.train(documents(spark, sf_dir), table(spark, sf_dir, "labels"), ~(crc_mod("doc_id", 3) == 1))
    return toxicity.keep_clean(docs, model, 0.7)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest original stays, then the smallest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to the square root of their natural shares, globally shuffled; columns of documents."""
    key = fresh(docs, "_order")                      # a column of the caller's that is named like one of the mix stays
    own = docs.withColumnRenamed("order_key", key)
    return mixing.mix(own, copy=fresh(docs, "_copy")).drop("order_key").withColumnRenamed(key, "order_key").select(*own_columns(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a document that the mix repeats is packed once per copy."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity, the Jaccard join and packing are not expressible in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table runs through and gives no rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        folder = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
