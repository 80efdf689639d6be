"""The registered queries of this subpackage: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.llm import exact_dedup, jaccard_join, language_id, licenses, mixing, packing, prefix_trie, quality, resampling, secret_scan, substring_dedup, topk, toxicity
from triplematch.llm.common import crc_mod, documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "text", "copy", "order_key")


ORACLES["op1_exact_dedup"] = exact_dedup.ORACLE
ORACLES["op7_license_scan"] = licenses.oracle()
ORACLES["op8_source_mixing"] = mixing.oracle()


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 3) == 1
    model = language_id.train(docs, ~held)
    return language_id.predict(docs, model).withColumn("held_out", held)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels")
    return quality.classify(documents(spark, sf_dir), labels, ~held).withColumn("held_out", held)


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).withColumn("held_out", held)


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op4_exact_topk"] = topk.ORACLE


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), words=3, percent=90)


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring_dedup.dedup_spans(documents(spark, sf_dir), k=20)
    return spans.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = resampling.ORACLE


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = prefix_trie.ORACLE
