"""Structured Streaming form of dialogue scoring.

The reference processes finite files only; every row-local operator here (fallback triple, T1,
v1/v2/v3, copy penalty) is a stateless expression, so the same columns run unchanged on a stream:
no watermark or state store is needed. Pairs arrive as Parquet files (``pair_id, q, a`` and optional
``q_triples`` / ``a_triples``); scores go to a Parquet sink with exactly-once file commits, the
checkpoint living under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from triplematch.operators import scoring
from triplematch.session import ensure_checkpoint_dir

PAIR_SCHEMA = "pair_id long, q string, a string, q_triples array<array<string>>, a_triples array<array<string>>"


def score_stream(stream: DataFrame, mode: str = "v1") -> DataFrame:
    """Score a streaming (or batch) DataFrame of pairs; missing triples fall back to P3."""
    df = stream
    for side in ("q", "a"):
        col = f"{side}_triples"
        if col not in df.columns:
            df = df.withColumn(col, F.lit(None).cast("array<array<string>>"))
        df = scoring.with_fallback(df, col, side)
    extra = {}
    if mode == "v3":
        from triplematch.functions.text import whitespace_words

        df = df.withColumn("q_words", whitespace_words("q")).withColumn("a_words", whitespace_words("a"))
        extra = {"q_words": "q_words", "a_words": "a_words"}
    return scoring.score_pairs(df, mode=mode, **extra).select("pair_id", F.round("score", 6).alias("score"))


def start(spark: SparkSession, source_dir: str, sink_dir: str, name: str = "pair_scores", mode: str = "v1",
          available_now: bool = False) -> StreamingQuery:
    """Read new pair files from ``source_dir`` and append their scores to ``sink_dir``."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    src = spark.readStream.schema(PAIR_SCHEMA).parquet(source_dir)
    writer = (score_stream(src, mode).writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", ckpt).outputMode("append").queryName(name))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
