"""The stream scorer equals the batch scorer on the same pairs."""

import uuid

from pyspark.sql import functions as F

from places import SF_SMALL
from triplematch.operators import scoring
from triplematch.session import table
from triplematch.streaming import scoring as stream_scoring


def test_stream_matches_batch(spark, tmp_path):
    pairs = scoring.pair_turns(table(spark, SF_SMALL, "conversations"))
    pairs = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "q", "a",
                         F.lit(None).cast("array<array<string>>").alias("q_triples"),
                         F.lit(None).cast("array<array<string>>").alias("a_triples"))
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    pairs.write.parquet(src)
    q = stream_scoring.start(spark, src, sink, name=f"t{uuid.uuid4().hex[:8]}", available_now=True)
    q.awaitTermination(300)
    got = {r.pair_id: r.score for r in spark.read.parquet(sink).collect()}
    want = {r.pair_id: r.score for r in stream_scoring.score_stream(pairs).collect()}
    assert got == want and len(got) > 0
