"""Table-level uses of the reader helpers: min-max confidence (A5) and forward fill (W5) on ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplematch.functions import fixed
from triplematch.operators.windows import forward_fill
from triplematch.plans.registry import register
from triplematch.session import table
from triplematch.sources.readers import min_max_confidence

MINMAX_SQL = f"""
SELECT event_id, event_type,
  round(((value - min(value) OVER (PARTITION BY event_type)) + {fixed.MINMAX_EPS!r})
        / (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type) + 2 * {fixed.MINMAX_EPS!r}), 6)
  AS confidence
FROM events
"""


@register("minmax_confidence", "A5", MINMAX_SQL)
def minmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("confidence"))
    out = min_max_confidence(ev, by=["event_type"])
    return out.select("event_id", "event_type", F.round("confidence", 6).alias("confidence"))


FFILL_SQL = """
SELECT event_id, user_id,
  last(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view
FROM events
"""


@register("forward_fill", "W5", FFILL_SQL)
def forward_fill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carry each user's latest 'view' event onto the following events (by time), like the current
    sentence of a ClausIE file. Blocks of one hour keep a very active user spread over many tasks."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")).alias("t"),
        F.when(F.col("event_type") == "view", F.col("event_id")).alias("view_id"))
    out = forward_fill(ev, "t", "view_id", "last_view", block=3600 * 1_000_000, partition=["user_id"])
    return out.select("event_id", "user_id", "last_view")
