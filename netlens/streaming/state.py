"""Stateful streams: coalesced touches and live counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOUCH_WINDOW = "60 seconds"
# How late a row may be and still count; older rows are ignored by these two
# operators only. Ingest itself stores rows of any age.
LIVE_DELAY = "10 minutes"


def coalesce_touches(stream: DataFrame, ts: str = "timestamp", ip: str = "remote_ip") -> DataFrame:
    """The first sighting of each address per minute of event time, so that a busy
    address updates its reputation row once and not per packet. The state of an
    address expires with the watermark."""
    seen = stream.where(F.col(ip).isNotNull()).select(F.col(ip).alias("ip"), F.col(ts).alias("ts"))
    return seen.withWatermark("ts", TOUCH_WINDOW).dropDuplicatesWithinWatermark(["ip"])


def live_counts(stream: DataFrame, ts: str = "timestamp", delay: str = LIVE_DELAY) -> DataFrame:
    """Overview and action counts per tumbling hour; use with update mode."""
    firewall, action = F.col("log_type") == "firewall", F.col("rule_action")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(firewall & (action == "allow")).alias("allowed"),
            F.count_if(action == "block").alias("blocked"),
            F.count_if(F.col("threat_score") > 50).alias("threats"),
            *[F.count_if(firewall & (action == a)).alias(a) for a in ("allow", "block", "redirect")],
        )
        .select(F.col("w.start").alias("period"), "total", "allowed", "blocked", "threats", "allow", "block", "redirect")
    )
