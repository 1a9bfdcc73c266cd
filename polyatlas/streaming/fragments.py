"""Events as a stream of fragments, and their counts in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_fragments(events: DataFrame) -> DataFrame:
    """(cell, chrom, start, length, ts) of event rows; works on batches and streams alike."""
    return events.select(F.col("user_id").alias("cell"), F.col("event_type").alias("chrom"), F.unix_timestamp("ts").alias("start"), (1 + F.floor("value")).alias("length"), "ts")


def stream_counts(fragments: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(chrom, begin, n) in tumbling windows; rows later than ``late`` behind the watermark are left out of a stream's state."""
    marked = fragments.withWatermark("ts", late)
    counted = marked.groupBy("chrom", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("chrom", F.col("w.start").alias("begin"), "n")
