"""Structured Streaming forms of the timeline operators (an extension; the batch operators are in ``operators``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, time: str, gap: str = "90 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of one track in a stream: rows of one key and name no more than ``gap`` apart. State ends with the watermark."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("w"), key, "artist", "title")
        .agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_merged"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "artist", "title", "score", "n_merged")
    )


def latest_by_key(entries: DataFrame, key: str, time: str) -> DataFrame:
    """The newest entry of each key, kept up to date: the cache and upsert rule on a stream (update or complete mode)."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("e")).select(key, "e.*")
