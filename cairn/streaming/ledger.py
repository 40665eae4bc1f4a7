"""Running ledgers over streams; an extension, the batch forms are in operators.replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events per window and key; those later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def state_counts(events: DataFrame, key: str) -> DataFrame:
    """Events per key so far, for output mode complete or update."""
    return events.groupBy(key).agg(F.count("*").alias("n"))
