"""Reductions and histograms over event-time windows: mergeable aggregates only, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkarray.operators.hist import bin_of


def windowed(events: DataFrame, ts: str, value: str, window: str, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """n, sum, least, largest of a value for each window (and group)."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    out = events.groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total", "least", "largest")


def windowed_histogram(events: DataFrame, ts: str, value: str, window: str, edges: list[float], late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    binned = events.withColumn("bin", bin_of(F.col(value).cast("double"), edges)).filter("bin is not null")
    return binned.groupBy(F.window(ts, window), "bin").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "bin", "n")
