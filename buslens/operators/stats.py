"""Capture statistics. Each is one aggregation with map-side partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(frames: Column, elapsed: Column) -> Column:
    """Frames per second, 0 when no time has passed."""
    return F.when(elapsed > 0, frames / elapsed).otherwise(F.lit(0.0))


def count_frames(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count(F.lit(1)).alias("frames"))


def capture_stats(frames: DataFrame) -> DataFrame:
    """Frames, elapsed event time and rate per capture."""
    return (
        frames.groupBy("capture_id")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            (F.max("timestamp") - F.min("timestamp")).alias("elapsed_seconds"),
        )
        .withColumn("fps", rate(F.col("frames"), F.col("elapsed_seconds")))
    )


def capture_manifest(frames: DataFrame) -> DataFrame:
    """One metadata row per capture: start time, frame count, span, rate."""
    return (
        frames.groupBy("capture_id")
        .agg(
            F.min("ts").alias("capture_time"),
            F.count(F.lit(1)).alias("frame_count"),
            (F.max("timestamp") - F.min("timestamp")).alias("elapsed_seconds"),
        )
        .withColumn("fps", rate(F.col("frame_count"), F.col("elapsed_seconds")))
    )


def window_stats(frames: DataFrame, width: str = "10 seconds", by: list[str] | None = None) -> DataFrame:
    """Frames and rate per time window; the same code serves batch and streams."""
    by = ["capture_id"] if by is None else by
    counted = frames.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("frames"))
    seconds = F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    return counted.select(
        *by,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "frames",
        (F.col("frames") / (seconds / 1e6)).alias("fps"),
    )
