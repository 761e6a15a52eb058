"""Windowed statistics on live streams.

The aggregations are the batch ones; the watermark bounds their state and late
rows beyond it are dropped. In append mode a window appears once the watermark
has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.operators.decode import LONG_COLUMNS, signals_long
from buslens.operators.ordered import with_previous
from buslens.operators.quality import COPY_KEY, cycle_times
from buslens.operators.signals import bucket_stats
from buslens.operators.stats import window_stats
from buslens.scale import lookup_join
from buslens.sources.catalogue import Catalogue

SPAN_KEYS = ["capture_id", "can_id_dec"]


def live_frame_stats(
    frames: DataFrame, width: str = "10 seconds", delay: str = "30 seconds", by: list[str] | None = None
) -> DataFrame:
    """Frames and rate per window of a streaming frames table."""
    return window_stats(frames.withWatermark("ts", delay), width, by)


def live_signal_stats(
    frames: DataFrame,
    catalogue: Catalogue,
    width: str = "10 seconds",
    delay: str = "30 seconds",
    signals: list[str] | None = None,
) -> DataFrame:
    """Mean, range and count per window and signal of a streaming frames table."""
    keep = [*LONG_COLUMNS[:4], "ts"]
    decoded = signals_long(frames.withWatermark("ts", delay), catalogue, signals, keep)
    return bucket_stats(decoded, width)


def live_spans(frames: DataFrame, catalogue: Catalogue, factor: float = 1.5, delay: str = "30 seconds") -> DataFrame:
    """Unbroken spans of cyclic messages on a stream; a span that closes is an identifier gone silent.

    A session window whose gap is ``factor`` cycle times of the message. A row
    appears once the watermark has passed the end of its span by that gap, so
    the state holds the open spans only: one per capture and identifier that is
    being received, and those of the watermark's delay.
    """
    timed = frames.withWatermark("ts", delay)
    known = lookup_join(timed, cycle_times(catalogue), ["can_id_dec"], "inner", small_fits=catalogue.small)
    silence = F.concat(F.round(F.col("cycle_time_ms") * 1000 * factor).cast("bigint").cast("string"), F.lit(" microseconds"))
    moment = F.struct("timestamp", "seq")
    spans = known.groupBy(F.session_window("ts", silence).alias("span"), *SPAN_KEYS, "cycle_time_ms").agg(
        F.count(F.lit(1)).alias("frames"), F.min(moment).alias("first"), F.max(moment).alias("last")
    )
    return spans.select(
        *SPAN_KEYS, "cycle_time_ms", "frames", F.col("span.end").alias("silent_from"),
        F.col("first.timestamp").alias("first_timestamp"), F.col("first.seq").alias("first_seq"),
        F.col("last.timestamp").alias("last_timestamp"), F.col("last.seq").alias("last_seq"),
    )


def span_gaps(spans: DataFrame) -> DataFrame:
    """The gaps between stored spans, with the columns of ``missing_frames``."""
    rows = spans.select(*SPAN_KEYS, "cycle_time_ms", "first_timestamp", "first_seq", "last_timestamp", "last_seq")
    before = {"previous_timestamp": "last_timestamp", "previous_seq": "last_seq"}
    stepped = with_previous(rows, SPAN_KEYS, ["first_timestamp"], before).where(F.col("previous_timestamp").isNotNull())
    return stepped.select(
        *SPAN_KEYS, F.col("first_seq").alias("seq"), "previous_seq", F.col("first_timestamp").alias("timestamp"),
        "previous_timestamp", (F.col("first_timestamp") - F.col("previous_timestamp")).alias("gap_seconds"), "cycle_time_ms",
    )


def without_live_copies(frames: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Frames of a stream without the copies that arrive within ``delay`` of event time.

    Copies are told by capture, time, identifier and payload, in whichever
    batches and runs they come; the state holds the keys of the delay only. The
    copy that arrives first is kept.
    """
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(COPY_KEY)
