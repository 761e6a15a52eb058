"""Row filters. All of them are plain predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.functions.ids import id_from_text
from buslens.scale import all_of, lookup_join, materialise

# More than the rounding of seconds to microseconds can shift a frame.
MARGIN = 2e-6


def by_ids(frames: DataFrame, ids: list[int] | None) -> DataFrame:
    """Keep frames with one of the decimal IDs; none given passes everything."""
    return frames.where(F.col("can_id_dec").isin(list(ids))) if ids else frames


def by_id_table(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """Keep frames whose ID is in a table with column ``can_id_dec``."""
    wanted = ids.select("can_id_dec").where(F.col("can_id_dec").isNotNull()).distinct()
    # Stored, since checking its size and joining it would compute it twice.
    return lookup_join(frames, materialise(wanted, "ids"), ["can_id_dec"], "left_semi")


def ids_from_text(table: DataFrame, column: str) -> DataFrame:
    """Parse a text column of IDs; ``can_id_dec`` is null for bad tokens."""
    return table.withColumn("can_id_dec", id_from_text(F.col(column)))


def by_id_range(frames: DataFrame, low: int, high: int) -> DataFrame:
    return frames.where(F.col("can_id_dec").between(low, high))


def by_time(frames: DataFrame, start=None, end=None) -> DataFrame:
    """Keep ``start <= ts < end``; bounds are datetimes, strings or columns.

    ``ts`` is computed from ``timestamp``, which no scan can look through, so the
    bounds are also put on ``timestamp``, a microsecond wider; that prunes files
    and row groups.
    """
    bounds = []
    if start is not None:
        bounds += [F.col("ts") >= _instant(start), F.col("timestamp") >= _seconds(start) - MARGIN]
    if end is not None:
        bounds += [F.col("ts") < _instant(end), F.col("timestamp") < _seconds(end) + MARGIN]
    return frames.where(all_of(bounds))


def _instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def _seconds(value) -> Column:
    return F.unix_micros(_instant(value)) / 1e6


def by_signal_range(
    signals: DataFrame, signal: str, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Keep rows of the long form of one signal whose value lies in the range."""
    conditions = [F.col("signal") == signal]
    if low is not None:
        conditions.append(F.col("value") >= low)
    if high is not None:
        conditions.append(F.col("value") <= high)
    return signals.where(all_of(conditions))
