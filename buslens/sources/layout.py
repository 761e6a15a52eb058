"""A storage order for two kinds of scans: signals along a space-filling curve.

Sorted by signal and time, a scan for some values of a signal reads all of that
signal. Here signal, time and value are each cut into steps that hold about the
same number of rows, and the bits of the three step numbers are interleaved into
one key. Neighbours on that curve are near in all three, so min/max statistics
let scans by signal and value skip row groups as well as scans by time.

Steps are quantiles: of time within a capture, of value within a signal; signals
take the steps at which they start when all rows are counted in the order of
their names. They only decide where a row lies, never whether it is stored, so
approximate ones do. Null and undecodable values lie in the first step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buslens.scale import lookup_join, materialise

BITS = 5  # of each step number
ACCURACY = 1_000
CURVE = "_curve"


def interleave(steps: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of the numbers in turn, the highest of the first number foremost."""
    key = F.lit(0).cast("long")
    for bit in range(bits):
        for place, step in enumerate(reversed(steps)):
            key = key + F.shiftleft(F.shiftright(step.cast("long"), bit).bitwiseAND(F.lit(1)), bit * len(steps) + place)
    return key


def _quantiles(column: str, bits: int) -> Column:
    return F.percentile_approx(column, [k / 2**bits for k in range(1, 2**bits)], ACCURACY)


def _step(column: str, bounds: str) -> Column:
    """How many of the bounds a value has reached."""
    return F.coalesce(F.array_size(F.filter(bounds, lambda bound: bound <= F.col(column))), F.lit(0))


def with_curve(signals: DataFrame, bits: int = BITS) -> DataFrame:
    """``signals`` with ``_curve``; needs ``capture_id, signal, timestamp, value``."""
    by_capture = signals.groupBy("capture_id").agg(_quantiles("timestamp", bits).alias("_times"))
    by_signal = materialise(
        signals.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), _quantiles("value", bits).alias("_values")), "steps"
    )
    # One row per name of the catalogue, so one task suffices.
    ahead = Window.orderBy("signal").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) * 2**bits / F.sum("n").over(every))
    by_signal = by_signal.select("signal", "_values", start.alias("_name"))
    placed = lookup_join(signals, materialise(by_capture, "steps"), ["capture_id"], null_safe=True)
    placed = lookup_join(placed, by_signal, ["signal"], null_safe=True)
    steps = [F.coalesce("_name", F.lit(0)), _step("timestamp", "_times"), _step("value", "_values")]
    names = ["_name", "_time", "_value"]
    placed = placed.withColumns(dict(zip(names, steps, strict=True)))
    return placed.select(*signals.columns, interleave([F.col(n) for n in names], bits).alias(CURVE))


def interleaved(signals: DataFrame, bits: int = BITS) -> DataFrame:
    """``signals`` range-partitioned and sorted along the curve within each capture.

    A step that holds many rows still spreads: time and ``seq`` follow in the order.
    """
    order = ["capture_id", CURVE, "signal", "timestamp", "seq"]
    return with_curve(signals, bits).repartitionByRange(*order).sortWithinPartitions(*order).select(*signals.columns)
