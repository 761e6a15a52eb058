"""Limit rules with a pass/fail verdict per capture."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.operators.decode import signals_long
from buslens.operators.ordered import with_previous
from buslens.scale import lookup_join, materialise
from buslens.sources.catalogue import Catalogue

# Signals with a rule that are named in the plan, so that other messages are not read.
NAMED_SIGNALS = 1_000


def check_rules(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Check the long form against a rule table (``rule, signal, low, high``).

    One row per capture and rule whose signal occurs: number of samples and
    violations, time of the first violation, verdict. A null bound is open; a
    value outside the bounds, or not a number, violates the rule.
    """
    matched = _matched(signals, rules, ["capture_id", "timestamp", "signal", "value"])
    return (
        matched.groupBy("capture_id", "rule", "signal")
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if("_broken").alias("violations"),
            F.min(F.when(F.col("_broken"), F.col("timestamp"))).alias("first_violation"),
        )
        .withColumn("verdict", F.when(F.col("violations") == 0, "pass").otherwise("fail"))
    )


def _matched(signals: DataFrame, rules: DataFrame, columns: list[str]) -> DataFrame:
    """Samples with each rule on their signal, and whether they break it."""
    low, high, value = F.col("low"), F.col("high"), F.col("value")
    broken = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False)) | F.isnan(value)
    matched = lookup_join(signals.select(*columns), rules, ["signal"], "inner")
    return matched.withColumn("_broken", F.coalesce(broken, F.lit(False)))


def sustained_violations(signals: DataFrame, rules: DataFrame, least_seconds: Column | float = 0.0) -> DataFrame:
    """Unbroken runs of violations that last at least ``least_seconds``.

    A run is all consecutive samples of a capture's signal that break the rule,
    and lasts from the first to the last of them. ``least_seconds`` may be a
    column of the rule table. Samples are compared with the one before in sorted
    slices, so that a run may cross them, and then the borders of runs alike.
    """
    keys, order = ["capture_id", "rule", "signal"], ["timestamp", "seq"]
    more = [c for c in rules.columns if c not in ("rule", "signal", "low", "high")]
    matched = _matched(signals.where(F.col("timestamp").isNotNull()), rules, ["capture_id", *order, "signal", "value"])
    stepped = with_previous(
        matched.select(*keys, *order, "_broken", *more), keys, order, {"_was": "_broken", "_since": "timestamp"}
    )
    was = F.coalesce("_was", F.lit(False))
    # A run begins at a border with _broken, and the next border of its key names its last sample.
    borders = stepped.where(F.col("_broken") != was)
    closing = stepped.groupBy(*keys).agg(F.max("timestamp").alias("_until"), F.count(F.lit(1)).alias("samples"))
    # In the order turned round, the previous border is the following one; null comes first, so its opposite last.
    turned = {"_t": -F.col("timestamp"), "_q": -F.coalesce("seq", F.lit(-((1 << 63) - 1)))}
    borders = materialise(borders.select(*keys, *order, "_broken", "_since", *more).withColumns(turned), "borders")
    runs = with_previous(borders, keys, ["_t", "_q"], {"_ends": "_since"}).where("_broken")
    runs = lookup_join(runs, materialise(closing, "closing"), keys, "inner", null_safe=True)
    lasts = runs.withColumn("last_violation", F.coalesce("_ends", "_until"))
    least = least_seconds if isinstance(least_seconds, Column) else F.lit(least_seconds)
    seconds = F.col("last_violation") - F.col("timestamp")
    return lasts.where(seconds >= least).select(
        *keys, F.col("timestamp").alias("first_violation"), F.col("seq").alias("first_seq"), "last_violation", seconds.alias("seconds")
    )


def check_frames(frames: DataFrame, catalogue: Catalogue, rules: DataFrame) -> DataFrame:
    """:func:`check_rules` on frames, decoding only the signals that have a rule."""
    names = [row.signal for row in rules.select("signal").distinct().limit(NAMED_SIGNALS + 1).collect()]
    if len(names) <= NAMED_SIGNALS:
        return check_rules(signals_long(frames, catalogue, names), rules)
    ruled = catalogue.signals.join(rules.select("signal").distinct(), "signal", "left_semi")
    return check_rules(signals_long(frames, replace(catalogue, signals=ruled)), rules)
