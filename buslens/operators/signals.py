"""Statistics over the long form (one row per decoded signal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.operators.normalise import event_time
from buslens.operators.ordered import with_last, with_previous, with_running_sum
from buslens.scale import lookup_join, materialise


def _time(signals: DataFrame) -> Column:
    return F.col("ts") if "ts" in signals.columns else event_time(F.col("timestamp"))


def bucket_stats(signals: DataFrame, width: str, by: list[str] | None = None) -> DataFrame:
    """Mean, minimum, maximum and count per time bucket and signal."""
    by = ["capture_id"] if by is None else by
    return (
        signals.groupBy(F.window(_time(signals), width).alias("bucket"), *by, "signal")
        .agg(
            F.count("value").alias("samples"),
            F.avg("value").alias("mean"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .select(
            F.col("bucket.start").alias("bucket_start"), *by, "signal", "samples", "mean", "low", "high"
        )
    )


def signal_summary(signals: DataFrame, by: list[str] | None = None, accuracy: int = 1_000) -> DataFrame:
    """Count, range, mean, deviation and quartiles of every signal.

    Quartiles are approximate with a rank error of ``1 / accuracy``; their
    sketches are what is shuffled, not the values.
    """
    return signals.groupBy(*(by or []), "signal").agg(
        F.count("value").alias("samples"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("deviation"),
        F.percentile_approx("value", [0.25, 0.5, 0.75], accuracy).alias("quartiles"),
    )


def signal_correlation(
    signals: DataFrame, first: str, second: str, width: str, by: list[str] | None = None
) -> DataFrame:
    """Pearson correlation of two signals averaged over common time buckets.

    Both averages come out of one aggregation, so the signals are never joined.
    """
    by = by or []
    name, value = F.col("signal"), F.col("value")
    both = (
        signals.where(name.isin(first, second))
        .groupBy(F.window(_time(signals), width).alias("bucket"), *by)
        .agg(
            F.avg(F.when(name == first, value)).alias("x"),
            F.avg(F.when(name == second, value)).alias("y"),
        )
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    return both.groupBy(*by).agg(
        F.lit(first).alias("first"),
        F.lit(second).alias("second"),
        F.count(F.lit(1)).alias("buckets"),
        F.corr("x", "y").alias("correlation"),
    )


def signals_as_of(signals: DataFrame, first: str, second: str, max_age: float | None = None) -> DataFrame:
    """Every sample of ``first`` with the last value of ``second`` at or before its time in the capture.

    Both signals in one sorted table, where the last value is carried on, over
    the borders of its slices too; nothing is joined by ranges. Samples without
    an earlier value, or with one older than ``max_age`` seconds, are left out.
    """
    name = F.col("signal")
    rows = signals.where(name.isin(first, second) & F.col("timestamp").isNotNull()).select(
        "capture_id", "timestamp", "seq",
        # At one time the second signal comes first, so that its value counts.
        (name == first).alias("_asks"),
        F.when(name == first, F.col("value")).alias("value"),
        F.when(name == second, F.struct("timestamp", "value")).alias("_seen"),
    )
    if first == second:
        raise ValueError("as-of alignment needs two different signals")
    carried = with_last(rows, ["capture_id"], ["timestamp", "_asks", "seq"], {"_last": "_seen"})
    found = carried.where(F.col("_asks") & F.col("_last").isNotNull())
    if max_age is not None:
        found = found.where(F.col("timestamp") - F.col("_last.timestamp") <= max_age)
    return found.select(
        "capture_id", "timestamp", "seq", F.col("value").alias("x"), F.col("_last.value").alias("y"),
        F.col("_last.timestamp").alias("y_timestamp"),
    )


def signal_correlation_as_of(
    signals: DataFrame, first: str, second: str, max_age: float | None = None, by: list[str] | None = None
) -> DataFrame:
    """Pearson correlation of ``first`` with the value ``second`` had at each of its samples; null if either is constant."""
    pairs = signals_as_of(signals, first, second, max_age)
    correlation = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return pairs.groupBy(*(by or [])).agg(
        F.lit(first).alias("first"), F.lit(second).alias("second"), F.count(F.lit(1)).alias("pairs"), correlation.alias("correlation")
    )


def signal_drift(signals: DataFrame, width: str, by: list[str] | None = None) -> DataFrame:
    """Change of a signal's mean from one time bucket with data to the next."""
    by = ["capture_id"] if by is None else by
    buckets = bucket_stats(signals, width, by).select("bucket_start", *by, "signal", "samples", "mean")
    stepped = with_previous(buckets, [*by, "signal"], ["bucket_start"], {"previous_mean": "mean"})
    return stepped.withColumn("change", F.col("mean") - F.col("previous_mean"))


def signal_shifts(signals: DataFrame, by: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Where the level of a signal changes most: its change point by cumulative sums.

    The sum of the deviations from the overall mean, up to each sample, is
    farthest from zero at the last sample before the change (the earliest of
    several). One row per key with the times on both sides and both means;
    ``least`` leaves out smaller changes, as a difference of means. The sums are
    carried over the borders of sorted slices.
    """
    by = ["capture_id"] if by is None else by
    keys, order = [*by, "signal"], ["timestamp", "seq"]
    samples = signals.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("timestamp").isNotNull())
    means = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.sum("value").alias("_total"))
    means = materialise(means, "means")
    rows = lookup_join(samples.select(*keys, *order, "value"), means, keys, "inner", null_safe=True)
    rows = rows.withColumns({"_one": F.lit(1), "_deviation": F.col("value") - F.col("_total") / F.col("samples")})
    summed = with_running_sum(rows, keys, order, {"_before": "_one", "_sum": "value", "_cusum": "_deviation"})
    inner = summed.where(F.col("_before") < F.col("samples"))
    # Rounded, so that noise of the summation does not choose between equal sums.
    place = F.struct(F.round(F.abs("_cusum"), 6).alias("size"), (-F.col("_before")).alias("early"))
    last = F.struct("timestamp", "seq", "_before", "_sum", "samples", "_total")
    found = inner.groupBy(*keys).agg(F.max_by(last, place).alias("last"))
    n, before, total = F.col("last.samples"), F.col("last._before"), F.col("last._total")
    level = {
        "mean_before": F.col("last._sum") / before, "mean_after": (total - F.col("last._sum")) / (n - before),
    }
    shifts = found.select(
        *keys, n.alias("samples"), before.cast("bigint").alias("samples_before"), F.col("last.timestamp").alias("last_before"),
        F.col("last.seq").alias("seq_before"), *[column.alias(name) for name, column in level.items()],
    )
    return shifts.where(F.abs(F.col("mean_after") - F.col("mean_before")) >= least)


def sketch_buckets(signals: DataFrame, width: str, by: list[str] | None = None, size: int = 200) -> DataFrame:
    """A quantile sketch per time bucket and signal, which ``sketch_rollup`` merges without reading frames again."""
    by = ["capture_id"] if by is None else by
    numbers = signals.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return (
        numbers.groupBy(F.window(_time(signals), width).alias("bucket"), *by, "signal")
        .agg(F.count("value").alias("samples"), F.kll_sketch_agg_double("value", size).alias("sketch"))
        .select(F.col("bucket.start").alias("bucket_start"), *by, "signal", "samples", "sketch")
    )


def sketch_rollup(sketches: DataFrame, width: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """Quantiles per wider bucket from the sketches of narrower ones, within the rank error of the sketch size."""
    by = ["capture_id"] if by is None else by
    merged = F.reduce(
        F.slice("each", F.lit(2), F.size("each")), F.col("each")[0], lambda a, b: F.kll_sketch_merge_double(a, b)
    )
    # As many sketches come together as narrow buckets fit into a wide one.
    gathered = sketches.groupBy(F.window("bucket_start", width).alias("bucket"), *by, "signal").agg(
        F.sum("samples").alias("samples"), F.collect_list("sketch").alias("each")
    )
    return gathered.withColumn("sketch", merged).select(
        F.col("bucket.start").alias("bucket_start"), *by, "signal", "samples",
        F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for q in quantiles]).alias("quantiles"),
    )


def signal_trend(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope of every signal in units per second."""
    by = ["capture_id"] if by is None else by
    return signals.groupBy(*by, "signal").agg(
        F.count("value").alias("samples"),
        F.regr_slope("value", "timestamp").alias("slope"),
    )
