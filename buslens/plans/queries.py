"""Registered queries: every operator over the whole ``events`` table.

Each takes ``(spark, sf_dir)`` and returns a flat table, so that an independent
SQL query over the source columns can check it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buslens.functions.ids import parse_id_list
from buslens.operators import limits, quality, rules, select, signals, stats
from buslens.operators.decode import decode, frames_wide, signal_texts, signals_long
from buslens.operators.normalise import normalise
from buslens.plans.capture import run_capture, select_frames
from buslens.plans.event_frames import (
    event_catalogue, event_frames, pack_events, read_events, stream_events,
)
from buslens.scale import scratch_path
from buslens.schemas import RULE
from buslens.sinks import fan_out, sinks
from buslens.sources.catalogue import expected_signals, info_for_ids
from buslens.sources.frames import read_capture
from buslens.sources.store import read_frames, write_frames, write_store
from buslens.streaming.capture import run_to_table, start_capture
from buslens.streaming.monitor import live_frame_stats, live_signal_stats

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Parameters shared with the SQL side.
ID_LIST = "0x100, 291"
FRAME_LIMIT = 25
DURATION = 3600.0
STREAM_WIDTH, STREAM_DELAY = "1 hour", "30 seconds"
RULES = [
    ("value high", "Value", None, 300.0),
    ("trim range", "Trim", -900.0, 900.0),
    ("k range", "K", -40.0, 59.0),
    ("user known", "UserId", 0.0, None),
]


def query(name: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        REGISTRY[name] = run
        return run

    return add


def _micros(column: Column) -> Column:
    return F.unix_micros(column)


def _texts(column: str = "texts") -> Column:
    """``name=value`` list in catalogue order; null stays null."""
    return F.array_join(F.transform(column, lambda s: F.concat(s["signal"], F.lit("="), s["text"])), ",")


def _long(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    return signals_long(event_frames(spark, sf_dir), event_catalogue(spark), names)


def _as_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from a careless logger: fixed length, no extended flag, views as remote frames."""
    raw = pack_events(read_events(spark, sf_dir))
    return normalise(
        raw.withColumns(
            {"dlc": F.lit(8), "is_extended": F.lit(False), "is_remote": F.col("can_id_dec") == 512}
        )
    )


def _twice_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames where every error frame was logged a second time."""
    frames = event_frames(spark, sf_dir)
    again = frames.where(F.col("can_id_dec") == 1110).withColumn("seq", F.col("seq") + 1_000_000_000)
    return frames.unionByName(again)


# --- records, filters, decoding -------------------------------------------------


@query("frames_normalised")
def query_frames_normalised(spark, sf_dir):
    return event_frames(spark, sf_dir).select(
        "capture_id", "seq", "timestamp", _micros(F.col("ts")).alias("ts_micros"), "can_id", "can_id_dec",
        "dlc", "data_hex", F.array_join(F.col("data_bytes").cast("array<string>"), " ").alias("data_bytes"),
        "is_extended", "is_remote", "is_error",
    )


@query("filter_ids")
def query_filter_ids(spark, sf_dir):
    frames = select.by_ids(event_frames(spark, sf_dir), parse_id_list(ID_LIST))
    return frames.select("capture_id", "seq", "timestamp", "can_id", "dlc", "data_hex")


@query("filter_id_table")
def query_filter_id_table(spark, sf_dir):
    frames = event_frames(spark, sf_dir)
    texts = frames.where(F.col("dlc") == 8).select("can_id")
    ids = select.ids_from_text(texts, "can_id")
    return select.by_id_table(frames, ids).select("capture_id", "seq", "can_id", "data_hex")


@query("filter_ranges")
def query_filter_ranges(spark, sf_dir):
    frames = select.by_id_range(event_frames(spark, sf_dir), 0x100, 0x2FF)
    frames = select.by_time(frames, "2024-01-03 00:00:00", "2024-01-20 12:00:00")
    rows = select.by_signal_range(signals_long(frames, event_catalogue(spark)), "Value", 50.0, 150.0)
    return rows.select("capture_id", "seq", "can_id_dec", "signal", "value")


@query("signals_long")
def query_signals_long(spark, sf_dir):
    return _long(spark, sf_dir)


@query("frames_parsed")
def query_frames_parsed(spark, sf_dir):
    frames = signal_texts(event_frames(spark, sf_dir), event_catalogue(spark))
    return frames.select("capture_id", "seq", "can_id", _texts().alias("parsed"))


@query("parsed_map")
def query_parsed_map(spark, sf_dir):
    frames = decode(event_frames(spark, sf_dir), event_catalogue(spark))
    return frames.select(
        "seq",
        F.size("parsed").alias("signals"),
        F.col("parsed")["Value"]["value"].alias("value"),
        F.col("parsed")["Sel"]["label"].alias("sel_label"),
    )


@query("raw_without_catalogue")
def query_raw_without_catalogue(spark, sf_dir):
    frames = decode(event_frames(spark, sf_dir), None)
    return frames.select("seq", "can_id", "data_hex", F.col("parsed").isNull().alias("undecoded"))


@query("frames_wide")
def query_frames_wide(spark, sf_dir):
    return frames_wide(event_frames(spark, sf_dir), event_catalogue(spark), keep=["seq", "timestamp", "can_id", "dlc", "data_hex"])


@query("message_info")
def query_message_info(spark, sf_dir):
    seen = event_frames(spark, sf_dir).groupBy("can_id_dec").agg(F.count(F.lit(1)).alias("frames"))
    info = info_for_ids(seen, event_catalogue(spark))
    return info.withColumn("signals", F.array_join("signals", ","))


@query("expected_signal_samples")
def query_expected_signal_samples(spark, sf_dir):
    catalogue = event_catalogue(spark)
    samples = _long(spark, sf_dir).groupBy("signal").agg(F.count(F.lit(1)).alias("samples"))
    return expected_signals(catalogue).join(samples, "signal", "left").withColumn(
        "samples", F.coalesce("samples", F.lit(0))
    )


# --- numbers and limits ---------------------------------------------------------


@query("frame_numbers")
def query_frame_numbers(spark, sf_dir):
    frames = event_frames(spark, sf_dir).select("capture_id", "seq", "timestamp")
    return limits.number_frames(frames).select("capture_id", "seq", "frame_num")


@query("frame_lines")
def query_frame_lines(spark, sf_dir):
    from buslens.sinks.files import text_lines

    numbered = limits.number_frames(event_frames(spark, sf_dir))
    return text_lines(numbered, event_catalogue(spark))


@query("count_limit")
def query_count_limit(spark, sf_dir):
    return limits.limit_count(event_frames(spark, sf_dir), FRAME_LIMIT).select("capture_id", "seq", "can_id", "data_hex")


@query("duration_limit")
def query_duration_limit(spark, sf_dir):
    return limits.limit_duration(event_frames(spark, sf_dir), DURATION).select("capture_id", "seq", "timestamp", "can_id")


@query("duration_filter_count")
def query_duration_filter_count(spark, sf_dir):
    kept = select_frames(event_frames(spark, sf_dir), parse_id_list(ID_LIST), DURATION * 6, FRAME_LIMIT)
    return kept.select("capture_id", "seq", "timestamp", "can_id")


# --- statistics -----------------------------------------------------------------


@query("capture_stats")
def query_capture_stats(spark, sf_dir):
    return stats.capture_stats(event_frames(spark, sf_dir)).select(
        "capture_id", "frames", F.round("elapsed_seconds", 6).alias("elapsed_seconds"), F.round("fps", 9).alias("fps")
    )


@query("kept_frame_count")
def query_kept_frame_count(spark, sf_dir):
    return stats.count_frames(select.by_ids(event_frames(spark, sf_dir), parse_id_list(ID_LIST)))


@query("manifest")
def query_manifest(spark, sf_dir):
    return stats.capture_manifest(event_frames(spark, sf_dir)).select(
        "capture_id", _micros(F.col("capture_time")).alias("capture_time_micros"), "frame_count"
    )


@query("window_stats_10s")
def query_window_stats_10s(spark, sf_dir):
    return _windows(stats.window_stats(event_frames(spark, sf_dir), "10 seconds"))


def _windows(table: DataFrame) -> DataFrame:
    return table.select(
        "capture_id", _micros(F.col("window_start")).alias("window_start_micros"), "frames", F.round("fps", 9).alias("fps")
    )


@query("bucket_stats")
def query_bucket_stats(spark, sf_dir):
    return _buckets(signals.bucket_stats(_long(spark, sf_dir), "1 hour"))


def _buckets(table: DataFrame) -> DataFrame:
    # Signals here are multiples of 0.01, so the total has two decimals; rounding
    # it removes the noise of the summation order before it can flip a digit.
    mean = F.round(F.col("mean") * F.col("samples"), 3) / F.col("samples")
    return table.select(
        "capture_id", _micros(F.col("bucket_start")).alias("bucket_micros"), "signal", "samples",
        mean.alias("mean"), "low", "high",
    )


@query("signal_summary")
def query_signal_summary(spark, sf_dir):
    return signals.signal_summary(_long(spark, sf_dir)).select(
        "signal", "samples", "low", "high", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")
    )


@query("signal_corr")
def query_signal_corr(spark, sf_dir):
    both = _long(spark, sf_dir, ["Value", "K"])
    return signals.signal_correlation(both, "Value", "K", "1 hour").select(
        "first", "second", "buckets", F.round("correlation", 6).alias("correlation")
    )


@query("signal_drift")
def query_signal_drift(spark, sf_dir):
    return signals.signal_drift(_long(spark, sf_dir), "4 hours").select(
        "capture_id", "signal", _micros(F.col("bucket_start")).alias("bucket_micros"), "samples",
        F.round("mean", 7).alias("mean"), F.round("change", 7).alias("change"),
    )


@query("signal_trend")
def query_signal_trend(spark, sf_dir):
    return signals.signal_trend(_long(spark, sf_dir)).select(
        # Adding zero turns a negative zero into zero.
        "capture_id", "signal", "samples", (F.round("slope", 6) + 0.0).alias("slope")
    )


# --- quality and rules ----------------------------------------------------------


@query("quarantine")
def query_quarantine(spark, sf_dir):
    bad = quality.quarantined_frames(_as_logged(spark, sf_dir))
    return bad.select("seq", "can_id_dec", F.array_join("reasons", "; ").alias("reasons"))


@query("valid_frames")
def query_valid_frames(spark, sf_dir):
    good = quality.valid_frames(_as_logged(spark, sf_dir))
    return good.select("capture_id", "seq", "can_id", "data_hex")


@query("gaps")
def query_gaps(spark, sf_dir):
    gaps = quality.missing_frames(event_frames(spark, sf_dir), event_catalogue(spark))
    return gaps.withColumn("gap_seconds", F.round("gap_seconds", 6))


@query("duplicates")
def query_duplicates(spark, sf_dir):
    copies = quality.duplicate_frames(_twice_logged(spark, sf_dir))
    return copies.select("capture_id", "can_id_dec", "first_seq", F.hex("data").alias("data"), "copies")


@query("frames_without_duplicates")
def query_frames_without_duplicates(spark, sf_dir):
    kept = quality.drop_duplicate_frames(_twice_logged(spark, sf_dir))
    return kept.select("capture_id", "seq", "can_id", "data_hex")


@query("quality")
def query_quality(spark, sf_dir):
    return quality.quality_report(_twice_logged(spark, sf_dir), event_catalogue(spark))


@query("rules")
def query_rules(spark, sf_dir):
    table = spark.createDataFrame(RULES, RULE)
    return rules.check_frames(event_frames(spark, sf_dir), event_catalogue(spark), table)


# --- sinks ----------------------------------------------------------------------


@query("sink_csv")
def query_sink_csv(spark, sf_dir):
    catalogue, path = event_catalogue(spark), scratch_path(spark, "csv")
    sinks.create("csv", path=path, catalogue=catalogue).write(event_frames(spark, sf_dir))
    stored = read_capture(spark, path, "csv", catalogue.names())
    return stored.select("capture_id", "timestamp", "can_id", "dlc", "data_hex", *catalogue.names())


@query("sink_ndjson")
def query_sink_ndjson(spark, sf_dir):
    path = scratch_path(spark, "json")
    sink = sinks.create("json", path=path, catalogue=event_catalogue(spark), extra=["seq"])
    sink.write(event_frames(spark, sf_dir))
    stored = read_capture(spark, path, "json")
    cells = F.transform(F.array_sort(F.map_entries("parsed")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return stored.select(
        "capture_id", "seq", "timestamp", "can_id", "can_id_dec", "dlc", "data_hex",
        F.array_join(F.col("data_bytes").cast("array<string>"), " ").alias("data_bytes"),
        "is_extended", "is_remote", "is_error", F.array_join(cells, ",").alias("parsed"),
    )


@query("sink_text")
def query_sink_text(spark, sf_dir):
    path = scratch_path(spark, "txt")
    sinks.create("txt", path=path, catalogue=event_catalogue(spark)).write(event_frames(spark, sf_dir))
    return spark.read.schema("value string, capture_id string").format("text").load(path).select(
        "capture_id", F.col("value").alias("line")
    )


@query("sink_parquet")
def query_sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    sinks.create("parquet", path=path).write(event_frames(spark, sf_dir))
    return read_capture(spark, path, "parquet").select("capture_id", "seq", "timestamp", "can_id", "data_hex")


@query("store_tables")
def query_store_tables(spark, sf_dir):
    root = scratch_path(spark, "store")
    write_store(event_frames(spark, sf_dir), event_catalogue(spark), root)
    stored = spark.read.schema("capture_id string, signal string, value double").parquet(f"{root}/signals")
    captures = spark.read.schema("capture_id string, frame_count long").parquet(f"{root}/captures")
    counted = stored.groupBy("capture_id").agg(F.count("value").alias("samples"))
    return captures.join(counted, "capture_id", "left")


@query("store_bulk_import")
def query_store_bulk_import(spark, sf_dir):
    catalogue, path, root = event_catalogue(spark), scratch_path(spark, "csv"), scratch_path(spark, "store")
    sinks.create("csv", path=path, catalogue=catalogue).write(event_frames(spark, sf_dir))
    write_frames(read_capture(spark, path, "csv", catalogue.names()), root)
    return read_frames(spark, root).select("capture_id", "timestamp", "can_id_dec", "dlc", "data_hex")


@query("schema_evolution")
def query_schema_evolution(spark, sf_dir):
    path = scratch_path(spark, "versions")
    frames = event_frames(spark, sf_dir)
    # The first version of the store knew no flags; error frames came with the second.
    old = frames.where(F.col("can_id_dec") != 1110).select("capture_id", "seq", "timestamp", "can_id_dec", "dlc", "data")
    old.write.mode("append").partitionBy("capture_id").parquet(path)
    write_frames(frames.where(F.col("can_id_dec") == 1110), path, mode="append")
    merged = read_frames(spark, path, defaults={"is_remote": True})
    return merged.select("capture_id", "seq", "can_id", "data_hex", "is_extended", "is_remote")


@query("fanout_count")
def query_fanout_count(spark, sf_dir):
    path, catalogue = scratch_path(spark, "fanout"), event_catalogue(spark)
    counts = run_capture(
        event_frames(spark, sf_dir), catalogue, formats=["csv", "json", "count"], output_dir=path
    )
    return spark.createDataFrame(list(counts.items()), "sink string, frames bigint")


# --- streams --------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(pack_events(stream_events(spark, sf_dir)))


@query("stream_signals")
def query_stream_signals(spark, sf_dir):
    path = scratch_path(spark, "signals")
    run_to_table(signals_long(_stream(spark, sf_dir), event_catalogue(spark)), path)
    return spark.read.parquet(path)


@query("stream_stats")
def query_stream_stats(spark, sf_dir):
    path = scratch_path(spark, "windows")
    run_to_table(live_frame_stats(_stream(spark, sf_dir), STREAM_WIDTH, STREAM_DELAY), path)
    return _windows(spark.read.parquet(path))


@query("stream_monitor")
def query_stream_monitor(spark, sf_dir):
    path = scratch_path(spark, "monitor")
    live = live_signal_stats(_stream(spark, sf_dir), event_catalogue(spark), STREAM_WIDTH, STREAM_DELAY)
    run_to_table(live, path)
    return _buckets(spark.read.parquet(path))


@query("stream_capture")
def query_stream_capture(spark, sf_dir):
    path, catalogue = scratch_path(spark, "live"), event_catalogue(spark)
    targets = {f: sinks.create(f, path=f"{path}/{f}", catalogue=catalogue) for f in ("csv", "txt")}
    run = start_capture(_stream(spark, sf_dir), targets, parse_id_list(ID_LIST), trigger={"availableNow": True})
    run.wait()
    lines = spark.read.schema("value string, batch_id int, capture_id string").format("text").load(f"{path}/txt")
    return lines.select("capture_id", F.col("value").alias("line"))
