"""Registered queries on sinks, sources and streams that run more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from buslens.functions.ids import parse_id_list
from buslens.operators import limits, quality, signals
from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.plans.capture import run_capture
from buslens.plans.event_frames import (
    catalogue_rows, event_catalogue, event_frames, pack_events, read_events, stream_events,
)
from buslens.plans.queries import FRAME_LIMIT, ID_LIST, query
from buslens.scale import scratch_path
from buslens.schemas import CATALOGUE, RAW_FRAME
from buslens.sinks import sinks
from buslens.sources.catalogue import load_catalogue, prepare_catalogue
from buslens.sources.frames import read_capture, read_raw, stream_raw
from buslens.sources.store import write_store
from buslens.streaming.capture import running_totals, start_capture

# Parameters shared with the SQL side.
ODD_LIMIT = 330
QUARTILES = (0.25, 0.5, 0.75)
VALUE_RANGE, TIME_RANGE = (20.0, 40.0), (1705000000.0, 1705600000.0)
LEADING_BYTES = {256: 4, 512: 56, 291: 5, 1110: 56}


@query("sink_two_captures")
def query_sink_two_captures(spark, sf_dir):
    """Captures written one after another into one folder; none replaces another."""
    catalogue, path = event_catalogue(spark), scratch_path(spark, "two")
    sink = sinks.create("csv", path=path, catalogue=catalogue)
    day = F.substring("capture_id", -1, 1).cast("int")
    for part in (0, 1, 0):  # the first captures twice: replaced, not doubled
        sink.write(event_frames(spark, sf_dir).where(day % 2 == part))
    stored = read_capture(spark, path, "csv", catalogue.names())
    return stored.select("capture_id", "timestamp", "can_id", "dlc", "data_hex", *catalogue.names())


@query("stream_restart")
def query_stream_restart(spark, sf_dir):
    """A capture of several files in small batches, stopped and started again twice."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "restart")
    raw = pack_events(read_events(spark, sf_dir))
    for part in (0, 1, None):
        if part is not None:
            raw.where(F.col("seq") % 2 == part).repartition(3).write.mode("append").parquet(landing)
        frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=1))
        start_capture(frames, {"parquet": sinks.create("parquet", path=path)}, trigger={"availableNow": True}).wait()
    stored = spark.read.schema(StructType([*RAW_FRAME.fields, StructField("batch_id", IntegerType())])).parquet(path)
    return stored.select("capture_id", "seq", "timestamp", "can_id_dec", "dlc")


@query("stream_totals")
def query_stream_totals(spark, sf_dir):
    path = scratch_path(spark, "totals")
    totals = running_totals(normalise(pack_events(stream_events(spark, sf_dir))))

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    stream = totals.writeStream.outputMode("complete").foreachBatch(save).trigger(availableNow=True)
    stream.option("checkpointLocation", scratch_path(spark, "totals-state")).start().awaitTermination()
    return spark.read.parquet(path).select(
        "capture_id", "frames", F.round("elapsed_seconds", 6).alias("elapsed_seconds"), F.round("fps", 9).alias("fps")
    )


@query("count_limit_odd_times")
def query_count_limit_odd_times(spark, sf_dir):
    """Frames without a time come first, those whose time is no number last."""
    seq = F.col("seq")
    odd = F.when(seq % 89 == 0, F.lit(None)).when(seq % 97 == 0, F.lit(float("nan"))).otherwise(F.col("timestamp"))
    frames = event_frames(spark, sf_dir).withColumn("timestamp", odd)
    return limits.limit_count(frames, ODD_LIMIT).select("capture_id", "seq", "can_id")


@query("landed_frames")
def query_landed_frames(spark, sf_dir):
    path = scratch_path(spark, "landed")
    raw = pack_events(read_events(spark, sf_dir)).withColumn("data_hex", F.hex("data")).drop("data")
    raw.select(*["data_hex" if n == "data" else n for n in RAW_FRAME.names]).write.option("header", True).csv(path)
    return normalise(read_raw(spark, path, "csv")).select("capture_id", "seq", "timestamp", "can_id", "dlc", "data_hex", "is_extended")


@query("catalogue_loaded")
def query_catalogue_loaded(spark, sf_dir):
    path = scratch_path(spark, "catalogue-json")
    spark.createDataFrame(catalogue_rows(), CATALOGUE).write.json(path)
    return signals_long(event_frames(spark, sf_dir), load_catalogue(spark, path, "json"))


@query("kept_in_memory")
def query_kept_in_memory(spark, sf_dir):
    kept = run_capture(event_frames(spark, sf_dir), event_catalogue(spark), parse_id_list(ID_LIST), count=FRAME_LIMIT)
    return kept.select("capture_id", "seq", "can_id", "data_hex")


@query("json_extra")
def query_json_extra(spark, sf_dir):
    """Nested extra fields: bytes become hex, dates become text."""
    path = scratch_path(spark, "json-extra")
    pairs = F.array(F.substring("data", 1, 1), F.substring("data", 2, 1))
    extra = F.struct(F.col("data").alias("raw"), pairs.alias("pair"), F.to_date("ts").alias("day"), F.col("dlc").alias("size"))
    frames = event_frames(spark, sf_dir).withColumn("more", extra)
    sinks.create("json", path=path, extra=["seq", "more"]).write(frames)
    stored = spark.read.schema("seq long, more struct<raw: string, pair: array<string>, day: string, size: int>").json(path)
    return stored.select("seq", "more.raw", F.array_join("more.pair", "-").alias("pair"), "more.day", "more.size")


@query("signal_quartiles")
def query_signal_quartiles(spark, sf_dir):
    """Whether the quartiles of each signal lie within their rank error."""
    accuracy = 1_000
    long = signals_long(event_frames(spark, sf_dir), event_catalogue(spark))
    found = signals.signal_summary(long, accuracy=accuracy).select("signal", "samples", F.posexplode("quartiles").alias("quartile", "at"))
    ranks = long.select("signal", "value").join(F.broadcast(found), "signal").groupBy("signal", "samples", "quartile").agg(
        F.count_if(F.col("value") < F.col("at")).alias("below"), F.count_if(F.col("value") <= F.col("at")).alias("until")
    )
    wanted = F.element_at(F.array(*[F.lit(q) for q in QUARTILES]), F.col("quartile") + 1) * F.col("samples")
    slack = F.col("samples") / accuracy + 1
    return ranks.select("signal", "quartile", ((F.col("below") <= wanted + slack) & (F.col("until") >= wanted - slack)).alias("within"))


@query("store_signals")
def query_store_signals(spark, sf_dir):
    root = scratch_path(spark, "store-signals")
    write_store(event_frames(spark, sf_dir), event_catalogue(spark), root)
    stored = spark.read.schema("capture_id string, seq long, can_id_dec long, signal string, value double, label string").parquet(f"{root}/signals")
    return stored.select("capture_id", "seq", "can_id_dec", "signal", "value", "label")


@query("store_pruned_scan")
def query_store_pruned_scan(spark, sf_dir):
    """A scan by signal and value and one by time, both of signals stored along the curve."""
    root = scratch_path(spark, "store-interleaved")
    write_store(event_frames(spark, sf_dir), event_catalogue(spark), root, layout="interleaved")
    stored = spark.read.schema("capture_id string, seq long, timestamp double, signal string, value double").parquet(f"{root}/signals")
    by_value = stored.where((F.col("signal") == "Value") & F.col("value").between(*VALUE_RANGE)).withColumn("scan", F.lit("value"))
    by_time = stored.where(F.col("timestamp").between(*TIME_RANGE)).withColumn("scan", F.lit("time"))
    return by_value.unionByName(by_time)


@query("quality_flags")
def query_quality_flags(spark, sf_dir):
    """The report over frames whose flags differ."""
    seq = F.col("seq")
    raw = pack_events(read_events(spark, sf_dir)).withColumns({"is_error": seq % 11 == 0, "is_remote": seq % 13 == 0})
    report = quality.quality_report(normalise(raw), event_catalogue(spark))
    return report.select("capture_id", "can_id_dec", "frames", "error_frames", "remote_frames", "invalid_frames")


@query("signals_long_payload")
def query_signals_long_payload(spark, sf_dir):
    """The event signals behind other bytes, in payloads of 12 to 64 bytes."""
    place = F.coalesce(*[F.when(F.col("can_id_dec") == i, F.lit(n)) for i, n in LEADING_BYTES.items()], F.lit(0))
    frames = event_frames(spark, sf_dir).withColumn("data", F.concat(F.unhex(F.repeat(F.lit("A5"), place)), F.col("data")))
    rows = [(*row[:4], row[4] + 8 * LEADING_BYTES[row[0]], *row[5:]) for row in catalogue_rows()]
    return signals_long(frames, prepare_catalogue(spark.createDataFrame(rows, CATALOGUE)))
