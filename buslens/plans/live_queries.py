"""Registered queries on selector trees, silent identifiers, copies on streams and runs of violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from buslens.operators import quality, rules, signals
from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.plans.event_frames import event_catalogue, event_frames, pack_events, read_events, stream_events
from buslens.plans.queries import RULES, query
from buslens.scale import folders, scratch_path
from buslens.schemas import CATALOGUE, RULE
from buslens.sinks import sinks
from buslens.sinks.files import TextSink
from buslens.sources.catalogue import prepare_catalogue
from buslens.sources.compaction import Folding, fold, read_folded
from buslens.sources.frames import read_capture, stream_raw
from buslens.sources.store import read_frames, write_store
from buslens.streaming.capture import run_to_table, start_capture
from buslens.streaming.monitor import SPAN_KEYS, live_spans, span_gaps, without_live_copies

# Parameters shared with the SQL side.
LEAST_SECONDS, MOST_AGE = 600.0, 1800.0
QUARTILES, RANK_ERROR = (0.25, 0.5, 0.75), 0.03
PARTS_LANDED, COPY_DELAY = 4, "20 days"
# Rows of a landed file, so that tasks read and write a part together.
LANDED_ROWS = 250_000
# Message, signal, start, length, signed, selector, its value. Byte 7 is the low byte of the event's number.
TREE = [
    (291, "Kind", 56, 1, False, None, None),
    (291, "Value", 0, 16, False, "Kind", 0),
    (291, "Sub", 57, 1, False, "Kind", 1),
    (291, "Trim", 40, 16, True, "Sub", 0),
    (291, "K", 16, 8, False, "Sub", 1),
    (291, "Page", 58, 2, False, None, None),
    (291, "Low", 56, 8, False, "Page", 0),
    (291, "High", 24, 8, False, "Page", 1),
    (291, "User", 32, 8, False, "Page", 2),
    (1110, "Value", 0, 16, False, None, None),
    (1110, "Kind", 56, 1, False, None, None),
    (1110, "K", 16, 8, False, "Kind", 0),
    (512, "Page", 58, 2, False, None, None),
    (512, "Low", 56, 8, False, "Page", 0),
    (512, "High", 24, 8, False, "Page", 1),
    (512, "User", 32, 8, False, "Page", 2),
    (512, "K", 16, 8, False, "Page", 3),
    (256, "Value", 0, 16, False, None, None),
    (256, "Wide", 0, 70, False, None, None),
]


@query("signals_mux_nested")
def query_signals_mux_nested(spark, sf_dir):
    """Two selectors in one message, one with another below it; one message that cannot be decoded."""
    rows = [
        (message, f"Msg{message}", None, signal, start, length, "le", signed, 1.0, 0.0, None, place, "int", selector, value, None, True)
        for place, (message, signal, start, length, signed, selector, value) in enumerate(TREE)
    ]
    return signals_long(event_frames(spark, sf_dir), prepare_catalogue(spark.createDataFrame(rows, CATALOGUE)))


@query("catalogue_problems")
def query_catalogue_problems(spark, sf_dir):
    """Frames of the messages that a catalogue cannot decode, with the reason."""
    rows = [(256, "MsgA", None, "Wide", 0, 70, *["le", False, 1.0, 0.0, None, 0, "int", None, None, None, True]),
            (291, "MsgC", None, "x", 0, 8, *["le", False, 1.0, 0.0, None, 0, "int", "y", 1, None, True])]
    problems = prepare_catalogue(spark.createDataFrame(rows, CATALOGUE)).problems
    frames = event_frames(spark, sf_dir).groupBy(F.col("can_id_dec").alias("message_id")).agg(F.count(F.lit(1)).alias("frames"))
    return problems.join(frames, "message_id", "left")


@query("stream_gaps")
def query_stream_gaps(spark, sf_dir):
    path = scratch_path(spark, "spans")
    frames = normalise(pack_events(stream_events(spark, sf_dir)))
    run_to_table(live_spans(frames, event_catalogue(spark)), path)
    return span_gaps(spark.read.parquet(path)).withColumn("gap_seconds", F.round("gap_seconds", 6))


@query("stream_silences")
def query_stream_silences(spark, sf_dir):
    path = scratch_path(spark, "silences")
    frames = normalise(pack_events(stream_events(spark, sf_dir)))
    run_to_table(live_spans(frames, event_catalogue(spark)), path)
    return spark.read.parquet(path).select(*SPAN_KEYS, "frames", "first_timestamp", "last_timestamp", F.unix_micros("silent_from").alias("silent_from"))


def landed_files(events, parts):
    """How many files each of so many parts of the events lands as."""
    return max(1, -(-events.count() // (parts * LANDED_ROWS)))


def land(rows, landing, files):
    """Land a part as exactly so many files, so that as many of them per trigger are this part."""
    before = landed(rows, landing)
    (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(landing)
    # A task without rows writes no file, but for the first.
    for _ in range(files - (landed(rows, landing) - before)):
        rows.limit(0).coalesce(1).write.mode("append").parquet(landing)


def landed(rows, landing):
    return sum(name.endswith(".parquet") for name in folders(rows.sparkSession, landing))


@query("stream_without_duplicates")
def query_stream_without_duplicates(spark, sf_dir):
    """Every error frame lands a second time with the next part; the run is stopped and started between parts."""
    landing, path, state = (scratch_path(spark, name) for name in ("landing", "distinct", "distinct-state"))
    events = read_events(spark, sf_dir)
    raw, files = pack_events(events), landed_files(events, PARTS_LANDED)
    part = F.least(F.floor((F.dayofmonth(F.to_date("capture_id")) - 1) / 8), F.lit(PARTS_LANDED - 1))
    for k in range(PARTS_LANDED):
        copies = raw.where((part == k - 1) & (F.col("can_id_dec") == 1110)).withColumn("seq", F.col("seq") + 1_000_000_000)
        land(raw.where(part == k).unionByName(copies), landing, files)
        if k % 2:
            frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=files))
            run_to_table(without_live_copies(frames, COPY_DELAY), path, checkpoint=state)
    return spark.read.parquet(path).select("capture_id", "seq", "can_id", "data_hex")


@query("sink_parquet_twice")
def query_sink_parquet_twice(spark, sf_dir):
    """A capture written again replaces itself and no other."""
    path = scratch_path(spark, "twice")
    sink = sinks.create("parquet", path=path)
    frames = event_frames(spark, sf_dir)
    sink.write(frames)
    sink.write(frames.where(F.col("capture_id") < "2024-01-11"))
    return read_capture(spark, path, "parquet").select("capture_id", "seq", "timestamp", "can_id", "data_hex")


@query("store_twice")
def query_store_twice(spark, sf_dir):
    root, frames, catalogue = scratch_path(spark, "store-twice"), event_frames(spark, sf_dir), event_catalogue(spark)
    write_store(frames, catalogue, root)
    write_store(frames.where(F.col("capture_id") < "2024-01-11"), catalogue, root)
    captures = spark.read.schema("capture_id string, frame_count long").parquet(f"{root}/captures")
    stored = read_frames(spark, f"{root}/frames").groupBy("capture_id").agg(F.count("seq").alias("frames"))
    signals = spark.read.schema("capture_id string, value double").parquet(f"{root}/signals")
    samples = signals.groupBy("capture_id").agg(F.count("value").alias("samples"))
    return captures.join(stored, "capture_id", "full").join(samples, "capture_id", "full")


@query("valid_frames_fd")
def query_valid_frames_fd(spark, sf_dir):
    """Payloads of 8, 12, 13, 64 and 72 bytes: two of these are no length of a frame."""
    padding = F.element_at(F.array(*[F.lit(n) for n in (0, 4, 5, 56, 64)]), (F.col("seq") % 5 + 1).cast("int"))
    raw = pack_events(read_events(spark, sf_dir)).withColumn("data", F.concat("data", F.unhex(F.repeat(F.lit("00"), padding))))
    frames = normalise(raw.withColumn("dlc", F.length("data")))
    reasons = quality.with_reasons(frames)
    return reasons.select("capture_id", "seq", "dlc", F.array_join("reasons", "; ").alias("reasons"))


@query("rules_sustained")
def query_rules_sustained(spark, sf_dir):
    long = signals_long(event_frames(spark, sf_dir), event_catalogue(spark))
    found = rules.sustained_violations(long, spark.createDataFrame(RULES, RULE), LEAST_SECONDS)
    return found.withColumn("seconds", F.round("seconds", 6))


@query("signal_corr_asof")
def query_signal_corr_asof(spark, sf_dir):
    long = signals_long(event_frames(spark, sf_dir), event_catalogue(spark), ["Value", "Trim"])
    found = signals.signal_correlation_as_of(long, "Value", "Trim", MOST_AGE, ["capture_id"])
    return found.withColumn("correlation", F.round("correlation", 6))


@query("signals_asof")
def query_signals_asof(spark, sf_dir):
    long = signals_long(event_frames(spark, sf_dir), event_catalogue(spark), ["UserId", "K"])
    return signals.signals_as_of(long, "UserId", "K")


class UnsteadySink(TextSink):
    """A text sink that fails the first two times it is written to."""

    failures = 2

    def write(self, frames, batch_id=None):
        if self.failures:
            self.failures -= 1
            raise OSError("not reachable")
        return super().write(frames, batch_id)


@query("stream_sink_catches_up")
def query_stream_sink_catches_up(spark, sf_dir):
    """One of two sinks fails twice; in the end both have all batches, numbered on as if it had not."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "unsteady")
    events = read_events(spark, sf_dir)
    raw, files = pack_events(events), landed_files(events, PARTS_LANDED)
    part = F.least(F.floor((F.dayofmonth(F.to_date("capture_id")) - 1) / 8), F.lit(PARTS_LANDED - 1))
    for k in range(PARTS_LANDED):
        land(raw.where(part == k), landing, files)
    targets = {"txt": UnsteadySink(f"{path}/txt", event_catalogue(spark)), "parquet": sinks.create("parquet", path=f"{path}/parquet")}
    frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=files))
    run = start_capture(frames, targets, checkpoint=f"{path}/state", trigger={"availableNow": True}, fail_on_error=False)
    run.wait()
    lines = spark.read.schema("value string, batch_id int, capture_id string").format("text").load(f"{path}/txt")
    return lines.select("capture_id", F.col("value").alias("line"))


@query("store_compacted")
def query_store_compacted(spark, sf_dir):
    """Batches folded into the store in three runs, the second of which stops before and after its frames are written."""
    landing, live, root = (scratch_path(spark, name) for name in ("landing", "live", "compacted"))
    events = read_events(spark, sf_dir)
    raw, files = pack_events(events), landed_files(events, 2 * PARTS_LANDED)
    for k in range(2 * PARTS_LANDED):
        land(raw.where(F.col("seq") % (2 * PARTS_LANDED) == k), landing, files)
        if k % PARTS_LANDED == PARTS_LANDED - 1:
            frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=files))
            start_capture(frames, {"parquet": sinks.create("parquet", path=live, cluster=False)}, trigger={"availableNow": True}).wait()
            if k < PARTS_LANDED:
                fold(spark, live, root, keep_last=1)
    stopped = Folding(spark, live, root)
    stopped.note(1, [3, 4])
    stopped.note(2, [5])
    stopped.write(2, [5])
    fold(spark, live, root, keep_last=1)
    return read_folded(spark, live, root).select("capture_id", "seq", "timestamp", "can_id", "data_hex")


@query("signal_shifts")
def query_signal_shifts(spark, sf_dir):
    found = signals.signal_shifts(signals_long(event_frames(spark, sf_dir), event_catalogue(spark)))
    # Signals here have two decimals, so rounded sums are free of the noise of their order.
    after = F.col("samples") - F.col("samples_before")
    return found.withColumns({
        "mean_before": F.round(F.col("mean_before") * F.col("samples_before"), 3) / F.col("samples_before"),
        "mean_after": F.round(F.col("mean_after") * after, 3) / after,
    })


@query("sketch_rollup")
def query_sketch_rollup(spark, sf_dir):
    """Whether quantiles of days, merged from sketches of hours, lie within their rank error."""
    long = signals_long(event_frames(spark, sf_dir), event_catalogue(spark), ["Value", "K", "UserId"])
    hours = sketch_buckets_stored(spark, long)
    days = signals.sketch_rollup(hours, "1 day", QUARTILES).select(
        "capture_id", "signal", F.col("samples").alias("total"), F.posexplode("quantiles").alias("quartile", "at")
    )
    ranks = long.select("capture_id", "signal", "value").join(F.broadcast(days), ["capture_id", "signal"]).groupBy(
        "capture_id", "signal", "total", "quartile"
    ).agg(F.count_if(F.col("value") < F.col("at")).alias("below"), F.count_if(F.col("value") <= F.col("at")).alias("until"))
    wanted = F.element_at(F.array(*[F.lit(q) for q in QUARTILES]), F.col("quartile") + 1) * F.col("total")
    slack = F.col("total") * RANK_ERROR + 1
    within = (F.col("below") <= wanted + slack) & (F.col("until") >= wanted - slack)
    return ranks.select("capture_id", "signal", F.col("total").alias("samples"), "quartile", within.alias("within"))


def sketch_buckets_stored(spark, long):
    path = scratch_path(spark, "sketches")
    signals.sketch_buckets(long, "1 hour").write.parquet(path)
    return spark.read.parquet(path)
