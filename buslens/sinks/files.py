"""Built-in sinks: CSV, NDJSON, text, Parquet and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.functions.text import float_text_sql, frame_line, json_number_sql, json_safe
from buslens.operators.decode import frames_wide, signal_texts, signals_json
from buslens.operators.limits import number_frames
from buslens.operators.normalise import moved_narrow
from buslens.scale import lookup_join
from buslens.schemas import BASE_COLUMNS
from buslens.sinks.registry import FrameSink, sinks
from buslens.sources.store import frame_rows
from buslens.streaming.progress import last_state, store_state

# Fields of a JSON record, in order.
RECORD_COLUMNS = [
    "timestamp", "can_id", "can_id_dec", "dlc", "data_hex", "data_bytes",
    "is_extended", "is_remote", "is_error",
]
ARRIVAL = ["capture_id", "timestamp", "seq"]


class FolderSink(FrameSink):
    """Files below ``path``, one ``capture_id=…`` folder per capture.

    A batch replaces the captures it holds and leaves all others in the folder.
    ``ordered`` sorts frames by arrival over all part files, at the price of a
    range partitioning; without it no frame is shuffled.
    """

    def __init__(self, path, catalogue=None, ordered: bool = True, mode: str = "overwrite"):
        super().__init__(path, catalogue)
        self.ordered, self.mode = ordered, mode

    def arranged(self, frames: DataFrame) -> DataFrame:
        if not self.ordered:
            return frames
        return moved_narrow(
            frames, lambda rows: rows.repartitionByRange(*ARRIVAL).sortWithinPartitions(*ARRIVAL)
        )

    def writer(self, rows: DataFrame, batch_id: int | None):
        # A replayed micro-batch replaces its own folder, and all of that.
        mode = self.mode if batch_id is None else "overwrite"
        replaced = "dynamic" if batch_id is None else "static"
        return rows.write.mode(mode).option("partitionOverwriteMode", replaced).partitionBy("capture_id")


@sinks.register("csv")
class CsvSink(FolderSink):
    """Base columns plus one sorted column per expected signal, ``\\r\\n`` rows."""

    def prepare(self, frames, batch_id):
        return csv_rows(self.arranged(frames), self.catalogue)

    def save(self, rows, path, batch_id):
        # Missing signals and empty payloads are both empty cells.
        self.writer(rows, batch_id).options(header=True, lineSep="\r\n", emptyValue="").csv(path)


def csv_rows(frames: DataFrame, catalogue) -> DataFrame:
    wide = frames_wide(frames, catalogue, keep=["capture_id", *BASE_COLUMNS], as_text=True)
    return wide.withColumn("timestamp", F.expr(float_text_sql("timestamp")))


@sinks.register("json")
class NdjsonSink(FolderSink):
    """One JSON record per frame with all fields; a null ``parsed`` is kept.

    ``extra`` columns are written behind the record.
    """

    def __init__(self, path, catalogue=None, extra: list[str] | None = None, **options):
        super().__init__(path, catalogue, **options)
        self.extra = extra or []

    def prepare(self, frames, batch_id):
        return json_records(self.arranged(frames), self.catalogue, self.extra)

    def save(self, rows, path, batch_id):
        self.writer(rows, batch_id).option("ignoreNullFields", False).json(path)


def json_records(frames: DataFrame, catalogue, extra: list[str] | None = None) -> DataFrame:
    """Records whose numbers print as in a capture file; one JSON parse each for time and signals."""
    extras = [json_safe(F.col(c), frames.schema[c].dataType).alias(c) for c in extra or []]
    seconds = f"({float_text_sql('timestamp')})"
    return signals_json(frames, catalogue).select(
        "capture_id",
        F.expr(f"parse_json({json_number_sql(seconds)})").alias("timestamp"),
        *RECORD_COLUMNS[1:],
        F.parse_json(F.col("parsed_json")).alias("parsed"),
        *extras,
    )


@sinks.register("txt")
class TextSink(FolderSink):
    """One console line per frame with its arrival number in the capture."""

    def __init__(self, path, catalogue=None, show_signals: bool = True, mode: str = "overwrite"):
        super().__init__(path, catalogue, mode=mode)
        self.show_signals = show_signals

    def prepare(self, frames, batch_id):
        rows = number_frames(frames)
        if batch_id is not None:
            earlier = self._totals(frames, batch_id).select("capture_id", "before")
            rows = lookup_join(rows, earlier, ["capture_id"], "inner", null_safe=True)
            rows = rows.withColumn("frame_num", F.col("frame_num") + F.col("before"))
        lines = text_lines(rows, self.catalogue, self.show_signals)
        return lines.sortWithinPartitions("capture_id", "frame_num").select("capture_id", "line")

    def save(self, rows, path, batch_id):
        self.writer(rows, batch_id).text(path)

    def _totals(self, frames: DataFrame, batch_id: int) -> DataFrame:
        """Frames per capture up to this micro-batch; one small table per batch.

        Every table holds all captures so far, so only the last one is read.
        """
        spark, root = frames.sparkSession, f"{self.path}/_totals"
        last = last_state(spark, root, batch_id, "capture_id string, before bigint, frames bigint")
        past = last.select("capture_id", (F.col("before") + F.col("frames")).alias("before"), F.lit(0).alias("frames"))
        now = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("frames"))
        both = past.unionByName(now.withColumn("before", F.lit(0)))
        totals = both.groupBy("capture_id").agg(F.sum("before").alias("before"), F.sum("frames").alias("frames"))
        return store_state(totals, root, batch_id)


def text_lines(numbered: DataFrame, catalogue, show_signals: bool = True) -> DataFrame:
    """``capture_id, frame_num, line`` from frames with ``frame_num``."""
    shown = None
    if show_signals:
        numbered = signal_texts(numbered, catalogue)
        shown = F.transform("texts", lambda s: F.concat(s["signal"], F.lit("="), s["text"]))
    line = frame_line(F.col("frame_num"), F.col("ts"), F.col("can_id"), F.col("dlc"), F.col("data_hex"), shown)
    return numbered.select("capture_id", "frame_num", line.alias("line"))


@sinks.register("parquet")
class ParquetSink(FolderSink):
    """Raw frame columns, partitioned by capture and clustered by ID and time."""

    def __init__(self, path, catalogue=None, cluster: bool = True, mode: str = "overwrite"):
        super().__init__(path, catalogue, mode=mode)
        self.cluster = cluster

    def prepare(self, frames, batch_id):
        return frame_rows(frames, self.cluster)

    def save(self, rows, path, batch_id):
        self.writer(rows, batch_id).parquet(path)


@sinks.register("count")
class CountSink(FrameSink):
    """Counts frames and writes nothing."""

    def save(self, rows, path, batch_id):
        rows.write.format("noop").mode("overwrite").save()
