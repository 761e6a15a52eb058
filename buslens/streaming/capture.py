"""Continuous capture: landed frames to every sink until stopped."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from buslens.operators.select import by_ids
from buslens.operators.stats import capture_stats
from buslens.scale import folders, scratch_path, scratch_scope
from buslens.sinks.fanout import SinkErrors, fan_out
from buslens.sinks.registry import FrameSink
from buslens.streaming.ledger import SinkLedger
from buslens.streaming.progress import CaptureProgress


class CaptureRun:
    """A running capture: its query, running totals and sink errors."""

    def __init__(self, targets: dict[str, FrameSink], fail_on_error: bool, limits: dict, progress: CaptureProgress, ledger: SinkLedger):
        self.query: StreamingQuery | None = None
        self.frames = 0
        self.errors: dict[str, Exception] = {}
        self._targets, self._fail, self._started = targets, fail_on_error, time.time()
        self._limits, self._progress, self._ledger = limits, progress, ledger

    def write_batch(self, frames: DataFrame, batch_id: int) -> None:
        bounded = self._limits["duration"] or self._limits["count"]
        arrived = frames.persist(StorageLevel.MEMORY_AND_DISK) if bounded else frames
        try:
            with scratch_scope(frames.sparkSession):  # what a batch stores on the way goes with it
                kept = self._progress.select(arrived, batch_id, **self._limits)
                self._write(kept, batch_id)
                if bounded:
                    self._progress.advance(arrived, kept, batch_id)
        finally:
            if bounded:
                arrived.unpersist()

    def _write(self, kept: DataFrame, batch_id: int) -> None:
        targets = self._targets
        if not self._fail:
            # A sink that is behind gets this batch after those it missed.
            behind = self.catch_up(before=batch_id)
            targets = {name: sink for name, sink in targets.items() if name not in behind}
        try:
            counts = fan_out(kept, targets, batch_id, cache=True)
        except SinkErrors as failure:
            self.errors.update(failure.errors)
            if self._fail:
                raise
            counts = failure.counts
        for name in self._targets if not self._fail else []:
            if name not in counts:
                self._ledger.note(kept, name, batch_id)
            elif batch_id in self._ledger.missed(name):
                self._ledger.settle(name, batch_id, list(self._targets))
        self.frames += max(counts.values(), default=0)

    def catch_up(self, before: int | None = None) -> list[str]:
        """Bring the sinks what they missed, up to a batch; returns those that fail again."""
        behind = []
        for name, sink in self._targets.items():
            error = self._ledger.catch_up(name, sink, list(self._targets), before)
            if error is not None:
                self.errors[name] = error
                behind.append(name)
        return behind

    def missed(self) -> dict[str, list[int]]:
        """Batches that each sink still has to get."""
        return {name: self._ledger.missed(name) for name in self._targets}

    def stats(self) -> dict[str, object]:
        """Frames written by this run, seconds since its start and the rate."""
        elapsed = time.time() - self._started
        return {
            "frames": self.frames,
            "elapsed_seconds": elapsed,
            "fps": self.frames / elapsed if elapsed > 0 else 0.0,
            "formats": list(self._targets),
        }

    def stop(self) -> None:
        """Stop after the current batch; the checkpoint allows to resume."""
        if self.query is not None:
            self.query.stop()

    def wait(self, seconds: float | None = None) -> None:
        """Wait for the end of the run; sinks that are behind are then tried once more."""
        ended = self.query.awaitTermination(seconds)
        if not self._fail and (ended or seconds is None):
            self.catch_up()


def start_capture(
    frames: DataFrame,
    targets: dict[str, FrameSink],
    ids: list[int] | None = None,
    duration: float | None = None,
    count: int | None = None,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    fail_on_error: bool = True,
) -> CaptureRun:
    """Start writing a streaming frames table to all targets.

    The limits work per capture as in the batch plan, but over all batches; a
    capture that reached its limit adds nothing more, and the stream goes on
    for the others. ``trigger`` defaults to every 10 seconds;
    ``{"availableNow": True}`` makes a bounded run over what has landed. With
    ``fail_on_error`` a batch whose sink failed stops the run and is replayed
    on resume, otherwise the error is recorded, the run goes on, and the sink
    gets the batch later: before its next one, or when the capture starts again.

    Without ``checkpoint`` the run keeps its state below the first target's
    path, so that starting it again goes on where it stopped. A new checkpoint
    for an output that holds batches already is refused: its batches would mix
    with those of the earlier run.
    """
    spark = frames.sparkSession
    places = sorted(t.path for t in targets.values() if t.path is not None)
    # Targets without a path store nothing that could be written twice.
    checkpoint = checkpoint or (f"{places[0].rstrip('/')}/_checkpoint" if places else scratch_path(spark, "capture"))
    if "offsets" not in folders(spark, checkpoint):
        for place in places:
            if any(name.startswith("batch_id=") for name in folders(spark, place)):
                raise ValueError(f"{place} holds batches of a run with another checkpoint than {checkpoint}")
    limits = {"ids": ids, "duration": duration, "count": count}
    # Beside the checkpoint, so that a resumed run finds both.
    progress = CaptureProgress(f"{checkpoint.rstrip('/')}-progress")
    ledger = SinkLedger(spark, f"{checkpoint.rstrip('/')}-ledger")
    run = CaptureRun(targets, fail_on_error, limits, progress, ledger)
    if not fail_on_error:
        run.catch_up()
    if not duration and not count:
        # Without limits the ID filter reaches the scan of the source.
        frames = by_ids(frames, ids)
    run.query = (
        frames.writeStream.foreachBatch(run.write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .start()
    )
    return run


def running_totals(frames: DataFrame) -> DataFrame:
    """Frames, elapsed event time and rate since the start of each capture.

    The aggregation of :func:`capture_stats` as a stream with output mode
    ``complete``; its state is one row per capture.
    """
    return capture_stats(frames)


def run_to_table(
    rows: DataFrame, path: str, checkpoint: str | None = None, mode: str = "append"
) -> None:
    """Process what has landed and append the result to a Parquet folder."""
    query = (
        rows.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(rows.sparkSession, "stream"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
