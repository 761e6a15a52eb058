"""Batches that a sink of a running capture has missed, so that it gets them later.

A sink that fails does not stop the others. Its batch is stored once beside the
checkpoint and noted in the sink's ledger. From then on its batches queue up: each
new one first brings the earlier ones, in order, and only a sink without open
entries is written to directly. So a sink that counts on over batches sees them as
if nothing had happened, and what it missed outlives the run.

An entry is removed after its batch is written. A crash in between writes that
batch again, which replaces the same folder.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from buslens.operators.normalise import normalise
from buslens.scale import delete, folders, make_folder
from buslens.schemas import RAW_FRAME
from buslens.sinks.registry import FrameSink

log = logging.getLogger(__name__)


class SinkLedger:
    """Open entries per sink below ``root``: ``open/<sink>/batch=N``, with the frames in ``frames/batch=N``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def missed(self, sink: str) -> list[int]:
        """Batches that the sink still has to get, in order."""
        names = folders(self.spark, f"{self.root}/open/{sink}")
        return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))

    def note(self, frames: DataFrame, sink: str, batch_id: int) -> None:
        """Keep a batch for the sink. The frames come first, so that no entry is without them."""
        if "_SUCCESS" not in folders(self.spark, self._frames(batch_id)):
            frames.select(*RAW_FRAME.fieldNames()).write.mode("overwrite").parquet(self._frames(batch_id))
        make_folder(self.spark, f"{self.root}/open/{sink}/batch={batch_id}")

    def settle(self, sink: str, batch_id: int, others: list[str]) -> None:
        """Close an entry; the frames go with the last sink that needs them."""
        delete(self.spark, f"{self.root}/open/{sink}/batch={batch_id}")
        if not any(batch_id in self.missed(other) for other in others if other != sink):
            delete(self.spark, self._frames(batch_id))

    def catch_up(self, name: str, sink: FrameSink, others: list[str], before: int | None = None) -> Exception | None:
        """Write what the sink missed, in order, until it fails again; returns that failure."""
        for batch_id in self.missed(name):
            if before is not None and batch_id >= before:
                break
            try:
                stored = self.spark.read.schema(RAW_FRAME).parquet(self._frames(batch_id))
                sink.write(normalise(stored), batch_id)
            except Exception as error:  # the entry stays open
                log.error("sink %s failed again: %s", name, str(error).splitlines()[0])
                return error
            self.settle(name, batch_id, others)
        return None

    def _frames(self, batch_id: int) -> str:
        return f"{self.root}/frames/batch={batch_id}"
