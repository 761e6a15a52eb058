"""The same frames to several sinks."""

from __future__ import annotations

import logging

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from buslens.sinks.registry import FrameSink

log = logging.getLogger(__name__)


class SinkErrors(RuntimeError):
    """Some sinks failed; the others have finished."""

    def __init__(self, errors: dict[str, Exception], counts: dict[str, int]):
        super().__init__("; ".join(f"{name}: {str(e).splitlines()[0]}" for name, e in errors.items()))
        self.errors, self.counts = errors, counts


def fan_out(
    frames: DataFrame, targets: dict[str, FrameSink], batch_id: int | None = None, cache: bool = False
) -> dict[str, int]:
    """Write ``frames`` to every target and return the frames per target.

    A failing sink does not stop the others; all errors are raised at the end.
    Each write reads only the columns its sink needs, so a table scan is
    repeated rather than cached. ``cache`` is for inputs that are costly to
    compute again, such as micro-batches.
    """
    if cache:
        frames = frames.persist(StorageLevel.MEMORY_AND_DISK)
    counts: dict[str, int] = {}
    errors: dict[str, Exception] = {}
    try:
        for name, sink in targets.items():
            try:
                counts[name] = sink.write(frames, batch_id)
            except Exception as error:  # reported below, after the other sinks
                log.error("sink %s failed: %s", name, str(error).splitlines()[0])
                errors[name] = error
    finally:
        if cache:
            frames.unpersist()
    if errors:
        raise SinkErrors(errors, counts)
    return counts
