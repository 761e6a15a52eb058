"""The whole capture as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from buslens.operators.limits import limit_count, limit_duration
from buslens.operators.select import by_ids
from buslens.operators.stats import capture_manifest
from buslens.sinks.fanout import fan_out
from buslens.sinks.registry import sinks
from buslens.sources.catalogue import Catalogue


def select_frames(
    frames: DataFrame,
    ids: list[int] | None = None,
    duration: float | None = None,
    count: int | None = None,
) -> DataFrame:
    """Duration limit, then ID filter, then count limit; whichever comes first."""
    return limit_count(by_ids(limit_duration(frames, duration), ids), count)


def run_capture(
    frames: DataFrame,
    catalogue: Catalogue | None = None,
    ids: list[int] | None = None,
    duration: float | None = None,
    count: int | None = None,
    formats: list[str] | None = None,
    output_dir: str = "data",
) -> DataFrame | dict[str, int]:
    """Select frames and write them in every format below ``output_dir``.

    Captures that the folder holds already stay, unless they are written again.
    Beside the records of ``json`` goes ``manifest``, one row per capture.
    Without formats nothing is written and the lazy table is returned.
    """
    kept = select_frames(frames, ids, duration, count)
    if not formats:
        return kept
    targets = {f: sinks.create(f, path=f"{output_dir}/{f}", catalogue=catalogue) for f in formats}
    counts = fan_out(kept, targets)
    if "json" in formats:
        rows = capture_manifest(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("capture_id").json(f"{output_dir}/manifest")
    return counts
