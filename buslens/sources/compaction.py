"""Folding the micro-batches of a running capture into the clustered store.

A live capture leaves one ``batch_id=N`` folder per micro-batch, each with small
files. ``fold`` writes what has gathered as one clustered round and removes those
folders. Each round first notes its batches, then writes its frames; the frames
count once their job has committed. A run that was interrupted is finished by the
next one with the batches it had noted, so that every batch is folded once, and
``read_folded`` sees every frame once at any time in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buslens.operators.normalise import normalise
from buslens.scale import delete, folders
from buslens.schemas import RAW_FRAME
from buslens.sources.store import frame_rows

BATCH, ROUND = "batch_id=", "round="


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(name.removeprefix(prefix)) for name in folders(spark, path) if name.startswith(prefix))


class Folding:
    """The rounds of a store: ``noted/round=K`` lists batches, ``frames/round=K`` holds their frames."""

    def __init__(self, spark: SparkSession, live: str, root: str):
        self.spark, self.live, self.root = spark, live, root

    def noted(self) -> dict[int, list[int]]:
        """Batches of every round; a round whose note was not finished does not count."""
        rounds = _numbers(self.spark, f"{self.root}/noted", ROUND)
        paths = {k: f"{self.root}/noted/{ROUND}{k}" for k in rounds}
        done = {k: path for k, path in paths.items() if "_SUCCESS" in folders(self.spark, path)}
        return {k: [row.batch for row in self.spark.read.schema("batch long").json(path).collect()] for k, path in done.items()}

    def written(self, k: int) -> bool:
        return "_SUCCESS" in folders(self.spark, f"{self.root}/frames/{ROUND}{k}")

    def note(self, k: int, batches: list[int]) -> None:
        rows = self.spark.createDataFrame([(n,) for n in batches], "batch long")
        rows.coalesce(1).write.mode("overwrite").json(f"{self.root}/noted/{ROUND}{k}")

    def write(self, k: int, batches: list[int]) -> None:
        frames = self.batches(batches)
        frame_rows(frames).write.mode("overwrite").partitionBy("capture_id").parquet(f"{self.root}/frames/{ROUND}{k}")

    def batches(self, numbers: list[int]) -> DataFrame:
        """Raw frames of live batches."""
        stored = self.spark.read.schema(f"{RAW_FRAME.simpleString()[7:-1]}, batch_id long".replace(":", " ")).parquet(self.live)
        return stored.where(F.col("batch_id").isin(numbers)).select(*RAW_FRAME.fieldNames())

    def remove(self, batches: list[int]) -> None:
        for n in batches:
            delete(self.spark, f"{self.live}/{BATCH}{n}")


def fold(spark: SparkSession, live: str, root: str, keep_last: int = 0) -> list[int]:
    """Fold all batches below ``live`` but the ``keep_last`` newest; returns those folded now.

    Only one run may fold a store at a time. ``keep_last`` leaves batches that
    the capture may still write again after a failure: the newest one.
    """
    folding = Folding(spark, live, root)
    noted = folding.noted()
    folded: list[int] = []
    for k, batches in noted.items():
        if not folding.written(k):
            folding.write(k, batches)
            folded += batches
        folding.remove(batches)
    present = _numbers(spark, live, BATCH)
    waiting = present[: len(present) - keep_last]
    if waiting:
        k = max(noted, default=-1) + 1
        folding.note(k, waiting)
        folding.write(k, waiting)
        folding.remove(waiting)
    return folded + waiting


def read_folded(spark: SparkSession, live: str, root: str) -> DataFrame:
    """All frames of the capture: the rounds written, and the batches that are in none of them."""
    folding = Folding(spark, live, root)
    written = {k: batches for k, batches in folding.noted().items() if folding.written(k)}
    done = {n for batches in written.values() for n in batches}
    waiting = [n for n in _numbers(spark, live, BATCH) if n not in done]
    parts = [folding.batches(waiting)] if waiting else []
    if written:
        paths = [f"{root}/frames/{ROUND}{k}" for k in written]
        parts += [spark.read.schema(RAW_FRAME).parquet(path).select(*RAW_FRAME.fieldNames()) for path in paths]
    frames = parts[0] if parts else spark.createDataFrame([], RAW_FRAME)
    for part in parts[1:]:
        frames = frames.unionByName(part)
    return normalise(frames)
