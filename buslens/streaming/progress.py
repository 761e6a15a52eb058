"""What a running capture has seen and kept so far, per ``capture_id``.

A small table per micro-batch holds all captures, so only the last one is read.
Writing it again for a replayed batch gives the same content.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buslens.operators.limits import number_frames
from buslens.operators.select import by_ids
from buslens.scale import delete, folders, lookup_join

SCHEMA = "capture_id string, start double, kept bigint"


def last_state(spark: SparkSession, root: str, batch_id: int, schema: str) -> DataFrame:
    """Table that the latest batch before ``batch_id`` left below ``root``.

    Usually that is the batch just before; it is not if a sink joined the run
    later or failed for a batch. Empty if there is none at all.
    """
    read = spark.read.schema(schema)
    try:
        return read.parquet(f"{root}/batch={batch_id - 1}")
    except AnalysisException:
        pass
    try:
        states = spark.read.schema(f"{schema}, batch bigint").parquet(root)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    earlier = states.where(F.col("batch") < batch_id)
    newest = earlier.agg(F.max("batch").alias("batch")).first().batch
    return earlier.where(F.col("batch") == newest).drop("batch")


def store_state(state: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Write the state after ``batch_id`` and return it as stored.

    The two newest states before it stay, so that this batch can be replayed;
    older ones are removed.
    """
    spark, path = state.sparkSession, f"{root}/batch={batch_id}"
    state.write.mode("overwrite").parquet(path)
    known = sorted(int(name.removeprefix("batch=")) for name in folders(spark, root) if name.startswith("batch="))
    for old in [n for n in known if n < batch_id][:-2]:
        delete(spark, f"{root}/batch={old}")
    return spark.read.schema(state.schema).parquet(path)


class CaptureProgress:
    """Running start time and number of kept frames of every capture."""

    def __init__(self, path: str):
        self.path = path

    def before(self, frames: DataFrame, batch_id: int) -> DataFrame:
        """State before ``batch_id``; empty for the first batch."""
        return last_state(frames.sparkSession, self.path, batch_id, SCHEMA)

    def advance(self, frames: DataFrame, kept: DataFrame, batch_id: int) -> None:
        """Store the state after ``batch_id`` from its arrived and its kept frames."""
        arrived = frames.groupBy("capture_id").agg(F.min("timestamp").alias("start"), F.lit(0).alias("kept"))
        counted = kept.groupBy("capture_id").agg(
            F.lit(None).cast("double").alias("start"), F.count(F.lit(1)).alias("kept")
        )
        both = arrived.unionByName(counted).withColumn("old", F.lit(False))
        both = both.unionByName(self.before(frames, batch_id).withColumn("old", F.lit(True)))
        # The clock of a capture keeps the start it had in its first batch.
        after = both.groupBy("capture_id").agg(
            F.coalesce(F.min(F.when(F.col("old"), F.col("start"))), F.min("start")).alias("start"),
            F.sum("kept").alias("kept"),
        )
        store_state(after, self.path, batch_id)

    def select(
        self, frames: DataFrame, batch_id: int, ids: list[int] | None, duration: float | None, count: int | None
    ) -> DataFrame:
        """Apply duration limit, ID filter and count limit across batches."""
        if not duration and not count:
            return by_ids(frames, ids)
        before = self.before(frames, batch_id).withColumnsRenamed({"start": "_start", "kept": "_kept"})
        rows = frames
        if duration:
            arrived = frames.groupBy("capture_id").agg(F.min("timestamp").alias("_first"))
            rows = lookup_join(rows, arrived, ["capture_id"], "inner", null_safe=True)
            rows = lookup_join(rows, before.select("capture_id", "_start"), ["capture_id"], "left", null_safe=True)
            rows = rows.where(F.col("timestamp") - F.coalesce("_start", "_first") <= duration)
            rows = rows.select(*frames.columns)
        rows = by_ids(rows, ids)
        if count:
            rows = number_frames(rows, "_number")
            rows = lookup_join(rows, before.select("capture_id", "_kept"), ["capture_id"], "left", null_safe=True)
            rows = rows.where(F.col("_number") + F.coalesce("_kept", F.lit(0)) <= count).select(*frames.columns)
        return rows
