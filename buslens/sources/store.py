"""Partitioned Parquet store of captures: frames, signals and captures tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.operators.stats import capture_manifest
from buslens.schemas import RAW_FRAME
from buslens.sources.catalogue import Catalogue
from buslens.sources.layout import interleaved

FRAME_ORDER = ["capture_id", "can_id_dec", "timestamp", "seq"]
SIGNAL_ORDER = ["capture_id", "signal", "timestamp", "seq"]
# Written with every stored frame; files from before have none.
STORE_VERSION = 1
VERSION_FIELD = T.StructField("store_version", T.IntegerType())


def clustered(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition and sort for storage.

    Files are balanced even if one capture holds most rows, and min/max
    statistics let later scans skip row groups of other IDs or signals.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


LAYOUTS = {"clustered": lambda signals: clustered(signals, SIGNAL_ORDER), "interleaved": interleaved}


def frame_rows(frames: DataFrame, cluster: bool = True) -> DataFrame:
    """The stored columns of frames; derived ones are computed again on reading."""
    rows = frames.select(*RAW_FRAME.fieldNames())
    rows = clustered(rows, FRAME_ORDER) if cluster else rows
    return rows.withColumn(VERSION_FIELD.name, F.lit(STORE_VERSION))


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite", cluster: bool = True) -> None:
    """Store frames; captures that are there already are replaced, others stay. ``append`` adds to captures instead."""
    by_capture(frame_rows(frames, cluster), mode).parquet(path)


def by_capture(rows: DataFrame, mode: str):
    """A writer that keeps to the captures that ``rows`` hold."""
    return rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("capture_id")


def write_store(frames: DataFrame, catalogue: Catalogue | None, root: str, mode: str = "overwrite", layout: str = "clustered") -> None:
    """Write frames, decoded signals and one metadata row per capture, each replacing what the captures had.

    The ``clustered`` layout sorts signals by name and time. ``interleaved`` also lets
    scans by value skip row groups; it reads the frames twice more to find its steps.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}, one of {', '.join(LAYOUTS)}")
    write_frames(frames, f"{root}/frames", mode)
    by_capture(LAYOUTS[layout](signals_long(frames, catalogue)), mode).parquet(f"{root}/signals")
    by_capture(capture_manifest(frames), mode).parquet(f"{root}/captures")


def read_frames(spark: SparkSession, path: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Frames of any stored version, brought onto the current schema.

    Columns that older files lack become null or the given default. Files of
    the current version have all columns, so a null stored there stays null.
    Columns that are no longer known are left out.
    """
    # With the schema given, absent columns read as null and the capture folder
    # as text; inferring it would turn a capture named 007 into 7.
    stored = spark.read.schema(T.StructType([*RAW_FRAME.fields, VERSION_FIELD])).parquet(path)
    older = F.col(VERSION_FIELD.name).isNull()
    for name, value in (defaults or {}).items():
        default = F.lit(value).cast(RAW_FRAME[name].dataType)
        stored = stored.withColumn(name, F.when(older, F.coalesce(name, default)).otherwise(F.col(name)))
    return normalise(stored.select(*RAW_FRAME.fieldNames()))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Select ``df`` onto ``schema``; a column that ``df`` lacks gets its default or null."""
    columns = []
    for field in schema.fields:
        column = F.col(field.name) if field.name in df.columns else F.lit(defaults.get(field.name))
        columns.append(column.cast(field.dataType).alias(field.name))
    return df.select(*columns)
