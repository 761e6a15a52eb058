"""Frame sources: landed raw frames, batch or stream, and stored captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buslens.functions.ids import id_from_text
from buslens.operators.normalise import event_time, normalise
from buslens.schemas import BASE_COLUMNS, FRAME, RAW_FRAME

# Fields of a newline-delimited JSON capture record.
RECORD = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("can_id", T.StringType()),
        T.StructField("can_id_dec", T.LongType()),
        T.StructField("dlc", T.IntegerType()),
        T.StructField("data_hex", T.StringType()),
        T.StructField("data_bytes", T.ArrayType(T.IntegerType())),
        T.StructField("is_extended", T.BooleanType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("parsed", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)
# Raw frames landed as text carry the payload as hex.
TEXT_FRAME = T.StructType(
    [T.StructField("data_hex", T.StringType()) if f.name == "data" else f for f in RAW_FRAME.fields]
)


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed raw frames as one batch. CSV and JSON hold the payload in ``data_hex``."""
    return _payload(_raw_reader(spark.read, fmt).load(path))


def stream_raw(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Landed raw frames as a stream; new files in the folder extend it."""
    return _payload(_raw_reader(spark.readStream.options(**options), fmt).load(path))


def _raw_reader(reader, fmt: str):
    if fmt == "parquet":
        return reader.schema(RAW_FRAME).format(fmt)
    return reader.schema(TEXT_FRAME).option("header", fmt == "csv").format(fmt)


def _payload(frames: DataFrame) -> DataFrame:
    if "data" not in frames.columns:
        frames = frames.withColumn("data", bytes_from_hex(F.col("data_hex")))
    return frames.select(*RAW_FRAME.fieldNames())


def bytes_from_hex(text: Column) -> Column:
    """Hex text with or without spaces to BINARY; null text is an empty payload."""
    return F.unhex(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit("")))


def read_capture(
    spark: SparkSession, path: str, fmt: str, signals: list[str] | None = None, partitioned: bool = True
) -> DataFrame:
    """Scan a stored capture lazily as frame records.

    ``csv``      base columns plus one text column for each of ``signals``
    ``json``     newline-delimited records; ``parsed`` as a map of texts
    ``parquet``  raw frame columns; derived ones are computed again

    The capture is the ``capture_id=…`` folder, or without ``partitioned`` the
    name of the file, as in a folder with one file per capture.
    """
    if fmt == "parquet":
        stored = spark.read.schema(RAW_FRAME).parquet(path)
        return normalise(stored)
    if fmt == "json":
        return _from_records(_scan(spark, path, RECORD, partitioned, lambda r: r.format("json")))
    if fmt == "csv":
        names = signals or []
        schema = T.StructType(
            [f for f in RECORD.fields if f.name in BASE_COLUMNS]
            + [T.StructField(name, T.StringType()) for name in names]
        )
        scan = _scan(
            spark, path, schema, partitioned,
            lambda r: r.format("csv").option("header", True).option("enforceSchema", False),
        )
        return _from_cells(scan, names)
    raise ValueError(f"cannot read captures in format {fmt!r}")


def _scan(spark: SparkSession, path: str, schema: T.StructType, partitioned: bool, fmt) -> DataFrame:
    if partitioned:
        schema = T.StructType([*schema.fields, T.StructField("capture_id", T.StringType())])
        return fmt(spark.read.schema(schema)).load(path)
    base_name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return fmt(spark.read.schema(schema)).load(path).withColumn("capture_id", base_name)


def _from_records(records: DataFrame) -> DataFrame:
    return records.withColumns(
        {"data": bytes_from_hex(F.col("data_hex")), "ts": event_time(F.col("timestamp"))}
    ).select(*FRAME.fieldNames(), "parsed")


def _from_cells(cells: DataFrame, names: list[str]) -> DataFrame:
    unknown = F.lit(None)
    raw = cells.withColumns(
        {
            "seq": unknown.cast("bigint"),
            "can_id_dec": id_from_text(F.col("can_id")),
            "data": bytes_from_hex(F.col("data_hex")),
            "is_extended": unknown.cast("boolean"),
            "is_remote": unknown.cast("boolean"),
            "is_error": unknown.cast("boolean"),
        }
    )
    return normalise(raw, extra=names)
