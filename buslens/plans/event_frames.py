"""Frames and a catalogue derived from the ``events`` table.

The packing rule is deterministic, so a SQL oracle can recompute every signal
from the source columns without decoding anything.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buslens.operators.normalise import normalise
from buslens.schemas import CATALOGUE, RAW_FRAME
from buslens.sources.catalogue import Catalogue, prepare_catalogue

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

# Identifier of each event type.
EVENT_IDS = {"click": 256, "view": 512, "purchase": 291, "error": 1110, "signup": 419385573}

# Message, cycle time, signal, start, length, order, signed, scale, offset, mux, labels.
MESSAGES = {256: ("MsgA", 100), 512: ("MsgB", 100), 291: ("MsgC", 20), 1110: ("MsgD", None)}
SIGNALS = [
    (256, "Value", 0, 16, "le", False, 0.01, 0.0, None, None, None),
    (256, "K", 16, 8, "le", False, 1.0, -40.0, None, None, None),
    (512, "UserId", 31, 16, "be", False, 1.0, 0.0, None, None, None),
    (512, "Trim", 40, 16, "le", True, 0.1, 0.0, None, None, None),
    (291, "Sel", 56, 1, "le", False, 1.0, 0.0, None, None, {0: "even", 1: "odd"}),
    (291, "Value", 0, 16, "le", False, 0.01, 0.0, "Sel", 0, None),
    (291, "Trim", 40, 16, "le", True, 0.1, 0.0, "Sel", 1, None),
    (1110, "Value", 0, 16, "le", False, 0.01, 0.0, None, None, None),
    (1110, "UserId", 31, 16, "be", False, 1.0, 0.0, None, None, None),
]


def catalogue_rows() -> list[tuple]:
    rows, position = [], {}
    for message, signal, start, length, order, signed, scale, offset, mux, mux_value, labels in SIGNALS:
        name, cycle = MESSAGES[message]
        place = position[message] = position.get(message, -1) + 1
        rows.append(
            (message, name, cycle, signal, start, length, order, signed, scale, offset, None, place,
             "int", mux, mux_value, labels, scale == 1.0)
        )
    return rows


def event_catalogue(spark: SparkSession) -> Catalogue:
    """The catalogue of the event messages, prepared once per session."""
    return _prepared(spark, spark.sparkContext.applicationId)


@lru_cache(maxsize=1)
def _prepared(spark: SparkSession, application: str) -> Catalogue:
    return prepare_catalogue(spark.createDataFrame(catalogue_rows(), CATALOGUE))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def pack_events(events: DataFrame) -> DataFrame:
    """Raw frames from event rows; works on batch and streaming tables."""
    cents = F.round(F.col("value") * 100).cast("bigint").bitwiseAND(F.lit(65535))
    k = F.get_json_object("props", "$.k").cast("bigint")
    trim = (F.col("event_id") * 7 % 20001 - 10000).bitwiseAND(F.lit(65535))
    user = F.col("user_id")

    def byte(value, place: int):
        return F.shiftleft(value.bitwiseAND(F.lit(255)), 56 - 8 * place)

    cells = [
        byte(cents, 0), byte(F.shiftright(cents, 8), 1), byte(k, 2),
        byte(F.shiftright(user, 8), 3), byte(user, 4),
        byte(trim, 5), byte(F.shiftright(trim, 8), 6), byte(F.col("event_id"), 7),
    ]
    word = cells[0]
    for cell in cells[1:]:
        word = word.bitwiseOR(cell)
    can_id = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(i)) for t, i in EVENT_IDS.items()])
    instant = F.col("ts").cast("timestamp")
    full = F.unhex(F.lpad(F.hex(word), 16, "0"))
    dlc = F.when(F.col("event_type") == "error", 4).otherwise(8)
    return events.select(
        F.date_format(instant, "yyyy-MM-dd").alias("capture_id"),
        F.col("event_id").alias("seq"),
        (F.unix_micros(instant) / 1e6).alias("timestamp"),
        can_id.cast("bigint").alias("can_id_dec"),
        dlc.alias("dlc"),
        F.substring(full, F.lit(1), dlc).alias("data"),
        (can_id > 2047).alias("is_extended"),
        F.lit(False).alias("is_remote"),
        F.lit(False).alias("is_error"),
    ).select(*RAW_FRAME.fieldNames())


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised frames of the ``events`` table."""
    return normalise(pack_events(read_events(spark, sf_dir)))
