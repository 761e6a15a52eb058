"""Fixed schemas of the frame, signal and catalogue tables."""

from __future__ import annotations

from pyspark.sql import types as T

# One row per frame as it arrives from whatever logs the bus.
RAW_FRAME = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("can_id_dec", T.LongType()),
        T.StructField("dlc", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("is_extended", T.BooleanType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
    ]
)

# The normalised frame record.
FRAME = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("can_id", T.StringType()),
        T.StructField("can_id_dec", T.LongType()),
        T.StructField("dlc", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("data_hex", T.StringType()),
        T.StructField("data_bytes", T.ArrayType(T.IntegerType())),
        T.StructField("is_extended", T.BooleanType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("is_error", T.BooleanType()),
    ]
)

# One row per signal of the signal database.
CATALOGUE = T.StructType(
    [
        T.StructField("message_id", T.LongType()),
        T.StructField("message_name", T.StringType()),
        T.StructField("cycle_time_ms", T.IntegerType()),
        T.StructField("signal", T.StringType()),
        T.StructField("start_bit", T.IntegerType()),
        T.StructField("bit_length", T.IntegerType()),
        T.StructField("byte_order", T.StringType()),
        T.StructField("is_signed", T.BooleanType()),
        T.StructField("scale", T.DoubleType()),
        T.StructField("offset", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("mux_signal", T.StringType()),
        T.StructField("mux_value", T.LongType()),
        T.StructField("choices", T.MapType(T.LongType(), T.StringType())),
        T.StructField("is_integer", T.BooleanType()),
    ]
)

# One pass/fail rule on a signal; a null bound is open.
RULE = T.StructType(
    [
        T.StructField("rule", T.StringType()),
        T.StructField("signal", T.StringType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
    ]
)

# Columns every wide (one column per signal) output starts with.
BASE_COLUMNS = ["timestamp", "can_id", "dlc", "data_hex"]
