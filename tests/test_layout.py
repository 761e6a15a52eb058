"""The interleaved storage layout of signals."""

from __future__ import annotations

import math

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from buslens.sources.layout import BITS, CURVE, interleave, interleaved, with_curve
from buslens.sources.store import SIGNAL_ORDER, clustered, write_store

ROWS = 80_000
SIGNALS = "capture_id string, seq long, timestamp double, signal string, value double, label string"


@pytest.fixture(scope="module")
def signals(spark):
    """Four signals in one capture, one of them with half of the rows, values in no order of time."""
    k = F.col("id")
    name = F.when(k % 2 == 0, F.lit("Speed")).otherwise(F.concat(F.lit("S"), (k % 3).cast("string")))
    value = F.pmod(F.xxhash64(k), F.lit(100_000)) / 100
    return spark.range(ROWS).select(F.lit("c").alias("capture_id"), k.alias("seq"), (k / 100).alias("timestamp"), name.alias("signal"), value.alias("value"), F.lit(None).cast("string").alias("label"))


def read_share(folder, column, low, high, signal=None):
    """The share of rows in row groups that statistics do not rule out."""
    read = total = 0
    for file in folder.glob("**/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for group in (meta.row_group(k) for k in range(meta.num_row_groups)):
            stats = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
            total += group.num_rows
            met = stats[column].min <= high and stats[column].max >= low
            if met and (signal is None or stats["signal"].min <= signal <= stats["signal"].max):
                read += group.num_rows
    assert total == ROWS
    return read / total


def test_both_scans_skip_row_groups(signals, tmp_path):
    for name, rows in (("clustered", clustered(signals, SIGNAL_ORDER)), ("interleaved", interleaved(signals))):
        rows.write.option("parquet.block.size", 8 * 1024).option("parquet.enable.dictionary", "false").parquet(str(tmp_path / name))
    by_value = {name: read_share(tmp_path / name, "value", 400.0, 410.0, "Speed") for name in ("clustered", "interleaved")}
    by_time = {name: read_share(tmp_path / name, "timestamp", 100.0, 108.0) for name in ("clustered", "interleaved")}
    assert by_value["clustered"] > 0.45 and by_value["interleaved"] < by_value["clustered"] / 2
    assert by_time["interleaved"] < 0.4


def test_the_curve_takes_bits_in_turn(spark):
    row = spark.range(1).select(interleave([F.lit(0b101), F.lit(0b011), F.lit(0b110)], 3).alias("key")).first()
    assert row.key == 0b101011110


def test_odd_values_and_keys_stay(spark):
    rows = [
        (None, None, None, "A", None, None), (None, 1, 2.0, "A", math.nan, "x"), ("c", 1, math.nan, "B", 1.0, None), ("c", 1, math.nan, "B", 1.0, None),
        ("c", 2, 5.0, "Ä ö", math.inf, None), ("d", 3, -1.0, "A", -math.inf, ""), ("d", 4, 1.0, None, 2.0, None),
    ]
    df = spark.createDataFrame(rows, SIGNALS)
    placed = with_curve(df)
    assert placed.columns == [*df.columns, CURVE] and placed.where(F.col(CURVE).isNull() | (F.col(CURVE) >= 1 << 3 * BITS)).isEmpty()
    assert sorted(map(str, interleaved(df).collect())) == sorted(map(str, df.collect()))
    assert interleaved(spark.createDataFrame([], SIGNALS)).collect() == []


def test_one_value_everywhere(signals):
    same = signals.withColumns({"value": F.lit(1.0), "timestamp": F.lit(2.0)})
    assert interleaved(same).count() == ROWS


def test_unknown_layout(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown layout"):
        write_store(spark.range(1), None, str(tmp_path), layout="heap")
