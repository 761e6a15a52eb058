"""Plans must not move frames, and must prune and filter at the scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from buslens.operators import quality, select, stats
from buslens.operators.decode import decode, frames_wide, signal_texts, signals_long
from buslens.operators.normalise import normalise
from buslens.sinks.files import csv_rows, json_records
from buslens.sources.store import read_frames, write_frames
from tests.conftest import raw_row, signal_row


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves_frames(text):
    """Exchanges other than broadcasts."""
    return re.findall(r"^.*\bExchange .*$", text, re.M)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "frames")
    from buslens.schemas import RAW_FRAME

    rows = [raw_row(i, float(i), 1 + i % 4, bytes([i % 256, 2])) for i in range(500)]
    write_frames(spark.createDataFrame(rows, RAW_FRAME), path)
    return path


@pytest.fixture
def catalogue(make_catalogue):
    return make_catalogue(
        signal_row(1, "a"), signal_row(2, "b"), signal_row(2, "c", 8), signal_row(3, "S"),
        signal_row(3, "m", mux_signal="S", mux_value=1),
    )


def test_decoding_never_shuffles(spark, stored, catalogue):
    frames = read_frames(spark, stored)
    for build in (signals_long, decode, signal_texts, frames_wide, csv_rows, json_records):
        text = plan(build(frames, catalogue))
        assert "BroadcastHashJoin" in text and not moves_frames(text), build.__name__


def test_filters_reach_the_scan(spark, stored, catalogue):
    frames = select.by_ids(read_frames(spark, stored), [1, 2])
    for df in (decode(frames, catalogue), signals_long(frames, catalogue), frames_wide(frames, catalogue)):
        assert re.search(r"PushedFilters: \[.*In\(can_id_dec, \[1,2\]\)", plan(df))
    # Asking for one signal reads only the messages that carry it.
    assert "EqualTo(can_id_dec,2)" in plan(signals_long(read_frames(spark, stored), catalogue, ["b"]))
    assert "PartitionFilters: [isnotnull(capture_id" in plan(read_frames(spark, stored).where("capture_id = 'c1'"))


def test_only_needed_columns_are_read(spark, stored, catalogue):
    frames = read_frames(spark, stored)
    assert "ReadSchema: struct<timestamp:double>" in plan(stats.capture_stats(frames))
    long = plan(signals_long(frames, catalogue))
    assert "ReadSchema: struct<seq:bigint,timestamp:double,can_id_dec:bigint,data:binary>" in long
    wide = plan(frames_wide(frames, catalogue, keep=["timestamp"]))
    assert "ReadSchema: struct<timestamp:double,can_id_dec:bigint,data:binary>" in wide


def test_statistics_aggregate_before_the_shuffle(spark, stored, catalogue):
    frames = read_frames(spark, stored)
    for df in (stats.capture_stats(frames), stats.window_stats(frames), quality.duplicate_frames(frames)):
        text = plan(df)
        assert "partial_count" in text and len(moves_frames(text)) == 1


def test_removing_copies_hashes(spark, stored):
    text = plan(quality.drop_duplicate_frames(read_frames(spark, stored)))
    assert "SortAggregate" not in text and len(moves_frames(text)) == 1


def test_validation_is_a_plain_filter(spark, stored):
    good, bad = quality.split_valid(read_frames(spark, stored))
    for df in (good, bad):
        assert not moves_frames(plan(df)) and "Window" not in plan(df)


def test_no_python_in_the_core(spark, stored, catalogue):
    frames = normalise(read_frames(spark, stored))
    for df in (frames, decode(frames, catalogue), csv_rows(frames, catalogue), signals_long(frames, catalogue)):
        assert "Python" not in plan(df)


def test_wide_with_many_signals(spark, stored, make_catalogue):
    rows = [signal_row(1 + i % 4, f"s{i:03d}", i % 8, 8, position=i) for i in range(150)]
    wide = frames_wide(read_frames(spark, stored), make_catalogue(*rows), as_text=True)
    assert len(wide.columns) == 154
    filled = wide.select(F.sum(F.col("s000").isNotNull().cast("int")).alias("n")).first().n
    assert filled == 125
