from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.schemas import RAW_FRAME
from buslens.sinks import FrameSink, SinkErrors, sinks
from buslens.sources.frames import stream_raw
from buslens.streaming.capture import run_to_table, start_capture
from buslens.streaming.progress import last_state
from buslens.streaming.monitor import live_frame_stats, live_signal_stats
from tests.conftest import raw_row, signal_row

ONCE = {"availableNow": True}


@pytest.fixture
def landing(spark, tmp_path):
    """Land raw frames in a folder, one file per call."""
    path = str(tmp_path / "landing")

    def land(*rows):
        spark.createDataFrame(list(rows), RAW_FRAME).coalesce(1).write.mode("append").parquet(path)

    land.path = path
    return land


def frames_of(spark, landing):
    return normalise(stream_raw(spark, landing.path))


def lines(spark, path):
    table = spark.read.schema("value string, batch_id int, capture_id string").format("text").load(str(path))
    return sorted((r.capture_id, r.value) for r in table.collect())


def test_stream_equals_batch(spark, landing, make_catalogue, tmp_path):
    catalogue = make_catalogue(signal_row(1, "a"), signal_row(2, "b", 0, 16))
    rows = [raw_row(i, float(i), 1 + i % 3, bytes([i, 1])) for i in range(40)]
    landing(*rows[:25])
    landing(*rows[25:])
    run_to_table(signals_long(frames_of(spark, landing), catalogue), str(tmp_path / "out"))
    batch = signals_long(spark.createDataFrame(rows, RAW_FRAME), catalogue)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_in_memory_capture(spark, landing):
    landing(raw_row(1, 1.0, 1, b"\x01"))
    query = frames_of(spark, landing).writeStream.format("memory").queryName("kept").trigger(**ONCE).start()
    query.awaitTermination()
    assert spark.table("kept").first().data_hex == "01"


def test_capture_resumes_and_numbers_go_on(spark, landing, make_catalogue, tmp_path):
    catalogue = make_catalogue(signal_row(1, "a"))

    def run():
        targets = {f: sinks.create(f, path=str(tmp_path / f), catalogue=catalogue) for f in ("txt", "csv", "count")}
        capture = start_capture(frames_of(spark, landing), targets, ids=[1], checkpoint=str(tmp_path / "cp"), trigger=ONCE)
        capture.wait()
        capture.stop()
        return capture

    landing(raw_row(1, 1.0, 1, b"\x01"), raw_row(2, 2.0, 2, b"\x02"), raw_row(3, 3.0, 1, b"\x03"))
    assert run().stats()["frames"] == 2
    landing(raw_row(4, 4.0, 1, b"\x04"), raw_row(1, 9.0, 1, b"\x09", capture="d"))
    second = run().stats()
    assert second["frames"] == 2 and second["formats"] == ["txt", "csv", "count"] and second["fps"] > 0
    assert [(c, v[:7], v[-4:]) for c, v in lines(spark, tmp_path / "txt")] == [
        ("c1", "[    1]", " a=1"), ("c1", "[    2]", " a=3"), ("c1", "[    3]", " a=4"), ("d", "[    1]", " a=9"),
    ]


def test_last_state_skips_missing_batches(spark, tmp_path):
    root = str(tmp_path / "state")
    assert last_state(spark, root, 4, "k string").count() == 0
    for batch in (0, 2, 9):
        spark.createDataFrame([(f"b{batch}",)], "k string").write.parquet(f"{root}/batch={batch}")
    assert [last_state(spark, root, n, "k string").first() for n in (1, 2, 3, 5)] == [("b0",), ("b0",), ("b2",), ("b2",)]
    assert last_state(spark, root, 0, "k string").count() == 0


def test_limits_hold_across_batches(spark, landing, tmp_path):
    def run():
        targets = {"txt": sinks.create("txt", path=str(tmp_path / "txt"))}
        capture = start_capture(
            frames_of(spark, landing), targets, ids=[1], duration=10.0, count=3, checkpoint=str(tmp_path / "cp"), trigger=ONCE
        )
        capture.wait()
        return capture.frames

    landing(raw_row(1, 100.0, 2, b"\x00"), raw_row(2, 101.0, 1, b"\x01"))
    assert run() == 1
    landing(
        raw_row(3, 109.0, 1, b"\x02"), raw_row(4, 110.0, 1, b"\x03"), raw_row(5, 110.0, 1, b"\x04"),
        raw_row(1, 5.0, 1, b"\x05", capture="d"),
    )
    assert run() == 3
    landing(raw_row(2, 15.0, 1, b"\x06", capture="d"), raw_row(3, 15.5, 1, b"\x07", capture="d"), raw_row(6, 105.0, 1, b"\x08"))
    assert run() == 1
    kept = [(c, v.rsplit(" ", 1)[1]) for c, v in lines(spark, tmp_path / "txt")]
    assert kept == [("c1", "01"), ("c1", "02"), ("c1", "03"), ("d", "05"), ("d", "06")]


def test_failed_sink_is_replayed_once(spark, landing, tmp_path):
    class Flaky(FrameSink):
        broken = True

        def save(self, rows, path, batch_id):
            if Flaky.broken:
                raise OSError("not now")
            rows.write.mode("overwrite").parquet(path)

    def run(fail_on_error=True):
        targets = {"flaky": Flaky(str(tmp_path / "f")), "csv": sinks.create("csv", path=str(tmp_path / "csv"))}
        capture = start_capture(
            frames_of(spark, landing), targets, checkpoint=str(tmp_path / "cp"), trigger=ONCE, fail_on_error=fail_on_error
        )
        return capture

    landing(*[raw_row(i, float(i), 1, b"\x01") for i in range(5)])
    with pytest.raises(Exception, match="not now"):
        run().wait()
    Flaky.broken = False
    run().wait()
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    Flaky.broken = True
    landing(raw_row(9, 9.0, 1, b"\x01"))
    tolerant = run(fail_on_error=False)
    tolerant.wait()
    assert list(tolerant.errors) == ["flaky"] and tolerant.frames == 1
    assert isinstance(SinkErrors({"x": OSError("y")}, {}), RuntimeError)


def test_live_windows_close_with_the_watermark(spark, landing, make_catalogue, tmp_path):
    catalogue = make_catalogue(signal_row(1, "a"))
    rows = [raw_row(i, 1000.0 + i, 1, bytes([i])) for i in range(25)]
    landing(*rows)
    landing(raw_row(99, 2000.0, 1, b"\x63"))  # moves the watermark past all windows before
    run_to_table(live_frame_stats(frames_of(spark, landing)), str(tmp_path / "w"))
    windows = spark.read.parquet(str(tmp_path / "w")).orderBy("window_start").collect()
    assert [(r.frames, r.fps) for r in windows] == [(10, 1.0), (10, 1.0), (5, 0.5)]
    run_to_table(live_signal_stats(frames_of(spark, landing), catalogue), str(tmp_path / "s"))
    means = spark.read.parquet(str(tmp_path / "s")).orderBy("bucket_start").collect()
    assert [(r.samples, r.mean, r.low, r.high) for r in means] == [(10, 4.5, 0.0, 9.0), (10, 14.5, 10.0, 19.0), (5, 22.0, 20.0, 24.0)]


def test_late_frames_are_dropped(spark, landing, tmp_path):
    def run():
        run_to_table(live_frame_stats(frames_of(spark, landing)), str(tmp_path / "w"), str(tmp_path / "cp"))

    landing(raw_row(1, 1000.0, 1), raw_row(2, 1100.0, 1))
    run()
    landing(raw_row(3, 1001.0, 1), raw_row(4, 1101.0, 1), raw_row(5, 2000.0, 1))
    run()
    counts = spark.read.parquet(str(tmp_path / "w")).groupBy().agg(F.sum("frames").alias("n")).first().n
    assert counts == 3


def test_continuous_run_until_stopped(spark, landing, tmp_path):
    landing(raw_row(1, 1.0, 1, b"\x01"))
    capture = start_capture(
        frames_of(spark, landing), {"count": sinks.create("count")}, trigger={"processingTime": "1 second"},
        checkpoint=str(tmp_path / "cp"),
    )
    capture.query.processAllAvailable()
    landing(raw_row(2, 2.0, 1, b"\x01"))
    capture.query.processAllAvailable()
    assert capture.query.isActive
    capture.stop()
    assert not capture.query.isActive and capture.frames == 2
