"""Captures and streams that run more than once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from buslens.functions.ids import id_from_text, parse_id_list
from buslens.operators import limits, quality, select
from buslens.operators.normalise import normalise
from buslens.plans.capture import run_capture
from buslens.scale import folders, lookup_join, scratch_dir
from buslens.sinks import sinks
from buslens.sources.frames import read_capture, stream_raw
from buslens.sources.store import read_frames, write_frames
from buslens.streaming.capture import start_capture
from tests.conftest import raw_row

ONCE = {"availableNow": True}


def rows(capture, count, start=0):
    return [raw_row(start + k, 10.0 + start + k, 0x100 + k % 3, bytes([k % 256]), capture=capture) for k in range(count)]


def test_captures_share_a_folder(make_raw, spark, tmp_path):
    for capture, count in (("c1", 4), ("d", 3), ("c1", 2)):
        run_capture(normalise(make_raw(*rows(capture, count))), formats=["csv", "json", "txt"], output_dir=str(tmp_path))
    for fmt in ("csv", "json"):
        stored = read_capture(spark, f"{tmp_path}/{fmt}", fmt).groupBy("capture_id").count()
        assert {r[0]: r[1] for r in stored.collect()} == {"c1": 2, "d": 3}
    manifest = spark.read.schema("capture_id string, frame_count long").json(f"{tmp_path}/manifest")
    assert {r.capture_id: r.frame_count for r in manifest.collect()} == {"c1": 2, "d": 3}


def test_csv_is_in_arrival_order(make_raw, spark, tmp_path):
    frames = normalise(make_raw(*rows("c1", 200))).repartition(5, F.rand(1))
    sinks.create("csv", path=str(tmp_path / "out")).write(frames)
    files = sorted((tmp_path / "out" / "capture_id=c1").glob("part-*"))
    times = [float(line.split(",")[0]) for f in files for line in f.read_text().splitlines()[1:]]
    assert times == [10.0 + k for k in range(200)]


def test_a_stream_goes_on_where_it_stopped(make_raw, spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    counts = []
    for n in range(10):
        make_raw(*rows("c1", 5, 5 * n)).coalesce(1).write.mode("append").parquet(landing)
        before = len(folders(spark, scratch_dir(spark)))
        frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=1))
        targets = {"txt": sinks.create("txt", path=f"{out}/txt"), "csv": sinks.create("csv", path=f"{out}/csv")}
        start_capture(frames, targets, count=32, checkpoint=f"{out}/state", trigger=ONCE).wait()
        after = len(folders(spark, scratch_dir(spark)))
        counts.append((after - before, len(folders(spark, f"{out}/state-progress")), len(folders(spark, f"{out}/txt/_totals"))))
    assert counts[-1] == counts[5] and counts[-1][0] == 0 and max(counts[-1]) <= 4
    lines = [r.value for r in spark.read.schema("value string, batch_id int, capture_id string").format("text").load(f"{out}/txt").collect()]
    assert sorted(int(line[1:6]) for line in lines) == list(range(1, 33))


def test_a_new_checkpoint_for_old_output_is_refused(make_raw, spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    make_raw(*rows("c1", 3)).write.parquet(landing)
    start = lambda **more: start_capture(
        normalise(stream_raw(spark, landing)), {"csv": sinks.create("csv", path=out)}, trigger=ONCE, **more
    ).wait()
    start()
    start()
    assert read_capture(spark, out, "csv").count() == 3
    with pytest.raises(ValueError, match="another checkpoint"):
        start(checkpoint=str(tmp_path / "other"))


def test_count_limit_equals_numbering(make_raw):
    odd = [raw_row(k, t, 1, b"") for k, t in enumerate([5.0, None, float("nan"), 100.0, None, -70.0, float("nan"), 5.0, 1e9, float("inf")])]
    frames = normalise(make_raw(*odd))
    numbered = limits.number_frames(frames).collect()
    for n in range(1, 12):
        kept = {r.seq for r in limits.limit_count(frames, n).collect()}
        assert kept == {r.seq for r in numbered if r.frame_num <= n}


def test_copies_without_sequence_keep_their_fields(make_raw):
    frames = normalise(make_raw(*[raw_row(None, 1.0, 1, b"ab")] * 3, raw_row(None, 2.0, 1, b"", error=True)))
    kept = sorted(quality.drop_duplicate_frames(frames).collect(), key=lambda r: r.timestamp)
    assert [(r.dlc, r.is_error, r.seq) for r in kept] == [(2, False, None), (0, True, None)]


def test_stored_nulls_survive_defaults(make_raw, spark, tmp_path):
    path = str(tmp_path / "frames")
    old = make_raw(raw_row(1, 1.0, 1, b"")).drop("is_error")
    old.write.partitionBy("capture_id").parquet(path)
    write_frames(make_raw(raw_row(2, 2.0, 1, b"")).withColumn("is_error", F.lit(None).cast("boolean")), path, mode="append")
    found = {r.seq: r.is_error for r in read_frames(spark, path, defaults={"is_error": True}).collect()}
    assert found == {1: True, 2: None}


def test_time_window_reaches_the_scan(make_raw, spark, tmp_path):
    path = str(tmp_path / "frames")
    write_frames(make_raw(*rows("c1", 50)), path)
    kept = select.by_time(read_frames(spark, path), "1970-01-01 00:00:20", "1970-01-01 00:00:30")
    assert sorted(r.seq for r in kept.collect()) == list(range(10, 20))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp," in plan and "LessThan(timestamp," in plan


def test_dotted_signal_names_come_back(spark, tmp_path, make_raw, make_catalogue):
    from tests.conftest import signal_row

    catalogue = make_catalogue(signal_row(0x100, "Eng.RPM"))
    sinks.create("csv", path=str(tmp_path), catalogue=catalogue).write(normalise(make_raw(raw_row(1, 1.0, 0x100, b"\x07"))))
    assert read_capture(spark, str(tmp_path), "csv", ["Eng.RPM"]).collect()[0]["Eng.RPM"] == "7"


def test_long_identifiers(spark):
    texts = ["0x" + "0" * 30 + "1F", "0" * 40 + "12", "0xFFFFFFFFFFFFFFFFF", "9" * 30, "0x0", "-5", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(id_from_text(F.col("t")).alias("i"))
    assert [r.i for r in df.collect()] == [31, 12, None, None, 0, -5, None]
    assert parse_id_list("0x" + "0" * 30 + "1F, " + "0" * 40 + "12") == [31, 12]
    with pytest.raises(ValueError):
        parse_id_list("9" * 30)


def test_salted_join_works_on_streams(make_raw, spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    make_raw(*rows("c1", 30)).write.parquet(landing)
    names = spark.createDataFrame([(0x100, "a"), (0x101, "b")], "can_id_dec long, name string")
    joined = lookup_join(stream_raw(spark, landing), names, ["can_id_dec"], "inner", small_fits=False)
    query = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(**ONCE).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 20
