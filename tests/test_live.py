"""Numbering by pieces, hot keys, spans and copies on streams, runs of violations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from buslens import scale
from buslens.operators import limits, quality, rules
from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.plans import live_queries
from buslens.plans.event_frames import event_frames
from buslens.schemas import RAW_FRAME, RULE
from buslens.sinks import sinks
from buslens.sources.frames import read_capture, stream_raw
from buslens.streaming.capture import run_to_table
from buslens.streaming.monitor import live_spans, span_gaps, without_live_copies
from tests.conftest import raw_row, signal_row
from tests.test_order import arrival, skewed_rows

ODD_TIMES = [None, float("nan"), float("inf"), float("-inf"), -3.5, 1e300]


def expected_numbers(rows):
    def place(row):
        t, seq = row[2], row[1]
        kind = 0 if t is None else 2 if t != t else 1
        return kind, t if kind == 1 else 0, seq is not None, seq or 0

    out: dict = {}
    for row in sorted(rows, key=place):
        out.setdefault(row[0], []).append(row)
    return {(c, r[1]): k for c, some in out.items() for k, r in enumerate(some, 1)}


@pytest.mark.parametrize("heavy", [1_000_000, 100, 7])
def test_numbers_whatever_is_split(spark, monkeypatch, heavy):
    monkeypatch.setattr(limits, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(limits, "PIECE_ROWS", max(2, heavy // 2))
    monkeypatch.setattr(limits, "CUTS", 16)
    rows = skewed_rows(n=1500) + [raw_row(5000 + k, t, 1, b"", capture=c) for k, t in enumerate(ODD_TIMES * 12) for c in ("hot", None, "")]
    rows += [raw_row(9000, 7.0, 1, bytes([k % 256, k // 256]), capture="copies") for k in range(400)]
    numbered = limits.number_frames(spark.createDataFrame(rows, RAW_FRAME)).collect()
    got = [(r.capture_id, r.seq, r.frame_num) for r in numbered if r.capture_id != "copies"]
    want = expected_numbers([r for r in rows if r[0] != "copies"])
    assert sorted(got, key=str) == sorted(((c, seq, n) for (c, seq), n in want.items()), key=str)
    assert sorted(r.frame_num for r in numbered if r.capture_id == "copies") == list(range(1, 401))


def test_numbering_moves_frames_once_and_stores_none(spark, monkeypatch):
    written = []
    store = scale.materialise
    monkeypatch.setattr(limits, "materialise", lambda df, label: written.append(df.columns) or store(df, label))
    rows = skewed_rows(n=300)
    numbered = limits.number_frames(spark.createDataFrame(rows, RAW_FRAME))
    assert written and all("data" not in columns and "seq" not in columns for columns in written)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(moves) == 1 and "Window" not in plan
    # Out of the slices in the order of arrival.
    order = [(r.capture_id or "", r.frame_num) for r in numbered.collect()]
    assert order == sorted(order)
    assert len(order) == sum(len(some) for some in arrival(rows).values())


def test_numbers_of_nothing(spark):
    assert limits.number_frames(spark.createDataFrame([], RAW_FRAME)).collect() == []


def test_only_hot_keys_are_copied(spark):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(5_000).select(F.col("id").alias("k"), F.lit("x").alias("name"))
    hot = scale.hot_keys(big, ["k"], 64)
    assert len(hot) == 1
    assert scale._copies(small, ["k"], hot, 64).count() == 5_000 + 63
    assert scale._copies(small, ["k"], None, 64).count() == 5_000 * 64
    joined = scale.lookup_join(big, small, ["k"], "left", small_fits=False)
    assert joined.count() == 30_000 and joined.where("name IS NOT NULL").count() == big.where("k < 5000").count()


def test_hot_null_keys(spark):
    big = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id")).cast("long").alias("k"), F.lit(None).cast("int").alias("n"))
    small = spark.createDataFrame([(None, None, "none"), (5, None, "five")], "k long, n int, name string")
    safe = scale.lookup_join(big, small, ["k", "n"], "inner", small_fits=False, null_safe=True)
    assert {(r.name, r["count"]) for r in safe.groupBy("name").count().collect()} == {("none", 1500), ("five", 1)}
    assert scale.lookup_join(big.limit(0), small, ["k", "n"], "left", small_fits=False).count() == 0


def land(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, RAW_FRAME).coalesce(1).write.mode("append").parquet(path)


def test_spans_equal_gaps_over_restarts(spark, make_catalogue, tmp_path):
    catalogue = make_catalogue(signal_row(1, "x", cycle_time_ms=100), signal_row(2, "x", cycle_time_ms=1000), signal_row(3, "x"))
    rnd = random.Random(3)
    rows = [raw_row(k, round(1000 + k * 0.06 + rnd.choice([0, 0, 0.2]), 3), rnd.choice([1, 1, 2, 3, 4]), b"\x01", capture=rnd.choice(["a", None])) for k in range(900)]
    rows.append(raw_row(5000, 1200.0, 1, b"\x01", capture="a"))
    landing, out, state = (str(tmp_path / n) for n in ("landing", "spans", "state"))
    for part in (rows[:300], rows[300:]):
        land(spark, landing, part)
        frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=1))
        run_to_table(live_spans(frames, catalogue, delay="5 seconds"), out, checkpoint=state)
    spans = spark.read.parquet(out)
    columns = ["capture_id", "can_id_dec", "seq", "previous_seq", "cycle_time_ms"]
    got = {tuple(r) for r in span_gaps(spans).select(*columns).collect()}
    batch = quality.missing_frames(normalise(spark.createDataFrame(rows, RAW_FRAME)), catalogue)
    # The last frame leaves its own span open, and the gap before it.
    want = {tuple(r) for r in batch.where("seq < 5000").select(*columns).collect()}
    assert got == want and len(want) > 20
    assert spans.agg(F.sum("frames")).first()[0] == sum(r[3] in (1, 2) for r in rows) - 1


def test_copies_in_other_batches_and_runs(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("landing", "rows", "state"))
    first = [raw_row(k, 100.0 + k, k % 3, bytes([k])) for k in range(20)]
    again = [raw_row(1000 + k, 100.0 + k, k % 3, bytes([k])) for k in range(10, 20)]
    other = [raw_row(2000, 119.0, 1, b"other"), raw_row(2001, 119.0, 2, bytes([19]))]
    for part in (first, again + again, other):
        land(spark, landing, part)
        frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=1))
        run_to_table(without_live_copies(frames, "60 seconds"), out, checkpoint=state)
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == [*range(20), 2000, 2001]


def plain_runs(samples, low, high, least):
    runs, run = [], []
    for t, seq, value in [*sorted(samples), (None, None, 0.0)]:
        if t is not None and (value < low or value > high):
            run.append((t, seq))
        elif run:
            if run[-1][0] - run[0][0] >= least:
                runs.append((run[0][0], run[0][1], run[-1][0]))
            run = []
    return runs


@pytest.mark.parametrize("least", [0.0, 3.0])
def test_runs_of_violations(spark, make_catalogue, least):
    rnd = random.Random(9)
    rows = [raw_row(k, float(rnd.randint(0, 900)), 1, bytes([rnd.choice([1, 9, 9, 9])]), capture=rnd.choice(["a", "a", "b", None])) for k in range(1200)]
    frames, catalogue = spark.createDataFrame(rows, RAW_FRAME), make_catalogue(signal_row(1, "x"))
    table = spark.createDataFrame([("high", "x", None, 5.0), ("never", "x", 0.0, 99.0)], RULE)
    found = rules.sustained_violations(signals_long(frames, catalogue), table, least).collect()
    want = set()
    for capture in ("a", "b", None):
        samples = [(r[2], r[1], r[5][0]) for r in rows if r[0] == capture]
        want |= {(capture, "high", *run) for run in plain_runs(samples, 0.0, 5.0, least)}
    assert {(r.capture_id, r.rule, r.first_violation, r.first_seq, r.last_violation) for r in found} == want and want


def test_rule_scan_reads_ruled_messages_only(spark, make_catalogue, tmp_path):
    path = str(tmp_path / "frames")
    spark.createDataFrame([raw_row(1, 1.0, 1, b"\x01"), raw_row(2, 1.0, 2, b"\x01")], RAW_FRAME).write.parquet(path)
    catalogue = make_catalogue(signal_row(1, "x"), signal_row(2, "y"))
    table = spark.createDataFrame([("r", "x", None, 5.0)], RULE)
    plan = rules.check_frames(spark.read.schema(RAW_FRAME).parquet(path), catalogue, table)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(can_id_dec,1)" in plan or "In(can_id_dec, [1])" in plan


def test_capture_written_again_replaces_itself(spark, make_raw, tmp_path):
    path = str(tmp_path / "store")
    sink = sinks.create("parquet", path=path)
    sink.write(normalise(make_raw(raw_row(1, 1.0, 1, b"\x01"), raw_row(2, 2.0, 1, b"\x02"), raw_row(3, 1.0, 1, b"\x03", capture="c2"))))
    sink.write(normalise(make_raw(raw_row(4, 1.0, 1, b"\x04"))))
    assert sorted(r.seq for r in read_capture(spark, path, "parquet").collect()) == [3, 4]


def test_payload_lengths(spark, make_raw):
    frames = normalise(make_raw(*[raw_row(n, 1.0, 1, bytes(n)) for n in range(80)]))
    assert sorted(r.seq for r in quality.valid_frames(frames).collect()) == [*range(9), 12, 16, 20, 24, 32, 48, 64]
    assert sorted(r.seq for r in quality.valid_frames(frames, classic=True).collect()) == list(range(9))
    reasons = {r.seq: r.reasons for r in quality.quarantined_frames(frames).collect()}
    assert reasons[13] == ["no length of a frame"] and reasons[65] == ["payload too long"]


def test_landed_parts_are_batches_of_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live_queries, "LANDED_ROWS", 10)
    files = live_queries.landed_files(spark.range(100), 2)
    assert files == 5 and live_queries.landed_files(spark.range(0), 2) == 1
    landing, seen = str(tmp_path / "landing"), []
    for rows in (60, 0, 3):
        live_queries.land(spark.range(rows), landing, files)
    full = {r.name for r in spark.read.parquet(landing).select(F.col("_metadata.file_name").alias("name")).where("id >= 3").collect()}
    assert len(full) == files  # one task did all of a part before
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", files).parquet(landing)
    run = stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / "state"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert seen == [60, 0, 3]


@pytest.mark.parametrize("name", ["stream_sink_catches_up", "stream_without_duplicates", "store_compacted"])
def test_captures_landed_in_many_files(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(live_queries, "LANDED_ROWS", 40)
    landings = []
    write = live_queries.land
    monkeypatch.setattr(live_queries, "land", lambda rows, landing, files: (landings.append((landing, files)), write(rows, landing, files)))
    found = live_queries.__dict__[f"query_{name}"](spark, sf_dir)
    assert all(files > 1 for _, files in landings)
    assert live_queries.landed(found, landings[0][0]) == sum(files for _, files in landings)
    frames = event_frames(spark, sf_dir)
    by = ["capture_id"] if name == "stream_sink_catches_up" else ["capture_id", "seq"]
    assert sorted(map(tuple, found.select(*by).collect())) == sorted(map(tuple, frames.select(*by).collect()))
