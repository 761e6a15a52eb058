"""Sinks that fail and catch up, folding of batches, as-of pairs, level shifts and merged sketches."""

from __future__ import annotations

import bisect
import random
import re

import pytest
from pyspark.sql import functions as F

from buslens.operators import signals
from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.scale import folders
from buslens.schemas import RAW_FRAME
from buslens.sinks.files import ParquetSink, TextSink
from buslens.sources.compaction import Folding, fold, read_folded
from buslens.sources.frames import stream_raw
from buslens.streaming.capture import start_capture
from tests.conftest import raw_row, signal_row


def unsteady(kind, failures):
    class Sink(kind):
        left = failures

        def write(self, frames, batch_id=None):
            if self.left:
                self.left -= 1
                raise OSError("not reachable")
            return super().write(frames, batch_id)

    return Sink


def land(spark, path, rows):
    spark.createDataFrame(rows, RAW_FRAME).coalesce(1).write.mode("append").parquet(path)


def capture(spark, landing, targets, state, fail_on_error=False):
    frames = normalise(stream_raw(spark, landing, maxFilesPerTrigger=1))
    run = start_capture(frames, targets, checkpoint=state, trigger={"availableNow": True}, fail_on_error=fail_on_error)
    run.wait()
    return run


def line_numbers(spark, path):
    lines = spark.read.schema("value string, batch_id int, capture_id string").format("text").load(path).collect()
    return sorted(int(re.match(r"\[ *(\d+)\]", r.value).group(1)) for r in lines)


def test_sinks_catch_up_in_order_and_over_restarts(spark, tmp_path):
    landing, state, text, store = (str(tmp_path / n) for n in ("landing", "state", "txt", "parquet"))
    for k in range(3):
        land(spark, landing, [raw_row(10 * k + i, float(10 * k + i), 1, b"\x01") for i in range(4)])
    # Both miss batch 0; the text sink misses all batches of this run.
    targets = {"txt": unsteady(TextSink, 9)(text), "parquet": unsteady(ParquetSink, 1)(store)}
    run = capture(spark, landing, targets, state)
    assert run.missed() == {"txt": [0, 1, 2], "parquet": []} and set(run.errors) == {"txt", "parquet"}
    assert spark.read.schema(RAW_FRAME).parquet(store).count() == 12
    assert sorted(folders(spark, f"{state}-ledger/frames")) == ["batch=0", "batch=1", "batch=2"]
    land(spark, landing, [raw_row(30, 30.0, 1, b"\x01")])
    run = capture(spark, landing, {"txt": unsteady(TextSink, 1)(text), "parquet": ParquetSink(store)}, state)
    assert run.missed() == {"txt": [], "parquet": []} and folders(spark, f"{state}-ledger/frames") == []
    assert line_numbers(spark, text) == list(range(1, 14))
    assert spark.read.schema(RAW_FRAME).parquet(store).count() == 13


def test_without_failures_nothing_is_kept(spark, tmp_path):
    landing, state, text = (str(tmp_path / n) for n in ("landing", "state", "txt"))
    land(spark, landing, [raw_row(1, 1.0, 1, b"\x01")])
    run = capture(spark, landing, {"txt": TextSink(text)}, state)
    assert run.missed() == {"txt": []} and folders(spark, f"{state}-ledger") == [] and run.frames == 1


@pytest.mark.parametrize("stopped", ["noted", "half written", "written", "removed in part"])
def test_interrupted_folding_folds_every_batch_once(spark, tmp_path, stopped):
    live, root = str(tmp_path / "live"), str(tmp_path / "store")
    rows = [raw_row(k, float(k), k % 3, bytes([k])) for k in range(40)]
    for n in range(5):
        frames = normalise(spark.createDataFrame(rows[8 * n : 8 * n + 8], RAW_FRAME))
        ParquetSink(live, cluster=False).write(frames, n)
    assert fold(spark, live, root, keep_last=3) == [0, 1]
    folding = Folding(spark, live, root)
    folding.note(1, [2, 3])
    if stopped == "half written":  # files without the mark that their job has ended
        folding.batches([2]).write.parquet(f"{root}/frames/round=1")
        (tmp_path / "store" / "frames" / "round=1" / "_SUCCESS").unlink()
    if stopped in ("written", "removed in part"):
        folding.write(1, [2, 3])
    if stopped == "removed in part":
        folding.remove([2])
    seen = lambda: sorted(r.seq for r in read_folded(spark, live, root).collect())
    assert seen() == list(range(40))
    fold(spark, live, root, keep_last=1)
    assert seen() == list(range(40)) and [f for f in folders(spark, live) if f.startswith("batch")] == ["batch_id=4"]
    assert fold(spark, live, root) == [4] and fold(spark, live, root) == []
    assert seen() == list(range(40))


def test_folding_nothing(spark, tmp_path):
    live, root = str(tmp_path / "live"), str(tmp_path / "store")
    assert fold(spark, live, root) == [] and read_folded(spark, live, root).count() == 0


def long_form(spark, make_catalogue, n=1500):
    rnd = random.Random(4)
    rows = [
        raw_row(k, float(rnd.randint(0, 400)), rnd.choice([1, 2, 3]), bytes([rnd.randint(0, 255)]), capture=rnd.choice(["a", "a", "b", None]))
        for k in range(n)
    ]
    rows.append(raw_row(n, None, 1, b"\x01", capture="a"))
    catalogue = make_catalogue(signal_row(1, "x"), signal_row(2, "y"), signal_row(3, "z"))
    return rows, signals_long(spark.createDataFrame(rows, RAW_FRAME), catalogue)


@pytest.mark.parametrize("age", [None, 1.5])
def test_as_of_pairs(spark, make_catalogue, age):
    rows, long = long_form(spark, make_catalogue)
    want = set()
    for capture_id in ("a", "b", None):
        own = [r for r in rows if r[0] == capture_id and r[2] is not None]
        seen = sorted((r[2], r[1], r[5][0]) for r in own if r[3] == 2)
        for r in own:
            k = bisect.bisect_right(seen, (r[2], float("inf"), 0))
            if r[3] == 1 and k and (age is None or r[2] - seen[k - 1][0] <= age):
                want.add((capture_id, r[2], r[1], float(r[5][0]), float(seen[k - 1][2]), seen[k - 1][0]))
    assert {tuple(r) for r in signals.signals_as_of(long, "x", "y", age).collect()} == want
    with pytest.raises(ValueError, match="different"):
        signals.signals_as_of(long, "x", "x")


def test_level_shifts(spark):
    rnd = random.Random(8)
    rows = [("a", "s", float(k), k, (0.0 if k < 700 else 5.0) + rnd.random()) for k in range(1000)]
    rows += [("a", "flat", float(k), k, 3.0) for k in range(50)] + [("b", "one", 1.0, 1, 2.0), ("b", "s", 1.0, 1, None), ("b", "s", 2.0, 2, float("nan"))]
    table = spark.createDataFrame(rows, "capture_id string, signal string, timestamp double, seq long, value double").repartition(5)
    found = {(r.capture_id, r.signal): r for r in signals.signal_shifts(table).collect()}
    assert found.keys() == {("a", "s"), ("a", "flat")}
    shift = found["a", "s"]
    assert (shift.samples, shift.samples_before, shift.last_before, shift.seq_before) == (1000, 700, 699.0, 699)
    assert abs(shift.mean_after - shift.mean_before - 5) < 0.1 and found["a", "flat"].mean_before == 3.0
    assert [r.signal for r in signals.signal_shifts(table, least=1.0).collect()] == ["s"]


def test_merged_sketches(spark):
    values = spark.range(20_000).select(
        F.lit("c").alias("capture_id"), F.lit("s").alias("signal"), (F.col("id") / 10).alias("timestamp"), (F.col("id") * 7919 % 20_000).cast("double").alias("value")
    )
    hours = signals.sketch_buckets(values, "1 minute")
    assert hours.count() > 30
    day = signals.sketch_rollup(hours, "1 day", [0.1, 0.5, 0.9]).first()
    assert day.samples == 20_000
    assert all(abs(got / 20_000 - q) < 0.03 for got, q in zip(day.quantiles, [0.1, 0.5, 0.9]))
