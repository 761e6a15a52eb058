from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from buslens.operators import quality, rules, select, signals, stats
from buslens.operators.decode import signals_long
from buslens.operators.normalise import normalise
from buslens.schemas import RULE
from tests.conftest import raw_row, signal_row


@pytest.fixture
def samples(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(c, i, t, 1, s, v, None) for i, (c, t, s, v) in enumerate(rows)],
            "capture_id string, seq bigint, timestamp double, can_id_dec bigint, signal string, value double, label string",
        )
    return build


def test_filters(spark, make_raw):
    frames = normalise(make_raw(
        raw_row(1, 0.0, 0x100), raw_row(2, 60.0, 0x123), raw_row(3, 120.0, 0x18FF50E5), raw_row(4, 180.0, 0x100),
    ))
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(select.by_ids(frames, [])) == seqs(select.by_ids(frames, None)) == [1, 2, 3, 4]
    assert seqs(select.by_ids(frames, [0x100, 291])) == [1, 2, 4]
    tokens = spark.createDataFrame([("0x100",), ("291",), ("bad",)], "t string")
    assert seqs(select.by_id_table(frames, select.ids_from_text(tokens, "t"))) == [1, 2, 4]
    assert seqs(select.by_id_range(frames, 0x101, 0x7FF)) == [2]
    assert seqs(select.by_time(frames, "1970-01-01 00:01:00", "1970-01-01 00:03:00")) == [2, 3]
    assert seqs(select.by_time(frames)) == [1, 2, 3, 4]


def test_capture_stats(make_raw):
    frames = normalise(make_raw(
        raw_row(1, 10.0, 1), raw_row(2, 12.0, 1), raw_row(3, 14.0, 1), raw_row(1, 5.0, 1, capture="one"),
    ))
    got = {r.capture_id: (r.frames, r.elapsed_seconds, r.fps) for r in stats.capture_stats(frames).collect()}
    assert got == {"c1": (3, 4.0, 0.75), "one": (1, 0.0, 0.0)}
    manifest = {r.capture_id: (r.frame_count, r.capture_time.second) for r in stats.capture_manifest(frames).collect()}
    assert manifest == {"c1": (3, 10), "one": (1, 5)}
    assert stats.count_frames(frames).first().frames == 4


def test_window_stats(make_raw):
    frames = normalise(make_raw(*[raw_row(i, i * 3.0, 1) for i in range(5)]))
    got = {r.window_start.second: (r.frames, r.fps) for r in stats.window_stats(frames).collect()}
    assert got == {0: (4, 0.4), 10: (1, 0.1)}


def test_bucket_stats_and_drift(samples):
    table = samples(
        ("c", 0.0, "a", 1.0), ("c", 5.0, "a", 3.0), ("c", 65.0, "a", 7.0), ("c", 600.0, "a", 6.0), ("c", 1.0, "b", 9.0),
    )
    buckets = {(r.signal, r.bucket_start.minute): (r.samples, r.mean, r.low, r.high) for r in signals.bucket_stats(table, "1 minute").collect()}
    assert buckets == {
        ("a", 0): (2, 2.0, 1.0, 3.0), ("a", 1): (1, 7.0, 7.0, 7.0), ("a", 10): (1, 6.0, 6.0, 6.0), ("b", 0): (1, 9.0, 9.0, 9.0),
    }
    drift = {(r.signal, r.bucket_start.minute): r.change for r in signals.signal_drift(table, "1 minute").collect()}
    assert drift == {("a", 0): None, ("a", 1): 5.0, ("a", 10): -1.0, ("b", 0): None}
    trend = {r.signal: r.slope for r in signals.signal_trend(samples(*[("c", float(t), "a", 2.0 * t) for t in range(5)])).collect()}
    assert trend["a"] == pytest.approx(2.0)


def test_signal_summary(samples):
    values = [float(v) for v in (4, 8, 15, 16, 23, 42)]
    row = signals.signal_summary(samples(*[("c", float(i), "a", v) for i, v in enumerate(values)])).first()
    assert (row.samples, row.low, row.high, row.mean) == (6, 4.0, 42.0, 18.0)
    assert row.deviation == pytest.approx(statistics.stdev(values))
    assert row.quartiles == [8.0, 15.0, 23.0]


def test_correlation(samples):
    rows = [("c", float(t), "x", float(t)) for t in range(0, 100, 10)]
    rows += [("c", t + 1.0, "y", 5.0 - 2 * t) for t in range(0, 100, 10)]
    rows += [("c", 1000.0, "x", 99.0)]
    row = signals.signal_correlation(samples(*rows), "x", "y", "10 seconds").first()
    assert row.buckets == 10 and row.correlation == pytest.approx(-1.0)


def test_reasons(make_raw):
    raw = make_raw(
        raw_row(1, 1.0, 0x100, b"\x01"), raw_row(2, 1.0, 0x100, b"\x01\x02", dlc=8), raw_row(3, None, 0x100, b""),
        raw_row(4, -1.0, 0x800, b"", extended=False), raw_row(5, 1.0, 0x20000000, b"", extended=True),
        raw_row(6, 1.0, 0x100, b"\x00" * 9), raw_row(7, 1.0, 0x100, b"\x01", remote=True),
        raw_row(8, 1.0, 0x100, b"", dlc=4, remote=True), raw_row(9, float("nan"), None, None, dlc=0),
    )
    frames = normalise(raw)
    good, bad = quality.split_valid(frames)
    assert sorted(r.seq for r in good.collect()) == [1, 8]
    assert {r.seq: r.reasons for r in bad.collect()} == {
        2: ["length differs from payload"], 3: ["no timestamp"],
        4: ["negative timestamp", "identifier needs extended frame"], 5: ["identifier out of range"],
        6: ["no length of a frame"], 7: ["remote frame with data"], 9: ["no timestamp", "no identifier", "no payload"],
    }
    for row in quality.with_reasons(frames).collect():
        assert (row.reasons == []) == (row.seq in (1, 8))


def test_gaps(make_raw, make_catalogue):
    catalogue = make_catalogue(signal_row(1, "x", cycle_time_ms=100), signal_row(2, "x"))
    raw = make_raw(
        raw_row(1, 0.0, 1), raw_row(2, 0.1, 1), raw_row(3, 0.1, 1), raw_row(4, 0.4, 1), raw_row(5, 0.55, 1),
        raw_row(6, 0.0, 2), raw_row(7, 9.0, 2), raw_row(8, 5.0, 77), raw_row(9, float("nan"), 1),
        raw_row(1, 2.0, 1, capture="d"),
    )
    gaps = quality.missing_frames(raw, catalogue).collect()
    assert [(r.capture_id, r.seq, r.previous_seq) for r in gaps] == [("c1", 4, 3)]
    assert gaps[0].gap_seconds == pytest.approx(0.3)


def test_duplicates_and_report(make_raw, make_catalogue):
    catalogue = make_catalogue(signal_row(1, "x", cycle_time_ms=100))
    raw = normalise(make_raw(
        raw_row(1, 1.0, 1, b"\x01"), raw_row(2, 1.0, 1, b"\x01"), raw_row(3, 1.0, 1, b"\x01"), raw_row(4, 1.0, 1, b"\x02"),
        raw_row(5, 3.0, 1, b"\x01", error=True), raw_row(6, 1.0, 9, b"\x01", dlc=8), raw_row(7, 2.0, 9, b"", remote=True),
        raw_row(8, 1.0, 1, b"\x01", capture=None),
    ))
    copies = [(r.can_id_dec, r.copies, r.first_seq) for r in quality.duplicate_frames(raw).collect()]
    assert copies == [(1, 3, 1)]
    kept = quality.drop_duplicate_frames(raw)
    assert kept.columns == raw.columns
    assert sorted(r.seq for r in kept.collect()) == [1, 4, 5, 6, 7, 8]
    report = {(r.capture_id, r.can_id_dec): tuple(r)[2:] for r in quality.quality_report(raw, catalogue).collect()}
    #         frames unknown error remote invalid copies gaps
    assert report == {
        ("c1", 1): (5, 0, 1, 0, 0, 2, 1), ("c1", 9): (2, 2, 0, 1, 1, 0, 0), (None, 1): (1, 0, 0, 0, 0, 0, 0),
    }
    blind = {(r.capture_id, r.can_id_dec): r.unknown_frames for r in quality.quality_report(raw, None).collect()}
    assert blind == {("c1", 1): 5, ("c1", 9): 2, (None, 1): 1}


def test_rules(spark, samples):
    table = samples(
        ("c", 1.0, "a", 5.0), ("c", 2.0, "a", 50.0), ("c", 3.0, "a", -5.0), ("d", 1.0, "a", 1.0), ("c", 1.0, "b", math.nan),
    )
    limit = spark.createDataFrame([("range", "a", 0.0, 10.0), ("low", "a", -10.0, None), ("b", "b", 0.0, None), ("none", "z", 0.0, 1.0)], RULE)
    got = {(r.capture_id, r.rule): (r.samples, r.violations, r.first_violation, r.verdict) for r in rules.check_rules(table, limit).collect()}
    assert got == {
        ("c", "range"): (3, 2, 2.0, "fail"), ("d", "range"): (1, 0, None, "pass"),
        ("c", "low"): (3, 0, None, "pass"), ("d", "low"): (1, 0, None, "pass"), ("c", "b"): (1, 1, 1.0, "fail"),
    }


def test_signal_range(make_raw, make_catalogue):
    catalogue = make_catalogue(signal_row(1, "a"), signal_row(2, "b"))
    frames = make_raw(*[raw_row(i, float(i), 1 + i % 2, bytes([i])) for i in range(10)])
    rows = select.by_signal_range(signals_long(frames, catalogue), "a", 2, 6)
    assert sorted(r.value for r in rows.collect()) == [2.0, 4.0, 6.0]
    only = signals_long(frames, catalogue, signals=["b"]).agg(F.collect_set("signal").alias("s")).first().s
    assert only == ["b"]
