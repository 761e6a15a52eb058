from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from buslens.operators.normalise import normalise
from buslens.plans.capture import run_capture
from buslens.sinks import FrameSink, SinkErrors, SinkRegistry, fan_out, sinks
from buslens.sources.frames import read_capture, read_raw
from buslens.sources.store import read_frames, write_frames, write_store
from tests.conftest import raw_row, signal_row


class Counter(FrameSink):
    def save(self, rows, path, batch_id):
        rows.write.format("noop").mode("overwrite").save()


class LineWriter(DataSourceWriter):
    def __init__(self, path):
        self.path = path

    def write(self, iterator):
        rows = [f"{row.can_id};{row.data_hex}" for row in iterator]
        if rows:
            os.makedirs(self.path, exist_ok=True)
            with open(os.path.join(self.path, f"{os.getpid()}-{id(rows)}.txt"), "w") as out:
                out.write("\n".join(rows) + "\n")
        return WriterCommitMessage()


class LineSource(DataSource):
    @classmethod
    def name(cls):
        return "linefile"

    def writer(self, schema, overwrite):
        return LineWriter(self.options["path"])


@pytest.fixture
def registry():
    return SinkRegistry()


def test_register_and_create(registry):
    assert registry.names() == []
    assert registry.register("lines")(Counter) is Counter
    registry.register("cells")(LineSource)
    assert registry.names() == ["lines", "cells"]
    made = registry.create("lines", path="/x", catalogue=None)
    assert isinstance(made, Counter) and made.path == "/x"


@pytest.mark.parametrize("name", ["", "two words"])
def test_bad_names(registry, name):
    with pytest.raises(ValueError):
        registry.register(name)(Counter)
    # The name is checked before the class.
    with pytest.raises(ValueError):
        registry.register(name)(dict)


def test_duplicate_wrong_base_and_unknown(registry):
    with pytest.raises(ValueError, match=r"known sinks are \[\]"):
        registry.create("absent")
    registry.register("twice")(Counter)
    with pytest.raises(ValueError):
        registry.register("twice")(Counter)
    with pytest.raises(ValueError):
        registry.register("twice")(dict)
    for wrong in (dict, "text"):
        with pytest.raises(TypeError):
            registry.register("other")(wrong)
    with pytest.raises(ValueError, match=r"known sinks are \['twice'\]"):
        registry.create("absent")


def test_built_in_names():
    assert sinks.names() == ["csv", "json", "txt", "parquet", "count"]


@pytest.fixture
def capture(make_raw, make_catalogue):
    catalogue = make_catalogue(
        signal_row(0x100, "RPM", 0, 16, scale=0.5, position=0), signal_row(0x100, "Gear", 16, 8, choices={1: "D"}, position=1),
        signal_row(0x200, "Count", 0, 8), signal_row(0x300, "Far", 32, 8),
    )
    frames = normalise(make_raw(
        raw_row(1, 1712057096.123, 0x100, b"\x41\x06\x01"), raw_row(2, 1712057096.5, 0x200, b"\x07"),
        raw_row(3, 1712057097.0, 0x300, b"\x07"), raw_row(4, 1712057098.25, 0x18FF50E5, b""),
        raw_row(1, 0.5, 0x100, b"\x40\x06\x02", capture="007"),
    ))
    return frames, catalogue


def stored(path, pattern="*"):
    out = {}
    for file in sorted(glob.glob(f"{path}/{pattern}")):
        with open(file, newline="", encoding="utf-8") as handle:
            out.setdefault(os.path.basename(os.path.dirname(file)), []).append(handle.read())
    return out


def test_csv_text(spark, capture, tmp_path):
    frames, catalogue = capture
    assert sinks.create("csv", path=str(tmp_path / "c"), catalogue=catalogue, ordered=True).write(frames.coalesce(1)) == 5
    head = "timestamp,can_id,dlc,data_hex,Count,Far,Gear,RPM\r\n"
    files = {k: sorted("".join(v).replace(head, "").splitlines()) for k, v in stored(tmp_path / "c", "capture_id=*/*.csv").items()}
    assert files == {
        "capture_id=007": ["0.5,0x100,3,40 06 02,,,2,800.0"],
        "capture_id=c1": [
            "1712057096.123,0x100,3,41 06 01,,,D,800.5", "1712057096.5,0x200,1,07,7,,,",
            "1712057097.0,0x300,1,07,,,,", "1712057098.25,0x18FF50E5,0,,,,,",
        ],
    }
    for texts in stored(tmp_path / "c", "capture_id=*/*.csv").values():
        assert all(t.startswith(head) and t.endswith("\r\n") for t in texts)
    back = read_capture(spark, str(tmp_path / "c"), "csv", catalogue.names())
    rows = {(r.capture_id, r.can_id): r for r in back.collect()}
    assert rows["007", "0x100"].RPM == "800.0" and rows["c1", "0x18FF50E5"].can_id_dec == 0x18FF50E5
    assert rows["c1", "0x18FF50E5"].data_bytes == [] and rows["c1", "0x100"].ts.microsecond == 123000


def test_ndjson_text(spark, capture, tmp_path):
    frames, catalogue = capture
    path = str(tmp_path / "j")
    assert sinks.create("json", path=path, catalogue=catalogue, extra=["seq"]).write(frames) == 5
    lines = [line for texts in stored(path, "capture_id=*/*.json").values() for t in texts for line in t.splitlines()]
    records = {(r["timestamp"]): r for r in map(json.loads, lines)}
    assert records[1712057096.123] == {
        "timestamp": 1712057096.123, "can_id": "0x100", "can_id_dec": 256, "dlc": 3, "data_hex": "41 06 01",
        "data_bytes": [65, 6, 1], "is_extended": False, "is_remote": False, "is_error": False,
        "parsed": {"RPM": 800.5, "Gear": "D"}, "seq": 1,
    }
    assert records[1712057097.0]["parsed"] == {} and records[1712057098.25]["parsed"] is None
    assert list(records[0.5])[:10] == [
        "timestamp", "can_id", "can_id_dec", "dlc", "data_hex", "data_bytes", "is_extended", "is_remote", "is_error", "parsed",
    ]
    # Whole floats stay floats, integer signals stay integers, times stay plain.
    assert any('"RPM":800.0' in line and '"Gear":2' in line for line in lines)
    assert any('"timestamp":1712057096.123' in line for line in lines)
    back = read_capture(spark, path, "json").orderBy("capture_id", "seq")
    assert [r.parsed for r in back.collect()] == [
        {"RPM": "800.0", "Gear": "2"}, {"RPM": "800.5", "Gear": "D"}, {"Count": "7"}, {}, None,
    ]
    assert back.select(*frames.columns).collect() == frames.orderBy("capture_id", "seq").collect()


def test_ndjson_escapes_and_odd_numbers(spark, make_raw, make_catalogue, tmp_path):
    import math
    import struct

    catalogue = make_catalogue(
        signal_row(1, "a", 0, 8, choices={1: 'say "hi"\\\n', 2: "é"}), signal_row(2, "f", 0, 64, value_type="float64"),
        signal_row(3, "u", 0, 64), signal_row(3, "s", 0, 8, scale=1e-6),
    )
    frames = normalise(make_raw(
        raw_row(1, 1.0, 1, b"\x01"), raw_row(2, 2.0, 1, b"\x02"), raw_row(3, 3.0, 2, struct.pack("<d", math.nan)),
        raw_row(4, 4.0, 2, struct.pack("<d", 1e300)), raw_row(5, 5.0, 3, b"\xff" * 8), raw_row(6, 6.0, 2, struct.pack("<d", -math.inf)),
    ))
    sinks.create("json", path=str(tmp_path / "j"), catalogue=catalogue).write(frames)
    lines = [line for texts in stored(tmp_path / "j", "capture_id=*/*.json").values() for t in texts for line in t.splitlines()]
    parsed = {r["timestamp"]: r["parsed"] for r in map(json.loads, lines)}
    assert parsed == {
        1.0: {"a": 'say "hi"\\\n'}, 2.0: {"a": "é"}, 3.0: {"f": "nan"}, 4.0: {"f": 1e300},
        5.0: {"u": 2**64 - 1, "s": 255 * 1e-6}, 6.0: {"f": "-inf"},
    }


def test_ndjson_without_catalogue(capture, tmp_path):
    frames, _ = capture
    sinks.create("json", path=str(tmp_path / "j")).write(frames)
    for texts in stored(tmp_path / "j", "capture_id=*/*.json").values():
        for line in "".join(texts).splitlines():
            assert json.loads(line)["parsed"] is None


def test_text_lines(capture, tmp_path):
    frames, catalogue = capture
    assert sinks.create("txt", path=str(tmp_path / "t"), catalogue=catalogue).write(frames) == 5
    files = {k: "".join(v).splitlines() for k, v in stored(tmp_path / "t", "capture_id=*/*.txt").items()}
    assert files == {
        "capture_id=007": ["[    1] 00:00:00.500 | ID: 0x100 | DLC: 3 | Data: 40 06 02 | Signals: RPM=800.0 | Gear=2"],
        "capture_id=c1": [
            "[    1] 11:24:56.123 | ID: 0x100 | DLC: 3 | Data: 41 06 01 | Signals: RPM=800.5 | Gear=D",
            "[    2] 11:24:56.500 | ID: 0x200 | DLC: 1 | Data: 07 | Signals: Count=7",
            "[    3] 11:24:57.000 | ID: 0x300 | DLC: 1 | Data: 07",
            "[    4] 11:24:58.250 | ID: 0x18FF50E5 | DLC: 0 | Data: ",
        ],
    }
    sinks.create("txt", path=str(tmp_path / "q"), catalogue=catalogue, show_signals=False).write(frames)
    assert "Signals" not in str(stored(tmp_path / "q", "capture_id=*/*.txt"))


def test_store_and_evolution(spark, capture, tmp_path):
    frames, catalogue = capture
    root = str(tmp_path / "s")
    write_store(frames, catalogue, root)
    back = read_frames(spark, f"{root}/frames")
    assert back.select(*frames.columns).orderBy("capture_id", "seq").collect() == frames.orderBy("capture_id", "seq").collect()
    signals = spark.read.schema("capture_id string, signal string, value double").parquet(f"{root}/signals")
    assert signals.where("capture_id = '007'").count() == 2 and signals.count() == 5
    assert spark.read.parquet(f"{root}/captures").count() == 2
    # An older version without flags, and one with an unknown column, in the same folder.
    old = frames.select(F.lit("old").alias("capture_id"), "seq", "timestamp", "can_id_dec", "dlc", "data")
    old.withColumn("extra", F.lit(1)).write.mode("append").partitionBy("capture_id").parquet(f"{root}/frames")
    merged = read_frames(spark, f"{root}/frames", defaults={"is_error": False})
    assert merged.columns == frames.columns
    row = merged.where("capture_id = 'old'").first()
    assert row.is_extended is None and row.is_error is False and row.can_id is not None


def test_folder_with_one_file_per_capture(spark, tmp_path):
    (tmp_path / "run_1.csv").write_text("timestamp,can_id,dlc,data_hex,RPM\r\n1.5,0x123,2,AA BB,800.0\r\n", newline="")
    (tmp_path / "run_2.csv").write_text("timestamp,can_id,dlc,data_hex,RPM\r\n2.5,0x124,0,,\r\n", newline="")
    rows = read_capture(spark, str(tmp_path), "csv", ["RPM"], partitioned=False).orderBy("capture_id").collect()
    assert [(r.capture_id, r.can_id_dec, r.data_hex, r.RPM) for r in rows] == [("run_1", 291, "AA BB", "800.0"), ("run_2", 292, "", None)]
    with pytest.raises(ValueError):
        read_capture(spark, str(tmp_path), "hdf5")


def test_raw_frames_landed_as_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"capture_id":"x","seq":1,"timestamp":1.5,"can_id_dec":5,"dlc":2,"data_hex":"AA BB","is_error":true}\n')
    row = read_raw(spark, str(tmp_path), "json").first()
    assert bytes(row.data) == b"\xaa\xbb" and row.is_error and row.is_remote is None


def test_three_sinks_lifecycle(make_raw, make_catalogue, tmp_path):
    catalogue = make_catalogue(signal_row(0x100, "RPM", 0, 16), signal_row(0x100, "Speed", 16, 8))
    frames = normalise(make_raw(*[raw_row(i, 1234567890.123, 0x100, bytes(range(1, 9))) for i in range(10)]))
    counts = run_capture(frames, catalogue, formats=["csv", "json", "count"], output_dir=str(tmp_path))
    assert counts == {"csv": 10, "json": 10, "count": 10}
    assert catalogue.names() == ["RPM", "Speed"]
    # Without formats the table itself is the result.
    assert run_capture(frames, catalogue, count=3).count() == 3


def test_one_failing_sink_does_not_stop_the_others(make_raw, tmp_path):
    class Broken(FrameSink):
        def save(self, rows, path, batch_id):
            raise OSError("disk on fire")

    frames = normalise(make_raw(raw_row(1, 1.0, 5, b"\x01"), raw_row(2, 1.0, 5, b"\x02")))
    targets = {"bad": Broken(), "csv": sinks.create("csv", path=str(tmp_path / "c")), "count": Counter()}
    with pytest.raises(SinkErrors, match="disk on fire") as failure:
        fan_out(frames, targets, cache=True)
    assert failure.value.counts == {"csv": 2, "count": 2} and list(failure.value.errors) == ["bad"]
    assert stored(tmp_path / "c", "capture_id=*/*.csv")


def test_custom_data_source(make_raw, registry, tmp_path):
    registry.register("lines")(LineSource)
    frames = normalise(make_raw(raw_row(1, 1.0, 0x100, b"\xaa"), raw_row(2, 1.0, 5, b"")))
    assert registry.create("lines", path=str(tmp_path / "l")).write(frames) == 2
    lines = sorted("".join(t for v in stored(tmp_path / "l").values() for t in v).splitlines())
    assert lines == ["0x005;", "0x100;AA"]


def test_parquet_sink_clusters(spark, capture, tmp_path):
    frames, _ = capture
    assert sinks.create("parquet", path=str(tmp_path / "p")).write(frames) == 5
    write_frames(frames, str(tmp_path / "p"), mode="append", cluster=False)
    assert read_capture(spark, str(tmp_path / "p"), "parquet").count() == 10
