from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from buslens.functions.ids import hex_id, id_from_text, parse_id_list
from buslens.functions.payload import big_endian_word, byte_list, spaced_hex, swap_bytes
from buslens.functions.text import float_text_sql, frame_line, json_safe
from buslens.operators.normalise import normalise
from tests.conftest import raw_row


def test_hex_id(spark):
    ids = [0, 5, 0x7F, 0x100, 0x123, 0x7FF, 0x1000, 0x18FF50E5]
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", hex_id(F.col("id")).alias("h"))
    assert {r.id: r.h for r in rows.collect()} == {i: f"0x{i:03X}" for i in ids}


def test_payload_text_and_bytes(spark):
    payloads = [b"", b"\x00", b"\xff\x80", bytes(range(1, 9)), b"\x0a" * 9, bytes(range(64)), None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, data binary")
    out = df.select("i", spaced_hex(F.col("data")).alias("h"), byte_list(F.col("data")).alias("b"))
    for row in out.collect():
        p = payloads[row.i]
        assert row.h == (None if p is None else " ".join(f"{x:02X}" for x in p))
        assert row.b == (None if p is None else list(p))


def test_words(spark):
    payloads = [bytes(random.Random(i).randrange(256) for _ in range(i % 9)) for i in range(60)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, data binary")
    be = big_endian_word(F.col("data"))
    for row in df.select("i", be.alias("be"), swap_bytes(be).alias("le")).collect():
        padded = payloads[row.i].ljust(8, b"\0")
        assert row.be == int.from_bytes(padded, "big", signed=True)
        assert row.le == int.from_bytes(padded, "little", signed=True)


def test_ids_from_text(spark):
    texts = {"0x123": 291, "0X7fF": 2047, " 291 ": 291, "+5": 5, "ZZ": None, "0x": None, "0xZZ": None, "12.5": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", id_from_text(F.col("t")).alias("id"))
    assert {r.t: r.id for r in df.collect()} == texts


def test_id_list():
    assert parse_id_list("0x123, 0x456,291") == [291, 1110, 291]
    assert parse_id_list(None) == [] and parse_id_list("") == []
    for bad in ("0x123,ZZ", "0x", "1 2", "0x123,,5"):
        with pytest.raises(ValueError):
            parse_id_list(bad)


def test_float_text_is_shortest_plain_text(spark):
    rnd = random.Random(7)
    values = [0.0, -0.0, 1.0, 800.0, 50.5, 1712057096.123, 1e7, 12345678.0, 1e15, 1e16, 1.5e16, 1e22, 1e-3, 1.5e-4,
              1e-4, 9.9e-5, 1.5e-5, 1e-10, -2.5e-7, -12345678.25, 314.15, float("inf"), float("-inf"), float("nan")]
    values += [round(rnd.uniform(1.6e9, 1.8e9), 6) for _ in range(2000)]
    values += [rnd.randrange(65536) * 0.01 for _ in range(2000)]
    values += [rnd.randrange(-10000, 10000) * 0.1 for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", F.expr(float_text_sql("v")).alias("t")).collect()}
    for i, v in enumerate(values):
        assert got[i] == repr(v), v


def test_normalise_keeps_flags_and_time(make_raw):
    raw = make_raw(
        raw_row(1, 1712057096.123, 0x123, bytes.fromhex("123456789ABCDEF0")),
        raw_row(2, 1.5, 0x18FF50E5, b"", dlc=0, remote=True),
        raw_row(3, float("nan"), 5, b"\x01", error=True),
    )
    one, two, three = normalise(raw).orderBy("seq").collect()
    assert one.can_id == "0x123" and one.data_hex == "12 34 56 78 9A BC DE F0"
    assert one.data_bytes == [18, 52, 86, 120, 154, 188, 222, 240] and one.dlc == 8
    assert one.ts.microsecond == 123000
    assert (two.can_id, two.data_hex, two.data_bytes) == ("0x18FF50E5", "", [])
    assert two.is_extended and two.is_remote and not two.is_error
    assert three.ts is None and three.is_error and three.can_id == "0x005"


def test_frame_line_states(spark):
    df = spark.createDataFrame(
        [(7, "0x100", 2, "AA BB", ["RPM=800.0", "Gear=3"]), (123456, "0x18FF50E5", 0, "", []), (8, "0x005", 1, "01", None)],
        "n bigint, id string, dlc int, hex string, s array<string>",
    ).withColumn("ts", F.timestamp_micros(F.lit(1712057096123999)))
    line = frame_line(F.col("n"), F.col("ts"), F.col("id"), F.col("dlc"), F.col("hex"), F.col("s"))
    lines = [r.line for r in df.select(line.alias("line")).collect()]
    assert lines == [
        "[    7] 11:24:56.123 | ID: 0x100 | DLC: 2 | Data: AA BB | Signals: RPM=800.0 | Gear=3",
        "[123456] 11:24:56.123 | ID: 0x18FF50E5 | DLC: 0 | Data: ",
        "[    8] 11:24:56.123 | ID: 0x005 | DLC: 1 | Data: 01",
    ]


def test_json_safe(spark):
    schema = T.StructType([
        T.StructField("b", T.BinaryType()),
        T.StructField("n", T.MapType(T.StringType(), T.ArrayType(T.BinaryType()))),
        T.StructField("d", T.DateType()),
        T.StructField("s", T.StructType([T.StructField("x", T.BinaryType()), T.StructField("y", T.DoubleType())])),
    ])
    import datetime

    df = spark.createDataFrame([(b"\xab\xcd", {"k": [b"\x01", None]}, datetime.date(2024, 1, 2), (b"\xff", 1.5))], schema)
    out = df.select([json_safe(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields])
    text = out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first().j
    assert text == '{"b":"abcd","n":{"k":["01",null]},"d":"2024-01-02","s":{"x":"ff","y":1.5}}'


def test_ieee_floats(spark):
    from buslens.functions.bits import ieee_sql

    rnd = random.Random(3)
    singles = [0, 1, 0x80000000, 0x7F800000, 0xFF800000, 0x7FC00000, 1078530011, 3212836864, 0x007FFFFF, 0x7F7FFFFF]
    singles += [rnd.getrandbits(32) for _ in range(300)]
    doubles = [0, 1, 1 << 63, 0x7FF << 52, 0xFFF << 52, (0x7FF << 52) + 1, 0x7FEFFFFFFFFFFFFF, 0xFFFFFFFFFFFFF]
    doubles += [rnd.getrandbits(64) for _ in range(300)]
    for bits, code, sql in ((singles, "<f", ieee_sql("r", 8, 23)), (doubles, "<d", ieee_sql("r", 11, 52))):
        size = struct.calcsize(code)
        signed = [b - (1 << 64) if b >> 63 else b for b in bits]
        df = spark.createDataFrame([(i, b) for i, b in enumerate(signed)], "i int, r bigint")
        got = {r.i: r.v for r in df.select("i", F.expr(sql).alias("v")).collect()}
        for i, b in enumerate(bits):
            want = struct.unpack(code, b.to_bytes(size, "little"))[0]
            assert got[i] == want or (math.isnan(want) and math.isnan(got[i])), hex(b)
