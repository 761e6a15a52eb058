from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from buslens.operators.decode import decode, frames_wide, signal_texts, signals_long
from buslens.operators.normalise import normalise
from buslens.schemas import RAW_FRAME
from buslens.sources import catalogue as catalogue_module
from buslens.sources.catalogue import expected_signals, info_for_ids, load_catalogue, message_info, prepare_catalogue
from tests.conftest import raw_row, signal_row

PAYLOAD = bytes.fromhex("123456789ABCDEF0")


def shapes(frames, catalogue):
    """Decoded signals by seq from the three forms, which must agree."""
    long: dict = {}
    for row in signals_long(frames, catalogue).collect():
        long.setdefault(row.seq, {})[row.signal] = (row.value, row.label)
    parsed = {
        row.seq: None if row.parsed is None else {k: (v.value, v.label) for k, v in row.parsed.items()}
        for row in decode(frames, catalogue).collect()
    }
    assert {seq: signals for seq, signals in parsed.items() if signals} == long
    names = catalogue.names()
    for row in frames_wide(normalise(frames), catalogue, keep=["seq"]).collect():
        cells = {n: row[n] for n in names if row[n] is not None}
        assert cells == {n: v[0] for n, v in (parsed[row.seq] or {}).items()}
    return parsed


def texts(frames, catalogue):
    rows = signal_texts(frames, catalogue).select("seq", "texts").collect()
    return {r.seq: None if r.texts is None else [(t.signal, t.text, t.is_label) for t in r.texts] for r in rows}


def test_golden_vectors(make_raw, make_catalogue):
    catalogue = make_catalogue(
        signal_row(1, "le16", 0, 16), signal_row(2, "be16", 7, 16, "be", True), signal_row(3, "u64", 0, 64),
        signal_row(4, "s16", 0, 16, signed=True), signal_row(4, "beyond", 8, 16),
        signal_row(5, "far", 24, 16),
    )
    frames = make_raw(
        raw_row(1, 1.0, 1, PAYLOAD), raw_row(2, 1.0, 2, PAYLOAD), raw_row(3, 1.0, 3, PAYLOAD),
        raw_row(4, 1.0, 4, b"\xff\x80"), raw_row(5, 1.0, 5, b"\x8f"), raw_row(6, 1.0, 77, b""),
        raw_row(7, 1.0, 5, b"", remote=True),
    )
    assert shapes(frames, catalogue) == {
        1: {"le16": (13330.0, None)}, 2: {"be16": (4660.0, None)}, 3: {"u64": (17356517385562371090.0, None)},
        4: {"s16": (-32513.0, None)}, 5: {}, 6: None, 7: {},
    }
    assert texts(frames, catalogue)[3] == [("u64", "17356517385562371090", False)]


def test_multiplexing(make_raw, make_catalogue):
    catalogue = make_catalogue(
        signal_row(9, "Plain", 0, position=0), signal_row(9, "Sel", 8, position=1),
        signal_row(9, "A", 0, mux_signal="Sel", mux_value=0, position=2),
        signal_row(9, "B", 0, mux_signal="Sel", mux_value=1, position=3),
        signal_row(8, "Late", 8, mux_signal="Mux", mux_value=1, position=0), signal_row(8, "Mux", 0, 4, position=1),
        signal_row(8, "End", 16, position=2),
    )
    frames = make_raw(
        raw_row(1, 1.0, 9, b"\x0a\x00"), raw_row(2, 1.0, 9, b"\x0a\x01"), raw_row(3, 1.0, 9, b"\x0a\x07"),
        raw_row(4, 1.0, 9, b"\x0a"), raw_row(5, 1.0, 8, b"\x11\x22\x33"), raw_row(6, 1.0, 8, b"\x01"),
    )
    got = shapes(frames, catalogue)
    ten = (10.0, None)
    assert got[1] == {"Plain": ten, "Sel": (0.0, None), "A": ten}
    assert got[2] == {"Plain": ten, "Sel": (1.0, None), "B": ten}
    assert got[3] is None
    assert got[4] == {"Plain": ten}
    assert got[6] == {"Mux": (1.0, None)}
    # Selected signals print after the plain ones.
    assert [name for name, _, _ in texts(frames, catalogue)[5]] == ["Mux", "End", "Late"]


def test_labels_and_texts(make_raw, make_catalogue):
    catalogue = make_catalogue(
        signal_row(1, "Gear", 0, 8, signed=True, choices={-1: "R", 0: "N"}, position=0),
        signal_row(1, "Speed", 8, 16, scale=0.5, position=1),
        signal_row(1, "Temp", 24, 8, offset=-40.0, position=2),
        signal_row(1, "Count", 24, 8, scale=3.0, is_integer=False, position=3),
        signal_row(2, "Big", 0, 63, scale=2.0, offset=1.0),
    )
    frames = make_raw(
        raw_row(1, 1.0, 1, b"\xff\x65\x00\x0a"), raw_row(2, 1.0, 1, b"\x05\x40\x06\x00"),
        raw_row(3, 1.0, 2, b"\xff" * 8),
    )
    assert shapes(frames, catalogue)[1] == {
        "Gear": (-1.0, "R"), "Speed": (50.5, None), "Temp": (-30.0, None), "Count": (30.0, None),
    }
    assert texts(frames, catalogue) == {
        1: [("Gear", "R", True), ("Speed", "50.5", False), ("Temp", "-30", False), ("Count", "30.0", False)],
        2: [("Gear", "5", False), ("Speed", "800.0", False), ("Temp", "-40", False), ("Count", "0.0", False)],
        3: [("Big", str((2**63 - 1) * 2 + 1), False)],
    }


def test_float_signals(make_raw, make_catalogue):
    import struct

    catalogue = make_catalogue(
        signal_row(1, "f", 0, 32, value_type="float32"), signal_row(2, "d", 0, 64, value_type="float64"),
        signal_row(3, "b", 7, 32, "be", value_type="float32"),
    )
    frames = make_raw(
        raw_row(1, 1.0, 1, struct.pack("<f", -2.5)), raw_row(2, 1.0, 2, struct.pack("<d", 3.14159)),
        raw_row(3, 1.0, 3, struct.pack(">f", 1e-3)),
    )
    got = shapes(frames, catalogue)
    assert got[1] == {"f": (-2.5, None)} and got[2] == {"d": (3.14159, None)}
    assert got[3]["b"][0] == struct.unpack(">f", struct.pack(">f", 1e-3))[0]


def reference_value(data: bytes, start: int, length: int, order: str, signed: bool):
    """Raw value read bit by bit; None if the signal ends beyond the data."""
    bits = [(byte >> (7 - i)) & 1 for byte in data for i in range(8)]
    if order == "le":
        places = [8 * (b // 8) + 7 - b % 8 for b in range(start, start + length)][::-1]
    else:
        first = 8 * (start // 8) + 7 - start % 8
        places = list(range(first, first + length))
    last = start + length if order == "le" else 8 * (start // 8) + 7 - start % 8 + length
    if last > 8 * len(data):
        return None
    value = int("".join(str(bits[p]) for p in places), 2)
    return value - (1 << length) if signed and value >> (length - 1) else value


@pytest.mark.parametrize("bits, bound", [(64, 50_000), (512, 50_000), (512, 10)])
def test_random_layouts_against_bit_by_bit_reading(spark, make_catalogue, monkeypatch, bits, bound):
    rnd = random.Random(11)
    layouts, rows = {}, []
    for message in range(1, 60):
        layouts[message] = []
        for i in range(rnd.randint(1, 4)):
            order, length = rnd.choice(["le", "be"]), rnd.randint(1, 64)
            if order == "le":
                start = rnd.randint(0, bits - length)
            else:
                place = rnd.randint(0, bits - length)
                start = 8 * (place // 8) + 7 - place % 8
            signed = rnd.random() < 0.5
            layouts[message].append((f"s{i}", start, length, order, signed))
            rows.append(signal_row(message, f"s{i}", start, length, order, signed))
    with monkeypatch.context() as patch:
        patch.setattr(catalogue_module, "CATALOGUE_ROWS", bound)
        catalogue = make_catalogue(*rows)
    assert catalogue.small == (bound > len(rows)) and catalogue.traits.far == (bits > 64)
    raw = [
        raw_row(seq, float(seq), rnd.randint(1, 62), bytes(rnd.randrange(256) for _ in range(rnd.randint(0, bits // 8))))
        for seq in range(1500)
    ]
    got = shapes(spark.createDataFrame(raw, RAW_FRAME), catalogue)
    for _, seq, _, can_id, _, data, *_ in raw:
        if can_id not in layouts:
            assert got[seq] is None
            continue
        values = {n: reference_value(data, s, length, o, g) for n, s, length, o, g in layouts[can_id]}
        assert got[seq] == {n: (float(v), None) for n, v in values.items() if v is not None}


def test_extended_flag_is_not_consulted(make_raw, make_catalogue):
    catalogue = make_catalogue(signal_row(0x100, "x"))
    frames = make_raw(raw_row(1, 1.0, 0x100, b"\x07"), raw_row(2, 1.0, 0x100, b"\x07", extended=True))
    assert shapes(frames, catalogue) == {1: {"x": (7.0, None)}, 2: {"x": (7.0, None)}}


def test_large_catalogue_is_joined_by_shuffle(make_raw, make_catalogue, monkeypatch):
    monkeypatch.setattr(catalogue_module, "CATALOGUE_ROWS", 2)
    rows = [signal_row(m, f"s{m % 3}", 0, 8, position=0) for m in range(1, 6)]
    catalogue = make_catalogue(*rows)
    assert not catalogue.small
    monkeypatch.setattr(catalogue_module, "CATALOGUE_ROWS", 100)
    frames = make_raw(*[raw_row(i, 1.0, 1 + i % 7, bytes([i])) for i in range(50)])
    got = shapes(frames, catalogue)
    assert len(got) == 50
    for seq, signals in got.items():
        m = 1 + seq % 7
        assert signals == ({f"s{m % 3}": (float(seq), None)} if m < 6 else None)
    plan = signals_long(frames, catalogue)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


# One bad row each; the message before it is a good one of the same number.
BAD_ROWS = [
    (signal_row(11, "x", 0, 65), "length"), (signal_row(12, "x", 0, 0), "length"),
    (signal_row(13, "x", -1, 8), "no start"), (signal_row(14, "x", order="up"), "byte order"),
    (signal_row(15, "x", value_type="text"), "value type"),
    (signal_row(16, "x", 0, 16, value_type="float32"), "32 bits"),
    (signal_row(17, "x", mux_signal="S"), "half"), (signal_row(None, "x"), "no message"),
    (signal_row(18, "x", mux_signal="S", mux_value=1), "selector is not a signal"),
    (signal_row(19, "ok"), "twice"),
]


@pytest.mark.parametrize("bound", [1000, 1])
def test_bad_messages_void_their_own_frames(spark, make_raw, monkeypatch, bound):
    from buslens.schemas import CATALOGUE

    bad = {row[0]: reason for row, reason in BAD_ROWS}
    rows = [signal_row(m, "ok") for m in bad if m is not None] + [signal_row(2, "fine", 0), *[row for row, _ in BAD_ROWS]]
    table = spark.createDataFrame(rows, CATALOGUE)
    with monkeypatch.context() as patch:
        patch.setattr(catalogue_module, "CATALOGUE_ROWS", bound)
        with pytest.raises(ValueError, match="no message ID"):
            prepare_catalogue(table, strict=True)
        catalogue = prepare_catalogue(table)
    assert catalogue.small == (bound > 1)
    listed: dict = {}
    for row in catalogue.problems.collect():
        listed.setdefault(row.message_id, []).append(row.problem)
    assert listed.keys() == bad.keys() and all(any(reason in p for p in listed[m]) for m, reason in bad.items())
    frames = make_raw(*[raw_row(m, 1.0, m, b"\x05") for m in (2, 3, *[m for m in bad if m])])
    assert shapes(frames, catalogue) == {**{m: None for m in (3, *[m for m in bad if m])}, 2: {"fine": (5.0, None)}}
    assert {r.message_id for r in message_info(catalogue).collect()} == {2, *[m for m in bad if m]}


def tree_reference(layout, data):
    """Decode ``name: (start, length, parent, value)`` by walking the selectors from the top; None voids the frame."""
    def raw(name):
        start, length, _, _ = layout[name]
        return reference_value(data, start, length, "le", False)

    out, waiting = {}, [None]
    while waiting:
        parent = waiting.pop()
        level = [n for n, (_, _, p, _) in layout.items() if p == parent]
        if parent is not None:
            value = raw(parent)
            if value is None:
                continue
            level = [n for n in level if layout[n][3] == value]
            if not level:
                return None
        for name in level:
            if raw(name) is not None:
                out[name] = (float(raw(name)), None)
            if any(p == name for _, _, p, _ in layout.values()):
                waiting.append(name)
    return out


@pytest.mark.parametrize("bound", [1000, 2])
def test_selector_trees_equal_a_walk(spark, make_catalogue, monkeypatch, bound):
    rnd = random.Random(11)
    layouts = {}
    for message in range(1, 25):
        names, layout = [], {}
        for k in range(rnd.randint(1, 9)):
            parent = rnd.choice([None, None, *names])
            layout[f"n{k}"] = (rnd.randint(0, 40), rnd.choice([1, 2, 3, 8]), parent, rnd.randint(0, 2) if parent else None)
            names.append(f"n{k}")
        layouts[message] = layout
    rows = [
        signal_row(m, n, start, length, mux_signal=parent, mux_value=value, position=k)
        for m, layout in layouts.items() for k, (n, (start, length, parent, value)) in enumerate(layout.items())
    ]
    with monkeypatch.context() as patch:
        patch.setattr(catalogue_module, "CATALOGUE_ROWS", bound)
        catalogue = make_catalogue(*rows)
    assert catalogue.traits.nested and catalogue.problems.count() == 0
    raw = [
        raw_row(seq, float(seq), rnd.randint(1, 25), bytes(rnd.choice([0, 1, 2, 5, 64, 255]) for _ in range(rnd.randint(0, 8))))
        for seq in range(1200)
    ]
    got = shapes(spark.createDataFrame(raw, RAW_FRAME), catalogue)
    for _, seq, _, can_id, _, data, *_ in raw:
        assert got[seq] == (tree_reference(layouts[can_id], data) if can_id in layouts else None)


def test_selectors_in_a_circle_are_a_problem(make_raw, make_catalogue):
    catalogue = make_catalogue(
        signal_row(1, "S", 0, mux_signal="T", mux_value=0), signal_row(1, "T", 8, mux_signal="S", mux_value=0),
        signal_row(1, "x", 16), signal_row(2, "y", 0),
    )
    assert {(r.signal, r.problem) for r in catalogue.problems.collect()} == {
        (n, f"1.{n}: selectors select each other") for n in ("S", "T")
    }
    frames = make_raw(raw_row(1, 1.0, 1, bytes(8)), raw_row(2, 1.0, 2, b"\x07"))
    assert shapes(frames, catalogue) == {1: None, 2: {"y": (7.0, None)}}


def test_plain_catalogues_carry_no_code_for_trees(make_raw, make_catalogue):
    one = make_catalogue(signal_row(1, "S"), signal_row(1, "x", 8, mux_signal="S", mux_value=0))
    assert one.traits.muxed and not one.traits.nested and not one.traits.broken
    plan = signals_long(make_raw(raw_row(1, 1.0, 1, bytes(8))), one)._jdf.queryExecution().executedPlan().toString()
    assert "forall" not in plan and "is_broken" not in plan


def test_many_ids_become_a_range(make_raw, make_catalogue, monkeypatch):
    monkeypatch.setattr(catalogue_module, "LITERAL_IDS", 2)
    catalogue = make_catalogue(*[signal_row(m, "x") for m in (3, 5, 9)])
    frames = make_raw(*[raw_row(m, 1.0, m, b"\x01") for m in range(12)])
    long = signals_long(frames, catalogue)
    assert sorted(r.seq for r in long.collect()) == [3, 5, 9]
    assert "(can_id_dec#" in long._jdf.queryExecution().optimizedPlan().toString() and " <= 9" in long._jdf.queryExecution().optimizedPlan().toString()


def test_missing_or_unreadable_catalogue_turns_decoding_off(spark, make_raw, tmp_path):
    assert load_catalogue(spark, None) is None
    assert load_catalogue(spark, str(tmp_path / "absent")) is None
    (tmp_path / "broken.parquet").write_text("no parquet")
    broken = load_catalogue(spark, str(tmp_path / "broken.parquet"))
    assert broken is None
    frames = normalise(make_raw(raw_row(1, 1.0, 5, b"\x01")))
    assert decode(frames, broken).first().parsed is None
    assert signals_long(frames, broken).count() == 0
    assert frames_wide(frames, broken).columns == ["timestamp", "can_id", "dlc", "data_hex"]


def test_catalogue_files(spark, tmp_path):
    from buslens.schemas import CATALOGUE

    rows = [signal_row(256, "Gear", 0, 8, choices={0: "N", 1: "D"}, position=0), signal_row(256, "V", 8, 8, position=1)]
    table = spark.createDataFrame(rows, CATALOGUE)
    table.write.parquet(str(tmp_path / "p"))
    table.write.json(str(tmp_path / "j"))
    table.withColumn("choices", F.to_json("choices")).write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    for fmt in ("parquet", "json", "csv"):
        loaded = load_catalogue(spark, str(tmp_path / fmt[0]), fmt)
        assert loaded.names() == ["Gear", "V"], fmt
        assert loaded.traits.labelled, fmt


def test_message_info_and_expected_signals(spark, make_catalogue):
    catalogue = make_catalogue(
        signal_row(1, "b", 8, position=1, cycle_time_ms=100), signal_row(1, "a", 0, position=0, cycle_time_ms=100),
        signal_row(2, "a", 0), signal_row(3, None, None, None, None),
    )
    info = {r.message_id: (r.message_name, r.signals, r.cycle_time_ms) for r in message_info(catalogue).collect()}
    assert info == {1: ("M1", ["a", "b"], 100), 2: ("M2", ["a"], None), 3: ("M3", [], None)}
    assert sorted(r.signal for r in expected_signals(catalogue).collect()) == ["a", "b"]
    assert catalogue.names() == ["a", "b"]
    ids = spark.createDataFrame([(1,), (99,)], "can_id_dec bigint")
    found = {r.can_id_dec: r.message_name for r in info_for_ids(ids, catalogue).collect()}
    assert found == {1: "M1", 99: None}


def test_message_without_signals_gives_an_empty_map(make_raw, make_catalogue):
    catalogue = make_catalogue(signal_row(1, "x"), signal_row(3, None, None, None, None))
    frames = make_raw(raw_row(1, 1.0, 3, b"\x01"), raw_row(2, 1.0, 1, b"\x01"))
    assert shapes(frames, catalogue) == {1: {}, 2: {"x": (1.0, None)}}


def test_wide_names_must_not_clash(make_raw, make_catalogue):
    frames = normalise(make_raw(raw_row(1, 1.0, 1, b"\x01")))
    for name in ("dlc", "DLC"):
        with pytest.raises(ValueError, match="clashes"):
            frames_wide(frames, make_catalogue(signal_row(1, name)))
