from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from buslens import scale
from buslens.operators import ordered
from buslens.operators.limits import limit_count, limit_duration, number_frames
from buslens.operators.normalise import normalise
from buslens.plans.capture import select_frames
from buslens.schemas import RAW_FRAME
from tests.conftest import raw_row, signal_row


@pytest.fixture(autouse=True)
def several_slices(spark):
    """Keep small shuffles apart, or these tables would fit into one slice."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed_rows(seed=5, n=3000):
    """One capture with a third of the rows at one instant, copies and a null capture."""
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        capture = rnd.choices(["hot", "b", "c", None], [70, 20, 9, 1])[0]
        t = 50.0 if rnd.random() < 0.33 else round(rnd.uniform(0, 600), 3)
        rows.append(raw_row(seq, t, rnd.choice([1, 2, 3]), bytes([seq % 256]), capture=capture))
    rnd.shuffle(rows)
    return rows


def arrival(rows):
    by_capture: dict = {}
    for row in sorted(rows, key=lambda r: (r[2], r[1])):
        by_capture.setdefault(row[0], []).append(row)
    return by_capture


def test_numbers_under_skew(spark):
    rows = skewed_rows()
    frames = spark.createDataFrame(rows, RAW_FRAME)
    got = {(r.capture_id, r.seq): r.frame_num for r in number_frames(frames).collect()}
    want = {(c, r[1]): i for c, rs in arrival(rows).items() for i, r in enumerate(rs, 1)}
    assert got == want


def test_hot_instant_is_split_over_slices(spark):
    frames = spark.createDataFrame(skewed_rows(), RAW_FRAME)
    slices = scale.sorted_slices(frames, ["capture_id"], ["timestamp", "seq"])
    sizes = [r["count"] for r in slices.groupBy("_slice").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * 3000
    hot = slices.where("capture_id = 'hot' AND timestamp = 50.0").select("_slice").distinct().count()
    assert hot > 1


def test_copies_all_get_numbers(spark):
    rows = [raw_row(7, 1.0, 1, b"\x01")] * 500 + [raw_row(8, 2.0, 1, b"\x02")] * 3
    numbers = [r.frame_num for r in number_frames(spark.createDataFrame(rows, RAW_FRAME)).collect()]
    assert sorted(numbers) == list(range(1, 504))


def test_derived_columns_survive_numbering(make_raw):
    frames = normalise(make_raw(raw_row(1, 1.0, 0x100, b"\xaa\xbb"), raw_row(2, 0.5, 5, b"")))
    numbered = number_frames(frames)
    assert numbered.columns == [*frames.columns, "frame_num"]
    rows = {r.frame_num: r for r in numbered.collect()}
    assert rows[2].data_hex == "AA BB" and rows[2].data_bytes == [170, 187] and rows[1].can_id == "0x005"
    assert rows[2].ts == frames.where("seq = 1").first().ts


@pytest.mark.parametrize("count", [1, 7, 500, 10_000])
def test_count_limit(spark, count):
    rows = skewed_rows()
    frames = spark.createDataFrame(rows, RAW_FRAME)
    got = {(r.capture_id, r.seq) for r in limit_count(frames, count).collect()}
    assert got == {(c, r[1]) for c, rs in arrival(rows).items() for r in rs[:count]}


def test_no_limit(make_raw):
    frames = make_raw(raw_row(1, 1.0, 1))
    for nothing in (None, 0):
        assert limit_count(frames, nothing) is frames
        assert limit_duration(frames, nothing) is frames


def test_duration_counts_from_first_frame_and_is_inclusive(make_raw):
    frames = make_raw(
        raw_row(1, 10.0, 9), raw_row(2, 11.0, 1), raw_row(3, 15.0, 1), raw_row(4, 15.5, 1),
        raw_row(1, 100.0, 1, capture="d"), raw_row(2, 106.0, 1, capture="d"), raw_row(5, 3.0, 1, capture=None),
    )
    kept = {(r.capture_id, r.seq) for r in limit_duration(frames, 5).collect()}
    assert kept == {("c1", 1), ("c1", 2), ("c1", 3), ("d", 1), (None, 5)}
    # The clock starts with ID 9 although the filter drops it.
    both = {(r.capture_id, r.seq) for r in select_frames(frames, ids=[1], duration=5, count=1).collect()}
    assert both == {("c1", 2), ("d", 1), (None, 5)}


def test_previous_row_crosses_slices(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([None, 1.0, 2.0])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): (r.pt, r.pv) for r in ordered.with_previous(df, ["k"], ["t"], {"pt": "t", "pv": "v"}).collect()}
    last, want = {}, {}
    for k, t, v in rows:
        want[k, t] = last.get(k, (None, None))
        last[k] = (t, v)
    assert got == want


def test_lookup_join_beyond_the_broadcast_bound(spark):
    big = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    big = big.unionByName(spark.range(5).select(F.lit(None).cast("bigint").alias("k"), "id"))
    small = spark.createDataFrame([(k, f"n{k}") for k in range(5)] + [(None, "none")], "k bigint, name string")
    for how, rows in (("inner", 715), ("left", 1005), ("left_semi", 715)):
        joined = scale.lookup_join(big, small, ["k"], how, max_rows=3)
        assert joined.count() == rows and "_salt" not in joined.columns, how
        assert joined.count() == scale.lookup_join(big, small, ["k"], how).count()
    safe = scale.lookup_join(big, small, ["k"], "inner", max_rows=3, null_safe=True)
    assert safe.columns == ["k", "id", "name"]
    assert safe.where("k IS NULL AND name = 'none'").count() == 5
    assert sorted(map(tuple, safe.collect()), key=str) == sorted(
        map(tuple, scale.lookup_join(big, small, ["k"], "inner", null_safe=True).collect()), key=str
    )


def test_broadcast_bounds(spark):
    assert scale.fits_broadcast(spark.range(10), max_rows=10)
    assert not scale.fits_broadcast(spark.range(11), max_rows=10)
    wide = spark.range(5).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert scale.fits_broadcast(wide, max_bytes=6000) and not scale.fits_broadcast(wide, max_bytes=4000)
    assert scale.fits_broadcast(spark.range(0))


def test_scratch_is_dropped(spark, make_catalogue):
    import glob

    catalogue = make_catalogue(signal_row(1, "x"))
    table = scale.materialise(spark.range(3), "probe")
    folder = f"{scale.scratch_dir(spark)}/probe-*"
    assert table.count() == 3 and glob.glob(folder)
    assert scale.drop_scratch(spark) >= 1 and not glob.glob(folder)
    assert scale.drop_scratch(spark) == 0 and catalogue.signals.count() == 1


def test_salts_spread_one_hot_key(spark):
    big = spark.range(0, 64_000, numPartitions=4).select(F.lit(1).alias("k"), "id")
    small = spark.createDataFrame([(k,) for k in range(10)], "k int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = scale.lookup_join(big, small, ["k"], "inner", small_fits=False)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 64_000 and max(sizes) < 0.6 * 64_000


def test_scratch_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "/shared/checkpoints/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert scale.scratch_dir(Session()) == "/shared/checkpoints"
