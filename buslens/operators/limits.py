"""Frame numbers and the count and duration limits of a capture.

All limits work per ``capture_id`` on event time; order is (timestamp, seq).

Frames are numbered in pieces that one task each can sort: the time steps of a
capture. A histogram counts the frames of every step, its running sums say how
many come before, and put consecutive steps into slices of equal size. So the frames
move once, come out in the order of arrival over all slices, and are never stored.
Steps with too many frames are split at quantiles of their times, instants with too
many at quantiles of ``seq``, and what is alike in both by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buslens.operators.normalise import moved_narrow
from buslens.scale import lookup_join, materialise, row_hash

ORDER = ["timestamp", "seq"]
# Width of the time steps that find where a count limit falls.
STEP_SECONDS = 60.0
# Rows above which a step, and then an instant, is split, and the rows that a piece is to have.
HEAVY_ROWS, PIECE_ROWS = 1_000_000, 250_000
# Quantiles that a heavy step is cut at, and their accuracy; copies are dealt over so many pieces at most.
CUTS, CUT_ACCURACY, MOST_DEALT = 1_024, 8_192, 4_096
# Time steps whose running sum is taken together, as a power of two.
STEPS_TOGETHER = 10
# The position in a task that a monotonically increasing id holds in its lower bits.
ROWS_OF_A_SLICE = (1 << 33) - 1
# What cuts a heavy piece, in turn: quantiles of time, where one instant is heavy those of seq, then the hash of a copy.
CUTTERS = {"_time1": "timestamp", "_time2": "timestamp", "_seq1": "seq", "_seq2": "seq", "_copy": None}
PIECE = ["_capture", "_step", *CUTTERS]
# Steps of frames without a time and with one that is no number.
BEFORE, AFTER = -(1 << 63), (1 << 63) - 1


def number_frames(frames: DataFrame, name: str = "frame_num") -> DataFrame:
    """1-based arrival number of every frame of its capture."""
    return moved_narrow(frames, lambda rows: _numbered(rows, name))


def _numbered(frames: DataFrame, name: str) -> DataFrame:
    pieced, counts = _pieces(frames)
    slices = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    offsets = materialise(_offsets(counts, slices), "offsets")
    placed = lookup_join(pieced, offsets, PIECE, "inner").select(*frames.columns, "_hash", "_place", "_slice", "_shift")
    # Whole pieces go to slices in the order of arrival, so what is before a frame is known from the counts.
    sorted_rows = placed.repartitionById(slices, F.col("_slice")).sortWithinPartitions("_place", *ORDER, "_hash")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_OF_A_SLICE))
    return sorted_rows.withColumn(name, inside + F.col("_shift") + 1).select(*frames.columns, name)


def _pieces(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames with the keys of their piece, and the number of frames of every piece."""
    capture = F.when(F.col("capture_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), F.col("capture_id")))
    pieced = frames.withColumns({"_capture": capture, "_step": time_step(F.col("timestamp")), "_hash": row_hash(frames)})
    pieced = pieced.withColumns({column: F.lit(0) for column in CUTTERS})
    counts = materialise(_counted(pieced), "steps")
    if (counts.agg(F.max("_rows")).first()[0] or 0) <= HEAVY_ROWS:
        return pieced, counts
    # Each pass looks at what the ones before left heavy, if there is any.
    for column, value in CUTTERS.items():
        same = [f"_one_{v}" for v in ("timestamp", "seq")]
        # Seqs are compared within an instant only, hashes among frames that are alike in both.
        cut = {"timestamp": "NOT _one_timestamp", "seq": "_one_timestamp AND NOT _one_seq", None: " AND ".join(same)}[value]
        is_heavy = (F.col("_rows") > HEAVY_ROWS) & F.expr(cut)
        heavy = counts.where(is_heavy).select(*PIECE, "_rows")
        if not heavy.isEmpty():
            pieced, split = _split(pieced, heavy, column, value)
            counts = materialise(counts.where(~is_heavy).unionByName(_counted(split)), "steps")
    return pieced, counts


def _counted(pieced: DataFrame) -> DataFrame:
    """Frames per piece, and whether they agree in time and in seq."""
    one = {
        f"_one_{v}": F.min(v).eqNullSafe(F.max(v)) & (F.count(v) % F.count(F.lit(1)) == 0) for v in ("timestamp", "seq")
    }
    return pieced.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("_rows"), *[column.alias(name) for name, column in one.items()])


def _split(pieced: DataFrame, heavy: DataFrame, column: str, value: str | None) -> tuple[DataFrame, DataFrame]:
    """Cut heavy pieces at quantiles of ``value``, or by the hash; also returns just their frames.

    A quantile is a piece of its own, so a value that many frames share stands alone.
    """
    # HEAVY_ROWS frames each, so there are few.
    marked = heavy.withColumn("_deals", F.least(F.ceil(F.col("_rows") / PIECE_ROWS), F.lit(MOST_DEALT)).cast("int"))
    if value is None:
        split = materialise(marked.select(*PIECE, "_deals"), "heavy")
        place = F.pmod(F.col("_hash"), F.col("_deals")).cast("int")
    else:
        rows = pieced.join(F.broadcast(marked), PIECE, "inner")
        sketch = F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], CUT_ACCURACY)
        bounds = rows.groupBy(*PIECE).agg(F.array_sort(F.array_distinct(sketch)).alias("_bounds"))
        split = materialise(bounds, "heavy")
        below = F.size(F.filter("_bounds", lambda b: b < F.col(value)))
        place = F.when(F.col(value).isNull(), F.lit(-1)).otherwise(2 * below + F.array_contains("_bounds", F.col(value)).cast("int"))
    joined = pieced.join(F.broadcast(split.withColumn("_heavy", F.lit(True))), PIECE, "left")
    placed = joined.withColumn(column, F.when(F.col("_heavy"), F.coalesce(place, F.lit(0))).otherwise(F.col(column)))
    return placed.select(*pieced.columns), placed.where("_heavy").select(*pieced.columns)


def _offsets(counts: DataFrame, slices: int) -> DataFrame:
    """Where each piece goes: its place among all, its slice, and what turns a position there into a number."""
    together = counts.withColumn("_together", F.shiftright("_step", STEPS_TOGETHER))
    # Sums of sums, so that no window holds all steps of a capture.
    sums = together.groupBy("_capture", "_together").agg(F.sum("_rows").alias("_sum"))
    sums = sums.withColumn("_earlier", _sum_before("_sum", ["_capture"], ["_together"]))
    captures = counts.groupBy("_capture").agg(F.sum("_rows").alias("_sum"))
    captures = captures.withColumn("_others", _sum_before("_sum", [], ["_capture"])).select("_capture", "_others")
    rows = max(1, counts.agg(F.sum("_rows")).first()[0] or 0)
    inside = together.withColumn("_inside", _sum_before("_rows", ["_capture", "_together"], PIECE[1:]))
    placed = inside.join(sums.drop("_sum"), ["_capture", "_together"]).join(captures, "_capture")
    before = placed.withColumn("_before", F.col("_inside") + F.col("_earlier"))
    placed = before.withColumn("_place", F.col("_before") + F.col("_others"))
    placed = placed.withColumn("_slice", F.floor(F.col("_place") / rows * slices).cast("int"))
    firsts = placed.groupBy("_slice").agg(F.min("_place").alias("_first"))
    shift = F.col("_before") - (F.col("_place") - F.col("_first"))
    return placed.join(firsts, "_slice").select(*PIECE, "_place", "_slice", shift.alias("_shift"))


def _sum_before(column: str, keys: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def limit_count(frames: DataFrame, count: int | None) -> DataFrame:
    """The first ``count`` frames of every capture; None or 0 keeps all.

    A narrow pre-aggregation finds the time step in which a capture reaches
    its limit. Everything after it is filtered out before the exact numbering,
    which therefore sorts little more than the frames it returns.
    """
    if not count:
        return frames
    step = time_step(F.col("timestamp"))
    steps = frames.groupBy("capture_id", step.alias("_step")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("capture_id").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        steps.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where(F.col("_before") < count)
        .groupBy("capture_id")
        .agg(F.max("_step").alias("_until"))
    )
    rows = lookup_join(frames, materialise(needed, "until"), ["capture_id"], "inner", null_safe=True)
    near = rows.where(step <= F.col("_until")).select(*frames.columns)
    return number_frames(near, "_number").where(F.col("_number") <= count).drop("_number")


def time_step(timestamp: Column) -> Column:
    """Number of the time step, in the order of the frames: no time first, NaN last."""
    step = F.floor(timestamp / STEP_SECONDS)
    return F.when(timestamp.isNull(), F.lit(BEFORE)).when(F.isnan(timestamp), F.lit(AFTER)).otherwise(step)


def limit_duration(frames: DataFrame, seconds: float | None) -> DataFrame:
    """Frames up to ``seconds`` after the first frame of their capture.

    Apply it before any ID filter: the clock starts with the capture, not with
    the first frame kept. None or 0 keeps all.
    """
    if not seconds:
        return frames
    starts = frames.groupBy("capture_id").agg(F.min("timestamp").alias("_start"))
    rows = lookup_join(frames, materialise(starts, "starts"), ["capture_id"], "inner", null_safe=True)
    return rows.where(F.col("timestamp") - F.col("_start") <= seconds).select(*frames.columns)
