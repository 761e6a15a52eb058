"""Frame validation, missing frames, duplicates and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.functions.payload import FD_LENGTHS, MAX_BYTES
from buslens.operators.normalise import normalise
from buslens.operators.ordered import with_previous
from buslens.scale import any_of, lookup_join
from buslens.schemas import RAW_FRAME
from buslens.sources.catalogue import Catalogue

# Largest 11-bit and 29-bit identifiers.
MAX_STANDARD_ID, MAX_EXTENDED_ID = 0x7FF, 0x1FFFFFFF
# What makes two frames copies of each other.
COPY_KEY = ["capture_id", "timestamp", "can_id_dec", "data"]
REPORT_COLUMNS = [
    "capture_id", "can_id_dec", "frames", "unknown_frames", "error_frames", "remote_frames",
    "invalid_frames", "duplicate_frames", "gaps",
]


def frame_rules(classic: bool = False) -> dict[str, Column]:
    """Conditions that make a frame invalid, by reason.

    Payloads of more than 8 bytes are those of flexible-data-rate frames, which
    come in certain lengths; ``classic`` takes none of them.
    """
    size = F.length("data")
    long = size > MAX_BYTES
    remote = F.coalesce(F.col("is_remote"), F.lit(False))
    can_id, extended = F.col("can_id_dec"), F.coalesce(F.col("is_extended"), F.lit(False))
    return {
        "no timestamp": F.col("timestamp").isNull() | F.isnan("timestamp"),
        "negative timestamp": F.col("timestamp") < 0,
        "no identifier": can_id.isNull() | (can_id < 0),
        "identifier needs extended frame": (can_id > MAX_STANDARD_ID) & (can_id <= MAX_EXTENDED_ID) & ~extended,
        "identifier out of range": can_id > MAX_EXTENDED_ID,
        "no payload": F.col("data").isNull(),
        "payload too long": long if classic else size > FD_LENGTHS[-1],
        "no length of a frame": F.lit(False) if classic else long & (size <= FD_LENGTHS[-1]) & ~size.isin(FD_LENGTHS),
        "remote frame with data": remote & (size > 0),
        "length differs from payload": ~remote & (F.col("dlc").isNull() | (F.col("dlc") != size)),
    }


def frame_reasons(classic: bool = False) -> Column:
    """Array of reasons why a frame is invalid; empty for a good frame."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(reason)) for reason, rule in frame_rules(classic).items()]))


def with_reasons(frames: DataFrame, classic: bool = False) -> DataFrame:
    """All frames with their ``reasons``, for reports that need both kinds in one pass."""
    return frames.withColumn("reasons", frame_reasons(classic))


def is_invalid(classic: bool = False) -> Column:
    """Any rule broken; cheaper than the reasons and never null."""
    return any_of([F.coalesce(rule, F.lit(False)) for rule in frame_rules(classic).values()])


def valid_frames(frames: DataFrame, classic: bool = False) -> DataFrame:
    return frames.where(~is_invalid(classic))


def quarantined_frames(frames: DataFrame, classic: bool = False) -> DataFrame:
    """Invalid frames with their reasons."""
    return frames.where(is_invalid(classic)).withColumn("reasons", frame_reasons(classic))


def split_valid(frames: DataFrame, classic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good frames, and quarantined frames with their reasons; each is one filter on the scan."""
    return valid_frames(frames, classic), quarantined_frames(frames, classic)


def cycle_times(catalogue: Catalogue) -> DataFrame:
    """``can_id_dec, cycle_time_ms`` of the messages that are sent in cycles."""
    return (
        catalogue.signals.where(F.col("cycle_time_ms") > 0)
        .groupBy(F.col("message_id").alias("can_id_dec"))
        .agg(F.max("cycle_time_ms").alias("cycle_time_ms"))
    )


def missing_frames(frames: DataFrame, catalogue: Catalogue, factor: float = 1.5) -> DataFrame:
    """Gaps longer than ``factor`` cycle times before a frame of the same ID.

    Copies at one timestamp cannot form a gap, so they are merged first; only
    messages with a cycle time are read at all.
    """
    cycles = cycle_times(catalogue)
    keys = ["capture_id", "can_id_dec"]
    timed = frames.where(F.col("timestamp").isNotNull() & ~F.isnan("timestamp"))
    known = lookup_join(
        timed.select(*keys, "timestamp", "seq"), cycles, ["can_id_dec"], "inner", small_fits=catalogue.small
    )
    instants = known.groupBy(*keys, "timestamp").agg(
        F.min("seq").alias("seq"), F.max("seq").alias("_last_seq"), F.first("cycle_time_ms").alias("cycle_time_ms")
    )
    stepped = with_previous(
        instants, keys, ["timestamp"], {"previous_timestamp": "timestamp", "previous_seq": "_last_seq"}
    )
    gap = F.col("timestamp") - F.col("previous_timestamp")
    return (
        stepped.withColumn("gap_seconds", gap)
        .where(F.col("gap_seconds") > F.col("cycle_time_ms") / 1000.0 * factor)
        .select(*keys, "seq", "previous_seq", "timestamp", "previous_timestamp", "gap_seconds", "cycle_time_ms")
    )


def duplicate_frames(frames: DataFrame) -> DataFrame:
    """Groups of identical frames with their number of copies.

    Copies collapse before the shuffle, so a large group costs one task little.
    """
    return (
        frames.groupBy(*COPY_KEY)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("seq").alias("first_seq"))
        .where(F.col("copies") > 1)
    )


def drop_duplicate_frames(frames: DataFrame) -> DataFrame:
    """Keep the first (lowest ``seq``, none last) of identical frames."""
    rest = [name for name in RAW_FRAME.fieldNames() if name not in (*COPY_KEY, "seq")]
    # ``min_by`` passes over rows whose order is null.
    order = F.coalesce("seq", F.lit((1 << 63) - 1))
    # One value each instead of a struct, so that the aggregation hashes instead of sorting.
    first = frames.groupBy(*COPY_KEY).agg(
        F.min("seq").alias("seq"), *[F.min_by(name, order).alias(name) for name in rest]
    )
    return normalise(first)


def quality_report(frames: DataFrame, catalogue: Catalogue | None, factor: float = 1.5) -> DataFrame:
    """Frames, unknown, error, remote and invalid frames, copies and gaps per capture and ID."""
    keys = ["capture_id", "can_id_dec"]
    error, remote = F.coalesce("is_error", F.lit(False)), F.coalesce("is_remote", F.lit(False))
    per_payload = (
        frames.withColumn("_bad", is_invalid())
        .groupBy(*keys, "timestamp", "data")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(error).alias("error"),
            F.count_if(remote).alias("remote"),
            F.count_if("_bad").alias("bad"),
        )
    )
    report = per_payload.groupBy(*keys).agg(
        F.sum("n").alias("frames"),
        F.sum("error").alias("error_frames"),
        F.sum("remote").alias("remote_frames"),
        F.sum("bad").alias("invalid_frames"),
        F.sum(F.col("n") - 1).alias("duplicate_frames"),
    )
    if catalogue is None:
        nothing = F.lit(0).cast("bigint")
        return report.withColumns({"unknown_frames": F.col("frames"), "gaps": nothing}).select(*REPORT_COLUMNS)
    known = (
        catalogue.signals.select(F.col("message_id").alias("can_id_dec"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    report = lookup_join(report, known, ["can_id_dec"], "left", small_fits=catalogue.small)
    unknown = F.when(F.col("_known").isNull(), F.col("frames")).otherwise(F.lit(0))
    report = report.withColumns({"unknown_frames": unknown, "gaps": F.lit(0)}).drop("_known")
    gaps = missing_frames(frames, catalogue, factor).select(*keys, F.lit(1).alias("gaps"))
    # Added up instead of joined, so that null keys stay whole.
    counts = [c for c in REPORT_COLUMNS if c not in keys]
    both = report.unionByName(gaps, allowMissingColumns=True)
    totals = both.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return totals.select(*REPORT_COLUMNS)
