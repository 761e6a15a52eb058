"""Raw frames to the normalised frame record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.functions.ids import hex_id
from buslens.functions.payload import byte_list, spaced_hex
from buslens.schemas import FRAME


def quoted(name: str) -> str:
    """A column name as a reference; signal names may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def event_time(timestamp: Column) -> Column:
    """Unix seconds (DOUBLE) to TIMESTAMP, rounded to microseconds."""
    return F.timestamp_micros(F.rint(timestamp * 1e6).try_cast("bigint"))


# Derived columns: the columns each needs and how it is computed.
DERIVED: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "ts": (["timestamp"], lambda: event_time(F.col("timestamp"))),
    "can_id": (["can_id_dec"], lambda: hex_id(F.col("can_id_dec"))),
    "data_hex": (["data"], lambda: spaced_hex(F.col("data"))),
    "data_bytes": (["data"], lambda: byte_list(F.col("data"))),
}


def normalise(raw: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Add the derived columns of the frame record; flags pass through.

    One projection: no shuffle, and unused columns are pruned up to the scan.
    ``extra`` columns of the input are kept behind the record.
    """
    derived = {name: build() for name, (_, build) in DERIVED.items()}
    return raw.withColumns(derived).select(*FRAME.fieldNames(), *[quoted(c) for c in extra or []])


def moved_narrow(frames: DataFrame, move: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply ``move``, which shuffles or stores rows, without the derived columns.

    They are computed again afterwards, which costs far less than moving them.
    """
    names = [n for n, (needs, _) in DERIVED.items() if n in frames.columns and set(needs) <= set(frames.columns)]
    moved = move(frames.drop(*names))
    added = [c for c in moved.columns if c not in frames.columns]
    return moved.withColumns({n: DERIVED[n][1]() for n in names}).select(*frames.columns, *added)
