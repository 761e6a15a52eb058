"""Helpers shared by the operators: Python tasks over Arrow batches."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that a task works on at once; a longer document is one chunk.
CHUNK_BYTES = 4 << 20


def expose_package(spark: SparkSession) -> None:
    """Let local Python workers import this package; on a cluster it is shipped with the job."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable on the workers."""
    expose_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return df.mapInArrow(task, schema)


def map_groups(df: DataFrame, by: str, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``applyInArrow`` per value of ``by``, with this package importable on the workers."""
    expose_package(df.sparkSession)

    def group(table: pa.Table) -> pa.Table:
        found = work(table)
        release_memory()
        return found

    return df.groupBy(by).applyInArrow(group, schema)


def release_memory() -> None:
    """Give freed memory back: workers live on, and what one stage used the next would lack."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes for id and text, the same for repeated rows.

    Never null, so that no join adds a filter on it and exchanges stay alike.
    """
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return F.coalesce(F.unhex(digest), F.lit(b""))


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(columns: list[str]) -> str:
    """A name that none of the columns has: it is longer than all of them."""
    return "_".join(["key", *columns]).replace(".", "_").replace("`", "_")


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes, one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths.astype(np.int64)) - lengths) // limit
    for begin, end in equal_spans(part):
        yield batch.slice(begin, end - begin)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def bounds(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of the given lengths: 0 first, the total last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, …`` for each run, one after another."""
    ends = np.cumsum(lengths)
    if not len(lengths) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def equal_spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal neighbours."""
    if not len(values):
        return []
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True))


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list per run of ``values``."""
    return pa.ListArray.from_arrays(pa.array(bounds(lengths).astype(np.int32)), pa.array(values))


class PieceTable:
    """Token ids of distinct text segments, filled on demand and bounded in size.

    ``codes`` numbers the segments, ``gather`` turns numbers into ids. When the
    table is full, segments that were met once make room.
    """

    def __init__(self, encode: Callable[[list], list[np.ndarray]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self._fill([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _fill(self, segments: list, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.code = dict(zip(segments, range(len(segments)), strict=True))
        self.flat, self.lengths, self.starts = flat, lengths, bounds(lengths)[:-1]
        self.met = np.ones(len(segments), np.int64)

    def codes(self, segments: list) -> np.ndarray:
        """Numbers of the segments, valid until the next call."""
        distinct = set(segments)
        new = [s for s in distinct if s not in self.code]
        if len(self.code) + len(new) > self.limit:
            self._shrink()
            new = [s for s in distinct if s not in self.code]
        if new:
            ids = self.encode(new)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + bounds(lengths)[:-1]])
            self.flat = np.concatenate([self.flat, *ids]).astype(np.uint32, copy=False)
            self.lengths = np.concatenate([self.lengths, lengths])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        codes = np.fromiter(map(self.code.__getitem__, segments), np.int64, len(segments))
        self.met += np.bincount(codes, minlength=len(self.met))
        return codes

    def _shrink(self) -> None:
        """Keep the segments met most, half of the limit at most."""
        least = max(2, np.partition(self.met, -self.limit // 2)[-self.limit // 2] + 1 if len(self.met) > self.limit // 2 else 2)
        kept = np.flatnonzero(self.met >= least)
        names = list(self.code)
        flat, lengths = self.gather(kept)
        self._fill([names[k] for k in kept], flat, lengths)

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments in order, and how many each has."""
        lengths = self.lengths[codes]
        return self.flat[ranges(self.starts[codes], lengths)], lengths
