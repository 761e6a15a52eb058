"""Packing documents into fixed-length sequences, shortest pack first.

Only the histogram of piece lengths reaches the driver, at most one count per
length up to the sequence length. Lengths are placed longest first, each time
into the packs with the most room; packs of equal content are one pattern with a
count, so the work depends on the lengths, not on the documents. Patterns are
joined back by rank: the n-th piece of a length takes the n-th place for it.

A pattern opens at most once per length and splits at most once per length, so
there are at most 2 x 4096 of them, each with at most 90 different lengths; the
table of places that tasks receive is therefore bounded, whatever the input.

Ranks need no sort and gather no length in one task: each task numbers its own
pieces per length, and the counts per (length, task) give the offsets.

Defined results: a null text is the empty text and packs its end id alone;
repeated rows are packed each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buslens.llm.tasks import bounds, chunks, map_batches, quoted, ranges
from buslens.llm.tokens import encode_batch
from buslens.scale import materialise

SEQUENCE = 4_096
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, task int, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most ``sequence`` ids of every whole text, numbered per task and length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(sequence + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, counts = encode_batch(part, "text", tokenizer_path, end_id)
                data, first = memoryview(ids.astype("<u4").tobytes()), bounds(counts)[:-1]
                many = -(-counts // sequence)
                doc = np.repeat(np.arange(len(counts)), many)
                start = ranges(np.zeros(len(many), np.int64), many) * sequence
                length = np.minimum(sequence, counts[doc] - start)
                at = 4 * (first[doc] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at, at + 4 * length, strict=True)]
                order = np.argsort(length, kind="stable")
                nth = np.empty(len(length), np.int64)
                runs = np.bincount(length, minlength=sequence + 1)
                nth[order] = ranges(seen[runs > 0], runs[runs > 0])
                seen += runs
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)),
                     pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), task, np.int32)), pa.array(nth)],
                    [c.split()[0] for c in PIECES.split(", ")],
                )

    return map_batches(docs, work, PIECES)


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(packs, [(length, times), …])`` for a histogram of lengths."""
    by_room: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(sequence + 1)]
    for length in sorted(counts, reverse=True):
        left, room = counts[length], sequence
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room >= length:
                packs, content = by_room[room].pop()
                used = min(packs, left)
                if used < packs:
                    by_room[room].append((packs - used, content))
                left -= used
                by_room[room - length].append((used, _with(content, length, 1)))
            else:  # nothing fits: a new pack takes as many of this length as it can hold
                fit = sequence // length
                for packs, times in ((left // fit, fit), (bool(left % fit), left % fit)):
                    if packs:
                        by_room[sequence - times * length].append((int(packs), [(length, times)]))
                left = 0
    return [pattern for same in by_room for pattern in same]


def _with(content: list[tuple[int, int]], length: int, times: int) -> list[tuple[int, int]]:
    if content and content[-1][0] == length:
        return [*content[:-1], (length, content[-1][1] + times)]
    return [*content, (length, times)]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each run of equal lengths in a pattern: the ranks it takes and where they go."""
    rows, taken, first = [], {}, 0
    for packs, content in patterns:
        offset = 0
        for length, times in content:
            rank = taken.get(length, 0)
            rows.append((length, rank, packs, first, offset))
            taken[length] = rank + packs * times
            offset += length * times
        first += packs
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, k] for k, name in enumerate(("length", "rank", "packs", "first", "offset"))}


def assign(length: np.ndarray, rank: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    heads = np.searchsorted(table["length"], length)
    ends = np.searchsorted(table["length"], length, side="right")
    for value in np.unique(length):
        mine = np.flatnonzero(length == value)
        low, high = heads[mine[0]], ends[mine[0]]
        run = low + np.searchsorted(table["rank"][low:high], rank[mine], side="right") - 1
        behind = rank[mine] - table["rank"][run]
        sequence[mine] = table["first"][run] + behind % table["packs"][run]
        offset[mine] = table["offset"][run] + behind // table["packs"][run] * value
    return sequence, offset


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int, sequence: int = SEQUENCE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every id of every document in one piece of one sequence; see ``PACKED``."""
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))
    cut = materialise(pieces(rows, tokenizer_path, end_id, sequence), "pieces")  # numbers must not change below
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(pack_histogram(histogram, sequence)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            found = assign(length, batch.column("rank").to_numpy(), table.value)
            kept = [batch.column(c) for c in ("doc_id", "start", "ids_crc32", "doc_tokens")]
            arrays = [*kept[:2], pa.array(length), *kept[2:], *map(pa.array, found)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PACKED.split(", ")])

    return map_batches(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"), work, PACKED)
