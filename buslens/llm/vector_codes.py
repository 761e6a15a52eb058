"""Vector codes by product quantisation, trained with active-entry Lloyd rounds.

Vectors become integers, ``floor(1024 * x)``, and are cut into equal parts. Each
position has a codebook. A round assigns every part to the nearest entry (squared
distance, ties to the lower index) and then moves each entry to the floored mean
of its parts; entries without parts stay.

Between rounds a table keeps, beside each vector, the code and the exact distance
of every part. An entry that the last update did not move keeps its distance to
every part, so a part whose own entry stayed compares the stored distance with the
moved entries only; it still beats all others. Parts whose entry moved scan the
whole codebook. Both take the lower index among equal distances, so every round
gives what a full scan gives.

A round is one narrow pass over that table and one sum per entry; what tasks
receive and the driver holds are the codebooks (``ENTRIES`` vectors), the same at
any size. Distances are exact: in doubles while all terms stay below 2**53, else
in 64-bit integers.

Defined results: vectors that are null, empty, or hold null or non-finite
components are dropped. So are those whose length differs from that of the smallest
kept id, or is no multiple of ``PARTS``. Repeated ids are rows of their own; seeds
are taken in the order of id (null last), then of components. Fewer vectors than
entries give smaller codebooks; an empty table gives an empty result. Components
too large for exact 64-bit sums raise ValueError. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import map_batches, quoted
from buslens.scale import delete, lookup_join, materialise, scratch_path

PARTS, ENTRIES, ROUNDS, STEPS = 4, 256, 4, 1024
# Parts compared at once, which bounds the matrix of distances.
ROWS_AT_ONCE = 8192
STATE = "vec_id long, label string, parts binary, entry binary, distance binary"
SUMS = "cell int, rows long, sums array<long>"


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers, and there are any."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & whole, F.lit(False))


def as_integers(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * STEPS).astype(np.int64)


class Codebooks:
    """The entries of all positions, and which of them the last update moved."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray, largest: int):
        self.entries, self.moved = entries, moved  # parts x entries x places, parts x entries
        places = entries.shape[2]
        # Twice the largest component, squared and summed, bounds every term.
        self.doubles = 4 * places * (largest + 1) ** 2 < 1 << 53

    def distances(self, part: int, rows: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of ``rows`` to the entries ``which`` of a position."""
        entries = self.entries[part, which]
        if self.doubles:
            x, c = rows.astype(np.float64), entries.astype(np.float64)
            found = (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]
            return found.astype(np.int64)
        return np.stack([((rows - c) ** 2).sum(1) for c in entries], axis=1)

    def nearest(self, part: int, rows: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and distance of the nearest of the entries ``which``; the lower index among equals."""
        index, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for begin in range(0, len(rows), ROWS_AT_ONCE):
            found = self.distances(part, rows[begin : begin + ROWS_AT_ONCE], which)
            best = found.argmin(1)
            index[begin : begin + ROWS_AT_ONCE] = which[best]
            distance[begin : begin + ROWS_AT_ONCE] = found[np.arange(len(best)), best]
        return index, distance

    def assign(self, part: int, rows: np.ndarray, entry: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New entries and distances, given those of the last round."""
        entry, distance = entry.copy(), distance.copy()
        active = np.flatnonzero(self.moved[part])
        lost = self.moved[part][entry]
        rescan, fixed = np.flatnonzero(lost), np.flatnonzero(~lost)
        if len(rescan):
            entry[rescan], distance[rescan] = self.nearest(part, rows[rescan], np.arange(self.entries.shape[1]))
        if len(fixed) and len(active):
            index, near = self.nearest(part, rows[fixed], active)
            better = (near < distance[fixed]) | ((near == distance[fixed]) & (index < entry[fixed]))
            entry[fixed[better]], distance[fixed[better]] = index[better], near[better]
        return entry, distance

    def updated(self, cells: dict[int, tuple[int, list[int]]], largest: int) -> Codebooks:
        """Entries at the floored means of their parts; unused entries stay."""
        entries = self.entries.copy()
        for cell, (rows, sums) in cells.items():
            entries[divmod(cell, ENTRIES)] = [total // rows for total in sums]
        return Codebooks(entries, (entries != self.entries).any(2), largest)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


class Layout:
    """How vectors and states are stored as bytes."""

    def __init__(self, length: int, largest: int):
        self.length, self.places = length, length // PARTS
        self.kind = next(k for k in ("<i2", "<i4", "<i8") if largest <= np.iinfo(k).max)

    def rows(self, column: pa.Array) -> np.ndarray:
        """The vectors of a column of packed parts: rows x parts x places."""
        return _bytes(column, self.kind).reshape(-1, PARTS, self.places)

    def packed(self, rows: np.ndarray) -> pa.Array:
        return _binary(rows.reshape(len(rows), self.length).astype(self.kind))


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    """The values of a column of equally long binary cells."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, kind)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary cell for each row of a matrix."""
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    offsets = np.arange(len(data) + 1, dtype=np.int64) * width
    cells = pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    return cells.cast(pa.binary())


def _first_state(kept: DataFrame, layout: Layout, books: Codebooks) -> DataFrame:
    """Every kept vector with its nearest entries, by full scans."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pc.list_flatten(batch.column("vector")).to_numpy(zero_copy_only=False)
            rows = as_integers(values).reshape(-1, PARTS, layout.places)
            found = [books.nearest(p, rows[:, p], np.arange(books.entries.shape[1])) for p in range(PARTS)]
            yield _state_batch(batch, layout.packed(rows), found)

    return map_batches(kept.select("vec_id", "label", "vector"), work, STATE)


def _next_state(state: DataFrame, layout: Layout, books: Codebooks) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, entry, distance = _unpacked(batch, layout)
            found = [books.assign(p, rows[:, p].astype(np.int64), entry[:, p].astype(np.int64), distance[:, p]) for p in range(PARTS)]
            yield _state_batch(batch, batch.column("parts"), found)

    return map_batches(state, work, STATE)


def _unpacked(batch: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    entry = _bytes(batch.column("entry"), "u1").reshape(-1, PARTS)
    return layout.rows(batch.column("parts")), entry, _bytes(batch.column("distance"), "<i8").reshape(-1, PARTS)


def _state_batch(batch: pa.RecordBatch, parts: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    entry = np.stack([index for index, _ in found], 1).astype(np.uint8)
    distance = np.stack([near for _, near in found], 1).astype("<i8")
    columns = [batch.column("vec_id"), batch.column("label"), parts, _binary(entry), _binary(distance)]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "parts", "entry", "distance"])


def _cells(state: DataFrame, layout: Layout) -> dict[int, tuple[int, list[int]]]:
    """Number and sum of the parts of every entry; each task sends one row per entry."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros(PARTS * ENTRIES, np.int64)
        sums = np.zeros((PARTS * ENTRIES, layout.places), np.int64)
        for batch in batches:
            parts, entry, _ = _unpacked(batch, layout)
            for p in range(PARTS):
                cell = p * ENTRIES + entry[:, p].astype(np.int64)
                rows += np.bincount(cell, minlength=len(rows))
                order = np.argsort(cell, kind="stable")
                used, first = np.unique(cell[order], return_index=True)
                if len(used):
                    sums[used] += np.add.reduceat(parts[order, p].astype(np.int64), first, axis=0)
        used = np.flatnonzero(rows)
        lists = pa.array(list(sums[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(rows[used]), lists], ["cell", "rows", "sums"])

    sent = map_batches(state.select("parts", "entry", "distance"), work, SUMS)
    totals = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(layout.places)]
    # One row per entry comes back: PARTS * ENTRIES sums of vectors.
    found = sent.groupBy("cell").agg(F.sum("rows").alias("rows"), *totals).collect()
    return {row.cell: (row.rows, list(row[2:])) for row in found}


def train_codes(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """Every kept vector with its final entries and distances, and the codebooks they belong to."""
    label = F.col(quoted(label_column)).cast("string") if label_column in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(
        F.col(quoted(id_column)).cast("long").alias("vec_id"), label.alias("label"),
        F.col(quoted(vector_column)).cast("array<double>").alias("vector"),
    ).where(usable(F.col("vector")))
    smallest = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector")
    first = smallest.first()
    spark = vectors.sparkSession
    if first is None or len(first.vector) % PARTS:
        return spark.createDataFrame([], STATE), None
    kept = rows.where(F.size("vector") == len(first.vector))
    extent = F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))
    # ENTRIES vectors at most.
    seeds = [r.vector for r in smallest.where(F.size("vector") == len(first.vector)).limit(ENTRIES).collect()]
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.max(extent).alias("extent")).first()
    if not size.extent * STEPS < 1 << 62:
        raise ValueError("components are too large for exact 64-bit distances")
    largest = int(size.extent * STEPS) + 1
    layout = Layout(len(first.vector), largest)
    if 4 * layout.length * largest**2 >= 1 << 63 or size.rows * largest >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit distances")
    entries = as_integers(np.array(seeds)).reshape(len(seeds), PARTS, layout.places).transpose(1, 0, 2).copy()
    books = Codebooks(entries, np.ones(entries.shape[:2], bool), largest)
    state, path = _stored(_first_state(kept, layout, books))
    for _ in range(rounds):
        books = books.updated(_cells(state, layout), largest)
        earlier = path
        state, path = _stored(_next_state(state, layout, books))
        delete(spark, earlier)
    return state, books


def _stored(state: DataFrame) -> tuple[DataFrame, str]:
    """A state written to the shared folder, and where; the state before it can go then."""
    path = scratch_path(state.sparkSession, "codes")
    state.write.parquet(path)
    return state.sparkSession.read.schema(STATE).parquet(path), path


def vector_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector.

    ``code`` has two hex digits per part, ``error`` is the squared distance to
    the entries, ``label_error`` its sum over equal labels.
    """
    state, books = train_codes(vectors, id_column, vector_column, label_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = _bytes(batch.column("distance"), "<i8").reshape(-1, PARTS).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("entry"), pa.array(error)],
                                             ["vec_id", "label", "entry", "error"])

    rows = map_batches(state.select("vec_id", "label", "entry", "distance"), work, "vec_id long, label string, entry binary, error long")
    by_label = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    joined = lookup_join(rows, by_label, ["label"], "inner", null_safe=True)
    return joined.select(
        "vec_id", F.lower(F.hex("entry")).alias("code"), "error", "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )
