"""Repeated passages of many words, found by difference-cover anchors.

A window is a run of ``window`` words. Every window whose words also start
earlier (in a smaller document, or earlier in the same one) is repeated, and the
words under repeated windows are removed.

Hashing all windows would move one row for each word of the corpus. Instead:

1. Runs of ``window - period + 1`` words are hashed at positions of a difference
   cover modulo ``period`` only (4 of 13). Of two equal windows, wherever they
   start, some anchor stands at the same distance in both, so the windows of a
   repeated passage hold an anchor that occurs twice. Tasks send each anchor
   hash once per chunk of texts, in blobs per bucket of hashes.
2. From the anchors that occur twice the search extends to the windows around
   them. These alone are hashed in full (96 bits), again once per chunk, with
   document and position; per bucket all but the earliest are repeated.
3. The repeated windows return to their documents.

A hot passage therefore sends one entry per chunk of texts, not one per
occurrence, and no pairs are formed. Texts are shuffled once: the same exchange
serves the second step and the removal. Chunks and buckets are bounded in bytes.

Defined results: a null text has no words; a null id comes before all others;
rows with the same id and text are the same document and lose the same words;
rows that share an id but not the text are ordered by position alone, and equal
windows at the same position of such rows are both kept. Other columns pass
through the general form untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from buslens.llm.tasks import bounds, chunks, equal_spans, expose_package, fresh_name, map_batches, map_groups, quoted, row_key
from buslens.llm.wordhash import run_hashes, texts_words, word_hashes

WINDOW = 20
# Perfect difference covers, by period.
COVERS = {1: [0], 3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [1, 5, 11, 24, 25, 27]}
# Text bytes that one bucket of hashes stands for.
BUCKET_BYTES, LEAST_BUCKETS = 32 << 20, 64
CHUNK = 4 << 20
# What a row of a shuffle holds: a directory of the chunk, entries of a bucket, or answers.
DIRECTORY, ENTRIES, ANSWERS = 0, 1, 2
ROUTED = "chunk long, bucket int, kind int, data binary"
FOUND = "key binary, positions binary"
NO_DOC = np.iinfo(np.int64).min


def cover_of(window: int) -> tuple[int, list[int]]:
    """The period and its cover: anchors keep a third of the window at least."""
    period = max(p for p in COVERS if p == 1 or 3 * (window - p + 1) >= window)
    return period, COVERS[period]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length; whole numbers as differences, which compress well."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        if c.dtype == np.int64:
            c = np.diff(c, prepend=np.int64(0))
        raw = c.tobytes() if c.dtype != np.int64 else c.view(np.uint8).reshape(-1, 8).T.tobytes()
        body = zstandard.ZstdCompressor(level=1).compress(raw) if c.dtype == np.int64 else raw
        parts += [len(body).to_bytes(8, "little"), body]
    return b"".join(parts)


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    count, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds:
        size = int.from_bytes(data[at : at + 8], "little")
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if kind == "i8":
            raw = zstandard.ZstdDecompressor().decompress(body) if count else b""
            steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, count).T).view(np.int64).ravel()
            out.append(np.cumsum(steps))
        else:
            out.append(np.frombuffer(body, f"<{kind}"))
    return out


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``key, doc, text``: the key stands for id and text together."""
    doc, text = F.col(quoted(id_column)).cast("long"), F.col(quoted(text_column)).cast("string")
    return docs.select(row_key(doc, text).alias("key"), doc.alias("doc"), F.coalesce(text, F.lit("")).alias("text"))


def _buckets(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))


class _Chunk:
    """The different documents of a slice of rows, as word hashes."""

    def __init__(self, part: pa.RecordBatch):
        same = pc.dictionary_encode(part.column("key")).indices.to_numpy(zero_copy_only=False)
        first = np.unique(same, return_index=True)[1]
        docs = pc.fill_null(part.column("doc"), int(NO_DOC)).to_numpy(zero_copy_only=False)[first]
        order = np.argsort(docs, kind="stable")
        self.rows = first[order]
        self.docs = docs[order]
        self.keys = part.column("key").take(pa.array(self.rows)).to_pylist()
        texts = part.column("text").take(pa.array(self.rows)).cast(pa.large_binary()).to_pylist()
        self.words, self.counts = texts_words(texts)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        self.first = bounds(self.counts)[:-1]

    def directory(self) -> bytes:
        return b"".join([len(self.keys).to_bytes(8, "little"), *self.keys])


def _keys_of(directory: bytes) -> list[bytes]:
    return [directory[8 + 16 * k : 24 + 16 * k] for k in range(int.from_bytes(directory[:8], "little"))]


def _routed(part: _Chunk, chunk: int, buckets: int, hashes: np.ndarray, sent: np.ndarray, known: np.ndarray,
            at: np.ndarray, extra: list[np.ndarray], documents: bool) -> pa.RecordBatch:
    """Rows of a chunk: its directory, answers known already, and entries by bucket."""
    rows = [(chunk, chunk % buckets, DIRECTORY, part.directory())]
    owner, position = part.owner[at], at - part.first[part.owner[at]]
    if known.any():
        rows.append((chunk, chunk % buckets, ANSWERS, _pack(owner[known], position[known])))
    bucket = (hashes >> np.uint64(16)) % np.uint64(buckets)
    chosen = np.flatnonzero(sent)
    chosen = chosen[np.argsort(bucket[chosen], kind="stable")]  # by bucket, then by place
    for begin, end in equal_spans(bucket[chosen]):
        own = chosen[begin:end]
        columns = [owner[own], position[own], *[e[own] for e in extra]]
        if documents:
            columns.append(part.docs[owner[own]])
        rows.append((chunk, int(bucket[own[0]]), ENTRIES, _pack(*columns)))
    return _batch(rows, ROUTED)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            yield task << 32 | n, part
            n += 1


def _first_of_runs(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """True where a new value begins in columns taken in ``order``."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return new


def _anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Anchor hashes of every chunk, each once."""
    period, cover = cover_of(window)
    length = window - period + 1
    inside = np.zeros(period, bool)
    inside[cover] = True

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _numbered(batches):
            part = _Chunk(rows)
            place = np.arange(len(part.words)) - part.first[part.owner]
            fits = (place + length <= part.counts[part.owner]) & (part.counts[part.owner] >= window)
            at = np.flatnonzero(inside[place % period] & fits)
            hashes = run_hashes(part.words, length, at)
            order = np.argsort(hashes, kind="stable")
            new = _first_of_runs(order, hashes)
            group = np.cumsum(new) - 1
            many = np.bincount(group, minlength=group[-1] + 1 if len(group) else 0)
            sent, known = np.zeros(len(at), bool), np.zeros(len(at), bool)
            sent[order] = new
            known[order] = many[group] > 1
            short = np.ascontiguousarray((hashes & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()
            yield _routed(part, chunk, buckets, hashes, sent, known, at, [short], False)

    return map_batches(docs, work, ROUTED)


def _wide(short: np.ndarray) -> np.ndarray:
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _answered(routed: DataFrame, judge: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Judge the entries of each bucket together; everything else passes through."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.select(["chunk", "bucket", "kind", "data"]).to_pylist()
        out = [(r["chunk"], r["bucket"], r["kind"], r["data"]) for r in rows if r["kind"] != ENTRIES]
        entries = [r for r in rows if r["kind"] == ENTRIES]
        if entries:
            answers = judge([r["data"] for r in entries])
            out += [(r["chunk"], r["bucket"], ANSWERS, a) for r, a in zip(entries, answers, strict=True) if a is not None]
        return pa.Table.from_batches([_batch(out, ROUTED)])

    return map_groups(routed, "bucket", work, ROUTED)


def _returned(answered: DataFrame) -> DataFrame:
    """``key, positions`` of every document with answers, positions ascending."""

    def work(table: pa.Table) -> pa.Table:
        rows = table.select(["kind", "data"]).to_pylist()
        keys = next((_keys_of(r["data"]) for r in rows if r["kind"] == DIRECTORY), [])
        answers = [_unpack(r["data"], ["i8", "i8"]) for r in rows if r["kind"] == ANSWERS]
        if not answers:
            return pa.Table.from_batches([_batch([], FOUND)])
        owner, position = (np.concatenate(c) for c in zip(*answers, strict=True))
        order = np.lexsort([position, owner])
        order = order[_first_of_runs(order, owner, position)]
        owner, position = owner[order], position[order]
        out = [(keys[owner[a]], _pack(position[a:b])) for a, b in equal_spans(owner)]
        return pa.Table.from_batches([_batch(out, FOUND)])

    found = map_groups(answered, "chunk", work, FOUND)
    # A key met in several chunks has the same answer in each.
    return found.groupBy("key").agg(F.max("positions").alias("positions"))


def _repeated_anchors(blobs: list[bytes]) -> list[bytes | None]:
    """The entries whose hash occurs in more than one of the blobs."""
    parts = [_unpack(b, ["i8", "i8", "V6"]) for b in blobs]
    hashes = np.concatenate([_wide(p[2]) for p in parts])
    _, group, many = np.unique(hashes, return_inverse=True, return_counts=True)
    hit = np.split(many[group] > 1, np.cumsum([len(p[0]) for p in parts])[:-1])
    return [_pack(p[0][h], p[1][h]) if h.any() else None for p, h in zip(parts, hit, strict=True)]


def _windows(marked: DataFrame, window: int, buckets: int) -> DataFrame:
    """Hashes of the windows around repeated anchors, each once per chunk."""
    period, _ = cover_of(window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _numbered(batches):
            part = _Chunk(rows)
            found = rows.column("positions").take(pa.array(part.rows)).to_pylist()
            anchors = [_unpack(p, ["i8"])[0] + part.first[k] for k, p in enumerate(found) if p is not None]
            anchor = np.concatenate([np.zeros(0, np.int64), *anchors])
            size = len(part.words)
            # Marks where the stretch of starts of an anchor begins and ends.
            begin = np.maximum(anchor - period + 1, part.first[part.owner[anchor]])
            step = np.bincount(begin, minlength=size + 1) - np.bincount(anchor + 1, minlength=size + 1)
            near = np.cumsum(step)[:size] > 0
            place = np.arange(size) - part.first[part.owner]
            at = np.flatnonzero(near & (place + window <= part.counts[part.owner]))
            hashes, check = run_hashes(part.words, window, at), run_hashes(part.words, window, at, 1).astype(np.uint32)
            place, docs = place[at], part.docs[part.owner[at]]
            order = np.lexsort([place, docs, check, hashes])
            group = np.cumsum(_first_of_runs(order, hashes, check)) - 1
            head = np.flatnonzero(_first_of_runs(order, hashes, check))
            earliest = order[head][group] if len(order) else order
            later = (docs[order] != docs[earliest]) | (place[order] != place[earliest])
            sent, known = np.zeros(len(at), bool), np.zeros(len(at), bool)
            known[order] = later
            sent[order] = ~later  # the earliest, with its ties
            yield _routed(part, chunk, buckets, hashes, sent, known, at, [hashes, check], True)

    return map_batches(marked, work, ROUTED)


def _later_windows(blobs: list[bytes]) -> list[bytes | None]:
    """The entries that are not the earliest of their hash."""
    parts = [_unpack(b, ["i8", "i8", "u8", "u4", "i8"]) for b in blobs]
    place, hashes, check, docs = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3, 4))
    order = np.lexsort([place, docs, check, hashes])
    new = _first_of_runs(order, hashes, check)
    earliest = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(order), bool)
    later[order] = (docs[order] != docs[earliest]) | (place[order] != place[earliest])
    hit = np.split(later, np.cumsum([len(p[0]) for p in parts])[:-1])
    return [_pack(p[0][h], p[1][h]) if h.any() else None for p, h in zip(parts, hit, strict=True)]


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, positions``: starts of the repeated windows of the documents that have any.

    ``keyed`` has the columns ``key, doc, text``.
    """
    buckets = _buckets(keyed)
    anchors = _returned(_answered(_anchors(keyed, window, buckets), _repeated_anchors))
    marked = keyed.join(anchors, "key", "left").select("key", "doc", "text", "positions")
    return _returned(_answered(_windows(marked.where("positions is not null"), window, buckets), _later_windows))


def _removed(count: int, positions: bytes | None, window: int) -> np.ndarray:
    """True for the words under repeated windows."""
    if positions is None:
        return np.zeros(count, bool)
    starts = _unpack(positions, ["i8"])[0]
    step = np.bincount(starts, minlength=count + 1) - np.bincount(starts + window, minlength=count + 1)
    return np.cumsum(step)[:count] > 0


def _outcome(docs: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    keyed = _keyed(docs, id_column, text_column)
    return keyed.join(repeated_windows(keyed, window), "key", "left").select("doc", "text", "positions")


def removal_digests(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words, removed words and digest of the kept words of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            n_words, n_removed, digests = [], [], []
            for text, positions in zip(texts, batch.column("positions"), strict=True):
                words = text.as_py().split()  # the same white space as SPACE_BYTES
                gone = _removed(len(words), positions.as_py(), window)
                kept = [words[k] for k in np.flatnonzero(~gone)] if gone.any() else words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_batches(_outcome(docs, window, id_column, text_column), work, schema)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the removed words cut out of their texts, all columns and rows kept.

    Texts without repeated windows stay as they are, to the byte; elsewhere what
    stands between two kept words stays if nothing between them was removed, and
    is one space otherwise.
    """
    names = docs.columns
    fresh = fresh_name(names)
    keyed = _keyed(docs, id_column, text_column)
    key = row_key(F.col(quoted(id_column)).cast("long"), F.col(quoted(text_column)).cast("string"))
    found = repeated_windows(keyed, window).withColumnsRenamed({"key": fresh, "positions": f"{fresh}_at"})
    columns: list[Column] = [F.col(quoted(c)) for c in names]
    joined = docs.select(*columns, key.alias(fresh)).join(found, fresh, "left").select(*columns, f"{fresh}_at")

    plain = [f"c{k}" for k in range(len(names))]  # Python stages take no names with dots

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_column))
            places = batch.column(len(names))
            if places.null_count < len(places):
                new = [t.as_py() if p.as_py() is None or t.as_py() is None else _cut(t.as_py(), p.as_py(), window)
                       for t, p in zip(texts, places, strict=True)]
                texts = pa.array(new, texts.type)
            arrays = [texts if n == text_column else batch.column(k) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, plain)

    schema = StructType([StructField(n, f.dataType) for n, f in zip(plain, docs.schema, strict=True)])
    expose_package(docs.sparkSession)
    return joined.toDF(*plain, "places").mapInArrow(work, schema).toDF(*names)


def _cut(text: str, positions: bytes, window: int) -> str:
    data = text.encode()
    _, starts = word_hashes(data)
    gone = _removed(len(starts), positions, window)
    if gone.all():
        return ""
    # A stretch of kept words goes from its first word to the start of the next removed one.
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1))
    pieces = []
    for a, b in zip(edges, np.r_[edges[1:], len(gone)], strict=True):
        if not gone[a]:
            pieces.append(data[starts[a] : starts[b] if b < len(starts) else len(data)].rstrip())
    return b" ".join(pieces).decode()
