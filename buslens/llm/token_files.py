"""Token ids in binary blocks: documents compressed one by one with a shared dictionary.

A zstandard dictionary is trained on the serialized ids of a bounded sample of
documents. Every document is one frame of its own, so a short document is read
without its neighbours. Blocks of frames carry the hash of the dictionary and an
offset index; they are stored as binary cells of Parquet tables, which any store
that Spark reaches can hold and whose commits survive lost executors:

* ``dictionary``: its hash and bytes, one row;
* ``blocks``: shard, block, first and last document, counts, and the block;
* ``shards``: the ids stored before each shard, one row per file written.

Block layout (fixed values, little-endian): magic ``TOKZ``, version u16, bytes
per id u16, dictionary hash (32 bytes), documents u64; then per document id i64,
null flag u8 and number of ids u64, and the frame offsets u64 with the end as the
last one; then the frames.

Defined results: documents are stored in ascending id, null ids first, repeated
ids by a hash of their text; repeated rows stay. A null text is the empty text and holds
the end id alone. An empty table gives no blocks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buslens.llm.tasks import bounds, chunks, list_column, map_batches, quoted
from buslens.llm.tokens import encode_batch, text_encoder

# Fixed values of the format.
MAGIC, VERSION = b"TOKZ", 1
HEADER = struct.Struct("<4sHH32sQ")
# Bounds of the sample that the dictionary is trained on.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 1_000, 4_096, 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 3
BLOCKS = "shard int, block int, start long, n_docs long, n_ids long, first_doc long, last_doc long, data binary"


@dataclass(frozen=True)
class Dictionary:
    data: bytes

    @property
    def digest(self) -> bytes:
        return hashlib.sha256(self.data).digest()

    def _shared(self) -> zstandard.ZstdCompressionDict | None:
        return zstandard.ZstdCompressionDict(self.data) if self.data else None

    def compressor(self) -> zstandard.ZstdCompressor:
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=self._shared(), write_content_size=True)

    def decompressor(self) -> zstandard.ZstdDecompressor:
        return zstandard.ZstdDecompressor(dict_data=self._shared())


def id_bytes(tokenizer_path: str) -> int:
    return 2 if text_encoder(tokenizer_path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> Dictionary:
    """Train on the documents with the smallest id hashes; no training below a few samples."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = docs.select("doc_id").where(F.col("doc_id").isNotNull()).orderBy(*order).limit(SAMPLE_DOCUMENTS)
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").limit(SAMPLE_DOCUMENTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, lengths = encode_batch(part, "text", tokenizer_path, end_id)
                ends = bounds(lengths)
                data = [
                    ids[begin : min(end, begin + SAMPLE_IDS)].astype(f"<u{width}").tobytes()
                    for begin, end in zip(ends[:-1], ends[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["ids"])

    samples = sorted(bytes(row.ids) for row in map_batches(sample, work, "ids binary").collect())
    try:
        return Dictionary(zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes())
    except (zstandard.ZstdError, ValueError):  # too few or too short samples to train on
        return Dictionary(b"")


def pack_block(doc_ids: list, lengths: list[int], frames: list[bytes], digest: bytes, width: int) -> bytes:
    """One block from documents in order."""
    index = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        np.array(lengths, "<u8"),
        bounds(np.fromiter(map(len, frames), np.int64, len(frames))).astype("<u8"),
    ]
    return b"".join([HEADER.pack(MAGIC, VERSION, width, digest, len(doc_ids)), *[a.tobytes() for a in index], *frames])


@dataclass(frozen=True)
class Block:
    """A block opened for reading; frames are decompressed on demand."""

    doc_ids: np.ndarray
    missing: np.ndarray
    lengths: np.ndarray
    offsets: np.ndarray
    frames: memoryview
    width: int

    @classmethod
    def open(cls, data: bytes, digest: bytes) -> Block:
        magic, version, width, found, count = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a block of token ids")
        if found != digest:
            raise ValueError("the block was written with another dictionary")
        at, parts = HEADER.size, []
        for kind, size in (("<i8", count), ("u1", count), ("<u8", count), ("<u8", count + 1)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        return cls(parts[0], parts[1].astype(bool), parts[2].astype(np.int64), parts[3].astype(np.int64), memoryview(data)[at:], width)

    def ids(self, k: int, decompressor: zstandard.ZstdDecompressor) -> np.ndarray:
        """Ids of the k-th document of the block."""
        raw = decompressor.decompress(self.frames[self.offsets[k] : self.offsets[k + 1]]) if self.lengths[k] else b""
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def _blocks(ordered: DataFrame, tokenizer_path: str, end_id: int, dictionary: Dictionary, width: int) -> DataFrame:
    """Blocks of each sorted partition, numbered with the ids of the partition before them."""
    digest = dictionary.digest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, compressor = TaskContext.get().partitionId(), dictionary.compressor()
        block = start = size = 0
        ids: list = []
        lengths: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            known = [d for d in ids if d is not None]
            row = (shard, block, start, len(ids), sum(lengths), known[0] if known else None, known[-1] if known else None,
                   pack_block(ids, lengths, held, digest, width))
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for part in chunks(batch, "text"):
                encoded, counts = encode_batch(part, "text", tokenizer_path, end_id)
                data = memoryview(encoded.astype(f"<u{width}").tobytes())
                ends = bounds(counts) * width
                for doc, count, a, b in zip(part.column("doc_id").to_pylist(), counts.tolist(), ends[:-1], ends[1:], strict=True):
                    ids.append(doc)
                    lengths.append(count)
                    held.append(compressor.compress(data[a:b]))
                    size += len(held[-1])
                    if size >= BLOCK_BYTES:
                        yield close()
                        block, start, size = block + 1, start + sum(lengths), 0
                        ids, lengths, held = [], [], []
        if ids:
            yield close()

    return map_batches(ordered, work, BLOCKS)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Encode every whole text, append ``end_id`` and store the ids in ascending document id.

    One range shuffle moves the texts; each task encodes and stores its range.
    """
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))
    spark, width = docs.sparkSession, id_bytes(tokenizer_path)
    dictionary = train_dictionary(rows, tokenizer_path, end_id, width)
    spark.createDataFrame([(dictionary.digest, dictionary.data)], "digest binary, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    # Texts are dealt out before they are encoded: finding the ranges reads its input once more.
    # Ties split an id that many rows share, and rows that are repeated.
    order = ["doc_id", "hash", "tie"]
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = _blocks(ordered, tokenizer_path, end_id, dictionary, width)
    blocks.write.option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file written
    starts = totals.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("shard_start"))
    starts.coalesce(1).write.parquet(f"{path}/shards")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, Dictionary]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = Dictionary(bytes(row.data))
    if dictionary.digest != bytes(row.digest):
        raise ValueError("the dictionary does not have its hash")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    starts = spark.read.parquet(f"{path}/shards")
    return blocks.join(F.broadcast(starts), "shard"), dictionary


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of those in ``only``.

    For single documents the block bounds prune the scan, and only their frames
    are decompressed.
    """
    blocks, dictionary = _stored(spark, path)
    if only is not None:
        inside: Column = F.lit(False)
        for doc in only:
            inside = inside | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
        blocks = blocks.where(inside)
    wanted = None if only is None else np.array(only, np.int64)
    digest = dictionary.digest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = dictionary.decompressor()
        for block, first in _opened(batches, digest):
            starts = first + bounds(block.lengths)[:-1]
            rows = range(len(starts)) if wanted is None else np.flatnonzero(np.isin(block.doc_ids, wanted) & ~block.missing)
            for k in rows:
                ids = block.ids(k, decompressor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if block.missing[k] else block.doc_ids[k]], pa.int64()), pa.array([starts[k]]),
                     pa.array([len(ids)], pa.int64()), list_column(ids.astype(np.int32), np.array([len(ids)]))],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return map_batches(blocks.select("data", "start", "shard_start"), work, "doc_id long, start long, n_tokens long, ids array<int>")


def _opened(batches: Iterator[pa.RecordBatch], digest: bytes) -> Iterator[tuple[Block, int]]:
    for batch in batches:
        for data, start, shard_start in zip(*batch.columns, strict=True):
            yield Block.open(data.as_py(), digest), start.as_py() + shard_start.as_py()


def stored_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` computed from the stored blocks."""
    blocks, dictionary = _stored(spark, path)
    digest = dictionary.digest

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = dictionary.decompressor()
        for block, first in _opened(batches, digest):
            found = [block.ids(k, decompressor) for k in range(len(block.lengths))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, mask=block.missing), pa.array(first + bounds(block.lengths)[:-1]),
                 pa.array([len(i) for i in found], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in found], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return map_batches(blocks.select("data", "start", "shard_start"), work, "doc_id long, start long, n_tokens long, ids_crc32 long")
