"""Scoring texts by prediction by partial matching over byte contexts.

A text is its lower-cased words, each closed by a space, and an end mark; a space
stands before it. The model is a trie of byte contexts of up to ``ORDER`` bytes of
the running text, with the counts of the bytes that followed them in the training
documents. A byte is coded in the longest known context; where it was not seen
there, an escape (as many counts as different bytes) leads to the next shorter
one, in which bytes of the longer are excluded; last, all bytes are equal. The
score is the sum of the log10 probabilities. ``across_words=False`` ends contexts
at the space before the word instead.

A gram is a byte behind its longest context. The trie is never in one place:

1. a bounded sample tells which contexts of 2 to 5 bytes stand before more than one
   symbol in ``HOT_SHARE``. They steer the layout alone: any choice gives the same scores;
2. tasks turn chunks of texts into the distinct words and the distinct grams with
   their training counts; both and the texts are stored;
3. counts behind contexts of one byte or none and behind hot ones, 322,560 at most,
   are summed and sent to all tasks;
4. grams meet in buckets of the last two bytes of their contexts, behind a hot context
   of one byte more, and so on: a bucket has all counts of every longer context in it.
   Every gram of every training document counts; the distinct ones are coded and their
   code lengths return to the chunks. Words meet once, in buckets of their hashes, for
   the exact corpus counts;
5. chunks sum counts and code lengths over their texts, block by block.

Texts move once. A frequent word or gram sends one entry per chunk. Defined
results: a null text is empty and has the end alone; a null id is the text of no
digits, which is held out; repeated rows are counted and returned each; without
training documents every byte has the same probability. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buslens.llm.tasks import bounds, chunks, equal_spans, map_batches, map_groups, quoted, release_memory
from buslens.llm.wordhash import SPACE_BYTES, word_hashes
from buslens.scale import materialise

# Bytes of context; a longer one with its byte and its size does not fit a 64-bit key.
ORDER = 6
HELD_OUT_OF = 10
SMOOTHING = 0.1
# The marks behind a word and behind a text, and how many bytes there are besides white space.
WORD_END, TEXT_END, ALPHABET = 0x20, 0x0A, 250 + 2
# Bytes of a chunk, which sends each gram once, and of the blocks it is cut into, which bound what is in memory.
CHUNK, BLOCK = 16 << 20, 1 << 20
# Words hashed at once, whose tables of powers stay in memory, and blocks whose grams wait to be merged.
HASHED_WORDS, MERGED_BLOCKS = 1 << 13, 4
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 128
# Bits of a code length that do not travel: the relative error of a score stays below 2 ** -33.
CUT_BITS = 20
# Rows of a chunk besides its buckets: texts, and counts behind the shortest contexts.
TEXTS, LOW = -1, -2
LOW_SIZES, HIGH_SIZES, HOT_SIZES = (0, 1), range(2, ORDER + 1), range(2, ORDER)
# A context before this share of all symbols is hot, judged by so many bytes of texts.
HOT_SHARE, SAMPLE_BYTES = 256, 16 << 20
WORDS = "chunk long, bucket int, data binary"
COUNTED = WORDS + ", tokens long, distinct long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
MASKS = np.array([(1 << 8 * k) - 1 for k in range(ORDER + 1)], np.uint64)
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[ord("A") : ord("Z") + 1] += 32
FOLDED[list(SPACE_BYTES)] = WORD_END


def _squeeze(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays one after another, each compressed."""
    out = []
    for a in arrays:
        body = zstandard.ZstdCompressor(level=level).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a))
        out += [len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def _expand(data: bytes | pa.Buffer, kinds: list[str]) -> list:
    data, out, at = memoryview(data), [], 0
    for kind in kinds:
        size = int.from_bytes(data[at : at + 8], "little")
        raw = zstandard.ZstdDecompressor().decompress(data[at + 8 : at + 8 + size])
        out.append(raw if kind == "bytes" else np.frombuffer(raw, kind))
        at += 8 + size
    return out


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


def _stream(texts: pa.Array) -> np.ndarray:
    """The bytes of all texts: a space, the words with a space behind each, and the end mark."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = np.cumsum(np.diff(offsets) + 3)
    out = np.full(len(data) + 3 * len(texts), WORD_END, np.uint8)
    out[ends - 1] = TEXT_END
    body = np.ones(len(out), bool)
    for mark in (ends - 1, ends - 2, np.r_[0, ends[:-1]]):
        body[mark] = False
    out[body] = FOLDED[data]
    space = out == WORD_END
    return out[~(space & np.r_[False, space[:-1]])]


def _begins(stream: np.ndarray) -> np.ndarray:
    """Whether a text begins at each byte."""
    return np.r_[True, stream[:-1] == TEXT_END]


def _word_blocks(stream: np.ndarray) -> Iterator[np.ndarray]:
    """The words of the stream, each with its space, ``BLOCK`` bytes together, one word at least."""
    begin = 0
    while begin < len(stream):
        end = min(begin + BLOCK, len(stream))
        while end < len(stream) and stream[end - 1] != WORD_END:
            behind = np.flatnonzero(stream[end : end + BLOCK] == WORD_END)
            end = end + int(behind[0]) + 1 if len(behind) else min(end + BLOCK, len(stream))
        marks = stream[begin:end] == TEXT_END
        marks[1:] |= marks[:-1]  # the space before a text
        marks[0] |= not begin
        yield stream[begin:end][~marks]
        begin = end


def _split(data: np.ndarray) -> pa.LargeBinaryArray:
    """Words one after another, each with its space, as an array."""
    offsets = np.r_[0, np.flatnonzero(data == WORD_END) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _joined(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words one after another, and where each begins; the total last."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _words(stream: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Distinct words with their spaces, the number of each word in turn, and how many words each text has."""
    spaces, before = [], 0
    for begin in range(0, len(stream), BLOCK):
        block = stream[begin : begin + BLOCK]
        seen = np.cumsum(block == WORD_END, dtype=np.int64) + before
        spaces.append(seen[block == TEXT_END])
        before = int(seen[-1])
    per_text = np.diff(np.concatenate(spaces), prepend=0) - 1
    coded = [pc.dictionary_encode(_split(block)) for block in _word_blocks(stream)]
    # The words of a block are distinct, so few are left to compare with those of others.
    words = pc.dictionary_encode(pa.concat_arrays([c.dictionary for c in coded]))
    of_block = words.indices.to_numpy(zero_copy_only=False)
    starts = bounds(np.array([len(c.dictionary) for c in coded]))
    number = [of_block[a:][c.indices.to_numpy(zero_copy_only=False)] for a, c in zip(starts, coded, strict=False)]
    return words.dictionary, np.concatenate(number), per_text


def _spans(size: int) -> list[slice]:
    """``size`` items by small blocks, as each takes many bytes of scratch."""
    step = max(1, BLOCK // 4)
    return [slice(a, a + step) for a in range(0, size, step)]


def _chunk_rows(doc_ids: list[int | None], stream: np.ndarray, chunk: int, buckets: int, across: bool, hot: np.ndarray) -> list[tuple]:
    """The texts of a chunk, its distinct words and behind them its distinct grams by bucket, and its ``LOW`` counts."""
    held = np.array([is_held_out(d) for d in doc_ids], bool)
    known = np.array([d is not None for d in doc_ids], bool)
    rows = [(chunk, TEXTS, _squeeze(np.array([d or 0 for d in doc_ids], "<i8"), known, held, stream, level=3))]
    words, number, per_text = _words(stream)
    learnt, train = np.repeat(~held, per_text), np.zeros(len(words), "<i8")
    for span in _spans(len(number)):
        train += np.bincount(number[span][learnt[span]], minlength=len(words))
    del number, learnt
    hashes = [word_hashes(_joined(words[a : a + HASHED_WORDS])[0])[0] for a in range(0, len(words), HASHED_WORDS)]
    bucket = (np.concatenate([np.zeros(0, np.uint64), *hashes]) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    by = np.argsort(bucket, kind="stable")
    data, starts = _joined(words.take(pa.array(by)))
    del words
    for a, b in equal_spans(bucket[by]):
        steps = np.diff(by[a:b], prepend=0).astype("<i4")
        rows.append((chunk, int(bucket[by[a]]), _squeeze(data[starts[a] : starts[b]], steps, train[by[a:b]])))
    del data, starts, hashes, bucket, by
    release_memory()
    keys, trained = _trained_grams(stream, across, held)
    order, spans = _dealt(keys, buckets, hot)
    for k, a, b in spans:
        rows.append((chunk, buckets + k, _squeeze(_steps(keys[order[a:b]]), trained[order[a:b]])))
    del order
    low, counts = _short_grams(keys[trained > 0], trained[trained > 0], hot)
    rows.append((chunk, LOW, _squeeze(_steps(low), counts)))
    return rows


def _trained_grams(stream: np.ndarray, across: bool, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a stream, ascending, and how often each occurs in texts that are not held out."""
    keys, trained, found = np.zeros(0, np.uint64), np.zeros(0, "<i8"), []
    for key, owner in _gram_blocks(stream, across):
        key |= held.astype(np.uint64)[owner] << np.uint64(63)  # held out ones behind the others
        grams, many = _runs(key)
        del key, owner
        last, many = np.searchsorted(grams, np.uint64(1 << 63)), many.astype(np.int32)
        many[last:] = 0
        grams[last:] ^= np.uint64(1 << 63)
        found += [(grams[:last], many[:last]), (grams[last:], many[last:])]
        if len(found) >= 2 * MERGED_BLOCKS:
            keys, trained = _merged([(keys, trained), *found])
            found = []
    return _merged([(keys, trained), *found])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, ascending, and the sums of their counts; each part has a key once."""
    keys = _distinct(k for k, _ in parts)
    counts = np.zeros(len(keys), np.int64)
    for own, n in parts:
        for span in _spans(len(own)):
            counts[np.searchsorted(keys, own[span])] += n[span]
    return keys, counts


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], np.ndarray]]:
    """Ids and stream of the rows of a task, ``CHUNK`` bytes of text together, one row at least."""
    doc_ids, streams, size = [], [], 0
    for batch in batches:
        for part in chunks(batch, "text", CHUNK // 8):
            doc_ids += part.column("doc_id").to_pylist()
            streams.append(_stream(part.column("text")))
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= CHUNK:
                whole = doc_ids, np.concatenate(streams)
                doc_ids, streams, size = [], [], 0
                yield whole
                del whole
    if streams:
        yield doc_ids, np.concatenate(streams)


def _chunked(docs: DataFrame, buckets: int, across: bool, hot: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, (doc_ids, stream) in enumerate(_gathered(batches)):
            yield _rows(_chunk_rows(doc_ids, stream, task << 32 | n, buckets, across, hot), WORDS)
            del doc_ids, stream
            release_memory()

    return map_batches(docs, work, WORDS)


def _hot_contexts(docs: DataFrame, size: int, across: bool) -> np.ndarray:
    """Contexts of ``HOT_SIZES`` before many symbols of a sample, with those they end in; sorted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stream in _gathered(batches):
            for key, _ in _gram_blocks(stream, across):
                keys, many = _runs(key)
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([many.sum()])], ["context", "n"])
                for k in HOT_SIZES:
                    at = keys >> np.uint64(56) >= k
                    found, n = _summed([_cut_context(keys[at] >> np.uint64(8), k)], [many[at]])
                    # Rarer ones than this are not told, so that a block sends few rows.
                    common = n * 2 * HOT_SHARE >= many.sum()
                    yield pa.RecordBatch.from_arrays([pa.array(found[common].view(np.int64)), pa.array(n[common])], ["context", "n"])

    one_of = max(1, -(-size // SAMPLE_BYTES))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(one_of)) == 0)
    counts = map_batches(sample, work, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).where("n > 0")
    total = F.max(F.when(F.col("context") == 0, F.col("n"))).over(Window.partitionBy())
    rows = counts.withColumn("total", total).where((F.col("context") != 0) & (F.col("n") * HOT_SHARE > F.col("total"))).collect()
    hot: set[int] = set()
    for context in sorted(r.context for r in rows):  # the size comes first in the order
        k = context >> 48
        if k == HOT_SIZES[0] or context & int(MASKS[k - 1]) | k - 1 << 48 in hot:
            hot.add(context)
    return np.array(sorted(hot), np.uint64)


def _bucket_words(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Training counts of the distinct words of a bucket, and the word of each entry of each blob."""
    parts = [_expand(b, ["u1", "<i4", "<i8"]) for b in blobs]
    coded = pc.dictionary_encode(_split(np.concatenate([p[0] for p in parts])))
    which = coded.indices.to_numpy(zero_copy_only=False)
    # Whole numbers up to 2**53 are exact as weights.
    counts = np.bincount(which, weights=np.concatenate([p[2] for p in parts]), minlength=len(coded.dictionary)).astype(np.int64)
    return counts, which, [np.cumsum(p[1]) for p in parts]


def _cut_context(context: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Keys of the contexts cut to their last ``size`` bytes; the size is part of the key."""
    return (context & MASKS[size]) | np.asarray(size).astype(np.uint64) << np.uint64(48)


def _gram_blocks(stream: np.ndarray, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By block: each symbol behind its longest context, as a key, and the number of its text.

    In a key the symbol is lowest, then the nearest byte of the context, and its size highest.
    """
    texts = 0
    for begin in range(0, len(stream), BLOCK):
        low = max(0, begin - ORDER - 1)
        part = stream[low : begin + BLOCK]
        key = part.astype(np.uint64)
        # Each step doubles the bytes, up to more than the context and the symbol.
        for bytes_ in (1, 2, 4):
            key[bytes_:] |= key[:-bytes_] << np.uint64(8 * bytes_)
        key &= np.uint64((1 << 8 * (ORDER + 1)) - 1)
        key |= np.uint64(ORDER << 56)
        first = _begins(part)
        marks = np.flatnonzero(first if across else part == WORD_END)
        # Contexts that a mark cuts; the nearest mark comes last.
        for size in range(ORDER - 1, 0, -1):
            at = marks[: np.searchsorted(marks, len(part) - size)] + size
            key[at] = key[at] & MASKS[size + 1] | np.uint64(size << 56)
        ends = part[begin - low :] == TEXT_END
        owner = np.cumsum(ends, dtype=np.int32) + np.int32(texts)
        texts = int(owner[-1])
        owner -= ends
        body = ~first[begin - low :]
        key = key[begin - low :][body]
        yield key, owner[body]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs; sorts the values where they are."""
    values.sort()
    first = np.flatnonzero(_firsts(values))
    return values[first], np.diff(first, append=len(values))


def _firsts(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values differs from the one before."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def _distinct(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Distinct keys of all parts, ascending; few parts are held at once."""

    def joined() -> np.ndarray:
        whole = np.concatenate(held)
        held.clear()
        whole.sort()
        return whole[_firsts(whole)]

    held = [np.zeros(0, np.uint64)]
    for part in parts:
        held.append(part)
        if len(held) > 8:
            held = [joined()]
    return joined()


def _hash_slots(keys: np.ndarray, round_: int, bits: int) -> np.ndarray:
    """A slot of ``2 ** bits`` for each key, other ones in each round."""
    mixed = (keys ^ (keys >> np.uint64(32 + round_ % 16))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).view(np.int64)


def _hash_tables(keys: np.ndarray) -> list[np.ndarray]:
    """Tables with the places of distinct keys; those whose slot another one took are in the next table."""
    tables, left = [], np.arange(len(keys), dtype=np.int32)
    while len(left):
        bits = len(left).bit_length() + 1
        slot = _hash_slots(keys[left], len(tables), bits)
        tables.append(np.zeros(1 << bits, np.int32))
        tables[-1][slot] = left
        left = left[tables[-1][slot] != left]
    return tables


def _places(tables: list[np.ndarray], keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, all of which are among the keys."""
    places = np.zeros(len(wanted), np.int32)
    at = slice(None)
    for round_, table in enumerate(tables):
        own = wanted[at]
        found = table[_hash_slots(own, round_, len(table).bit_length() - 1)]
        places[at] = found
        missed = np.flatnonzero(keys[found] != own)
        at = missed if isinstance(at, slice) else at[missed]
    return places


def _gram_counts(texts: list[bytes], counts: np.ndarray, across: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Grams of texts that occur ``counts`` times, and how often each occurs."""
    blocks = list(_gram_blocks(_stream(pa.array(texts, pa.large_binary())), across))
    return _summed([keys for keys, _ in blocks], [counts[owner] for _, owner in blocks])


def _cut_grams(keys: np.ndarray, counts: np.ndarray, sizes: Iterable[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the symbols behind contexts of these sizes, which ascend, as the keys of the result do."""
    found = []
    for size in sizes:
        at = keys >> np.uint64(56) >= size
        own = keys[at]
        found.append(_summed([_cut_context(own >> np.uint64(8), size) << np.uint64(8) | own & np.uint64(255)], [counts[at]]))
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _short_grams(keys: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the symbols behind contexts of ``LOW_SIZES`` and behind hot ones, ascending."""
    contexts = {k: np.arange(1 << 8 * k, dtype=np.uint64) | np.uint64(k << 48) for k in LOW_SIZES} | {k: hot[hot >> np.uint64(48) == k] for k in HOT_SIZES}
    sums = {k: np.zeros(len(own) << 8) for k, own in contexts.items()}
    for span in _spans(len(keys)):
        size, context, symbol = keys[span] >> np.uint64(56), keys[span] >> np.uint64(8), (keys[span] & np.uint64(255)).astype(np.int64)
        at = np.arange(len(size))
        for k, own in contexts.items():
            at = at[size[at] >= k]
            if k in LOW_SIZES:
                place = (context[at] & MASKS[k]).astype(np.int64)
            else:  # a hot context ends in a hot one, so the others need not be looked at again
                place = _find(own, _cut_context(context[at], k))
                at, place = at[place >= 0], place[place >= 0]
            sums[k] += np.bincount(place << 8 | symbol[at], weights=counts[span][at], minlength=len(own) << 8)
    found = []
    for k, own in contexts.items():
        seen = np.flatnonzero(sums[k])
        found.append((own[seen >> 8] << np.uint64(8) | (seen & 255).astype(np.uint64), sums[k][seen].astype(np.int64)))
    return np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])


def _dealt(keys: np.ndarray, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of ascending grams by bucket and key, and bucket, begin and end of each run in it."""
    bucket = np.zeros(len(keys), np.min_scalar_type(buckets))  # short numbers sort faster
    for span in _spans(len(keys)):
        context, size = keys[span] >> np.uint64(8), keys[span] >> np.uint64(56)
        dealt = _cut_context(context, np.minimum(size, HOT_SIZES[0]).astype(np.int64))
        hot_at = np.flatnonzero(size > HOT_SIZES[0])
        for k in HOT_SIZES:
            hot_at = hot_at[(size[hot_at] > k) & (_find(hot, dealt[hot_at]) >= 0)]
            dealt[hot_at] = _cut_context(context[hot_at], k + 1)
        bucket[span] = (dealt * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, [(int(bucket[order[a]]), a, b) for a, b in equal_spans(bucket[order])]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_inverse=True)
    return found, np.bincount(inverse, weights=np.concatenate([np.zeros(0), *counts]), minlength=len(found)).astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _gram_blob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a blob of grams."""
    steps, counts = _expand(data, ["bytes", "<i8"])
    raw = np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, -1).T)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64), counts


def _low_counts(chunked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training counts behind contexts of ``LOW_SIZES`` and hot ones, bounded by their number; ascending."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, counts = _gram_blob(data)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

    spread = map_batches(chunked.where(F.col("bucket") == LOW).select("data"), entries, "gram long, n long")
    rows = spread.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return _summed([np.array([r.gram for r in rows], np.int64).view(np.uint64)], [np.array([r.n for r in rows], np.int64)])


def _bucket_grams(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct grams of a bucket, their training counts, and the number of each entry of each blob."""
    parts = [_gram_blob(b) for b in blobs]
    keys = _distinct([p[0] for p in parts])
    counts, entries = np.zeros(len(keys), np.int64), []
    for own, n in parts:  # each has a gram once
        entries.append(np.searchsorted(keys, own))
        counts[entries[-1]] += n
    return keys, counts, entries


def _least_count(chunked: DataFrame, buckets: int, low: tuple[np.ndarray, np.ndarray], bound: int) -> int:
    """The count from which at most ``bound`` grams of all sizes remain."""

    def sizes(table: pa.Table) -> pa.Table:
        keys, counts, _ = _bucket_grams(table.column("data").to_pylist())
        value, many = np.unique(_high_grams(keys, counts, low[0])[1], return_counts=True)
        return pa.table([pa.array(value, pa.int64()), pa.array(many, pa.int64())], names=["value", "n"])

    found = map_groups(chunked.where(F.col("bucket") >= buckets), "bucket", sizes, "value long, n long")
    spread = Counter({r.value: r.n for r in found.groupBy("value").agg(F.sum("n").alias("n")).collect()})
    spread.update(low[1].tolist())
    kept, least = 0, max(spread, default=0) + 1
    for value in sorted(spread, reverse=True):
        kept += spread[value]
        if kept > bound or not value:
            break
        least = value
    return least


def _high_grams(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the symbols behind the contexts of ``HIGH_SIZES`` that ``low`` has not."""
    grams, n = _cut_grams(keys, counts, HIGH_SIZES)
    own = _find(np.unique(low >> np.uint64(8)), grams >> np.uint64(8)) < 0
    return grams[own], n[own]


@dataclass(frozen=True)
class Trie:
    """Context counts, sorted; contexts carry the numbers that escapes need.

    ``distinct`` and ``excluded`` end with a zero, which stands for no context (-1).
    """

    grams: np.ndarray  # context << 8 | symbol
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    excluded: np.ndarray  # what the next shorter context counts for the symbols seen here

    @classmethod
    def build(cls, grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray] | None = None, least: int = 1) -> Trie:
        """The trie of grams behind their longest contexts; ``low`` has all counts behind contexts that others add to."""
        grams, counts = _cut_grams(grams, counts, range(ORDER + 1)) if low is None else _high_grams(grams, counts, low[0])
        if low is not None:
            grams, counts = _summed([grams, low[0]], [counts, low[1]])
        grams, counts = grams[counts >= least], counts[counts >= least]
        contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
        owner = np.repeat(np.arange(len(contexts)), np.diff(np.r_[first, len(grams)]))
        total = np.bincount(owner, weights=counts, minlength=len(contexts))
        size = (contexts >> np.uint64(48)).astype(np.int64)
        shorter = np.zeros(len(contexts), np.uint64)
        for k in range(1, ORDER + 1):
            shorter[size == k] = _cut_context(contexts[size == k], k - 1)
        below = _find(grams, shorter[owner] << np.uint64(8) | grams & np.uint64(255))
        inherited = np.where((size[owner] > 0) & (below >= 0), np.append(counts, 0)[below], 0)
        excluded = np.bincount(owner, weights=inherited, minlength=len(contexts))
        distinct = np.diff(np.r_[first, len(grams)])
        return cls(grams, counts, contexts, total, np.append(distinct, 0.0), np.append(excluded, 0.0))

    def code(self, context: np.ndarray, reach: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol behind its context."""
        score = np.zeros(len(symbol))
        longer = np.full(len(symbol), -1, np.int64)  # the known context one byte longer
        open_ = np.ones(len(symbol), bool)
        for size in range(ORDER, -1, -1):
            at = np.flatnonzero(open_ & (reach >= size))
            key = _cut_context(context[at], size)
            node = _find(self.contexts, key)
            at, key, node = at[node >= 0], key[node >= 0], node[node >= 0]
            above = longer[at]
            total = self.total[node] - self.excluded[above]
            fresh = self.distinct[node] - self.distinct[above]
            gram = _find(self.grams, key << np.uint64(8) | symbol[at])
            hit = gram >= 0
            score[at[hit]] += np.log10(self.counts[gram[hit]] / (total[hit] + fresh[hit]))
            open_[at[hit]] = False
            miss = ~hit & (fresh > 0)
            score[at[miss]] += np.log10(fresh[miss] / (total[miss] + fresh[miss]))
            longer[at] = node
        rest = np.flatnonzero(open_)
        left = ALPHABET - self.distinct[longer[rest]]
        score[rest] -= np.log10(np.maximum(left, 1))
        return score


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def score_documents(
    docs: DataFrame, bound: int | None = None, id_column: str = "doc_id", text_column: str = "text", across_words: bool = False
) -> DataFrame:
    """``SCORED`` for every document, learning from those that are not held out.

    ``bound`` keeps that many of the most frequent grams, for comparison; without it all count.
    """
    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = rows.agg(
        F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.crc32(id_text.cast("binary")) % HELD_OUT_OF != 0).alias("ends")
    ).first()
    buckets = max(LEAST_BUCKETS, -(-(size.bytes or 0) // BUCKET_BYTES))
    hot = _hot_contexts(rows, size.bytes or 0, across_words)
    chunked = materialise(_chunked(rows, buckets, across_words, hot), "chunked")
    low, ends = _low_counts(chunked), int(size.ends)
    least = 1 if bound is None else _least_count(chunked, buckets, low, bound)

    def count_words(table: pa.Table) -> pa.Table:
        chunk_of, bucket, blobs = (table.column(c).to_pylist() for c in ("chunk", "bucket", "data"))
        counts, which, numbers = _bucket_words(blobs)
        out, at = [], 0
        for chunk, number in zip(chunk_of, numbers, strict=True):
            own = which[at : at + len(number)]
            at += len(number)
            steps = np.diff(number, prepend=0).astype("<i4")
            # The sums over the bucket stand once, in its first row.
            sums = (int(counts.sum()), np.count_nonzero(counts)) if not out else (0, 0)
            out.append((chunk, bucket[0], _squeeze(steps, counts[own].astype("<i8")), *sums))
        return pa.Table.from_batches([_rows(out, COUNTED)])

    words = chunked.where((F.col("bucket") >= 0) & (F.col("bucket") < buckets))
    counted = materialise(map_groups(words, "bucket", count_words, COUNTED), "counted")
    sums = counted.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens = (sums.tokens or 0) + ends
    distinct = (sums.distinct or 0) + bool(ends)

    def code_grams(table: pa.Table) -> pa.Table:
        chunk_of, bucket, blobs = (table.column(c).to_pylist() for c in ("chunk", "bucket", "data"))
        keys, counts, entries = _bucket_grams(blobs)
        trie = Trie.build(keys[counts > 0], counts[counts > 0], low, least)
        codes = trie.code(keys >> np.uint64(8) & MASKS[ORDER], (keys >> np.uint64(56)).astype(np.int64), keys & np.uint64(255))
        del trie
        codes = ((codes.view(np.int64) + (1 << CUT_BITS - 1)) >> CUT_BITS << CUT_BITS).view(np.float64)
        all_values, value_of = np.unique(codes, return_inverse=True)  # equal counts have equal codes
        out = []
        for chunk, own in zip(chunk_of, entries, strict=True):
            values, which = np.unique(value_of[own], return_inverse=True)
            packed = (all_values[values], which.astype("<u4"))
            out.append((chunk, bucket[0], _squeeze(*[a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in packed])))
        return pa.Table.from_batches([_rows(out, WORDS)])

    def unpacked(data: bytes, kind: str) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()

    def per_chunk(table: pa.Table) -> pa.Table:
        blobs = {b: data.as_buffer() for b, data in zip(table.column("bucket").to_pylist(), table.column("data"), strict=True)}
        ids, known, held, stream = _expand(blobs.pop(TEXTS), ["<i8", "?", "?", "u1"])
        words, number, per_text = _words(stream)
        counts = np.zeros(len(words), np.int64)
        del words
        for k in [k for k in blobs if k < buckets]:
            steps, c = _expand(blobs.pop(k), ["<i4", "<i8"])
            counts[np.cumsum(steps)] = c
        divisor = tokens + SMOOTHING * (distinct + 1)
        base, seen = np.log10((counts + SMOOTHING) / divisor), counts > 0
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), per_text)
        known_words, base_score, score = (np.zeros(len(ids)) for _ in range(3))
        for span in _spans(len(number)):
            known_words += np.bincount(owner[span], weights=seen[number[span]], minlength=len(ids))
            base_score += np.bincount(owner[span], weights=base[number[span]], minlength=len(ids))
        del number, owner, base, seen, counts
        release_memory()
        keys = _distinct(_runs(key)[0] for key, _ in _gram_blocks(stream, across_words))
        order, spans = _dealt(keys, buckets, hot)
        codes = np.zeros(len(keys))
        for k, a, b in spans:
            values, index = _expand(blobs.pop(buckets + k), ["bytes", "bytes"])
            codes[order[a:b]] = unpacked(values, "<f8")[unpacked(index, "<u4")]
        del order
        tables = _hash_tables(keys)
        for key, text in _gram_blocks(stream, across_words):
            score += np.bincount(text, weights=codes[_places(tables, keys, key)], minlength=len(ids))
        return pa.table(
            [pa.array(ids, mask=~known), pa.array(held), pa.array(per_text + 1), pa.array(known_words.astype(np.int64) + (ends > 0)),
             pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base_score + np.log10((ends + SMOOTHING) / divisor)), pa.array(score)],
            names=[c.split()[0] for c in SCORED.split(", ")],
        )

    answers = map_groups(chunked.where(F.col("bucket") >= buckets), "bucket", code_grams, WORDS)
    texts = chunked.where(F.col("bucket") == TEXTS)
    return map_groups(answers.unionByName(counted.select(*texts.columns)).unionByName(texts), "chunk", per_chunk, SCORED)
