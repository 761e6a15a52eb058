"""Exact SentencePiece BPE encoding by backtracking, and decoding.

A text is normalised to one character string (a word mark for each space and
one in front) and cut where no piece can reach across. Each distinct segment is
encoded once:

* an Aho-Corasick automaton over all pieces yields, for every start, the pieces
  that match there, longest first;
* pieces are taken greedily; a piece may follow another only if merging the two
  texts anew gives just these two pieces (remembered per pair);
* when no piece fits, the last one is taken back, and its start is marked in a
  bit field of positions from which no encoding goes on, so that each position
  fails once at most.

A sequence whose neighbours are all compatible is the one that merging finds, as
long as the merge order is total. Pieces that share a score (runs of spaces in
public models) break that, so segments with such pieces are merged directly.

Defined results: a null text is the empty text and has no ids; characters that
the model lacks become the ids of their bytes, or the unknown id without byte
pieces. Repeated rows give repeated results, nothing is merged across rows; an
empty table gives an empty result; columns besides the two named are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import PieceTable, bounds, chunks, list_column, map_batches, quoted, texts_of

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "  # what the library prints for the unknown id
# Pairs of pieces and distinct segments remembered by a worker.
REMEMBERED_PAIRS, REMEMBERED_SEGMENTS = 400_000, 800_000
ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """A BPE model file: encodes and decodes batches of texts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.bytes_of: list[bytes] = []
        for k in range(len(model)):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(k):
                self.bytes_of.append(b"")
            elif model.is_unknown(k):
                self.bytes_of.append(UNKNOWN_TEXT.encode())
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode())
                if not model.is_unused(k):
                    self.id_of[piece], self.score[piece] = k, model.get_score(k)
        self._check(model)
        many = Counter(s for p, s in self.score.items() if len(p) > 1)
        self.tied = {p for p, s in self.score.items() if len(p) > 1 and many[s] > 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            if len(piece) > 1 and self._merged(piece) == [piece]:
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.tied_automaton = ahocorasick.Automaton()
        for piece in self.tied:
            self.tied_automaton.add_word(piece, 1)
        self.tied_automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.segment = _segments(self.id_of)
        self.table = PieceTable(lambda new: [np.array(self.encode_segment(s), np.uint32) for s in new], REMEMBERED_SEGMENTS)
        self.decoded = pa.array(self.bytes_of, pa.large_binary())
        self.digits = pa.array([b"%d," % k for k in range(len(self.bytes_of))], pa.large_binary())

    def _check(self, model) -> None:
        """Refuse models with another normalisation than marks for spaces."""
        probe = "  Aé　éｆ\t "
        if model.decode(model.encode(probe)) != probe or model.encode(" ") != model.encode(MARK):
            raise ValueError("only models that keep their text as it is and mark the start are supported")

    def _merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: best score first, then leftmost."""
        parts: list[str] = list(text)
        if len(parts) < 2:
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts):
                joined = parts[left] + parts[right]
                if joined in self.score:
                    heapq.heappush(heap, (-self.score[joined], left, joined))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, left, joined = heapq.heappop(heap)
            right = after[left]
            if not parts[left] or right >= len(parts) or parts[left] + parts[right] != joined:
                continue
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in parts if p]

    def _fits(self, left: str, right: str) -> bool:
        key = (left, right)
        fits = self.pairs.get(key)
        if fits is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            fits = self.pairs[key] = self._merged(left + right) == [left, right]
        return fits

    def pieces(self, segment: str) -> list[str]:
        """Pieces of a segment by backtracking."""
        if len(segment) < 2:
            return list(segment)
        if next(self.tied_automaton.iter(segment), None) is not None:
            return self._merged(segment)
        size = len(segment)
        lengths: list[list[int]] = [[1] for _ in range(size)]
        for end, length in self.automaton.iter(segment):  # by end, so shorter pieces come first
            lengths[end - length + 1].append(length)
        failed = bytearray((size >> 3) + 1)
        taken: list[str] = []
        left: list[list[int]] = []  # shorter pieces still to try, for each piece taken
        at, options = 0, lengths[0][:]
        while at < size:
            while options:
                length = options.pop()
                end = at + length
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = segment[at:end]
                if not taken or self._fits(taken[-1], piece):
                    taken.append(piece)
                    left.append(options)
                    at = end
                    options = lengths[at][:] if at < size else []
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                options = left.pop()
        return taken

    def encode_segment(self, segment: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(segment):
            known = self.id_of.get(piece)
            if known is not None:
                ids.append(known)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in piece.encode("utf-8", "replace")]
            else:
                ids.append(self.unknown)
        return ids

    def _codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        segments: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = self.segment(MARK + text.replace(" ", MARK)) if text else []
            counts[k] = len(own)
            segments += own
        return self.table.codes(segments), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        codes, counts = self._codes(texts)
        ids, lengths = self.table.gather(codes)
        return ids, np.diff(bounds(lengths)[bounds(counts)])

    def printed(self, ids: np.ndarray, lengths: np.ndarray) -> list[memoryview]:
        """Runs of ids as decimal text, joined by commas."""
        data, cuts = _joined(self.digits, ids, lengths)
        return [data[begin : max(begin, end - 1)] for begin, end in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Texts of runs of ids as UTF-8: pieces joined, without the mark in front."""
        data, cuts = _joined(self.decoded, ids, lengths)
        mark = (ids == self.id_of.get(MARK, -1)) if len(ids) else np.zeros(0, bool)
        first = bounds(lengths)[:-1]
        out = []
        for k, (begin, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lengths[k] and (mark[first[k]] or self.bytes_of[ids[first[k]]][:1] == b" " and ids[first[k]] != self.unknown):
                begin += 1
            text = bytes(data[begin:end])
            out.append(text if _valid(text) else text.decode("utf-8", "replace").encode())
        return out


def _joined(cells: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The cells of all ids one after another, and where each run of ids begins and ends."""
    if not len(ids):
        return memoryview(b""), np.zeros(len(lengths) + 1, np.int64)
    joined = cells.take(pa.array(ids))
    return memoryview(joined.buffers()[2] or b""), np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1)[bounds(lengths)]


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _segments(pieces: dict[str, int]):
    """A function that cuts a marked text where no piece reaches across.

    A cut lies before a mark that follows another character, and on both sides
    of characters that occur in no piece of several characters. A model with a
    piece across the first kind of cut gets whole texts.
    """
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return lambda text: [text]
    inside = {c for p in pieces if len(p) > 1 for c in p}
    # Ends of lines and tabs, if this model never merges them.
    alone = "".join(re.escape(c) for c in "\n\r\t" if c not in inside)
    body = f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else "")
    return re.compile(body).findall


@cache
def piece_model(path: str) -> PieceModel:
    """One model for each worker process, so that its segment table stays filled."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, lengths = model.encode(texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), list_column(ids.astype(np.int32), lengths)], ["doc_id", "ids"]
                )

    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))
    return map_batches(rows, work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            lists = [np.array(ids or [], np.int64) for ids in batch.column("ids").to_pylist()]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            texts = model.decode(np.concatenate([np.zeros(0, np.int64), *lists]), lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], ["doc_id", "text"]
            )

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids of every whole text and of the text decoded from them, in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, lengths = model.encode(texts_of(part, "text"))
                texts = model.decode(ids, lengths)
                digests = [hashlib.sha256(t).hexdigest() for t in model.printed(ids, lengths)]
                decoded = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))
    return map_batches(rows, work, ENCODED)
