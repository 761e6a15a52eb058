"""Byte-level BPE by ranks: encoding with segment trees, and decoding.

A text is cut by the matches of a pattern, and every distinct match is encoded
once. A match that is a token as a whole is that token. Any other one starts as
single bytes. The leaves of a segment tree are its byte positions: each holds the
rank of the pair that begins there together with the position, so the root is the
leftmost pair of the least rank. A merge writes three leaves, the merged token,
the one it took in (no pair any more) and the live neighbour before it, and the
minima on their ways to the root.

Short matches are merged side by side, one tree per column of an array; matches
beyond ``SIDE_BY_SIDE`` bytes get a tree of their own.

Defined results: a null text is the empty text and has no ids; repeated rows
give repeated results, nothing is merged across rows; long texts are taken in
slabs of matches, so that only their ids are held at once; an empty table gives
an empty result; columns besides the two named are not read. Ids decode to the
bytes of their tokens, whether or not these are valid text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import PieceTable, bounds, chunks, list_column, map_batches, quoted, texts_of

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
# Longest match that is merged beside others, and how many are merged at once.
SIDE_BY_SIDE, AT_ONCE = 64, 8192
# Distinct matches remembered by a worker, and matches looked up at once.
REMEMBERED, SLAB = 600_000, 200_000
# Rank of what is no pair; ranks and positions share 63 bits.
NO_PAIR = (1 << 40) - 1
# A character of each class of the pattern, neither space nor apostrophe nor part of a contraction.
STAND_IN = {"L": "ä", "N": "0", "Z": "\t", "": "!"}


class ByteTree:
    """Merges the bytes of one long match; the tree is a list of ``rank, position`` numbers."""

    def __init__(self, bpe: ByteBPE, match: bytes):
        self.size = len(match)
        self.width = max(1, (self.size - 1).bit_length())
        self.leaves = 1 << self.width
        self.tokens = [bpe.rank[match[k : k + 1]] for k in range(self.size)]
        self.after, self.before = list(range(1, self.size + 1)), list(range(-1, self.size - 1))
        self.merged = bpe.merged
        self.none = NO_PAIR << self.width
        self.tree = [self.none] * (2 * self.leaves)
        for k in range(self.size - 1):
            self.tree[self.leaves + k] = self._pair(k)
        for node in range(self.leaves - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])

    def _pair(self, at: int) -> int:
        follower = self.after[at]
        if follower >= self.size:
            return self.none
        rank = self.merged.get(self.tokens[at] << 32 | self.tokens[follower])
        return self.none if rank is None else rank << self.width | at

    def _update(self, at: int, value: int) -> None:
        tree, node = self.tree, self.leaves + at
        tree[node] = value
        while node > 1:
            least = min(tree[node], tree[node ^ 1])
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = least

    def ids(self) -> list[int]:
        while self.tree[1] < self.none:
            at = self.tree[1] & (self.leaves - 1)
            taken = self.after[at]
            self.tokens[at] = self.tree[1] >> self.width
            self.after[at] = self.after[taken]
            if self.after[at] < self.size:
                self.before[self.after[at]] = at
            self._update(taken, self.none)
            self._update(at, self._pair(at))
            if self.before[at] >= 0:
                self._update(self.before[at], self._pair(self.before[at]))
        out, at = [], 0
        while at < self.size:
            out.append(self.tokens[at])
            at = self.after[at]
        return out


class ByteBPE:
    """A file of ranked tokens: encodes batches of texts and decodes ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if not all(bytes([b]) in self.rank for b in range(256)):
            raise ValueError("ranks without all single bytes are not supported")
        # Every pair of tokens that makes a token, whichever merge the file was made by.
        self.merged = {
            left << 32 | right: rank
            for token, rank in self.rank.items()
            for k in range(1, len(token))
            if (left := self.rank.get(token[:k])) is not None and (right := self.rank.get(token[k:])) is not None
        }
        keys = np.fromiter(self.merged, np.int64, len(self.merged))
        self.keys = np.sort(keys)
        self.ranks = np.fromiter(self.merged.values(), np.int64, len(keys))[np.argsort(keys)]
        self.byte_rank = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.matches = Matches(pattern)
        self.table = PieceTable(self._encode_matches, REMEMBERED)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; a negative token makes no pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_PAIR)

    def _encode_matches(self, matches: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(matches)
        short: dict[int, list[int]] = {}
        encoded = [m.encode() for m in matches]
        for k, match in enumerate(encoded):
            whole = self.rank.get(match)
            if whole is not None:
                out[k] = np.array([whole], np.uint32)
            elif len(match) > SIDE_BY_SIDE:
                out[k] = np.array(ByteTree(self, match).ids(), np.uint32)
            else:
                short.setdefault((len(match) - 1).bit_length(), []).append(k)
        for width, places in short.items():
            for begin in range(0, len(places), AT_ONCE):
                some = places[begin : begin + AT_ONCE]
                for k, ids in zip(some, self._side_by_side([encoded[k] for k in some], width), strict=True):
                    out[k] = ids
        return out

    def _side_by_side(self, matches: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of matches of at most ``2**width`` bytes, merged step by step in all of them."""
        many, leaves = len(matches), 1 << width
        data = np.frombuffer(b"".join(m.ljust(leaves, b"\0") for m in matches), np.uint8).reshape(many, leaves).T
        sizes = np.fromiter(map(len, matches), np.int64, many)
        place = np.arange(leaves)[:, None]
        # A row beyond the leaves takes what neighbours of the ends are told.
        tokens = np.full((leaves + 1, many), -1, np.int64)
        tokens[:leaves] = np.where(place < sizes, self.byte_rank[data], -1)
        after = np.broadcast_to(np.minimum(np.arange(leaves + 1) + 1, leaves)[:, None], (leaves + 1, many)).copy()
        before = np.broadcast_to((np.arange(leaves + 1) - 1)[:, None], (leaves + 1, many)).copy()
        before[0] = leaves
        none = NO_PAIR << width
        tree = np.full((2 * leaves, many), none, np.int64)
        ranks = self._pairs(tokens[:leaves], tokens[1:])
        tree[leaves:] = np.where(ranks < NO_PAIR, ranks << width | place, none)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        live = np.flatnonzero(tree[1] < none)
        while len(live):
            root = tree[1, live]
            at = root & (leaves - 1)
            taken = after[at, live]
            follower, leader = after[taken, live], before[at, live]
            tokens[at, live] = root >> width
            tokens[taken, live] = -1
            after[at, live] = follower
            before[follower, live] = at
            tree[leaves + taken, live] = none
            ranks = self._pairs(tokens[at, live], tokens[follower, live])
            tree[leaves + at, live] = np.where(ranks < NO_PAIR, ranks << width | at, none)
            first = leader == leaves
            ranks = self._pairs(np.where(first, -1, tokens[leader, live]), tokens[at, live])
            led = np.where(first, at, leader)
            tree[leaves + led, live] = np.where(first, tree[leaves + at, live], np.where(ranks < NO_PAIR, ranks << width | led, none))
            nodes = [leaves + taken, leaves + at, leaves + led]
            for _ in range(width):
                nodes = [n >> 1 for n in nodes]
                for n in nodes:
                    tree[n, live] = np.minimum(tree[2 * n, live], tree[2 * n + 1, live])
            live = live[tree[1, live] < none]
        kept = tokens[:leaves].T
        return np.split(kept[kept >= 0].astype(np.uint32), np.cumsum((kept >= 0).sum(1))[:-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        found, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for pieces, owners in self.matches.slabs(texts):
            ids, lengths = self.table.gather(self.table.codes(pieces))
            found.append(ids)
            ends = bounds(lengths)
            at = 0
            for k, many in owners:
                counts[k] += ends[at + many] - ends[at]
                at += many
        return np.concatenate(found), counts

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[memoryview]:
        """The bytes of runs of ids."""
        if not len(ids):
            return [memoryview(b"")] * len(lengths)
        joined = self.tokens.take(pa.array(ids))
        data = memoryview(joined.buffers()[2] or b"")
        cuts = np.frombuffer(joined.buffers()[1], np.int64, len(ids) + 1)[bounds(lengths)].tolist()
        return [data[begin:end] for begin, end in zip(cuts[:-1], cuts[1:], strict=True)]


class Matches:
    """The matches of a pattern, with the library's classes of letters, numbers and spaces.

    Characters that the two regular expression engines class differently (their
    Unicode versions differ) are replaced for matching by one of the right class.
    """

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        self.other = {ord(c): STAND_IN[kind] for c, kind in _classed_otherwise()}
        self.odd = np.zeros(0x110000, bool)
        self.odd[list(self.other)] = True

    def _plain(self, text: str) -> bool:
        """Whether both engines class all characters of the text alike."""
        return text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()

    def of(self, text: str) -> Iterator[str]:
        if self._plain(text):
            return (m.group() for m in self.pattern.finditer(text))
        spans = (m.span() for m in self.pattern.finditer(text.translate(self.other)))
        return (text[begin:end] for begin, end in spans)

    def slabs(self, texts: list[str]) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
        """Matches in lists of about ``SLAB``, with ``(text, its number)`` of those in the list."""
        pieces: list[str] = []
        owners: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            short = len(text) <= SLAB and self._plain(text)
            rest = iter((self.pattern.findall(text),)) if short else _lists(self.of(text))
            for some in rest:
                pieces += some
                owners.append((k, len(some)))
                if len(pieces) >= SLAB:
                    yield pieces, owners
                    pieces, owners = [], []
        if owners:
            yield pieces, owners


def _lists(items: Iterator[str]) -> Iterator[list[str]]:
    while some := list(islice(items, SLAB)):
        yield some


@cache
def _classed_otherwise() -> list[tuple[str, str]]:
    """Characters that ``regex`` and ``tiktoken`` class differently, with the class that ``tiktoken`` has."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def classes(members) -> dict[str, str]:
        return {c: kind for kind, own in (("L", r"\p{L}"), ("N", r"\p{N}"), ("Z", r"\s")) for c in members(own)}

    def theirs(own: str) -> str:
        library = tiktoken.Encoding("single bytes", pat_str=own, mergeable_ranks=single, special_tokens={})
        return library.decode(library.encode_ordinary(everything))

    here, there = classes(lambda own: regex.findall(own, everything)), classes(theirs)
    return [(c, there.get(c, "")) for c in sorted(here.keys() | there.keys()) if here.get(c, "") != there.get(c, "")]


@cache
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One encoder for each worker process, so that its table of matches stays filled."""
    return ByteBPE(path, pattern)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, lengths = bpe.encode(texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_column(ids.astype(np.int32), lengths)], ["doc_id", "ids"])

    return map_batches(_rows(docs, id_column, text_column), work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from ``doc_id, ids``; null ids give no bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            lists = [np.array(ids or [], np.int64) for ids in batch.column("ids").to_pylist()]
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            found = bpe.decode(np.concatenate([np.zeros(0, np.int64), *lists]), lengths)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bytes(b) for b in found], pa.binary())], ["doc_id", "bytes"])

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of the ids of every whole text and of the bytes decoded from them, in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, lengths = bpe.encode(texts_of(part, "text"))
                data, cuts = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * bounds(lengths)).tolist()
                digests = [hashlib.sha256(data[begin:end]).hexdigest() for begin, end in zip(cuts[:-1], cuts[1:], strict=True)]
                decoded = [hashlib.sha256(b).hexdigest() for b in bpe.decode(ids, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_batches(_rows(docs, id_column, text_column), work, ENCODED)
