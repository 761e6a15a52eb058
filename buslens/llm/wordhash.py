"""Hashes of words and of runs of words, vectorised over many texts at once."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

# The bytes that separate words.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
# Odd multipliers; a running sum of terms times powers is undone by inverse powers.
BYTE_BASE, RUN_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTE_VALUE = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), "<u8")
# Bytes hashed at once, and the length from which a word is digested by itself.
SLICE_BYTES, LONG_WORD = 1 << 20, 1 << 16


@cache
def _powers(base: int, doublings: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, for 2**doublings exponents."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        terms = np.full(1 << doublings, b, np.uint64)
        terms[0] = 1
        out.append(np.cumprod(terms, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(10, int(count).bit_length()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of a public hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sums(terms: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial value of each run of terms, the same wherever the run stands."""
    up, down = powers(base, len(terms) + 1)
    total = np.zeros(len(terms) + 1, np.uint64)
    np.cumsum(terms * up[: len(terms)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate([[0] if len(data) and not space[0] else [], edge, [len(data)] if len(data) and not space[-1] else []])
    edges = edges.astype(np.int64)
    return edges[::2], edges[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of every word of ``data``."""
    whole = np.frombuffer(data, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        stop = min(len(whole), at + SLICE_BYTES)
        while stop < len(whole) and not IS_SPACE[whole[stop]]:  # to the end of the word
            behind = np.flatnonzero(IS_SPACE[whole[stop : stop + SLICE_BYTES]])
            stop = stop + int(behind[0]) if len(behind) else min(len(whole), stop + SLICE_BYTES)
        first, last = word_spans(whole[at:stop])
        long = np.flatnonzero(last - first >= LONG_WORD)
        if len(long):
            h = np.zeros(len(first), np.uint64)
            short = np.setdiff1d(np.arange(len(first)), long)
            for k in short:
                h[k] = _short(whole[at + first[k] : at + last[k]])
            for k in long:
                h[k] = int.from_bytes(hashlib.blake2b(whole[at + first[k] : at + last[k]].tobytes(), digest_size=8).digest(), "little")
        else:
            h = mixed(_sums(_BYTE_VALUE[whole[at:stop]], BYTE_BASE, first, last) + (last - first).astype(np.uint64))
        hashes.append(h)
        starts.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _short(word: np.ndarray) -> np.ndarray:
    size = np.array([len(word)])
    return mixed(_sums(_BYTE_VALUE[word], BYTE_BASE, np.array([0]), size) + size.astype(np.uint64))[0]


def run_hashes(words: np.ndarray, length: int, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the runs of ``length`` words that begin at ``starts``."""
    return mixed(_sums(words, RUN_BASES[which], starts, starts + length))


def texts_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after another, and the number of words of each."""
    hashes, starts = word_hashes(b"\n".join(texts))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
