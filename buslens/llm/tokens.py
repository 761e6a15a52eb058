"""Token ids of whole texts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from buslens.llm.tasks import PieceTable, bounds

# Joins words for one call of the library; a word that holds it is encoded alone.
JOINT = "|"
WORDS_PER_CALL = 256
# Distinct words remembered by a worker, about 200 bytes each.
WORDS_KEPT = 800_000
# The settings under which words between white space are encoded independently.
SPACE_RULE = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


class TextEncoder:
    """Encodes batches of texts, without special tokens added.

    Where the vocabulary drops white space, a text's ids are those of its words
    in turn, so every distinct word is encoded once and looked up afterwards.
    Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_word = _drops_space(rules)
        self.joint = self._plain([JOINT])[0]
        self.table = PieceTable(self._encode_words, WORDS_KEPT)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        if len(self.joint) != 1:
            return self._plain(texts)
        out: list = [None] * len(texts)
        alone = [k for k, t in enumerate(texts) if JOINT in t or len(t) > 1000]
        for k, ids in zip(alone, self._plain([texts[k] for k in alone]), strict=True):
            out[k] = ids
        rest = [k for k, ids in enumerate(out) if ids is None]
        calls = [rest[i : i + WORDS_PER_CALL] for i in range(0, len(rest), WORDS_PER_CALL)]
        joined = self._plain([f" {JOINT} ".join(texts[k] for k in call) for call in calls])
        for call, ids in zip(calls, joined, strict=True):
            cuts = np.flatnonzero(ids == self.joint[0])
            for k, begin, end in zip(call, np.r_[0, cuts + 1], np.r_[cuts, len(ids)], strict=True):
                out[k] = ids[begin:end]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; null is the empty text."""
        if not self.by_word:
            ids = self._plain(pc.fill_null(texts, "").to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(i) for i in ids], np.int64)
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = pc.dictionary_encode(words.flatten())
        codes = self.table.codes(coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist())
        ids, lengths = self.table.gather(codes[coded.indices.to_numpy(zero_copy_only=False)])
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        return ids, np.diff(bounds(lengths)[bounds(counts)])


def _drops_space(rules: dict) -> bool:
    normalizer = rules.get("normalizer") or {}
    steps = normalizer.get("normalizers", [normalizer])
    splitter = rules.get("pre_tokenizer") or {}
    splits = splitter.get("pretokenizers", [splitter])
    first = splits[0] if splits else {}
    pattern = first.get("pattern", {}).get("Regex", "") if first.get("type") == "Split" else ""
    return (
        SPACE_RULE in steps
        and {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
        and [s for s in steps if s.get("type") == "Replace"] == [SPACE_RULE]
        and first.get("invert") is True
        and first.get("behavior") == "Removed"
        # Every alternative matches letters, digits, or what is neither these nor space.
        and not re.search(r"\\s(?!\\p\{L\}\\p\{N\}\])", pattern)
        and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in rules.get("added_tokens", []))
    )


@cache
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, so that its word table stays filled."""
    return TextEncoder(path)


def encode_batch(batch: pa.RecordBatch, column: str, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch's texts, each closed by ``end_id``, and their numbers."""
    ids, lengths = text_encoder(path).encode(batch.column(column))
    if end_id is None:
        return ids, lengths
    whole = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
    return whole, lengths + 1
