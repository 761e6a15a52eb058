"""Target-distribution importance resampling over hashed word features.

A text is lower-cased in ASCII and cut into words by an untrained pre-tokeniser, a
regular expression Split of the tokenizers library, which returns words with their
offsets. Windows of 1 to ``longest`` consecutive offset pairs are the features:
their words joined by one space, hashed by CRC-32 into ``BUCKETS``. Two histograms
are counted, one over all documents and one over the target texts; a bucket's gain
is the logarithm of their smoothed ratio in thousandths, and the weight of a
document is the sum of the gains of its features. Scores add Gumbel noise that is a
hash of seed and id, so taking the highest scores draws without replacement in
proportion to the weights, alike in every run.

Every text is cut once: its buckets are stored beside its id, and histogram and
weights read only those. Tasks send one row per bucket, and receive one gain per
bucket. Ranks are given by a range partitioning over all documents that moves id,
weight and score only.

Defined results: a null or empty text has no features, weight 0 and a score, but
too few words to be drawn. A null id is hashed as the empty text and comes last
among equal scores. Repeated rows count each, are scored alike and get ranks of
their own. An empty table gives an empty result, an empty target gains from the
documents alone. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import bounds, chunks, map_batches, quoted
from buslens.operators.ordered import number_rows
from buslens.scale import materialise

# What words are made of, the number of buckets, and the draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 10, 2024
STORED = "doc_id long, n_words long, n_features long, buckets binary"
SCORED = "doc_id long, n_words long, n_features long, weight long"


@cache
def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def features(text: str, longest: int = 1) -> tuple[list[str], int]:
    """Windows of consecutive words of a lower-cased text, and the number of its words."""
    found = splitter().pre_tokenize_str(text)
    if longest == 1:
        return [word for word, _ in found], len(found)
    spans = [span for _, span in found]
    windows = (spans[k : k + size] for size in range(1, longest + 1) for k in range(len(spans) - size + 1))
    return [" ".join([text[begin:end] for begin, end in window]) for window in windows], len(found)


def bucket_lists(texts: pa.Array, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a batch one after another, features and words per text; null is empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts, "")).to_pylist()
    found = [features(text, longest) for text in lowered]
    each = [zlib.crc32(f.encode()) % BUCKETS for some, _ in found for f in some]
    lengths = np.fromiter((len(some) for some, _ in found), np.int64, len(found))
    return np.array(each, "<u2"), lengths, np.fromiter((words for _, words in found), np.int64, len(found))


def document_buckets(docs: DataFrame, longest: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The buckets of every whole text as two bytes per feature; nothing is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                buckets, lengths, words = bucket_lists(part.column("text"), longest)
                cells = pa.Array.from_buffers(
                    pa.large_binary(), len(lengths), [None, pa.py_buffer(2 * bounds(lengths)), pa.py_buffer(buckets.tobytes())]
                )
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(lengths), cells.cast(pa.binary())],
                                                 ["doc_id", "n_words", "n_features", "buckets"])

    rows = docs.select(F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text"))
    return map_batches(rows, work, STORED)


def _flat(column: pa.Array) -> np.ndarray:
    """All buckets of a batch one after another."""
    column = column.cast(pa.large_binary())
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, "<u2")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u2")


def histogram(stored: DataFrame) -> np.ndarray:
    """Features per bucket; tasks send at most one row per bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            counts += np.bincount(_flat(batch.column("buckets")), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["bucket", "many"])

    sent = map_batches(stored.select("buckets"), work, "bucket int, many long")
    counts = np.zeros(BUCKETS, np.int64)
    for row in sent.groupBy("bucket").agg(F.sum("many").alias("many")).collect():  # BUCKETS rows at most
        counts[row.bucket] = row.many
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratio of target and source in thousandths, for each bucket."""
    n, m = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratios = ((t + 1) * n / ((s + 1) * m) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(stored: DataFrame, gains: np.ndarray) -> DataFrame:
    """The sum of the gains of every document's features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = bounds(gains[_flat(batch.column("buckets"))])
            ends = bounds(batch.column("n_features").to_numpy(zero_copy_only=False))
            names = ["doc_id", "n_words", "n_features"]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals[ends[1:]] - totals[ends[:-1]])], [*names, "weight"])

    return map_batches(stored, work, SCORED)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(
    docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, longest: int = 1,
    seed: int = SEED, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null for those not drawn."""
    stored = materialise(document_buckets(docs, longest, id_column, text_column), "buckets")
    aim = materialise(document_buckets(target.select(F.lit(0).alias("doc_id"), "text"), longest), "target-buckets")
    weighed = weights(stored, bucket_gains(histogram(stored), histogram(aim)))
    long_enough = F.col("n_words") >= least_words
    scored = weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        # Documents that may be drawn come first, the highest score first.
        (~long_enough).alias("short"),
    )
    scored = materialise(scored.withColumns({"from_top": -F.col("score"), "no_id": F.col("doc_id").isNull()}), "scores")
    drawn = scored.where(~F.col("short")).count() * percent // 100
    placed = number_rows(scored, [], ["short", "from_top", "no_id", "doc_id"], "place")
    rank = F.when(~F.col("short") & (F.col("place") <= drawn), F.col("place"))
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
