import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from buslens.llm import resample
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, ordered, with_clashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, longest=1):
    words = WORD.findall((text or "").encode().lower().decode())
    runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % resample.BUCKETS for r in runs], len(words)


def plainly(documents, target, longest=1):
    found = [(doc, *buckets_of(text, longest)) for doc, text in documents]
    s, t = [0] * resample.BUCKETS, [0] * resample.BUCKETS
    for _, own, _ in found:
        for b in own:
            s[b] += 1
    for text in target:
        for b in buckets_of(text, longest)[0]:
            t[b] += 1
    n, m = sum(s) + resample.BUCKETS, sum(t) + resample.BUCKETS
    gain = [math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in range(resample.BUCKETS)]
    rows = []
    for doc, own, words in found:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 10 * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


def test_words_are_those_of_the_pattern():
    texts = ["", "Ab\x00c ÉÀ9-x", "中 文 😀", "İ ΣΑΣ", "a" * 100_000 + " b"]
    for text in texts:
        lowered = text.encode().lower().decode()
        found, words = resample.features(lowered)
        assert found == WORD.findall(lowered) and words == len(found)
    buckets, lengths, words = resample.bucket_lists(pa.array([*texts, None]), 3)
    want = [buckets_of(t, 3) for t in [*texts, None]]
    assert buckets.tolist() == [b for own, _ in want for b in own]
    assert lengths.tolist() == [len(own) for own, _ in want] and words.tolist() == [n for _, n in want]


@pytest.mark.parametrize("longest", [1, 2])
def test_odd_documents(spark, longest):
    more = [(100 + k, f"shared words of copy {k % 4} and some more to pass the least number of words a b c d e f g h i j k") for k in range(60)]
    documents = [*ODD_DOCUMENTS, *more, (None, "words " * 25), (None, "words " * 25), (101, "words " * 25)]
    target = ["shared words of copy 3", None, "", "one two three"]
    docs = with_clashes(spark.createDataFrame(documents, DOCS)).withColumns({"place": F.lit(1), "short": F.lit(2), "rank": F.lit(3)})
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.draw(docs.repartition(5), aim, longest=longest).collect()
    assert ordered(got) == ordered(plainly(documents, target, longest))


def test_whole_table(spark, sf_dir):
    docs, aim = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    want = plainly([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in aim.collect()])
    assert ordered(resample.draw(docs, aim).collect()) == ordered(want)


def test_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    aim = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resample.draw(none, aim).collect() == []
    got = resample.draw(spark.createDataFrame([(1, "a " * 30)], DOCS), none).collect()
    assert ordered(got) == ordered(plainly([(1, "a " * 30)], []))
    gains = resample.bucket_gains(np.zeros(resample.BUCKETS, np.int64), np.zeros(resample.BUCKETS, np.int64))
    assert not gains.any()
