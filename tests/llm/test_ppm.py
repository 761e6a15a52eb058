import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest

from buslens.llm import ppm
from buslens.llm.ppm import score_documents
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, with_clashes

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, order=ppm.ORDER):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows]
    counts, trie, texts, ends = collections.Counter(), collections.defaultdict(collections.Counter), [], 0

    def steps(word):
        return [((b" " + word)[max(0, i + 1 - order) : i + 1], s) for i, s in enumerate(word + b" ")]

    for (_, text), out in zip(rows, held, strict=True):
        texts.append([w.encode() for w in WORD.findall(lower(text))])
        if not out:
            counts.update(texts[-1])
            ends += 1
    for word, n in counts.items():
        for context, s in steps(word):
            for k in range(len(context) + 1):
                trie[context[len(context) - k :]][s] += n
    if ends:
        trie[b""][10] += ends
        trie[b" "][10] += ends

    def code(context, s):
        excluded, total = set(), 0.0
        for k in range(len(context), -1, -1):
            left = {x: n for x, n in trie.get(context[len(context) - k :], {}).items() if x not in excluded}
            if left:
                size = sum(left.values()) + len(left)
                if s in left:
                    return total + math.log10(left[s] / size)
                total += math.log10(len(left) / size)
                excluded |= set(left)
        return total - math.log10(252 - len(excluded))

    tokens, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    base = lambda c: math.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))
    return [
        (d, out, len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), tokens, sum(base(counts[w]) for w in words) + base(ends),
         sum(code(c, s) for w in words for c, s in steps(w)) + code(b" ", 10))
        for (d, _), out, words in zip(rows, held, texts, strict=True)
    ]


def same(found, want):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[:4]) + (round(r[5], 6), round(r[6], 6))
    found, want = sorted((tuple(r) for r in found), key=key), sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in found] == pytest.approx([r[k] for r in want], rel=1e-9)


@pytest.mark.parametrize("rows", [ODD_DOCUMENTS, [], [(None, "a b")], [(1, None)], [(30, "The unseen"), (1, "the the Cat")]])
def test_scores_equal_brute_force(spark, rows):
    same(score_documents(with_clashes(spark.createDataFrame(rows, DOCS))).collect(), brute(rows))


def test_documents_in_chunks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(score_documents(spark.createDataFrame(rows, DOCS).repartition(3)).collect(), brute(rows))


def test_trie_is_bounded_and_still_a_distribution(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.score for r in score_documents(docs).collect()}
    small = {r.doc_id: r.score for r in score_documents(docs, bound=3_000).collect()}
    assert whole.keys() == small.keys() and all(s < 0 for s in small.values())
    assert sum(small.values()) < sum(whole.values())


def test_probabilities_sum_to_one():
    keys, counts = ppm._gram_counts([b"the", b"then", b"an"], np.array([5, 2, 3]))
    trie = ppm.Trie.build(keys, counts)
    symbols = np.array([s for s in range(256) if s not in (9, 11, 12, 13)], np.uint64)
    for context, reach in ((0, 0), (0x20, 1), (0x2074, 2), (0x7A, 1)):
        total = 10 ** trie.code(np.full(len(symbols), context, np.uint64), np.full(len(symbols), reach), symbols)
        assert total.sum() == pytest.approx(1)


def brute_running(rows, order=ppm.ORDER):
    """Scores by contexts of the running text: ``doc_id, score``."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    streams = [" " + "".join(w + " " for w in WORD.findall(lower(t))) + "\n" for _, t in rows]
    trie, cases = collections.defaultdict(collections.Counter), []
    for (d, _), stream in zip(rows, streams, strict=True):
        data = stream.encode()
        cases.append([(data[max(0, k - order) : k], data[k]) for k in range(1, len(data))])
        if zlib.crc32(b"" if d is None else str(d).encode()) % 10:
            for context, s in cases[-1]:
                for k in range(len(context) + 1):
                    trie[context[k:]][s] += 1

    def code(context, s):
        excluded, total = set(), 0.0
        for k in range(len(context) + 1):
            left = {x: n for x, n in trie.get(context[k:], {}).items() if x not in excluded}
            if left:
                size = sum(left.values()) + len(left)
                if s in left:
                    return total + math.log10(left[s] / size)
                total += math.log10(len(left) / size)
                excluded |= set(left)
        return total - math.log10(252 - len(excluded))

    return [(d, sum(code(c, s) for c, s in case)) for (d, _), case in zip(rows, cases, strict=True)]


@pytest.mark.parametrize("rows", [
    [r for r in ODD_DOCUMENTS if r[0] != 4], [], [(None, "a b")], [(1, None)], [(30, "The unseen cat"), (1, "the the Cat"), (2, "猫が 好き だ"), (30, "猫が 好き")],
])
def test_running_scores_equal_brute_force(spark, rows):
    assert ppm.ORDER >= 5
    found = score_documents(with_clashes(spark.createDataFrame(rows, DOCS)), across_words=True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, round(r[1], 6))
    found, want = sorted([(r.doc_id, r.score) for r in found], key=key), sorted(brute_running(rows), key=key)
    assert [r[0] for r in found] == [r[0] for r in want]
    assert [r[1] for r in found] == pytest.approx([r[1] for r in want], rel=1e-9)


def test_query_scores_the_order_of_words(spark, tmp_path):
    from buslens.llm.queries import op3_ppm

    rows = [(k, "the cat sat on the mat and slept") for k in range(1, 30)] + [(100, "mat the and cat slept on sat the")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.score for r in op3_ppm(spark, str(tmp_path)).collect()}
    assert scores[100] < scores[1] - 1


def test_every_count_is_kept_unless_bounded(spark):
    import inspect

    assert inspect.signature(score_documents).parameters["bound"].default is None
    rows = [(1, "abcdefg hijklmn " * 1_500), (2, "abcdefg hijklmn")]
    whole, none = ({r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, DOCS), bound).collect()} for bound in (None, 1))
    assert none[1] < 5 * whole[1]  # counts above 1,000 are bounded like others


@pytest.mark.parametrize("across", [True, False])
def test_blocks_join_to_the_whole(monkeypatch, across):
    texts, counts = [b"the cat sat", b"", b"a", b"on the mat of the cat"] * 3, np.arange(1, 13)
    whole = ppm._gram_counts(texts, counts, across)
    for block in (1, 5, 16):
        monkeypatch.setattr(ppm, "BLOCK", block)
        for one, other in zip(whole, ppm._gram_counts(texts, counts, across), strict=True):
            assert one.tolist() == other.tolist()


def test_hot_contexts_change_the_layout_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = [(r.text or "").encode() for r in docs.limit(60).collect()]
    keys, counts = ppm._gram_counts(texts, np.ones(len(texts)))
    hot = ppm._hot_contexts(docs, 0, True)
    assert len(hot) and set((hot >> np.uint64(48)).tolist()) >= {2, 3}
    whole = ppm.Trie.build(keys, counts)
    code = lambda trie, k: trie.code(k >> np.uint64(8) & ppm.MASKS[ppm.ORDER], (k >> np.uint64(56)).astype(int), k & np.uint64(255))
    low = ppm._short_grams(keys, counts, hot)
    order, spans = ppm._dealt(keys, 32, hot)
    assert sorted(order.tolist()) == list(range(len(keys)))
    for _, a, b in spans:
        own = order[a:b]
        assert code(ppm.Trie.build(keys[own], counts[own], low), keys[own]) == pytest.approx(code(whole, keys[own]), rel=1e-12)
    largest = [max(b - a for _, a, b in ppm._dealt(keys, 1 << 16, h)[1]) for h in (hot, hot[:0])]
    assert largest[0] < largest[1] / 2


def test_a_chunk_takes_little_memory(monkeypatch):
    import types

    import pyarrow as pa

    random = np.random.default_rng(0)
    words = np.array(["".join(w) for w in random.choice(list("etaoinshrdlucm"), (30_000, 5))])
    texts = [" ".join(words[random.zipf(1.3, 20_000) % len(words)]) for _ in range(140)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    size = batch.column("text").nbytes
    assert size > ppm.CHUNK
    monkeypatch.setattr(ppm, "map_batches", lambda df, work, schema: work)
    monkeypatch.setattr(ppm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    work = ppm._chunked(None, 128, True, np.zeros(0, np.uint64))
    tracemalloc.start()
    try:
        rows = next(iter(work(iter([batch]))))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows.num_rows > 200
    assert peak < 8 * size


@pytest.mark.parametrize("block", [1, 5, 1 << 20])
def test_words_of_blocks(monkeypatch, block):
    import pyarrow as pa

    monkeypatch.setattr(ppm, "BLOCK", block)
    texts = ["The cat  sat", "", " \n", "a", "on the\tmat of the longest-word", "cat"]
    words, number, per_text = ppm._words(ppm._stream(pa.array(texts, pa.large_string())))
    want = [w.lower().encode() + b" " for t in texts for w in t.split()]
    assert [words[int(k)].as_py() for k in number] == want and len(words) == len(set(want))
    assert per_text.tolist() == [len(t.split()) for t in texts]


@pytest.mark.parametrize("count", [0, 1, 2, 1_000])
def test_places_of_keys(count):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 59, count, np.uint64))
    wanted = np.r_[keys[::-1], keys[::3]]
    assert ppm._places(ppm._hash_tables(keys), keys, wanted).tolist() == np.searchsorted(keys, wanted).tolist()
