import collections
import math
import re

import pytest
import xxhash
from buslens import scale
from buslens.llm import quality
from buslens.llm.quality import bucket_weights, labelled_sample, verdicts
from pyspark.sql import functions as F
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, with_clashes

WORD = re.compile("[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def bucket(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    seed = seed - (1 << 64) if seed >> 63 else seed
    return seed % quality.BUCKETS


def grams(text):
    words = WORD.findall(text or "")
    return [bucket(w) for w in words] + [bucket(a, b) for a, b in zip(words[:-1], words[1:], strict=True)]


@pytest.fixture(scope="module")
def corpus():
    good = [(k, " ".join(f"word{(k * 7 + n * n * 3 + n) % 97} and{n % 7} the" for n in range(40))) for k in range(100, 140)]
    poor = [(k, " ".join(f"%%{(k + n * n) % 60} zz{n % 17} ##" for n in range(40))) for k in range(200, 220)]
    labels = [(k, 1, 0) for k, _ in good[:30]] + [(k, 0, 0) for k, _ in poor[:12]] + [(None, 1, 0), (5, None, None), (999, 0, 1), (good[0][0], 1, 0)]
    return good + poor + ODD_DOCUMENTS, labels


def test_counts_and_verdicts(spark, corpus):
    rows, labels = corpus
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    found = verdicts(docs, spark.createDataFrame(labels, LABELS)).collect()
    measured = collections.Counter(tuple(r)[:7] for r in found)
    assert measured == collections.Counter((d, *counts(t)) for d, t in rows)
    for r in found:
        if r.doc_id is not None and 100 <= r.doc_id < 140:
            assert r.kept
        if r.doc_id is not None and 200 <= r.doc_id < 220 or r.base_failed:
            assert not r.kept


def test_weights_equal_brute_force(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, DOCS)
    weights = bucket_weights(docs, labelled_sample(spark.createDataFrame(labels, LABELS))).first().weights
    trusted = {k for k, q, t in labels if q == 1 and k is not None}
    raw, target = collections.Counter(), collections.Counter()
    for doc, text in rows:
        raw.update(grams(text))
        if doc in trusted:
            target.update(grams(text))
    raws, targets = sum(raw.values()), sum(target.values())
    smooth = lambda n, total: math.log((n + 0.5) / (total + 0.5 * quality.BUCKETS))
    want = [smooth(target[b], targets) - smooth(raw[b], raws) for b in range(quality.BUCKETS)]
    assert weights == pytest.approx(want, abs=1e-9)


def test_no_labels_and_no_documents(spark, corpus):
    docs = spark.createDataFrame(corpus[0], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept != r.base_failed for r in verdicts(docs, none).collect())
    assert verdicts(docs.limit(0), spark.createDataFrame(corpus[1], LABELS)).collect() == []


def test_keeps_whole_rows(spark, corpus):
    docs = with_clashes(spark.createDataFrame(corpus[0], DOCS))
    found = verdicts(docs, spark.createDataFrame(corpus[1], LABELS), whole_rows=True)
    assert found.select("row.*").columns == docs.columns and found.count() == len(corpus[0])


def test_no_python_on_the_executors(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    plan = verdicts(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_text_is_measured_once(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    threshold_plans = []
    group = type(docs).groupBy

    def seen(df, *by):
        if "good" in df.columns and "m" in df.columns:
            threshold_plans.append(executed(df))
        return group(df, *by)

    monkeypatch.setattr(type(docs), "groupBy", seen)
    judged = quality.verdicts(docs, labels, whole_rows=True)
    kept = judged.where("kept").select("row.*")
    assert len(threshold_plans) == 1
    for plan in [executed(kept), executed(judged), *threshold_plans]:
        assert plan.count("regexp_extract_all") == 1
    # Nothing but the join selects the labelled rows.
    below = threshold_plans[0].split("BroadcastHashJoin")[1]
    assert "regexp_extract_all" not in below and "bucket_weights" not in below
    spark.conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_every_labelled_row_counts(spark, monkeypatch, most):
    """More trusted and poor rows than any bound there was, with ids broadcast and with texts moved."""
    n = 22_000
    monkeypatch.setattr(quality, "fits_broadcast", lambda df: scale.fits_broadcast(df, most))
    ids = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    found = quality.labelled_documents(ids.unionByName(ids.where("doc_id < 100")))
    assert (found.where("good").count(), found.where("NOT good").count()) == (n, n)
    docs = found.select("doc_id", F.concat(F.lit("w"), (F.col("doc_id") % 3).cast("string")).alias("text"))
    docs = docs.unionByName(docs.where("doc_id < 4"))
    weights = bucket_weights(docs, found).first().weights
    raw = {k: sum(d % 3 == k for d in [*range(2 * n), *range(4)]) for k in range(3)}
    target = {k: sum(d % 3 == k and d % 2 == 1 for d in [*range(2 * n), *range(4)]) for k in range(3)}
    smooth = lambda x, total: math.log((x + 0.5) / (total + 0.5 * quality.BUCKETS))
    for k in range(3):
        want = smooth(target[k], n + 2) - smooth(raw[k], 2 * n + 4)
        assert weights[bucket(f"w{k}")] == pytest.approx(want, abs=1e-9)
    texts = quality.labelled_texts(docs, found)
    assert collections.Counter(r.good for r in texts.collect()) == {True: n + 2, False: n + 2}
