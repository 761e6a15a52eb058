"""Quality rules: counts per document and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS``. Two
multinomials over the buckets are counted, one over all documents and one over
trusted documents (labelled good and not toxic); the weight of a bucket is the
logarithm of their smoothed ratio. The score of a document is the mean weight of
its n-grams, so it does not depend on the length. Every document is kept or
rejected by one threshold: the one that best separates the labelled rows.

All of it is DataFrame expressions. The corpus counts cover all documents, the
trusted counts and the threshold all labelled ones. What the scoring receives is
one array of ``BUCKETS`` weights.

Defined results: a null or empty text has no words and fails the base rules; a
null id is scored like any other; repeated rows are counted and returned each;
without labelled rows of both classes the threshold is minus infinity and only
the base rules decide. Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.llm.tasks import quoted
from buslens.scale import fits_broadcast, lookup_join, materialise

# What separates words, and the symbols that are counted.
SPACE, WORD, SYMBOL = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
BUCKETS = 1 << 16
SMOOTHING = 0.5
# Steps of the score between which the threshold is chosen, and its bounds.
STEP, BOUND = 0.002, 8.0
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        same = lambda s, k: (F.get(windows, k - 1)["h"] == s["h"]) | (F.get(windows, k + 1)["h"] == s["h"])
        found = F.filter(windows, lambda s, k: F.coalesce(same(s, k), F.get(windows, k - 1)["h"] == s["h"], F.get(windows, k + 1)["h"] == s["h"]))
        return bound(
            F.sort_array(F.transform(found, lambda s: s["i"])),
            # Each window adds the words up to the next one.
            lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(3)), F.lit(3))),
                F.lit(0),
                lambda total, n: total + n,
            ),
        )

    hashes = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    windows = F.sort_array(F.slice(hashes, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))
    return bound(windows, covered)


def text_counts(text: Column, words: Column) -> dict[str, Column]:
    """The counted columns of one text, given its words."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(plain, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": bound(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
    }


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def mean_weight(words: Column, weights: Column) -> Column:
    """Mean weight of the n-grams of a text; 0 without words."""
    each = F.transform(
        words,
        lambda w, i: F.get(weights, _bucket(w)) + F.when(i > 0, F.get(weights, _bucket(F.get(words, i - 1), w))).otherwise(F.lit(0.0)),
    )
    total = F.aggregate(each, F.lit(0.0), lambda t, x: t + x)
    return total / F.greatest(2 * F.size(words) - 1, F.lit(1))


def labelled_documents(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` of every trusted and every poor document; one labelled as both is neither."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    poor = F.col("quality") == 0
    each = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(good).alias("good"), F.max(poor).alias("poor"))
    return materialise(each.where(F.col("good") != F.col("poor")).select("doc_id", "good"), "labelled")


labelled_sample = labelled_documents  # its name when it was a sample


def labelled_texts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The labelled rows of ``docs`` with ``good``. Ids too many to broadcast move the texts, once for all that read them."""
    fits = fits_broadcast(labelled)
    found = lookup_join(docs, labelled, ["doc_id"], "inner", small_fits=fits)
    return found if fits else materialise(found, "labelled-texts")


def _bucket_counts(docs: DataFrame, name: str) -> DataFrame:
    """``bucket`` and how many words and pairs of ``docs`` fall into it; tasks send at most one row per bucket."""
    each = docs.select(words_of(F.col("text")).alias("words")).select("words", F.posexplode("words").alias("at", "word"))
    pair = F.when(F.col("at") > 0, _bucket(F.get("words", F.col("at") - 1), F.col("word")))
    grams = each.select(F.explode(F.array(_bucket(F.col("word")), pair)).alias("bucket")).where("bucket is not null")
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def bucket_weights(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: ``weights``, an array of the weights of all ``BUCKETS`` in order, given ``labelled_documents``."""
    return _weights(docs, labelled_texts(docs, labelled))


def _weights(docs: DataFrame, texts: DataFrame) -> DataFrame:
    raw, target = _bucket_counts(docs, "raw"), _bucket_counts(texts.where("good"), "target")
    counts = raw.join(target, "bucket", "left")
    everything = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = everything.join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    gathered = filled.agg(
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("each"),
    )
    smooth = F.lit(SMOOTHING)
    weight = lambda b: F.log((b["target"] + smooth) / (F.col("all_target") + smooth * BUCKETS)) - F.log(
        (b["raw"] + smooth) / (F.col("all_raw") + smooth * BUCKETS)
    )
    return materialise(gathered.select(F.transform("each", weight).alias("weights")).coalesce(1), "weights")


def _measured(text: Column, weights: Column) -> Column:
    """All counts, the base verdict and the score of a text, with its words split once; one row to explode.

    Exploded, and not just computed: a filter on what a projection computes is
    pushed below it with the whole expression in each place it names, so every
    text would be measured several times, and below a join for every row of it.
    """

    def measures(words: Column) -> Column:
        counts = F.struct(*[c.alias(n) for n, c in text_counts(text, words).items()], mean_weight(words, weights).alias("score"))
        return bound(counts, lambda m: F.struct(*[m[n].alias(n) for n in MEASURES], _base_failed(m).alias("base_failed")))

    return F.transform(F.array(words_of(text)), measures)


def _with_measures(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``docs`` with the struct ``m`` in place of ``text``.

    The weights are a scalar subquery: one value that every task receives, and
    that no plan spells out.
    """
    kept = [c for c in docs.columns if c != "text"]
    with_weights = docs.select("*", weights.scalar().alias("bucket_weights"))
    return with_weights.select(*kept, F.explode(_measured(F.col("text"), F.col("bucket_weights"))).alias("m"))


def _base_failed(measured: Column) -> Column:
    n, repeated = measured["n_words"], measured["n_repeat_words"]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)


def choose_threshold(texts: DataFrame, weights: DataFrame) -> float:
    """The score step that best separates the ``labelled_texts`` that pass the base rules."""
    labelled = _with_measures(texts.select("good", "text"), weights).where("NOT m.base_failed")
    score = F.col("m.score")
    step = F.floor(F.least(F.greatest(score, F.lit(-BOUND)), F.lit(BOUND)) / STEP)
    found = labelled.groupBy(step.alias("step")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("poor"))
    steps = sorted(found.collect())  # at most 2 * BOUND / STEP rows
    good, poor = sum(s.good for s in steps), sum(s.poor for s in steps)
    if not good or not poor:
        return float("-inf")
    best, cut, lost, caught = 0.0, None, 0, 0
    for s in steps:
        lost, caught = lost + s.good, caught + s.poor
        # A trusted document lost weighs as ten poor ones caught.
        if caught / poor - 10 * lost / good > best:
            best, cut = caught / poor - 10 * lost / good, s.step
    if cut is None:
        return float("-inf")
    # Halfway to the next labelled step, so that rows like the rejected ones go with them.
    above = min((s.step for s in steps if s.step > cut), default=cut + 1)
    return (cut + 1 + above) / 2 * STEP


def verdicts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole_rows: bool = False) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``score`` of every document.

    With ``whole_rows`` all columns of ``docs`` come along in the struct ``row``.
    """
    doc_id, text = F.col(quoted(id_column)).cast("long").alias("doc_id"), F.col(quoted(text_column)).cast("string").alias("text")
    rows = docs.select(doc_id, text)
    texts = labelled_texts(rows, labelled_documents(labels))
    weights = _weights(rows, texts)
    extra = ["row"] if whole_rows else []
    source = docs.select(*[F.struct("*").alias(name) for name in extra], doc_id, text)
    measured = _with_measures(source, weights)
    scored = measured.select(*extra, "doc_id", "m.*")
    threshold = choose_threshold(texts, weights)
    decided = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    counted = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return decided.select(*extra, "doc_id", *counted)
