import collections
import hashlib

from buslens.llm import jaccard
from buslens.llm.components import components
from buslens.llm.jaccard import forest_depth, near_duplicates, one_of_each
from buslens.llm.repeats import cover_of, removal_digests, without_repeats
from tests.llm.helpers import DOCS, ODD_DOCUMENTS, ordered, with_clashes

NUMBERS = " ".join(map(str, range(100)))
NEAR = [
    (1, "a b c"), (2, "a  b\nc"), (None, "a b c"), (None, None), (5, ""), (5, ""), (6, NUMBERS), (6, NUMBERS), (7, NUMBERS + " 100"),
    (8, " ".join(map(str, range(20, 100)))), (9, " ".join(map(str, range(15, 100)))), (None, "z z z z z z z"), (None, "z z z z z"),
]


def shingles(text):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    linked = {
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b)
    }
    top = list(range(len(rows)))
    for _ in rows:
        for i, j in linked:
            top[i] = top[j] = min(top[i], top[j])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None]
        out.append((doc, min(ids, default=None), sum(a == i for a, _ in linked)))
    return out


def found_near(df, **options):
    return [(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, **options).collect()]


def test_near_duplicates_equal_brute_force(spark):
    for rows in (NEAR, ODD_DOCUMENTS):
        assert ordered(found_near(with_clashes(spark.createDataFrame(rows, DOCS)))) == ordered(brute_near(rows))


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    rows = [(k, " ".join(map(str, [*range(60), *[1000 + k] * (k % 3), *range(60, 100)]))) for k in range(40)]
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", 3)
    monkeypatch.setattr(jaccard, "FETCH_ROWS", 1)  # the texts come by a shuffle
    assert ordered(found_near(spark.createDataFrame(rows, DOCS))) == ordered(brute_near(rows))


def test_no_links_at_all(spark):
    assert found_near(spark.createDataFrame([], DOCS)) == []
    assert ordered(found_near(spark.createDataFrame([(1, "a"), (2, "b")], DOCS))) == [(1, 1, 0), (2, 2, 0)]


def test_one_of_each_keeps_columns_and_lone_rows(spark):
    docs = with_clashes(spark.createDataFrame(NEAR, DOCS))
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert ordered((r.doc_id, r.text or "") for r in kept.collect()) == ordered(
        [(1, "a b c"), (None, ""), (5, ""), (6, NUMBERS), (None, "z z z z z")]
    )


def test_prefix_is_shortened_to_the_target_recall():
    for recall in (0.5, 0.9, 0.999, 0.999999):
        depth = forest_depth(0.8, 16, recall, 8)
        met = lambda d: 1 - (1 - 0.8**d) ** 16
        assert depth == 1 or met(depth) >= recall
        assert depth == 8 or met(depth + 1) < recall


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 9), (9, 3), (20, 21), (21, 20), (30, 30), *[(100 + k, 101 + k) for k in range(40)]]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = {**dict.fromkeys([1, 2, 3, 4, 5, 9], 1), 20: 20, 21: 20, **{100 + k: 100 for k in range(41)}}
    assert {r.node: r.root for r in found} == want and len(found) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_removal(rows, window):
    first = {}
    words = [(t or "").encode().split() for _, t in rows]
    place = lambda d, i: (d is not None, d or 0, i)
    for (doc, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, place(doc, i)), place(doc, i))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < place(doc, i):
                gone |= set(range(i, i + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def repeat_rows():
    import random

    random.seed(5)
    base = [" ".join(random.choices("a b c".split(), k=60)) for _ in range(6)]
    return [
        (None, base[0]), (None, base[0]), (5, base[0]), (5, base[0]), (5, base[1] + " " + base[1]), (6, base[1] + "\n" + base[2]), (7, None),
        (8, ""), (9, "x " * 200), (10, base[3][:50] + " q " + base[3]), (11, " z\t" + base[3]), (12, base[4]), (12, base[5]),
        (13, "  ".join(base)), (14, "y" * 70_000 + " " + base[2]), *ODD_DOCUMENTS,
    ]


def test_removal_equals_brute_force(spark):
    rows = repeat_rows()
    docs = with_clashes(spark.createDataFrame(rows, DOCS)).repartition(5)
    for window in (20, 5, 45):
        assert ordered(removal_digests(docs, window).collect()) == ordered(brute_removal(rows, window))


def test_every_shift_of_a_passage_is_found(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(k, " ".join([*[f"l{k}_{n}" for n in range(k)], passage, f"r{k}"])) for k in range(40)]
    found = {r.doc_id: r.n_removed for r in removal_digests(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {k: 20 if k else 0 for k in range(40)}


def test_texts_lose_the_same_words(spark):
    rows = [(d, t) for d, t in repeat_rows()[:15] if d not in (5, 12, None)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    cut = without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    before = dict(rows)
    for doc, _, removed, digest in brute_removal(rows, 20):
        assert hashlib.sha256(b" ".join((texts[doc] or "").encode().split())).hexdigest() == digest
        assert removed or texts[doc] == before[doc]


def test_nothing_to_remove(spark):
    assert removal_digests(spark.createDataFrame([], DOCS)).collect() == []


def test_cover_meets_every_difference():
    for window in (3, 5, 10, 20, 45, 100):
        period, cover = cover_of(window)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
        assert window - period + 1 >= 1


def test_texts_are_shuffled_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = removal_digests(docs)._jdf.queryExecution()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        text = removal_digests(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan is not None and text.count("ReusedExchange") == 1
    assert collections.Counter(text.split())["CartesianProduct"] == 0


def test_low_similarity_reaches_the_target_recall(spark):
    assert jaccard.forest_trees(0.8, 4, 16, 0.999) == 16 and jaccard.forest_trees(0.3, 1, 16, 0.999) == 20
    words = lambda kind, k, n: [f"{kind}{k}-{i}" for i in range(n)]
    # 10 of 100 shingles in common
    rows = [(2 * k + side, " ".join(words("c", k, 14) + words("ab"[side], k, 45))) for k in range(150) for side in (0, 1)]
    assert sum(n for _, _, n in found_near(spark.createDataFrame(rows, DOCS), similarity=0.1)) >= 2 * 149


def test_links_found_at_long_prefixes_tell_the_recall():
    assert jaccard.measured_recall([], 4, 16) == 1.0
    assert jaccard.measured_recall([1.0, 1.0], 8, 16) == 1.0
    low, high = (jaccard.measured_recall([0.8] * n + [0.99] * 10, 6, 16) for n in (100, 1))
    assert low < high < 1.0
    assert abs(jaccard.measured_recall([0.8] * 7, 4, 16, share=0.01) - (1 - (1 - 0.8**4) ** 16)) < 1e-12
    depths = [forest_depth(0.8, 16, 0.9, 8, found, 0.9999) for found in ([0.99] * 100, [0.99] * 90 + [0.9] * 10, [0.8] * 100)]
    assert depths == sorted(depths, reverse=True) and depths[0] == 8 and depths[-1] == 3


def test_keys_sort_as_tries():
    salts = jaccard._salts(3 * jaccard.LONGEST_PREFIX)
    sets = jaccard.shingle_sets([NUMBERS.encode(), (NUMBERS + " 100").encode(), b"a b c d e f g"])
    keys = [jaccard.forest_keys(s, salts, 3) for s in sets]
    assert {len(k) for k in keys} == {3 * jaccard.KEY_BYTES}
    for depth in range(1, 9):
        labels = jaccard._labels(keys, depth)
        for tree in range(3):
            nodes = [k[tree * jaccard.KEY_BYTES :][: 2 + 2 * depth] for k in keys]
            under = [x[8 * tree :][:8] for x in labels]
            assert [(a == b) for a in nodes for b in nodes] == [(a == b) for a in under for b in under]


def near_pairs(common, alone, count):
    """Pairs of texts with ``common + 2 * alone`` shingles, of which ``common`` are shared."""
    words = lambda kind, k, n: [f"{kind}{k}-{i}" for i in range(n)]
    return [(2 * k + side, " ".join(words("c", k, common + 4) + words("ab"[side], k, alone))) for k in range(count) for side in (0, 1)]


def test_recall_against_brute_force(spark):
    for similarity, common, alone in ((0.5, 50, 25), (0.8, 80, 10), (0.95, 95, 2)):
        rows = near_pairs(common, alone, 400)
        found = found_near(spark.createDataFrame(rows, DOCS), similarity=similarity - 0.01)
        assert sum(n for _, _, n in found) >= 0.995 * 2 * 400
        assert all(c in (d, d - 1) for d, c, _ in found)


def test_sampled_links_are_verified(spark, monkeypatch):
    docs = spark.createDataFrame(near_pairs(90, 5, 300) + [(1000 + d, t + f" z{d}") for d, t in near_pairs(20, 30, 40)], DOCS)
    keyed = jaccard._keyed(docs, "doc_id", "text")
    signed = jaccard._signed(keyed, 5, 16)
    first = jaccard.F.min(jaccard.F.struct("row_key")).alias("first")
    classes = jaccard.materialise(signed.groupBy("class").agg(first, jaccard.F.min("keys").alias("keys")), "classes")
    found, share = jaccard._found_links(classes, keyed, 0.8, 5, 16)
    assert share == 1 and len(found) > 290 and all(abs(s - 0.9) < 1e-9 for s in found)
    monkeypatch.setattr(jaccard, "SAMPLE_KEYS", 3000)
    monkeypatch.setattr(jaccard, "SAMPLE_PAIRS", 50)
    found, share = jaccard._found_links(classes, keyed, 0.8, 5, 16)
    assert 0 < share < 1 and 0 < len(found) <= 50
