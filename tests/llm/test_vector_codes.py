import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from buslens.llm.vector_codes import ENTRIES, PARTS, ROUNDS, Codebooks, train_codes, vector_codes
from tests.llm.helpers import ordered

VECTORS = "vec_id long, embedding array<float>, label int"


def plainly(rows):
    """The contract, vector by vector, with full scans."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not good or len(good[0][1]) % PARTS:
        return []
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // PARTS
    parts = [[[math.floor(1024 * float(np.float32(x))) for x in v[p * width : (p + 1) * width]] for p in range(PARTS)] for _, v, _ in good]
    books = [[parts[k][p] for k in range(min(ENTRIES, len(good)))] for p in range(PARTS)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x[p], c)), e) for e, c in enumerate(books[p])) for p in range(PARTS)] for x in parts]

    for _ in range(ROUNDS):
        near = assign()
        for p in range(PARTS):
            for e in range(len(books[p])):
                own = [parts[k][p] for k in range(len(good)) if near[k][p][1] == e]
                if own:
                    books[p][e] = [math.floor(sum(c) / len(own)) for c in zip(*own)]
    near = assign()
    error = [sum(d for d, _ in n) for n in near]
    labels = {}
    for (_, _, label), e in zip(good, error):
        labels[label] = labels.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in n), er, labels[label], digest) for (i, _, label), n, er in zip(good, near, error)]


def run(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    return vector_codes(df.withColumns({"code": F.lit(1), "entry": F.lit("x"), "vector": F.lit(2), "a.b": F.lit(3)})).collect()


def test_small_tables(spark):
    pick = np.random.default_rng(5)
    # Few different values give many equal distances and entries that stay.
    vectors = (pick.integers(-2, 3, (330, 8)) / 1024).astype(np.float32).tolist()
    rows = [(k, v, k % 3) for k, v in enumerate(vectors)]
    rows += [(7, vectors[9], 1), (None, vectors[11], None), (3, vectors[3], 0), (400, vectors[0], None)]
    rows += [(500, None, 1), (501, [], 1), (502, [None] * 8, 1), (503, [float("nan")] * 8, 1), (504, [float("-inf")] + [0.0] * 7, 1), (505, [1.0] * 4, 2)]
    assert ordered(run(spark, rows)) == ordered(plainly(rows))


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(k, [k / 7, -k / 3, 1e-5, -1e-5], None) for k in range(9)]
    assert ordered(run(spark, rows)) == ordered(plainly(rows))
    assert run(spark, rows[:0]) == [] and run(spark, [(1, None, None), (2, [1.0, 2.0, 3.0], 1)]) == []


def test_large_components(spark):
    rows = [(k, [float(k * 3001), -70000.5, 12345.678 * k, 0.25], k % 2) for k in range(30)]
    assert ordered(run(spark, rows)) == ordered(plainly(rows))
    with pytest.raises(ValueError, match="too large"):
        run(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])


def test_active_entries_equal_full_scans():
    pick = np.random.default_rng(2)
    for largest in (4, 1 << 26):  # distances in doubles, in integers
        rows = pick.integers(-4, 5, (400, 3)) * (largest // 4)
        books = Codebooks(rows[None, :20].copy(), np.ones((1, 20), bool), largest)
        assert books.doubles == (largest == 4)
        entry, distance = books.nearest(0, rows, np.arange(20))
        for _ in range(6):
            cells = {e: (int((entry == e).sum()), rows[entry == e].sum(0).tolist()) for e in range(20) if (entry == e).any()}
            books = books.updated(cells, largest)
            entry, distance = books.assign(0, rows, entry, distance)
            whole = books.nearest(0, rows, np.arange(20))
            assert (entry == whole[0]).all() and (distance == whole[1]).all()
        assert not books.moved.all()


def test_whole_table(spark, sf_dir):
    state, books = train_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assert books.entries.shape[:2] == (PARTS, ENTRIES) and state.count() > 0
