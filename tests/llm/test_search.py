import math

import numpy as np
import pytest

from buslens.llm import cover_tree
from buslens.llm.cover_tree import CoverTree, top_k
from tests.llm.helpers import ordered, with_clashes

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=10, every=100):
    fit = [(d, [math.floor(1024 * x) for x in v]) for d, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = max((len(v) for _, v in fit), default=0)
    matrix = np.array([v + [0] * (size - len(v)) for _, v in fit], np.int64).reshape(len(fit), size)
    out = []
    for j, (d, _) in enumerate(fit):
        if d is None or d % every:
            continue
        scores = matrix @ matrix[j]
        best = sorted((-int(scores[m]), fit[m][0] is None, fit[m][0] or 0) for m in range(len(fit)) if m != j)[:k]
        out += [(d, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(best)]
    return out


def odd_vectors():
    random = np.random.default_rng(1)
    rows = [(k, (random.normal(size=5) * 0.1).round(2).tolist()) for k in range(60)]
    rows += [(100, [1.0, 2.0]), (100, [1.0, 2.0]), (None, [0.5] * 5), (None, None), (200, None), (300, [float("nan")] * 5), (400, [None, 1.0])]
    return rows + [(500, []), (600, [0.0] * 5), (800, [float("inf")] * 5)] + [(700 + k, [0.1, 0.2, 0.3, 0.4, 0.5]) for k in range(40)]


@pytest.mark.parametrize("options", [{}, {"k": 3, "every": 2}, {"k": 500, "every": 50}])
def test_equals_brute_force(spark, options):
    df = spark.createDataFrame(odd_vectors(), SCHEMA)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert ordered(top_k(with_clashes(df), **options).collect()) == ordered(brute(rows, **options))


def test_small_blocks_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "DATA_BLOCK", 150)
    monkeypatch.setattr(cover_tree, "QUERY_BLOCK", 20)
    random = np.random.default_rng(2)
    centres = random.normal(size=(8, 6))
    rows = [(k, (centres[k % 8] + random.normal(size=6) * 0.05).tolist()) for k in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert ordered(top_k(df, every=10).collect()) == ordered(brute(rows, every=10))


def test_nothing_to_search(spark):
    assert top_k(spark.createDataFrame([], SCHEMA)).collect() == []
    assert top_k(spark.createDataFrame([(0, [1.0])], SCHEMA)).collect() == []


def test_nodes_cover_their_points():
    random = np.random.default_rng(3)
    points = np.floor(random.normal(size=(10, 4))[random.integers(0, 10, 2000)] * 500 + random.normal(size=(2000, 4)) * 20)
    tree, order = CoverTree.build(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(2000)) and len(tree.begin) > 10
    for a, b, c, r, children in zip(tree.begin, tree.end, tree.centre, tree.radius, tree.children, strict=True):
        assert np.sqrt(((tree.points[a:b] - tree.points[c]) ** 2).sum(axis=1)).max() <= r + 1e-9
        if children:
            assert [tree.begin[k] for k in children][1:] == [tree.end[k] for k in children][:-1]
            heads = tree.points[tree.centre[children]]
            apart = np.sqrt(((heads[:, None] - heads) ** 2).sum(axis=2)) + np.eye(len(heads)) * 1e9
            assert apart.min() > r * cover_tree.SHRINK


def test_far_apart_points_get_cover_levels():
    points = np.floor(np.random.default_rng(4).normal(size=(2000, 64)) * 128)
    tree, order = CoverTree.build(points)
    assert len(tree.begin) > 10 and sorted(order) == list(range(2000))
    for a, b, c, r in zip(tree.begin, tree.end, tree.centre, tree.radius, strict=True):
        assert np.sqrt(((tree.points[a:b] - tree.points[c]) ** 2).sum(axis=1)).max() <= r + 1e-6
