"""Exact top-k search by inner product with cover trees over queries and data.

Vectors are rounded to whole numbers, clustered around a bounded sample of
pivots and cut into blocks; each block carries a cover tree. A unit of work is a
block of queries against a block of data, both descended together. For a node of
queries (centre q, radius s) and one of data (centre c, radius r) no product can
exceed ``q.c + s|c| + r|q| + s r``; the pair is left out when that is below the
worst k-th score of the queries in the node. Leaves are compared by one matrix
product. First every query block meets the data block of the highest bound, then
those blocks that its k-th scores do not rule out.

A node covers its points by children of ``SHRINK`` times its radius whose centres
are further apart than that; where they would be too many, of the first share in
``WIDER`` that few fit; where points are too far apart even for the last, the node
is a leaf. Equal vectors of a block are one point, of which only the smallest
``k + 1`` ids can appear in a result, so a hot vector costs nothing.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors are filled with zeros; a null id is no query, and
as a candidate it loses ties; rows that share an id are different rows, so a
repeated query row is a candidate for its copy. Ties go to the smaller id. Empty
tables give no rows. Scores beyond 2**53 are not supported. Other columns are
not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buslens.llm.tasks import map_batches, quoted
from buslens.scale import materialise

SCALE, K, QUERY_EVERY = 1024, 10, 100
PIVOTS = 64
DATA_BLOCK, QUERY_BLOCK = 4_096, 512
SHRINK, WIDER, LEAF = 0.6, (0.7, 0.8, 0.9), 48
NO_ID = np.iinfo(np.int64).max
BLOCK = "block long, kind int, centre array<double>, radius double, data binary"
FOUND = "query_uid long, query_id long, vec_id long, score long"


@dataclass
class CoverTree:
    """Points in the order of the tree; every node is a range of them."""

    points: np.ndarray  # float64, whole numbers
    begin: np.ndarray
    end: np.ndarray
    centre: np.ndarray  # index of a point
    radius: np.ndarray
    norm: np.ndarray  # of the centre
    children: list[list[int]]

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree, and the order of the given points in it."""
        order = np.arange(len(points))
        begin, end, centre, radius, children = [], [], [], [], []

        def node(a: int, b: int) -> int:
            """A node over ``order[a:b]``, whose first point is its centre."""
            own = points[order[a:b]]
            away = np.sqrt(((own - own[0]) ** 2).sum(axis=1))
            k = len(begin)
            begin.append(a)
            end.append(b)
            centre.append(a)
            radius.append(float(away.max()))
            children.append([])
            if b - a <= LEAF or radius[k] == 0:
                return k
            groups = next((g for g in (cover(own, radius[k] * shrink) for shrink in (SHRINK, *WIDER)) if g is not None), None)
            if groups is None:
                return k
            order[a:b] = order[a:b][np.concatenate(groups)]
            at = a
            for g in groups:
                children[k].append(node(at, at + len(g)))
                at += len(g)
            return k

        def cover(own: np.ndarray, within: float) -> list[np.ndarray] | None:
            left = np.arange(len(own))
            groups = []
            while len(left):
                if len(groups) * LEAF > 4 * len(own):
                    return None  # too far apart for a cover by few children
                head = own[left[0]]
                near = ((own[left] - head) ** 2).sum(axis=1) <= within**2
                near[0] = True
                groups.append(left[near])
                left = left[~near]
            return groups

        if len(points):
            node(0, len(points))
        points = points[order]
        norm = np.sqrt((points[centre] ** 2).sum(axis=1)) if len(points) else np.zeros(0)
        as_int = lambda v: np.array(v, np.int64)
        return cls(points, as_int(begin), as_int(end), as_int(centre), np.array(radius), norm, children), order


@dataclass
class DataBlock:
    tree: CoverTree
    ids: list[np.ndarray]  # the smallest ids of each point, ascending
    uids: list[np.ndarray]


@dataclass
class QueryBlock:
    tree: CoverTree
    ids: np.ndarray
    uids: np.ndarray
    floor: np.ndarray  # a score that the k-th result reaches at least


class _Best:
    """The best results of each query so far."""

    def __init__(self, queries: QueryBlock, k: int):
        self.k, self.queries = k, queries
        self.found: list[list[tuple]] = [[] for _ in queries.ids]  # (-score, id, uid)
        self.worst = queries.floor.copy()

    def add(self, query: int, score: float, ids: np.ndarray, uids: np.ndarray) -> None:
        own = self.queries.uids[query]
        best = self.found[query]
        best += [(-score, i, u) for i, u in zip(ids.tolist(), uids.tolist(), strict=True) if u != own]
        if len(best) > 4 * self.k:
            self.settle(query)

    def settle(self, query: int) -> None:
        best = self.found[query]
        best.sort()
        del best[self.k :]
        if len(best) == self.k:
            self.worst[query] = max(self.worst[query], -best[-1][0])


def search(queries: QueryBlock, data: DataBlock, k: int) -> _Best:
    """The best ``k`` of a block for each query, descending both trees together."""
    best = _Best(queries, k)
    q, d = queries.tree, data.tree
    if not len(queries.ids) or not len(data.ids):
        return best

    def most(a: int, b: int) -> float:
        product = float(q.points[q.centre[a]] @ d.points[d.centre[b]])
        bound = product + q.radius[a] * d.norm[b] + d.radius[b] * q.norm[a] + q.radius[a] * d.radius[b]
        return bound + 1e-9 * abs(bound) + 1e-6  # for rounded norms

    stack = [(most(0, 0), 0, 0)]
    while stack:
        bound, a, b = stack.pop()
        if bound < best.worst[q.begin[a] : q.end[a]].min():
            continue
        open_q, open_d = q.children[a], d.children[b]
        if not open_q and not open_d:
            _leaves(best, queries, data, a, b)
        elif open_d and (not open_q or d.radius[b] >= q.radius[a]):
            stack += sorted((most(a, c), a, c) for c in open_d)  # the highest bound is taken first
        else:
            stack += sorted((most(c, b), c, b) for c in open_q)
    for k_ in range(len(queries.ids)):
        best.settle(k_)
    return best


def _leaves(best: _Best, queries: QueryBlock, data: DataBlock, a: int, b: int) -> None:
    q, d = queries.tree, data.tree
    rows, columns = slice(q.begin[a], q.end[a]), slice(d.begin[b], d.end[b])
    scores = q.points[rows] @ d.points[columns].T
    for at, row in enumerate(scores, q.begin[a]):
        good = np.flatnonzero(row >= best.worst[at])
        if len(good) > best.k + 1:  # ties of the last one stay
            limit = np.partition(row[good], -(best.k + 1))[-(best.k + 1)]
            good = good[row[good] >= limit]
        for c in good:
            best.add(at, row[c], data.ids[d.begin[b] + c], data.uids[d.begin[b] + c])
        best.settle(at)


def _whole(batch: pa.RecordBatch, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their rounded vectors."""
    vectors = [None if v is None or any(x is None for x in v) else np.array(v, np.float64) for v in batch.column("embedding").to_pylist()]
    fit = np.array([v is not None and len(v) > 0 and bool(np.isfinite(v).all()) for v in vectors], bool)
    size = max((len(v) for v, f in zip(vectors, fit, strict=True) if f), default=0)
    out = np.zeros((int(fit.sum()), max(size, dimension or 0)))
    for row, v in zip(out, (v for v, f in zip(vectors, fit, strict=True) if f), strict=True):
        row[: len(v)] = np.floor(SCALE * v)
    return fit, out


def _clustered(vectors: DataFrame) -> DataFrame:
    """``uid, vec_id, vector`` in the order of the nearest pivots, written once."""
    order = [F.xxhash64("vec_id", "embedding"), F.col("vec_id")]
    sample = vectors.where("embedding is not null").orderBy(*order).limit(PIVOTS).toArrow()
    pivots = _whole(sample.to_batches()[0])[1] if sample.num_rows else np.zeros((0, 0))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit, whole = _whole(batch, pivots.shape[1])
            centres = np.zeros((max(1, len(pivots)), whole.shape[1]))
            centres[: len(pivots), : pivots.shape[1]] = pivots
            away = (whole**2).sum(axis=1)[:, None] - 2 * whole @ centres.T + (centres**2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(fit)), pa.array(away.argmin(axis=1).astype(np.int32)), pa.array(away.min(axis=1)),
                 pa.array(list(whole), pa.list_(pa.float64()))],
                ["vec_id", "pivot", "away", "vector"],
            )

    rows = map_batches(vectors, near, "vec_id long, pivot int, away double, vector array<double>")
    tie = F.xxhash64("vec_id")  # splits a vector that many rows share
    ordered = rows.repartitionByRange("pivot", "away", tie).sortWithinPartitions("pivot", "away", "vector", "vec_id")
    return materialise(ordered.select("vec_id", "vector").withColumn("uid", F.monotonically_increasing_id()), "vectors")


def _matrix(vectors: list[list[float]]) -> np.ndarray:
    size = max(map(len, vectors), default=0)
    return np.array([[*v, *[0.0] * (size - len(v))] for v in vectors], np.float64).reshape(len(vectors), size)


def _blocks(rows: DataFrame, every: int, k: int) -> DataFrame:
    """Blocks of data (kind 0) and of queries (kind 1), each with its tree."""

    def block(kind: int, number: int, held: list[tuple]) -> tuple:
        points = _matrix([h[2] for h in held])
        ids = np.array([NO_ID if h[1] is None else h[1] for h in held], np.int64)
        uids = np.array([h[0] for h in held], np.int64)
        if kind == 1:
            tree, order = CoverTree.build(points)
            content = QueryBlock(tree, ids[order], uids[order], np.full(len(ids), -np.inf))
        else:
            points, which = np.unique(points, axis=0, return_inverse=True)
            tree, order = CoverTree.build(points)
            by = np.lexsort([uids, ids, which.ravel()])
            members = np.split(by, np.cumsum(np.bincount(which.ravel(), minlength=len(points)))[:-1])
            content = DataBlock(tree, [ids[members[p]][: k + 1] for p in order], [uids[members[p]][: k + 1] for p in order])
        return number, kind, tree.points[0].tolist(), float(tree.radius[0]), pickle.dumps(content)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: tuple[list, list] = ([], [])
        out = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "vec_id", "vector")), strict=True):
                held[0].append(row)
                if row[1] is not None and row[1] % every == 0:
                    held[1].append(row)
                for kind, size in ((0, DATA_BLOCK), (1, QUERY_BLOCK)):
                    if len(held[kind]) >= size:
                        out.append(block(kind, task << 32 | count, held[kind]))
                        held[kind].clear()
                        count += 1
        out += [block(kind, task << 32 | count + kind, held[kind]) for kind in (0, 1) if held[kind]]
        for row in out:
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])

    return map_batches(rows, work, BLOCK)


def _bounded(pairs: DataFrame) -> DataFrame:
    """``q, d, bound`` from the centres and radii of a query and a data block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, d = _matrix(batch.column("qc").to_pylist()), _matrix(batch.column("dc").to_pylist())
            size = min(q.shape[1], d.shape[1]) if batch.num_rows else 0
            s, r = batch.column("qr").to_numpy(), batch.column("dr").to_numpy()
            norm = lambda v: np.sqrt((v**2).sum(axis=1))
            bound = (q[:, :size] * d[:, :size]).sum(axis=1) + s * norm(d) + r * norm(q) + s * r
            bound = bound + 1e-9 * np.abs(bound) + 1e-6
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("d"), pa.array(bound)], ["q", "d", "bound"])

    return map_batches(pairs, work, "q long, d long, bound double")


def _searched(units: DataFrame, k: int, tasks: int) -> DataFrame:
    """Results of units ``queries, data, floors`` (the floors by query uid, or null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                queries: QueryBlock = pickle.loads(batch.column("queries")[n].as_py())
                data: DataBlock = pickle.loads(batch.column("data")[n].as_py())
                floors = {f["uid"]: f["floor"] for f in batch.column("floors")[n].as_py() or []}
                queries.floor = np.array([floors.get(u, -np.inf) for u in queries.uids.tolist()], np.float64)
                _same_size(queries.tree, data.tree)
                best = search(queries, data, k)
                rows = [(u, i, None if v == NO_ID else v, int(-s))
                        for u, i, found in zip(queries.uids.tolist(), queries.ids.tolist(), best.found, strict=True) for s, v, _ in found]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

    return map_batches(units.repartition(tasks, "q", "d").select("queries", "data", "floors"), work, FOUND)


def _same_size(a: CoverTree, b: CoverTree) -> None:
    size = max(a.points.shape[1], b.points.shape[1])
    for tree in (a, b):
        tree.points = np.pad(tree.points, ((0, 0), (0, size - tree.points.shape[1])))


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` other rows of every query.

    Queries are the rows whose id is divisible by ``every``; they meet all rows,
    block by block.
    """
    spark = vectors.sparkSession
    plain = vectors.select(F.col(quoted(id_column)).cast("long").alias("vec_id"), F.col(quoted(vector_column)).alias("embedding"))
    blocks = materialise(_blocks(_clustered(plain), every, k), "vector-blocks")
    queries, data = blocks.where("kind = 1"), blocks.where("kind = 0")
    pairs = queries.select(F.col("block").alias("q"), F.col("centre").alias("qc"), F.col("radius").alias("qr")).crossJoin(
        data.select(F.col("block").alias("d"), F.col("centre").alias("dc"), F.col("radius").alias("dr"))
    )  # the query set in blocks against all blocks
    pairs = materialise(_bounded(pairs), "block-pairs")
    first = pairs.groupBy("q").agg(F.max_by("d", F.struct("bound", "d")).alias("d"))
    tasks = max(1, min(pairs.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def with_blocks(units: DataFrame) -> DataFrame:
        whole = units.join(queries.select(F.col("block").alias("q"), F.col("data").alias("queries")), "q")
        return whole.join(data.select(F.col("block").alias("d"), "data"), "d")

    nothing = F.lit(None).cast("array<struct<uid: long, floor: double>>").alias("floors")
    found = materialise(_searched(with_blocks(first.select("q", "d", nothing)), k, tasks), "first-results")
    best = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    kth = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
    floors = map_query_blocks(queries).join(kth.select(F.col("query_uid").alias("uid"), F.col("score").cast("double").alias("floor")), "uid", "left")
    per_block = floors.groupBy("q").agg(
        F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("least"),
        F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("uid", "floor"))).alias("floors"),  # a block's queries at most
    )
    rest = pairs.join(first.select("q", F.col("d").alias("done")), "q").where("d <> done").join(per_block, "q").where("bound >= least")
    more = _searched(with_blocks(rest.select("q", "d", "floors")), k, tasks)
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def map_query_blocks(queries: DataFrame) -> DataFrame:
    """``q, uid`` of the queries of every block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                uids = pickle.loads(content).uids
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), number, np.int64)), pa.array(uids)], ["q", "uid"])

    return map_batches(queries.select("block", "data"), work, "q long, uid long")
