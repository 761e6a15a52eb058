"""Near-duplicate join on word shingles: a MinHash LSH forest with exact verification.

A document is the set of its runs of five words. Documents with the same set are
one class (copies are never paired). Each class has a key per tree: the number of
the tree and eight MinHash values, so that sorted keys are the tries of the forest
and a prefix of a key is a node. Two classes are candidates when they share a node
at the level to which the prefixes are shortened:

* the longest prefixes are matched first, one pair of classes per node, and a
  bounded sample of these pairs is verified. A link at similarity ``s`` is met at
  ``d`` values with probability ``1 - (1 - s^d)^trees``; weighted by the inverse of
  the probability at which the sample met them, the verified links tell which share
  of all links each level meets;
* prefixes are shortened until that share reaches ``LINK_RECALL`` and a pair exactly
  at the threshold, of which the sample may have none, the target recall. Where one
  value is too many for that, there are more trees.

Classes meet under the nodes of that level, and all candidates are verified exactly:

1. classes that share a node are laid out by the smallest class they meet, in
   the order of their labels, into blocks of bounded size, so that near copies stand together;
2. every block is one unit of work, and so are the classes of two blocks that meet
   under a label: pairs that share one are compared by their whole sets. A unit
   returns the number of links of each class and a spanning forest of its links,
   never the pairs;
3. the connected parts of the verified links are the near-duplicate groups.

A label that holds a third of all classes is thus compared in blocks by many
tasks, and what is shuffled for it are blocks, not pairs.

Defined results: a text of one to four words is one shingle of all its words;
null and empty texts have no shingles and no links, each row its own class.
Repeated rows and copies count as links of each other. The class id is the
smallest document id of the group, null if all ids in it are null. Columns
besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buslens.llm.components import components
from buslens.llm.tasks import bounds, chunks, expose_package, fresh_name, map_batches, map_groups, quoted, row_key
from buslens.llm.wordhash import mixed, run_hashes, texts_words
from buslens.scale import lookup_join, materialise, scratch_scope

SHINGLE, SIMILARITY = 5, 0.8
TREES, LONGEST_PREFIX, TARGET_RECALL = 16, 8, 0.999
# Recall over the links there are, as measured on a sample of verified pairs from about so many keys.
LINK_RECALL, SAMPLE_PAIRS, SAMPLE_KEYS = 0.9999, 2_000, 4_000_000
KEY_BYTES = 2 + 2 * LONGEST_PREFIX
# Bounds of a block: classes and shingles (one class alone may have more).
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 160_000
# Classes whose texts are fetched by a broadcast of their keys; beyond, by a shuffle.
FETCH_ROWS = 200_000
SIGNED = "row_key binary, doc_id long, class binary, keys binary, size long"
UNIT = "class binary, links long, other binary"


def meeting(similarity: float, depth: int, trees: int, share: float = 1.0) -> float:
    """The probability that a pair meets under a prefix of ``depth`` values, of which a ``share`` is looked at."""
    return 1 - (1 - share * similarity**depth) ** trees


def measured_recall(found: list[float], depth: int, trees: int, longest: int = LONGEST_PREFIX, share: float = 1.0) -> float:
    """The share of all links that meet at ``depth``, from the similarities of links found at the longest prefixes; 1 if none was."""
    weights = [1 / meeting(s, longest, trees, share) for s in found]
    met = sum(w * meeting(s, depth, trees) for s, w in zip(found, weights, strict=True))
    return met / sum(weights) if found else 1.0


def forest_depth(
    similarity: float, trees: int, recall: float, longest: int, found: list[float] | None = None, link_recall: float = LINK_RECALL, share: float = 1.0
) -> int:
    """The longest prefix at which pairs of this similarity, and the links ``found``, meet with their target recalls; 1 at least."""
    depth = longest
    while depth > 1 and (meeting(similarity, depth, trees) < recall or measured_recall(found or [], depth, trees, longest, share) < link_recall):
        depth -= 1
    return depth


def forest_trees(similarity: float, depth: int, trees: int, recall: float) -> int:
    """The number of trees, ``trees`` at least, in which pairs of this similarity meet with the target recall."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    while meeting(similarity, depth, trees) < recall:
        trees += 1
    return trees


def _salts(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count], seeds[count:] | np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = texts_words(texts)
    ends = bounds(counts)
    starts = np.concatenate([np.arange(a, max(a + 1, b - shingle + 1)) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a >= shingle] or [[]])
    hashes = run_hashes(words, shingle, starts.astype(np.int64))
    out, at = [], 0
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(hashes[at : at + b - a - shingle + 1]))
            at += b - a - shingle + 1
        elif b > a:
            out.append(run_hashes(words, b - a, np.array([a])) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def min_hashes(shingles: np.ndarray, salts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest salted hash of the set for each salt."""
    least = np.full(len(salts[0]), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] ^ salts[0]) * salts[1]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def forest_keys(shingles: np.ndarray, salts: tuple[np.ndarray, np.ndarray], trees: int) -> bytes:
    """The sortable key of the set in each tree: the number of the tree, then 16 bits of each MinHash value."""
    out = np.empty((trees, 1 + LONGEST_PREFIX), ">u2")
    out[:, 0] = np.arange(trees)
    out[:, 1:] = (mixed(min_hashes(shingles, salts)) >> np.uint64(48)).reshape(trees, LONGEST_PREFIX)
    return out.tobytes()


def _labels(keys: list[bytes], depth: int) -> list[bytes]:
    """One 64-bit label per tree for the node of each key at this depth."""
    values = np.frombuffer(b"".join(keys), ">u2").astype(np.uint64).reshape(len(keys), -1, 1 + LONGEST_PREFIX)
    label = values[:, :, 0] + np.uint64(1)
    for k in range(1, 1 + depth):
        label = mixed(label * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return [row.tobytes() for row in label]


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    doc_id, text = F.col(quoted(id_column)).cast("long"), F.col(quoted(text_column)).cast("string")
    return docs.select(row_key(doc_id, text).alias("row_key"), doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))


def _signed(keyed: DataFrame, shingle: int, trees: int) -> DataFrame:
    """Class, forest keys and set size of every row; texts and sets stay behind."""
    salts = _salts(trees * LONGEST_PREFIX)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column("text").cast(pa.large_binary()).to_pylist(), shingle)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [forest_keys(s, salts, trees) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key"), part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(keys, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int64())],
                    [c.split()[0] for c in SIGNED.split(", ")],
                )

    return map_batches(keyed, work, SIGNED)


def _by_node(classes: DataFrame, columns: list[str], trees: int, depth: int) -> DataFrame:
    """One row per class and trie node at this depth: a prefix of the key."""
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    node = F.expr(f"substring(keys, {KEY_BYTES} * tree + 1, {2 + 2 * depth})")
    return classes.select(*columns, "keys", at).select(*columns, node.alias("node"))


def _by_label(classes: DataFrame, columns: list[str], trees: int) -> DataFrame:
    """One row per class and label."""
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    node = F.expr("substring(labels, 8 * tree + 1, 8)")
    return classes.select(*columns, "labels", at).select(*columns, node.alias("node"))


def _found_links(classes: DataFrame, keyed: DataFrame, similarity: float, shingle: int, trees: int) -> tuple[list[float], float]:
    """Similarities of the links in a sample of the pairs with the longest common prefixes, and the share of nodes looked at.

    Nodes are chosen by their hash, so that all classes of a node are there or none;
    of a node the smallest and the largest class are paired, and a class stands in
    two pairs at most. At most ``SAMPLE_PAIRS`` numbers reach the driver.
    """
    share = min(1.0, SAMPLE_KEYS / max(1, classes.count() * trees))
    nodes = _by_node(classes, ["class"], trees, LONGEST_PREFIX)
    if share < 1:
        nodes = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    met = nodes.groupBy("node").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    chance = F.xxhash64("a", "b")
    first = met.groupBy("a").agg(F.min_by("b", F.struct(chance, "b")).alias("b"))
    pairs = first.groupBy("b").agg(F.min_by("a", F.struct(chance, "a")).alias("a"))
    pairs = materialise(pairs.orderBy(chance, "a", "b").limit(SAMPLE_PAIRS), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class"), F.xxhash64("a", "b").alias("pair"))
    places = F.broadcast(classes.join(F.broadcast(ends), "class").select(F.col("first.row_key").alias("row_key"), "class", "pair"))
    texts = keyed.join(places, "row_key").dropDuplicates(["class", "pair"]).select("pair", "text")

    def compare(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").cast(pa.large_binary()).to_pylist(), shingle)
        common = len(np.intersect1d(sets[0], sets[-1], assume_unique=True))
        return pa.table({"common": [common], "every": [len(sets[0]) + len(sets[-1]) - common]})

    rows = map_groups(texts, "pair", compare, "common long, every long").collect()
    return [r.common / r.every for r in rows if r.common >= similarity * r.every], share


def _blocks(candidates: DataFrame, depth: int) -> DataFrame:
    """Candidates numbered into blocks of bounded size, near ones together."""
    schema = "class binary, labels binary, copies long, size long, row_key binary, block long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, classes, shingles = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            numbers = []
            for size in batch.column("size").to_pylist():
                if classes and (classes >= BLOCK_CLASSES or shingles + size > BLOCK_SHINGLES):
                    block, classes, shingles = block + 1, 0, 0
                classes, shingles = classes + 1, shingles + size
                numbers.append(task << 32 | block)
            labels = pa.array(_labels(batch.column("keys").to_pylist(), depth), pa.binary())
            kept = [batch.column(c) for c in ("copies", "size", "row_key")]
            yield pa.RecordBatch.from_arrays([batch.column("class"), labels, *kept, pa.array(numbers, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    ordered = candidates.repartitionByRange("root", "keys").sortWithinPartitions("root", "keys", "class")
    return map_batches(ordered.select("class", "keys", "copies", "size", "row_key"), work, schema)


class _Block:
    """The classes of a block with their labels and shingle sets."""

    def __init__(self, rows: list[dict]):
        self.classes = [r["class"] for r in rows]
        self.labels = np.frombuffer(b"".join(r["labels"] for r in rows), np.uint64).reshape(len(rows), -1)
        self.copies = np.array([r["copies"] for r in rows], np.int64)
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)


def _common(left: list[np.ndarray], right: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of common shingles of the given pairs."""
    if len(pairs[0]) <= 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(*pairs, strict=True)], np.int64)
    # Many pairs: products of membership matrices, over the shingles that occur twice, part by part.
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, shingle, many = np.unique(every, return_inverse=True, return_counts=True)
    new = np.cumsum(many > 1) - 1
    used = many[shingle] > 1
    shingle, owner = new[shingle[used]], owner[used]
    product = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    for low in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, 8192):
        a, b = np.searchsorted(shingle, [low, low + 8192])
        member = np.zeros((len(left) + len(right), 8192), np.float32)
        member[owner[a:b], shingle[a:b] - low] = 1
        product += member[: len(left)] @ member[len(left) :].T
    return product[pairs].round().astype(np.int64)


def _compare(left: _Block, right: _Block | None, similarity: float) -> list[tuple]:
    """Links of each class of a unit and a spanning forest of the links; see ``UNIT``."""
    other = right or left
    met = np.zeros((len(left.classes), len(other.classes)), bool)
    for tree in range(left.labels.shape[1]):
        met |= left.labels[:, tree, None] == other.labels[None, :, tree]
    if right is None:
        met = np.triu(met, 1)
    # Sets whose sizes differ too much cannot be similar enough.
    small, large = np.minimum.outer(left.sizes, other.sizes), np.maximum.outer(left.sizes, other.sizes)
    a, b = np.nonzero(met & (small >= similarity * large))
    common = _common(left.sets, other.sets, (a, b))
    # In whole numbers where the threshold allows it, so that the bound itself counts.
    linked = common * 1_000_000 >= round(similarity * 1_000_000) * (left.sizes[a] + other.sizes[b] - common)
    a, b = a[linked], b[linked]
    links_left = np.bincount(a, weights=other.copies[b], minlength=len(left.classes)).astype(np.int64)
    links_right = np.bincount(b, weights=left.copies[a], minlength=len(other.classes)).astype(np.int64)
    rows = []
    if right is None:
        rows += [(c, int(n), None) for c, n in zip(left.classes, links_left + links_right, strict=True) if n]
    else:
        rows += [(c, int(n), None) for c, n in zip(left.classes, links_left, strict=True) if n]
        rows += [(c, int(n), None) for c, n in zip(right.classes, links_right, strict=True) if n]
    shift = 0 if right is None else len(left.classes)
    names = left.classes if right is None else left.classes + right.classes
    least = np.arange(len(names))
    while True:  # the smallest member of each connected part
        now = least.copy()
        low = np.minimum(now[a], now[b + shift])
        np.minimum.at(now, a, low)
        np.minimum.at(now, b + shift, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    return rows + [(names[k], 0, names[least[k]]) for k in np.flatnonzero(least != np.arange(len(names)))]


def _unit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = [pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in UNIT.split(", ")])


def _meetings(placed: DataFrame, trees: int) -> DataFrame:
    """``a, b, class``: the classes of two blocks that share a trie node across them."""
    places = _by_label(placed, ["block", "class"], trees)
    blocks = places.select("node", "block").distinct().groupBy("node").agg(F.collect_list("block").alias("blocks"))
    # A class meets another block once, under however many nodes.
    met = places.join(blocks.where(F.size("blocks") > 1), "node").groupBy("class", "block")
    each = met.agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    others = each.select("class", "block", F.explode(F.array_remove("blocks", F.col("block"))).alias("other"))
    return others.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "class")


def _verified(sets: DataFrame, meetings: DataFrame, similarity: float) -> DataFrame:
    """Compare within every block, and across two blocks the classes that meet there.

    A group is a block or parts of two, so its size is bounded.
    """

    def inner(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_unit_batch(_compare(_Block(table.to_pylist()), None, similarity))])

    def across(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        left, right = ([r for r in rows if r["block"] == r[side]] for side in ("a", "b"))
        return pa.Table.from_batches([_unit_batch(_compare(_Block(left), _Block(right), similarity))])

    expose_package(sets.sparkSession)
    within = map_groups(sets, "block", inner, UNIT)
    joined = meetings.join(sets, "class")
    return within.unionByName(joined.groupBy("a", "b").applyInArrow(across, UNIT))


def _grouped(signed: DataFrame, keyed: DataFrame, similarity: float, shingle: int, trees: int, recall: float) -> DataFrame:
    """``class, class_id, keeper, n_links`` of every class."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")).alias("first")
    classes = signed.where("class is not null").groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), first, F.min("keys").alias("keys"), F.min("size").alias("size")
    )
    classes = materialise(classes, "classes")
    found, share = _found_links(classes, keyed, similarity, shingle, trees)
    depth = forest_depth(similarity, trees, recall, LONGEST_PREFIX, found, share=share)
    by_node = _by_node(classes, ["class"], trees, depth)
    nodes = by_node.groupBy("node").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # The smallest class met under any node; it only decides which classes share a block.
    met = by_node.join(nodes.select("node", "least"), "node").groupBy("class").agg(F.min("least").alias("root"))
    candidates = classes.join(met, "class")
    numbered = candidates.select("class", "keys", "copies", "size", F.col("first.row_key").alias("row_key"), "root")
    placed = materialise(_blocks(numbered, depth), "placed")
    # The texts of the candidates are read again; all others stay where they are.
    wanted = placed.select("row_key", "class", "block", "labels", "copies")
    texts = lookup_join(keyed, wanted, ["row_key"], "inner", max_rows=FETCH_ROWS).dropDuplicates(["class"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                found = shingle_sets(part.column("text").cast(pa.large_binary()).to_pylist(), shingle)
                kept = [part.column(c) for c in ("class", "block", "labels", "copies")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([s.tobytes() for s in found], pa.binary())],
                                                 ["class", "block", "labels", "copies", "shingles"])

    with_sets = map_batches(texts.select("class", "block", "labels", "copies", "text"), sets,
                            "class binary, block long, labels binary, copies long, shingles binary")
    verified = materialise(_verified(materialise(with_sets, "sets"), _meetings(placed, trees), similarity), "verified")
    groups = components(verified.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    links = verified.groupBy("class").agg(F.sum("links").alias("links"))
    rooted = classes.select("class", "copies", "first").join(groups.withColumnRenamed("node", "class"), "class", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "class"))
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return rooted.join(heads, "root").join(links, "class", "left").select(
        "class", F.col("head.doc_id").alias("class_id"), F.col("head.row_key").alias("keeper"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    trees: int = TREES,
    recall: float = TARGET_RECALL,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``row_key, doc_id, class_id, n_links, keeper`` of every row.

    ``n_links`` is the number of other rows at the similarity or above;
    ``keeper`` is the row key that stands for the group, the one of the smallest
    id. Row keys are digests of id and text, the same for repeated rows.
    """
    trees = forest_trees(similarity, forest_depth(similarity, trees, recall, LONGEST_PREFIX), trees, recall)
    keyed = _keyed(docs, id_column, text_column)
    signed = materialise(_signed(keyed, shingle, trees), "signed")
    with scratch_scope(docs.sparkSession):  # blocks and candidates go when the groups are known
        labelled = materialise(_grouped(signed, keyed, similarity, shingle, trees, recall), "labelled", outlives=True)
    rows = signed.select("row_key", "doc_id", "class")
    placed_rows = lookup_join(rows.where("class is not null"), labelled, ["class"], "inner", max_rows=FETCH_ROWS)
    alone = rows.where("class is null").select(
        "row_key", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("row_key").alias("keeper")
    )
    return placed_rows.select("row_key", "doc_id", "class_id", "n_links", "keeper").unionByName(alone)


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    The row with the smallest id stays; of repeated rows, one.
    """
    found = near_duplicates(docs, id_column=id_column, text_column=text_column)
    keepers = found.where(F.col("row_key") == F.col("keeper")).select("row_key").distinct()
    names = docs.columns
    fresh = fresh_name(names)
    doc_id, text = F.col(quoted(id_column)).cast("long"), F.col(quoted(text_column)).cast("string")
    named = docs.select(*[F.col(quoted(c)) for c in names], row_key(doc_id, text).alias(fresh))
    kept = named.join(keepers.withColumnRenamed("row_key", fresh), fresh, "left_semi")
    return kept.dropDuplicates([fresh]).select(*[F.col(quoted(c)) for c in names])
