"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then dealt to its leaf. Inner product becomes
distance by one more coordinate that brings all vectors to the largest norm. A query walks the tree best bin
first: a priority queue over nodes, nearest centroid first, yields leaves in order. How many leaves it visits
is calibrated: for some queries the true neighbours are found by a pass over all vectors in blocks, and the
visits widen until the share of true neighbours inside visited leaves reaches the target.

A leaf is split into blocks of rows and its queries into shares, so that no task holds more than one block
and one share however full the leaf is. The tree, the leaf sizes and the calibration queries are bounded by
parameters and travel in closures; vectors and results never pass the driver.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows of null id; rows that repeat an id are candidates each, but query once,
with the smallest vector; with fewer candidates than asked all are returned; equal scores rank by id; an
empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mediamatch.session import checkpointed

K = 20
#: Most vectors that the tree is fitted on, and most numbers in them.
SAMPLE_ROWS = 20_000
SAMPLE_NUMBERS = 4_000_000
BRANCHES = 16
LEAF_SAMPLE = 256
KMEANS_ROUNDS = 8
CALIBRATION_QUERIES = 96
TARGET_RECALL = 0.97
#: Pairs of vectors whose scores are summed at once.
PAIRS = 1 << 16
BLOCK_ROWS = 4096
SHARE_QUERIES = 4096


@dataclass
class Tree:
    """Nodes in breadth-first order; a leaf has no children and a number."""

    children: list[tuple[int, int]] = field(default_factory=list)  # first child, end child
    centroids: np.ndarray | None = None
    leaf_of: list[int] = field(default_factory=list)  # leaf number of a node, -1 inside

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf_of)


def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from k-means++ seeds; (centroids, cluster of each point), empty clusters dropped."""
    centres = points[[rng.integers(len(points))]]
    gap = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k and gap.max() > 0:
        chosen = points[rng.choice(len(points), p=gap / gap.sum())]
        centres = np.vstack([centres, chosen])
        gap = np.minimum(gap, ((points - chosen) ** 2).sum(1))
    for _ in range(KMEANS_ROUNDS):
        own = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        used = np.unique(own)
        centres = np.vstack([points[own == c].mean(0) for c in used])
    own = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
    return centres, own


def fit_tree(points: np.ndarray, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    rng = np.random.default_rng(7)
    tree, centroids = Tree([(0, 0)], None, [-1]), [points.mean(0) if len(points) else np.zeros(points.shape[1])]
    queue = [(0, points)]
    while queue:
        node, own = queue.pop(0)
        centres, part = _means(own, branches, rng) if len(own) > leaf_sample else (np.zeros((1, 0)), None)
        if len(centres) == 1:  # few or equal points
            tree.leaf_of[node] = sum(x >= 0 for x in tree.leaf_of)
            continue
        first = len(centroids)
        tree.children[node] = (first, first + len(centres))
        for c in range(len(centres)):
            centroids.append(centres[c])
            tree.children.append((0, 0))
            tree.leaf_of.append(-1)
            queue.append((first + c, own[part == c]))
    tree.centroids = np.vstack(centroids)
    return tree


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf of each point, by descent to the nearest centroid."""
    at = np.zeros(len(points), np.int64)
    ends = np.array([end for _, end in tree.children])
    while True:
        inner = np.unique(at[ends[at] > 0])
        if not len(inner):
            return np.array(tree.leaf_of)[at]
        for node in inner:
            rows = np.flatnonzero(at == node)
            first, end = tree.children[node]
            centres = tree.centroids[first:end]
            at[rows] = first + np.argmin((centres**2).sum(1) - 2 * points[rows] @ centres.T, axis=1)


def best_bins(tree: Tree, point: np.ndarray, visits: int) -> list[int]:
    """The first leaves of a best-bin-first walk."""
    queue, out = [(0.0, 0)], []
    while queue and len(out) < visits:
        _, node = heapq.heappop(queue)
        if tree.leaf_of[node] >= 0:
            out.append(tree.leaf_of[node])
            continue
        first, end = tree.children[node]
        for i, gap in enumerate(((tree.centroids[first:end] - point) ** 2).sum(1).tolist()):
            heapq.heappush(queue, (gap, first + i))
    return out


def _lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """One more coordinate that brings every vector to the largest norm."""
    rest = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, rest])


def _aimed(queries: np.ndarray, norm: float) -> np.ndarray:
    length = np.sqrt((queries**2).sum(1, keepdims=True))
    return np.column_stack([queries * (norm / length), np.zeros(len(queries))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest_in(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """(query ids, ids, scores), aligned, of the k best of each query, its own id left out.

    Equal vectors are one candidate with its smallest ids. A matrix product picks candidates; their scores are
    summed again row by row, so equal vectors score alike wherever they lie.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order]) + 0.0  # one kind of zero
    rows = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, first, which, sizes = np.unique(rows, return_index=True, return_inverse=True, return_counts=True)
    members = np.argsort(which, kind="stable")
    place = np.arange(len(which)) - np.repeat(np.cumsum(np.r_[0, sizes[:-1]]), sizes)
    early = place <= k
    table = np.full((len(first), min(int(sizes.max()), k + 1)), -1)
    table[which[members[early]], place[early]] = members[early]
    plain = vectors[first]
    longest = np.sqrt((plain * plain).sum(axis=1).max(initial=0))
    for low in range(0, len(queries), 256):
        asked, asking = queries[low : low + 256], q_ids[low : low + 256]
        rough = asked @ plain.T
        top = min(k + 1, rough.shape[1])
        edge = -np.partition(-rough, top - 1, axis=1)[:, top - 1 : top]
        # the order of summation can change a score by this much; all that may tie with the last one kept stay
        unsure = np.finfo(float).eps * 4 * plain.shape[1] * longest * np.sqrt((asked * asked).sum(axis=1, keepdims=True))
        query, chosen = np.nonzero(rough >= edge - unsure)
        exact = np.concatenate(
            [np.add.reduce(asked[query[i : i + PAIRS]] * plain[chosen[i : i + PAIRS]], axis=1) for i in range(0, len(query), PAIRS)]
        )
        at = table[chosen]
        pair, member = np.nonzero(at >= 0)
        own, query, score = ids[at[pair, member]], query[pair], exact[pair]
        other = own != asking[query]
        own, query, score = own[other], query[other], score[other]
        best = np.lexsort((own, -score, query))
        ordered = query[best]
        place_of = np.arange(len(best)) - np.searchsorted(ordered, ordered, "left")
        best = best[place_of < k]
        yield asking[query[best]], own[best], score[best]


FOUND = "query_id long, vec_id long, score double"


def _found_batch(results: Iterator[tuple]) -> pa.Table:
    columns = [np.concatenate(x) for x in zip(*results)] or [np.zeros(0)] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("query_id", "vec_id", "score"), columns, kinds)})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrate(tree: Tree, points: DataFrame, queries: DataFrame, norm: float, k: int, target: float, count: int) -> int:
    """Leaf visits at which the mean recall of `count` queries reaches the target."""
    rows = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(count).toArrow()
    q_ids, asked = rows.column("query_id").to_numpy(), _matrix(rows.column("query"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest_in(q_ids, asked, batch.column(0).to_numpy(), _matrix(batch.column(1)), k)
                yield from _found_batch(found).to_batches()

    true = _ranked(points.select("vec_id", "vector").mapInArrow(nearest, FOUND), k)
    homes = points.select("vec_id", "leaf").join(F.broadcast(true.select("query_id", "vec_id")), "vec_id").select("query_id", "leaf")
    wanted: dict[int, list[int]] = {}
    for row in homes.collect():  # at most count x k rows
        wanted.setdefault(row["query_id"], []).append(row["leaf"])
    inside = np.zeros(tree.leaves)
    for query, point in zip(q_ids, _aimed(asked, norm)):
        place = {leaf: i for i, leaf in enumerate(best_bins(tree, point, tree.leaves))}
        for leaf in wanted.get(int(query), []):
            inside[place[leaf]] += 1
    reached = np.cumsum(inside)
    return int(np.searchsorted(reached, target * reached[-1])) + 1 if reached[-1] else 1


def search(
    embeddings: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row, among all rows but its own."""
    rows = embeddings.select(
        embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector_col].cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("square")
    )
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, norm = rows.where(F.size("vector") == most["size"]), float(np.sqrt(most["square"]))
    sampled = min(SAMPLE_ROWS, max(SAMPLE_NUMBERS // most["size"], 1000))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sampled).toArrow()
    tree = fit_tree(_lifted(_matrix(sample.column("vector")), norm))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            leaf = leaves_of(tree, _lifted(vectors, norm)) if len(vectors) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=["vec_id", "vector", "asks", "leaf"])

    points = checkpointed(rows.mapInArrow(place, "vec_id long, vector array<double>, asks boolean, leaf int"))
    queries = points.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))
    visits = calibrate(tree, points, queries, norm, k, target, CALIBRATION_QUERIES)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = _matrix(batch.column(1))
            bins = [best_bins(tree, p, visits) for p in _aimed(asked, norm)] if len(asked) else []
            at = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            leaf = pa.array([leaf for b in bins for leaf in b], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["query_id", "query"]).take(
                pa.array(at.astype(np.int64))
            ).append_column("leaf", leaf)

    walks = queries.mapInArrow(walk, "query_id long, query array<double>, leaf int")
    filled = {r["leaf"]: r["count"] for r in points.groupBy("leaf").count().collect()}  # one row for each leaf
    asked = {r["leaf"]: r["count"] for r in walks.groupBy("leaf").count().collect()}
    blocks = F.create_map(*(F.lit(x) for leaf in range(tree.leaves) for x in (leaf, -(-filled.get(leaf, 0) // BLOCK_ROWS) or 1)))
    shares = F.create_map(*(F.lit(x) for leaf in range(tree.leaves) for x in (leaf, -(-asked.get(leaf, 0) // SHARE_QUERIES) or 1)))

    def spread(rows: DataFrame, own: str, key: str, dealt: Column, other: str, copied: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), dealt[F.col("leaf")]).cast("int")
        return rows.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), copied[F.col("leaf")] - 1)))

    left = spread(points.drop("asks"), "block", "vec_id", blocks, "share", shares)
    right = spread(walks, "share", "query_id", shares, "block", blocks)
    keys = ("leaf", "block", "share")

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _found_batch(iter(()))
        found = nearest_in(
            queries.column("query_id").to_numpy(), _matrix(queries.column("query")),
            vectors.column("vec_id").to_numpy(), _matrix(vectors.column("vector")), k,
        )
        return _found_batch(found)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
