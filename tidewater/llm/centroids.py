"""Centroid clustering of whole-number vectors by kd-tree filtering.

Each partition is cut into blocks of vectors; a block becomes a kd-tree whose nodes hold the number of their vectors,
componentwise sums and boxes. The trees are written once. A round sends the centroids down every tree: of the centroids
that a node still has, those go that are farther than another one from every point of its box; a node with one left is
assigned whole, by its count and sums, and leaves that keep several are resolved vector by vector. Blocks return counts
and sums of each centroid, so a round shuffles centroids x components x blocks numbers, and the driver sees centroids x
components.

All arithmetic is exact: in doubles while every sum of products stays below 2 ** 53 (checked for each block), else in
Python's whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, fresh, give_back

#: Components beyond this have no squared distance that a long or a decimal of 38 digits could hold.
BEYOND = 1e15
#: Vectors in a tree, and in a leaf.
BLOCK, LEAF = 8192, 16
#: Largest component for which a block is reckoned in doubles: 2 * dims * (2 * SMALL) ** 2 stays below 2 ** 53 up to 1024 dims.
SMALL = 1 << 20


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: doubles if all are small, else Python's whole numbers."""
    if not vectors.size or np.abs(vectors).max() * scale < SMALL:
        return np.floor(vectors * scale)
    exact = [math.floor(Fraction(x) * scale) for x in vectors.ravel().tolist()]
    return np.array(exact, object).reshape(vectors.shape)


class Tree:
    """A kd-tree over the rows of points, halved at the median of the widest component. Node k's children are 2k+1 and
    2k+2; node k holds rows[first[k]:last[k]]."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
        self.rows = np.arange(n)
        self.first, self.last = np.zeros((2, 2 ** (self.depth + 1) - 1), np.int64)
        self.last[0] = n
        for k in range(2**self.depth - 1):
            a, b = self.first[k], self.last[k]
            mid = (a + b) // 2
            if b - a > 1:
                own = points[self.rows[a:b]]
                axis = int(np.argmax(own.max(0) - own.min(0)))
                self.rows[a:b] = self.rows[a:b][np.argsort(own[:, axis], kind="stable")]
            self.first[2 * k + 1 : 2 * k + 3], self.last[2 * k + 1 : 2 * k + 3] = (a, mid), (mid, b)
        self.points = points[self.rows]
        starts = np.minimum(self.first, n - 1)
        self.counts = self.last - self.first
        self.sums, self.lo, self.hi = (np.zeros((len(starts), points.shape[1]), points.dtype) for _ in range(3))
        for level in range(self.depth + 1):
            at = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            at = at[self.counts[at] > 0]
            for out, add in ((self.sums, np.add), (self.lo, np.minimum), (self.hi, np.maximum)):
                out[at] = add.reduceat(self.points, starts[at], axis=0)


def _nearest(points: np.ndarray, centroids: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest of its centroids, ties to the smaller number, and the squared distance."""
    far = (points * points).sum(1)[:, None] - 2 * points @ centroids.T + (centroids * centroids).sum(1)
    if open_ is not None:
        far = np.where(open_, far, far.max() + 1)
    at = far.argmin(1)
    return at, far[np.arange(len(points)), at]


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row of tree.points (or -1 within nodes that were assigned whole, of which owner tells),
    counts and sums of each centroid, and how many vectors had to be resolved one by one."""
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros(centroids.shape, centroids.dtype)
    owner = np.full(len(tree.points), -1)
    norms = (centroids * centroids).sum(1)
    apart = centroids[:, None] - centroids[None]  # [z, other]
    nodes, open_ = np.array([0]), np.ones((1, k), bool)
    for level in range(tree.depth + 1):
        some = tree.counts[nodes] > 0
        nodes, open_ = nodes[some], open_[some]
        if not len(nodes):
            break
        lo, hi = tree.lo[nodes], tree.hi[nodes]
        best, _ = _nearest((lo + hi), 2 * centroids, open_)  # of the box's middle, in halves
        for z in np.unique(best):
            own = np.flatnonzero(best == z)
            # the least of |p - c|^2 - |p - z|^2 over the box, for each centroid c
            diff = apart[:, z]
            least = norms - norms[z] - 2 * (hi[own] @ np.maximum(diff, 0).T + lo[own] @ np.minimum(diff, 0).T)
            open_[own] &= (least <= 0).astype(bool)
        single = open_.sum(1) == 1
        for node, z in zip(nodes[single], open_[single].argmax(1)):
            owner[tree.first[node] : tree.last[node]] = z
            counts[z] += tree.counts[node]
            sums[z] += tree.sums[node]
        nodes, open_ = nodes[~single], open_[~single]
        if level < tree.depth:
            nodes = np.stack([2 * nodes + 1, 2 * nodes + 2], 1).ravel()
            open_ = np.repeat(open_, 2, axis=0)
    resolved = 0
    if len(nodes):
        sizes = tree.counts[nodes]
        resolved = int(sizes.sum())
        at = np.repeat(tree.first[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(resolved)
        z, _ = _nearest(tree.points[at], centroids, np.repeat(open_, sizes, axis=0))
        owner[at] = z
        counts += np.bincount(z, minlength=k)
        for c in np.unique(z):
            sums[c] += tree.points[at[z == c]].sum(0)
    return owner, counts, sums, resolved


#: A tree as a row: its vectors' ids in the order of its rows, and its parts as bytes, or as text where numbers are large.
TREE = T.StructType([
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("n", T.LongType()), T.StructField("large", T.BooleanType()),
    T.StructField("points", T.BinaryType()), T.StructField("boxes", T.BinaryType()),
])


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes() if x.dtype != object else "\n".join(map(str, x.ravel().tolist())).encode()


def _unpacked(b: bytes, dims: int, large: bool) -> np.ndarray:
    x = np.array([int(v) for v in b.decode().split("\n")], object) if large else np.frombuffer(b, np.int32).astype(float)
    return x.reshape(-1, dims)


def _tree_row(ids: list, vectors: np.ndarray, scale: int) -> tuple:
    tree = Tree(whole_numbers(vectors, scale))
    boxes = np.concatenate([tree.sums, tree.lo, tree.hi])
    large = boxes.dtype == object
    sums = _packed(boxes) if large else boxes.astype(np.int64).tobytes()
    return [ids[r] for r in tree.rows], len(ids), large, _packed(tree.points), sums


def _tree_of(n: int, large: bool, points: bytes, boxes: bytes, dims: int) -> Tree:
    """The tree of a row. Its shape depends on the number of its vectors alone."""
    tree = Tree.__new__(Tree)
    tree.points = _unpacked(points, dims, large)
    tree.depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    first, last = np.zeros((2, 2 ** (tree.depth + 1) - 1), np.int64)
    last[0] = n
    for k in range(2**tree.depth - 1):
        mid = (first[k] + last[k]) // 2
        first[2 * k + 1 : 2 * k + 3], last[2 * k + 1 : 2 * k + 3] = (first[k], mid), (mid, last[k])
    tree.first, tree.last, tree.counts = first, last, last - first
    whole = _unpacked(boxes, dims, True) if large else np.frombuffer(boxes, np.int64).astype(float).reshape(-1, dims)
    tree.sums, tree.lo, tree.hi = np.split(whole, 3)
    return tree


def _centroids_for(tree: Tree, centroids: list[list[int]]) -> tuple[Tree, np.ndarray]:
    """Centroids in the kind of numbers of a tree; the tree in whole numbers if only the centroids are large."""
    exact = np.array(centroids, object)
    if tree.points.dtype != object and max(abs(v) for c in centroids for v in c) < 2 * SMALL:
        return tree, exact.astype(float)
    for part in ("points", "sums", "lo", "hi"):
        x = getattr(tree, part)
        setattr(tree, part, x if x.dtype == object else x.astype(np.int64).astype(object))
    return tree, exact


def build_trees(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """One row (TREE) for each block of at most BLOCK vectors of a partition."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, parts, held = [], [], 0
        for batch in batches:
            for a in range(0, len(batch), BLOCK):
                part = batch.iloc[a : a + BLOCK]
                ids += [None if pd.isna(i) else int(i) for i in part[id_col].tolist()]
                parts.append(np.stack(part[vector_col].tolist()).astype(float))
                held += len(part)
                while held >= BLOCK:
                    whole = np.concatenate(parts)
                    yield pd.DataFrame([_tree_row(ids[:BLOCK], whole[:BLOCK], scale)], columns=TREE.names)
                    ids, parts, held = ids[BLOCK:], [whole[BLOCK:]], held - BLOCK
        if held:
            yield pd.DataFrame([_tree_row(ids, np.concatenate(parts), scale)], columns=TREE.names)
        give_back()

    return bounded_batches(vectors).select(id_col, vector_col).mapInPandas(blocks, TREE)


def one_round(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Rows (cluster, dim, n, total): vectors assigned to each centroid, and their sums by component (dim -1: none)."""
    dims = len(centroids[0])

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tree, z = _centroids_for(_tree_of(row.n, row.large, row.points, row.boxes, dims), centroids)
                _, counts, sums, _ = filtered(tree, z)
                some = np.flatnonzero(counts)
                yield pd.DataFrame({
                    "cluster": np.repeat(some, dims), "dim": np.tile(np.arange(dims), len(some)), "n": np.repeat(counts[some], dims),
                    "total": [str(int(v)) for v in sums[some].ravel().tolist()],
                })
        give_back()

    found = trees.select("n", "large", "points", "boxes").mapInPandas(parts, "cluster int, dim int, n long, total string")
    return found.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def assigned(trees: DataFrame, centroids: list[list[int]], id_col: str) -> DataFrame:
    """Rows (id, cluster, distance) of all vectors. A squared distance beyond a long is null."""
    dims = len(centroids[0])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tree, z = _centroids_for(_tree_of(row.n, row.large, row.points, row.boxes, dims), centroids)
                owner = filtered(tree, z)[0]
                apart = tree.points - z[owner]
                distance = [int(d) if d < 2**63 else None for d in (apart * apart).sum(1).tolist()]
                yield pd.DataFrame({id_col: pd.array(row.ids, "Int64"), "cluster": owner, "distance": pd.array(distance, "Int64")})
        give_back()

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return trees.mapInPandas(rows, schema)


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3", scale: int = 1024, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row for each vector that takes part: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of dims components take part if none is null, non-finite or beyond 1e15; components become floor(scale * x). Centroids
    start as the k vectors with the smallest sha256 of "seed:id" (of equal ids the smaller vector; null ids last), or as
    all if they are fewer. Each round assigns every vector to its nearest centroid (ties: the smaller number) and replaces
    centroids by their vectors' componentwise floor(sum / count); those without vectors stay. Rows that repeat an id or a
    vector each count. No vectors, no rows. Components are exact; a squared distance, or a sum of them, that no
    long holds is null. Other columns are not read. Ids must be whole numbers.

    Work of a round: one pass over the trees, without a shuffle of vectors. The driver keeps k centroids.
    """
    scratch = Scratch(vectors.sparkSession)
    number = fresh(vectors, "_vector")
    whole = F.col(vector_col).cast("array<double>")
    sound = (F.size(whole) == dims) & ~F.exists(whole, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > BEYOND))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias(id_col), whole.alias(number))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = kept.select(number, name.alias("_name")).orderBy(F.col("_name").asc_nulls_last(), number).limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame(
            [], T.StructType([T.StructField(id_col, T.LongType()), T.StructField("cluster", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")], T.StructField("centroid_sha256", T.StringType())])
        )
    centroids = [[int(v) for v in whole_numbers(np.array([r[number]], float), scale)[0]] for r in first]
    trees = scratch.settle(build_trees(kept, id_col, number, scale))
    for _ in range(rounds):
        fresh_ones = [list(c) for c in centroids]
        for r in one_round(trees, centroids).collect():  # k x dims rows
            fresh_ones[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
        if fresh_ones == centroids:
            break
        centroids = fresh_ones
    rows = Scratch(vectors.sparkSession).settle(assigned(trees, centroids, id_col), keep=True)
    scratch.clear()
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["total"]) for r in rows.where(F.col("distance").isNotNull()).groupBy("cluster").agg(exact.alias("total")).collect()}
    fits = lambda total: F.lit(total if total < 2**63 else None).cast("long")
    hashes = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of_cluster, of_name = F.lit(None).cast("long"), F.lit(None).cast("string")
    for c, digest in enumerate(hashes):
        of_cluster = F.when(F.col("cluster") == c, fits(sums.get(c, 0))).otherwise(of_cluster)
        of_name = F.when(F.col("cluster") == c, F.lit(digest)).otherwise(of_name)
    return rows.select(
        id_col, "cluster", "distance", of_cluster.alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), of_name.alias("centroid_sha256")
    )
