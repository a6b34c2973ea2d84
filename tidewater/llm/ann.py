"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Nearness is the inner product. One more component makes all vectors equally long, and then the largest inner product
is the smallest distance. A Gaussian projection to a few dimensions turns a squared distance D2 into D2 times a
chi-square variable of as many degrees of freedom. A query takes points in the order of their own projected distance
and computes their true inner products, until the next projected distance is so large that the point is a better
neighbour with a chance below 1 - confidence (the chi-square stopping test).

On Spark the top of the kd-tree is fitted on a bounded sample: it deals all vectors into cells, and large cells into
blocks. A query first visits the few blocks whose cells are nearest to it in the projection; the bound found there and
the same test tell which other blocks it has to visit. Queries are sent to blocks, in groups of bounded size: a block
meets a group of queries in a keyed cogroup, and is copied only if more queries come to it than a group holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64

#: Rows that the top of the tree is fitted on, rows of a block, cells at most, blocks that a query visits first, queries
#: of a group, queries that are searched together, and points that a query verifies before it tests again.
SAMPLE, BLOCK, CELLS, FIRST, GROUP, TOGETHER, STEP = 20_000, 2048, 1024, 4, 4096, 128, 256
SEED = 20


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of an even number m of degrees of freedom <= x) = p, by bisection of the closed form."""
    lo, hi = 0.0, 100.0 + 10 * m
    for _ in range(100):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < p else (lo, x)
    return hi


class Split:
    """Median splits of projected points; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.dim, self.at, self.child, self.leaves = [], [], [], 0
        self._grow(points, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        """The node's number; a leaf's is -1 - its number."""
        spread = points.max(0) - points.min(0) if len(points) else np.zeros(1)
        if leaves < 2 or len(points) < 2 or spread.max() == 0:
            self.leaves += 1
            return -self.leaves
        d = int(spread.argmax())
        cut = float(np.median(points[:, d]))
        if not (points[:, d] > cut).any():
            cut = float(points[points[:, d] < cut, d].max())
        node = len(self.dim)
        self.dim.append(d), self.at.append(cut), self.child.append([0, 0])
        high = points[:, d] > cut
        self.child[node] = [self._grow(points[~high], leaves // 2), self._grow(points[high], leaves - leaves // 2)]
        return node

    def cell(self, points: np.ndarray) -> np.ndarray:
        if not self.dim:
            return np.zeros(len(points), dtype=np.int32)
        dim, at, child = np.array(self.dim), np.array(self.at), np.array(self.child)
        node = np.zeros(len(points), dtype=np.int64)
        while (inner := node >= 0).any():
            n = node[inner]
            node[inner] = child[n, (points[inner, dim[n]] > at[n]).astype(int)]
        return (-1 - node).astype(np.int32)


def _box_distance(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of each of the points q from each box."""
    out = np.zeros((len(q), len(lo)))
    for d in range(q.shape[1]):
        out += np.maximum(np.maximum(lo[None, :, d] - q[:, None, d], q[:, None, d] - hi[None, :, d]), 0) ** 2
    return out


def search_block(ids, x, p, q_ids, q, q_p, bound, top2, k, limit):
    """The k best of a block for each query, if not beyond its bound (a squared distance): query row, block row, score.

    Points come in the order of projected distance, STEP at a time; a query stops when the next one fails the test."""
    found, own = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], (p**2).sum(1)
    for a in range(0, len(q), TOGETHER):
        qa, qp, same = q[a : a + TOGETHER], q_p[a : a + TOGETHER], q_ids[a : a + TOGETHER]
        base, radius = top2 + (qa**2).sum(1), bound[a : a + TOGETHER].copy()
        far = np.maximum((qp**2).sum(1)[:, None] + own[None] - 2 * qp @ p.T, 0)
        best, best_row = np.full((len(qa), k), -np.inf), np.full((len(qa), k), -1)
        act = np.arange(len(qa))
        first = 0
        while len(act) and first < len(x):
            n = min(STEP, len(x) - first)
            # the next n points of each query: a partial sort of what passes the test, in falling remainders
            rows = np.argpartition(far[act], n - 1, axis=1)[:, :n] if n < len(x) else np.broadcast_to(np.arange(n), (len(act), n))
            near = np.take_along_axis(far[act], rows, 1)
            passes = (near <= limit * np.maximum(radius[act], 1e-12)[:, None]) & (ids[rows] != same[act][:, None])
            i, j = np.nonzero(passes)
            score = np.full(rows.shape, -np.inf)
            score[i, j] = np.einsum("nd,nd->n", x[rows[i, j]], qa[act[i]])
            far[act[:, None], rows] = np.inf  # seen
            score, rows = np.concatenate([best[act], score], 1), np.concatenate([best_row[act], rows], 1)
            order = np.lexsort((ids[rows], -score), axis=1)[:, :k]
            best[act], best_row[act] = np.take_along_axis(score, order, 1), np.take_along_axis(rows, order, 1)
            radius[act] = np.minimum(radius[act], np.maximum(base[act] - 2 * best[act, -1], 0))
            first += n
            act = act[near.max(1) <= limit * np.maximum(radius[act], 1e-12)]
        good = np.isfinite(best) & (base[:, None] - 2 * best <= bound[a : a + TOGETHER, None] + 1e-9)
        i, j = np.nonzero(good)
        found.append((a + i, best_row[i, j], best[i, j]))
    return [np.concatenate(c) for c in zip(*found)]


def usable(vec: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vec.isNotNull() & finite & F.exists(vec, lambda v: v != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, dims: int = 24, confidence: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, the k nearest found of all others.

    Ties go to the smaller id; rows that repeat an id, or an id and its vector, are points of their own, but never
    neighbours of a query of that id. A query id of several vectors gets the rows nearest to any of them. Null, zero and
    non-finite vectors take no part, nor do null ids. A vector shorter than the longest counts as followed by zeros.
    Vectors of any length are used whole. A query gets fewer than k rows only if fewer others exist. An empty table gives
    an empty table. Other columns are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    out = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
    size = rows.agg(F.max(F.size("x")).alias("d"), F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("top2")).first()
    if not size["n"]:
        return spark.createDataFrame([], out)
    d, n, top2 = size["d"], size["n"], size["top2"]
    rows = rows.withColumn("x", F.when(F.size("x") < d, F.concat("x", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("x")))).otherwise(F.col("x")))
    matrix = np.random.default_rng(SEED).standard_normal((d + 1, dims))
    # all distances share the added component, so its part must not be long or short by chance
    matrix[-1] *= math.sqrt(dims / (matrix[-1] ** 2).sum())
    limit = chi_square_quantile(confidence, dims)

    def project(x: np.ndarray) -> np.ndarray:
        return x @ matrix[:-1] + np.sqrt(np.maximum(top2 - (x**2).sum(1), 0))[:, None] * matrix[-1]

    def stack(c: pd.Series) -> np.ndarray:
        return np.stack(c.to_numpy()) if len(c) else np.zeros((0, d))

    # a key for each row, as an id and its vector may repeat
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SAMPLE))) == 0).select("x").toPandas()
    cells = min(CELLS, max(1, math.ceil(n / (BLOCK // 2))))
    top = Split(project(stack(sample["x"])), cells) if len(sample) else Split(np.zeros((0, dims)), 1)

    def dealing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = project(stack(b["x"]))
            yield b.assign(cell=top.cell(p), p=list(p))

    dealt = scratch.settle(rows.mapInPandas(dealing, "id long, x array<double>, row long, cell int, p array<double>"))
    edges = dealt.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(dims)]).toPandas().sort_values("cell")  # a row for each of at most CELLS cells
    lo, hi = (edges[[f"{f}{j}" for j in range(dims)]].to_numpy(dtype=float) for f in ("min", "max"))
    numbers, held = edges["cell"].to_numpy(), np.ceil(edges["n"].to_numpy(dtype=float) / BLOCK).astype(int)
    parts = F.create_map(*[F.lit(int(v)) for pair in zip(numbers, held) for v in pair])
    blocks = dealt.select("id", "x", "row", "cell", F.pmod(F.xxhash64("row"), parts[F.col("cell")]).cast("int").alias("part"))
    # equal rows ask once
    asking = dealt.where(F.pmod("id", F.lit(every)) == 0).groupBy("id", "x").agg(F.min("row").alias("ask"))

    # --- queries to blocks: the nearest few, then all that the bound and the test leave
    blocks_of = [(c, part) for c, h in zip(numbers, held) for part in range(h)]
    cell_at, part_at, edge_at = np.array([b[0] for b in blocks_of]), np.array([b[1] for b in blocks_of]), np.repeat(np.arange(len(numbers)), held)
    routed = "ask long, id long, q array<double>, bound double, cell int, part int, chunk int"

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                b = batch.iloc[a : a + 256]
                q, bound, ask = stack(b["x"]), b["bound"].to_numpy(dtype=float), b["ask"].to_numpy()
                far = _box_distance(q @ matrix[:-1], lo, hi)[:, edge_at]
                # blocks of one cell are equally near; each query starts with another
                turn = (part_at[None] - ask[:, None] % np.repeat(held, held)[None]) % np.repeat(held, held)[None]
                rank = np.lexsort((turn, far), axis=1).argsort(1)
                goes = np.where(np.isnan(bound)[:, None], rank < FIRST, (rank >= FIRST) & (far <= limit * np.maximum(np.nan_to_num(bound, nan=np.inf), 1e-12)[:, None]))
                i, j = np.nonzero(goes)
                bounds = np.where(np.isnan(bound), np.inf, bound)
                yield pd.DataFrame({"ask": ask[i], "id": b["id"].to_numpy()[i], "q": pd.Series([q[v] for v in i], dtype=object), "bound": bounds[i], "cell": cell_at[j], "part": part_at[j], "chunk": (mix64(ask.astype(np.uint64)) % np.uint64(chunks)).astype(int)[i]})

    def visit(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame(columns=["ask", "query_id", "vec_id", "key", "score"], dtype=object)
        x, q, q_ids, ids = stack(block["x"]), stack(asked["q"]), asked["id"].to_numpy(), block["id"].to_numpy()
        i, at, score = search_block(ids, x, project(x), q_ids, q, q @ matrix[:-1], asked["bound"].to_numpy(), top2, k, limit)
        return pd.DataFrame({"ask": asked["ask"].to_numpy()[i], "query_id": q_ids[i], "vec_id": ids[at], "key": block["row"].to_numpy()[at], "score": score})

    def search(to: DataFrame) -> DataFrame:
        key = ["cell", "part", "chunk"]
        data = blocks.join(to.select(*key).distinct(), ["cell", "part"]).select(*[F.col(c).alias(f"at_{c}") for c in key], "id", "row", "x")
        return scratch.settle(to.groupBy(*key).cogroup(data.groupBy(*[f"at_{c}" for c in key])).applyInPandas(visit, "ask long, query_id long, vec_id long, key long, score double"), keep=True)

    asking = scratch.settle(asking)
    chunks = max(1, math.ceil(asking.count() / GROUP))
    near = search(scratch.settle(asking.withColumn("bound", F.lit(float("nan"))).mapInPandas(route, routed)))
    nearest_first = [F.desc("score"), F.asc("vec_id")]
    kth = near.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(*nearest_first))).where(F.col("r") == k).select("ask", "score")  # at most FIRST * k rows of each query
    longest = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    bound = F.greatest(F.lit(0.0), F.lit(top2) + longest - 2 * F.col("score"))
    rest = asking.join(kth, "ask", "left").select("id", "x", "ask", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    away = search(scratch.settle(rest.mapInPandas(route, routed)))
    # a row that several vectors of one query id found counts once
    both = near.unionByName(away).groupBy("query_id", "key", "vec_id").agg(F.max("score").alias("score"))
    some = F.row_number().over(Window.partitionBy("query_id", F.pmod(F.xxhash64("key"), F.lit(16))).orderBy(*nearest_first))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))
    scratch.clear()
    return both.withColumn("r", some).where(F.col("r") <= k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
