"""Fitted models: logistic and ridge regression, boosted trees, importances. Rows stay where they are: every step adds up
sums over partitions, and what comes to the driver grows with the features, not with the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.ordered import missing_as_null, same_series
from tidewater.shared import Written


@dataclass(frozen=True)
class Linear:
    """mean and std standardise a feature; score is intercept + coef times that."""

    cols: list[str]
    coef: list[float]
    intercept: float
    mean: list[float]
    std: list[float]

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for c, w, m, s in zip(self.cols, self.coef, self.mean, self.std):
            out = out + w * (F.col(c) - m) / s
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.score()))


def _summed(df: DataFrame, parts: Callable[[np.ndarray], np.ndarray], cols: list[str]) -> np.ndarray:
    """The sum over partitions of parts(rows as a matrix)."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((parts(b[cols].to_numpy(float)) for b in batches if len(b)), 0.0)
        if not np.isscalar(total):
            yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    found = df.select(*cols).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(max((r["i"] for r in found), default=-1) + 1)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def _complete(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y"))
    return missing_as_null(rows, rows.columns).dropna()


def scaling(rows: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; a deviation of 0 counts as 1."""
    r = rows.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    d = len(cols)
    if r[0] is None:
        raise ValueError("no complete rows")
    std = np.array(r[d:], float)
    return np.array(r[:d], float), np.where(std == 0, 1.0, std)


def fit_logistic(df: DataFrame, cols: list[str], y: str, c: float = 0.5, tolerance: float = 1e-10, turns: int = 50) -> Linear:
    """Newton's method on c * sum of log losses + |coef|^2 / 2; the intercept is not penalised. Rows with a missing value
    are left out, features are standardised. One pass over the rows for each turn, of which there are few."""
    written = Written(df.sparkSession)
    rows = written.table(_complete(df, cols, y))
    mean, std = scaling(rows, cols)
    d = len(cols) + 1
    w, penalty = np.zeros(d), np.diag([0.0] + [1.0] * (d - 1))
    for _ in range(turns):

        def parts(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            z = np.column_stack([np.ones(len(x)), (x[:, :-1] - mean) / std])
            p = 1 / (1 + np.exp(-z @ w))
            return np.concatenate([z.T @ (p - x[:, -1]), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        total = _summed(rows, parts, [*cols, "_y"])
        step = np.linalg.solve(c * total[d:].reshape(d, d) + penalty, c * total[:d] + penalty @ w)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    written.drop()
    return Linear(cols, w[1:].tolist(), float(w[0]), mean.tolist(), std.tolist())


def fit_ridge(df: DataFrame, cols: list[str], y: str, alpha: float = 2.0) -> Linear:
    """Least squares with alpha |coef|^2, by normal equations of standardised features; the intercept is not penalised."""
    written = Written(df.sparkSession)
    rows = written.table(_complete(df, cols, y))
    mean, std = scaling(rows, cols)
    d = len(cols)

    def parts(x: np.ndarray) -> np.ndarray:
        z, t = (x[:, :-1] - mean) / std, x[:, -1]
        return np.concatenate([(z.T @ z).ravel(), z.T @ t, z.sum(0), [t.sum(), len(x)]])

    s = _summed(rows, parts, [*cols, "_y"])
    zz, zt, z1, t, n = s[: d * d].reshape(d, d), s[d * d : d * d + d], s[d * d + d : -2], s[-2], s[-1]
    coef = np.linalg.solve(zz - np.outer(z1, z1) / n + alpha * np.eye(d), zt - z1 * t / n)
    written.drop()
    return Linear(cols, coef.tolist(), float(t / n - coef @ z1 / n), mean.tolist(), std.tolist())


# --- boosted trees ---------------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Trees over binned features. A tree is a list of nodes (feature, last bin to the left, whether missing goes left) by
    heap position, None where there is no split, and values of its leaves by heap position."""

    cols: list[str]
    edges: list[list[float]]
    base: float = 0.0
    rate: float = 0.1
    trees: list[tuple[list, list]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """0 for missing, else 1 + the number of edges below the value."""
        out = np.zeros(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            have = ~np.isnan(x[:, j])
            out[have, j] = 1 + np.searchsorted(np.array(e), x[have, j], "left")
        return out

    def node(self, b: np.ndarray, nodes: list) -> np.ndarray:
        at = np.zeros(len(b), np.int64)
        for k, split in enumerate(nodes):
            if split is not None:
                j, last, missing_left = split
                own = at == k
                v = b[own, j]
                at[own] = 2 * k + np.where(np.where(v == 0, missing_left, v <= last), 1, 2)
        return at

    def raw(self, b: np.ndarray, start: int = 0) -> np.ndarray:
        out = np.full(len(b), self.base if start == 0 else 0.0)
        for nodes, values in self.trees[start:]:
            out += self.rate * np.array(values)[self.node(b, nodes)]
        return out

    def probability(self) -> Callable[..., Column]:
        """A column of probabilities: model.probability()(*columns of features)."""
        model = self

        @F.pandas_udf("double")
        def of(*x: pd.Series) -> pd.Series:
            m = np.column_stack([c.to_numpy(float) for c in x])
            return pd.Series(1 / (1 + np.exp(-model.raw(model.binned(m)))))

        return of


def best_split(h: np.ndarray, l2: float, least: int) -> tuple[float, int, int, bool] | None:
    """The best (gain, feature, last bin to the left, missing to the left) of a histogram (feature, bin, [gradient, curvature, rows]);
    bin 0 holds missing values. Both sides need `least` rows."""
    total = h[0].sum(0)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    best = None
    for j in range(len(h)):
        left = np.cumsum(h[j, 1:], 0)[:-1]
        for missing_left in (False, True):
            a = left + h[j, 0] if missing_left else left
            b = total - a
            gain = np.where((a[:, 2] >= least) & (b[:, 2] >= least), score(a) + score(b) - score(total), -np.inf)
            if len(gain) and np.isfinite(gain.max()) and gain.max() > (best[0] if best else 1e-12):
                best = (float(gain.max()), j, int(gain.argmax()) + 1, missing_left)
    return best


def fit_boosted(
    df: DataFrame, cols: list[str], y: str, id_col: str, trees: int = 60, depth: int = 3, rate: float = 0.1, l2: float = 1.0, least: int = 20, bins: int = 32, validation: float = 0.15, patience: int = 10
) -> Boosted:
    """Boosted trees for a label of 0 and 1. Features are binned between approximate quantiles; a missing value goes to the
    side of a split that it fits better. Rows of equal bins, label and part are one row with a count, of which there are at
    most as many as combinations of bins. For each level of a tree one pass over these adds up gradients by node, feature and bin. Rows
    whose hashed id falls within `validation` only judge: after `patience` trees without a better loss the trees since the
    best are dropped. Rows without a label are left out."""
    written = Written(df.sparkSession)
    numbers = [F.col(c).cast("double").alias(c) for c in cols]
    held_out = (F.pmod(F.xxhash64(id_col), F.lit(10_000)) < int(validation * 10_000)).cast("double")
    rows = missing_as_null(df.select(*numbers, F.col(y).cast("double").alias("_y"), held_out.alias("_v")), [*cols, "_y"]).where(F.col("_y").isNotNull())
    rows = written.table(rows)
    shares = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(c, F.array(*[F.lit(s) for s in shares]), 10_000) for c in cols], F.avg(F.when(F.col("_v") == 0, F.col("_y")))).first()
    mean = min(max(cuts[-1] or 0.5, 1e-6), 1 - 1e-6)
    model = Boosted(cols, [sorted(set(e or [])) for e in cuts[:-1]], float(np.log(mean / (1 - mean))), rate)
    width, losses, width_bins = len(cols), [], bins + 1

    def in_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b = model.binned(batch[cols].to_numpy(float))
            yield pd.DataFrame({**{f"b{j}": b[:, j] for j in range(width)}, "_y": batch["_y"], "_v": batch["_v"]})

    places = [f"b{j}" for j in range(width)]
    counted = rows.select(*cols, "_y", "_v").mapInPandas(in_bins, ", ".join(f"{c} short" for c in places) + ", _y double, _v double")
    counted = written.table(counted.groupBy(*places, "_y", "_v").agg(F.count("*").alias("_n")))

    def pass_over(nodes: list, level: int) -> np.ndarray:
        many = 2**level

        def parts(x: np.ndarray) -> np.ndarray:
            b, many_rows = x[:, :width].astype(np.int16), x[:, width + 2]
            raw, t, judge = model.raw(b), x[:, width], x[:, width + 1] == 1
            p = 1 / (1 + np.exp(-raw))
            at = model.node(b, nodes) - (many - 1)
            use = ~judge & (at >= 0) & (at < many)
            out = np.zeros((many, width, width_bins, 3))
            for j in range(width):
                cell = at[use] * width_bins + b[use, j]
                for k, v in enumerate((((p - t) * many_rows)[use], (p * (1 - p) * many_rows)[use], many_rows[use])):
                    out[:, j, :, k] = np.bincount(cell, v, many * width_bins).reshape(many, width_bins)
            loss = np.logaddexp(0, np.where(t == 1, -raw, raw)) * many_rows
            return np.concatenate([out.ravel(), [loss[judge].sum(), many_rows[judge].sum()]])

        return _summed(counted, parts, [*places, "_y", "_v", "_n"])

    for _ in range(trees):
        nodes: list = [None] * (2**depth - 1)
        values = [0.0] * (2 ** (depth + 1) - 1)
        for level in range(depth):
            found = pass_over(nodes, level)
            if level == 0 and found[-1]:
                losses.append(found[-2] / found[-1])
            h = found[:-2].reshape(2**level, width, width_bins, 3)
            for k in range(2**level):
                at = 2**level - 1 + k
                split = best_split(h[k], l2, least)
                total = h[k, 0].sum(0)
                values[at] = float(-total[0] / (total[1] + l2))
                if split:
                    _, j, last, missing_left = split
                    nodes[at] = (j, last, missing_left)
                    left = h[k, j, 1 : last + 1].sum(0) + (h[k, j, 0] if missing_left else 0)
                    for child, s in ((2 * at + 1, left), (2 * at + 2, total - left)):
                        values[child] = float(-s[0] / (s[1] + l2))
        if nodes[0] is None:
            break
        model.trees.append((nodes, values))
        if losses and len(losses) - 1 - int(np.argmin(losses)) >= patience:
            model.trees = model.trees[: int(np.argmin(losses))]
            break
    written.drop()
    return model


def auc_by(df: DataFrame, by: list[str], score: str, label: str, buckets: int = 64) -> DataFrame:
    """by, n, n_distinct, auc: the probability that a row of label 1 scores above one of label 0, ties counting half. Values
    are counted first and summed up in two steps, so no task sees all rows of a group."""
    df = missing_as_null(df, [score, label]).where(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = df.groupBy(*by, F.col(score).cast("double").alias("_x")).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    edges = values.groupBy(*by).agg(F.percentile_approx("_x", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), 1000).alias("_e"))
    values = same_series(values, edges, by).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col("_x")))).drop("_e")
    sums = values.groupBy(*by, "_b").agg(F.sum(F.col("_n") - F.col("_p")).alias("_s"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*by, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = same_series(values.withColumn("_in", F.coalesce(F.sum(F.col("_n") - F.col("_p")).over(inner), F.lit(0))), sums, [*by, "_b"])
    wins = F.sum(F.col("_p") * (F.col("_start") + F.col("_in") + (F.col("_n") - F.col("_p")) / 2))
    pos, neg = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return placed.groupBy(*by).agg(F.sum("_n").alias("n"), F.count("*").alias("n_distinct"), (wins / F.when((pos > 0) & (neg > 0), pos * neg)).alias("auc"))


def permutation_importance(df: DataFrame, score: Callable[..., Column], cols: list[str], y: str, id_col: str, repeats: int = 3) -> DataFrame:
    """feature, importance: the mean loss of AUC when a feature takes the values of other rows. Rows stand in the order of
    a hashed id and every row borrows from the one some places on, so one join serves all features of a repeat."""
    written = Written(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("_y")).where(F.col(y).isNotNull())
    rows = rows.withColumn("_h", F.xxhash64("_id")).withColumn("_cell", F.pmod("_h", F.lit(256)))
    inner = Window.partitionBy("_cell").orderBy("_h", "_id")
    counts = rows.groupBy("_cell").agg(F.count("*").alias("_n"))
    starts = counts.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(Window.partitionBy()).alias("_of"))
    placed = written.table(rows.withColumn("_r", F.row_number().over(inner)).join(F.broadcast(starts), "_cell").select((F.col("_s") + F.col("_r") - 1).alias("_rn"), "_of", *cols, "_y"))
    parts = [placed.select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), score(*[F.col(c) for c in cols]).alias("_score"), "_y")]
    for k in range(1, repeats + 1):
        donors = placed.select(F.pmod(F.col("_rn") + F.floor(F.col("_of") * F.lit(k / (repeats + 1))).cast("long"), F.col("_of")).alias("_rn"), *[F.col(c).alias(f"_d_{c}") for c in cols])
        both = placed.join(donors, "_rn")
        variants = [F.struct(F.lit(c).alias("feature"), score(*[F.col(f"_d_{x}" if x == c else x) for x in cols]).alias("s")) for c in cols]
        parts.append(both.select(F.explode(F.array(*variants)).alias("v"), "_y").select("v.feature", F.lit(k).alias("repeat"), F.col("v.s").alias("_score"), "_y"))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    found = Written(df.sparkSession).table(auc_by(scored, ["feature", "repeat"], "_score", "_y"), keep=True)
    written.drop()
    whole = found.where(F.col("feature") == "").first()["auc"]
    return found.where(F.col("feature") != "").groupBy("feature").agg((F.lit(whole) - F.avg("auc")).alias("importance"))
