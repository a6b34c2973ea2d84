"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is binned; the model is a lookup table for each feature and for a few pairs of features. The
tables are learned by cyclic boosting: one feature at a time, a shallow tree over its bins is fitted to the gradient
and added at a small rate. The score is the logistic function of the sum of the tables' entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "punctuation", "exclaim", "bar", "symbols", "digits", "non_ascii",
    "space", "distinct_words", "top_word", "repeats", "distinct_pairs", "line_length", "repeated_lines", "long_words", "sentences",
)
#: Labelled rows that the model is fitted on at most, and bins of a feature at most, alone and in a pair.
TRAINING_ROWS, BINS, PAIR_BINS = 20_000, 32, 8
ROUNDS, RATE, PAIRS = 200, 0.1, 6
_LONG = re.compile(r"\S{25,}")


def features(text: str | None) -> np.ndarray:
    """Of a whole text; null is empty."""
    text = text or ""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    c = np.bincount(raw, minlength=256)
    n, words, lines = max(len(raw), 1), text.split(), text.split("\n")
    m, filled = max(len(words), 1), [x for x in lines if x]
    most = max(Counter(words).values(), default=0)
    letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    pairs = len(set(zip(words, islice(words, 1, None))))
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / m, c[65:91].sum() / max(letters, 1),
        (c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) / n, c[33] / n, c[124] / n,
        (c[35] + c[36] + c[37] + c[38] + c[42]) / n, c[48:58].sum() / n, c[128:].sum() / n, (c[32] + c[10]) / n,
        len(set(words)) / m, most / m, sum(map(eq, words, islice(words, 1, None))) / m, pairs / m,
        len(text) / len(lines), 1 - len(set(filled)) / max(len(filled), 1), len(_LONG.findall(text)) / m, (c[46] + c[63]) / m,
    ])


def _tree(gradient: np.ndarray, weight: np.ndarray, splits: int = 3) -> np.ndarray:
    """Values for ordered bins of the best tree of a few splits: Newton steps of its leaves."""
    g, h = np.concatenate([[0], gradient.cumsum()]), np.concatenate([[0], weight.cumsum()])
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    cuts = [0, len(gradient)]
    for _ in range(splits):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                s = np.arange(a + 1, b)
                gain = score(a, s) + score(s, b) - score(a, b)
                if (top := float(gain.max())) > best[0]:
                    best = (top, int(s[gain.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


class AdditiveModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS):
        """x: rows of features; y: 0 or 1. Without rows, or with rows of one label, the model is a constant."""
        f = x.shape[1]
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(f)]
        self.coarse = [e[:: max(1, math.ceil(len(e) / (PAIR_BINS - 1)))] for e in self.edges]
        mean = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
        self.base = float(np.log(mean / (1 - mean)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if not len(y) or y.min() == y.max():
            return
        bins = self._bins(x, self.edges)
        out = np.full(len(y), self.base)
        for _ in range(rounds):
            for j in range(f):
                if len(self.edges[j]):
                    out += self._step(out, y, bins[j], self.tables[j], rate)
        # pairs in which residuals have most left to explain
        small = self._bins(x, self.coarse)
        p = 1 / (1 + np.exp(-out))
        gains = []
        for i in range(f):
            for j in range(i + 1, f):
                shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
                cell = small[i] * shape[1] + small[j]
                g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
                gains.append((-(g**2 / (h + 1)).sum(), i, j))
        for _, i, j in sorted(gains)[:pairs]:
            self.pairs.append((i, j))
            self.pair_tables.append(np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)))
        for _ in range(rounds // 4):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                p = 1 / (1 + np.exp(-out))
                cell = small[i] * table.shape[1] + small[j]
                g, h = np.bincount(cell, y - p, table.size).reshape(table.shape), np.bincount(cell, p * (1 - p), table.size).reshape(table.shape)
                # the first split by one feature, then a tree of the other in each half
                first = _tree(g.sum(1), h.sum(1), 1)
                step = np.zeros(table.shape)
                for value in np.unique(first):
                    rows = first == value
                    step[rows] = _tree(g[rows].sum(0), h[rows].sum(0), 1)
                table += rate * step
                out += rate * step.ravel()[cell]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    @staticmethod
    def _step(out, y, bins, table, rate) -> np.ndarray:
        p = 1 / (1 + np.exp(-out))
        step = rate * _tree(np.bincount(bins, y - p, len(table)), np.bincount(bins, p * (1 - p), len(table)))
        table += step
        return step[bins]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for table, bins in zip(self.tables, self._bins(x, self.edges)):
            out += table[bins]
        if self.pairs:
            small = self._bins(x, self.coarse)
            for (i, j), table in zip(self.pairs, self.pair_tables):
                out += table[small[i], small[j]]
        return 1 / (1 + np.exp(-out))


def fold(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text, y): labelled rows outside the held-out fold, `rows` of them at most, chosen by a hash of the id. Of rows that
    repeat an id one counts, chosen by a hash of the text, so an id on many rows takes no more than its place."""
    some = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("_id"), folds) != held_out)).distinct()
    chosen = some.orderBy(F.xxhash64(F.col("_id").cast("string"), F.lit(label)), "_id", "y").limit(rows)
    # at most `rows` ids: fit to be broadcast
    found = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    return found.groupBy("_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y")


def unlabelled(docs: DataFrame, folds: int, held_out: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(text): about `rows` rows outside the held-out fold, chosen by a hash of id and text; equal rows count once."""
    outside = docs.where(F.col(id_col).isNotNull() & (fold(F.col(id_col), folds) != held_out))
    slots = max(1, math.ceil(outside.count() / max(rows, 1)))
    some = outside.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("_h"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.pmod("_h", F.lit(slots)) == 0)
    return some.dropDuplicates(["_h"]).select("text")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """The model of a bounded sample of labelled rows; Spark computes their features, the driver sees only those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t) for t in b["text"]], "y": b["y"]})

    found = bounded_batches(labelled(docs, labels, label, folds, held_out, rows, id_col, text_col)).mapInPandas(run, "x array<double>, y int").toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else []  # sums do not depend on the order of arrival
    return AdditiveModel(x[order], found["y"].to_numpy(dtype=float)[order])


def quality_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(np.stack([features(t) for t in batch]))) if len(batch) else pd.Series([], dtype=float)
        give_back()

    return score(F.coalesce(F.col(text_col), F.lit("")))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted (1 if score >= threshold).

    Labels are learned only outside the held-out fold (crc32 of the id as text, modulo folds), from `rows` labelled
    rows at most. Scores use the whole text and nothing else; null and empty texts get the score of an empty text.
    Null labels are left out; of contradicting labels each counts. Without labels every score is 0.5, with labels of
    one kind only it is near that label. Rows that repeat an id stay, and equal texts get equal scores. Texts of any
    length are read whole. An empty table gives an empty table. Other columns are not read.
    """
    model = fit_quality(docs, labels, folds=folds, held_out=held_out, rows=rows, id_col=id_col, text_col=text_col)
    out = bounded_batches(docs).select(F.col(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"), quality_score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of docs of that score at least, with all their columns; nulls, ties, repeated rows and empty tables are
    as classify_quality has them."""
    model = fit_quality(docs, labels, **options)
    return bounded_batches(docs).where(quality_score(docs, model, options.get("text_col", "text")) >= threshold)
