"""Toxicity by weak supervision.

1. Lexicons are mined from labelled rows outside the held-out fold: words and word beginnings that stand in far more
   toxic than other documents. They are dealt to several voters by strength. Further voters look for patterns of the raw text:
   an entry near a word of address, shouting, masked spelling, repeated marks, and how many entries there are.
2. A generative label model sees only votes, of labelled and unlabelled documents alike. Expectation maximisation
   estimates how each voter votes given the hidden label. Voters that stay correlated given the label share their
   weight, so that a group of them counts once. Of the labels it knows only how many are toxic.
3. A linear classifier on word-level features is trained on the model's posterior labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Remembered
from .common import bounded_batches, give_back, words, words_of
from .quality import fold, labelled, unlabelled

#: Labelled rows, and as many others, that voters and models are fitted on at most; lexicon entries at
#: most, and the share of toxic documents that an entry needs; voters of entries.
TRAINING_ROWS, ENTRIES, COMMON, GROUPS = 20_000, 2000, 0.02, 8
PREFIXES = range(4, 9)
#: Words of address in the languages of the corpus.
ADDRESS = frozenset("you your yours yourself ya u tu te toi ton ta tes vous votre du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
_SHOUT = re.compile(r"(?:\b[A-Z]{3,}\b\W+){2,}[A-Z]{3,}\b")
_MASKED = re.compile(r"[A-Za-z][*@#$%]+[A-Za-z]")
_MARKS = re.compile(r"[!?]{3,}")
#: Columns of measure after the entries' counts and shares: entries near a word of address, and the other patterns.
PATTERNS = ("address", "shout", "masked", "marks", "exclamations", "symbols")
WIDTH = 2 * (GROUPS + 1) + len(PATTERNS)


@dataclass
class Model:
    lexicon: dict[str, int]  # entry: its voter, from 1
    weights: np.ndarray
    bias: float


def _entries(rows: DataFrame, n_toxic: int, n_clean: int, entries: int, common: float) -> list[tuple[str, float]]:
    """Entries (words, and beginnings marked by a hyphen) with their log odds ratio, strongest first: those
    that at least the share `common` of toxic documents have, `entries` at most."""
    beginnings = F.flatten(F.array(*[F.transform(_longer(n), _begin(n)) for n in PREFIXES]))
    terms = rows.select("y", F.array_distinct(F.concat("w", beginnings)).alias("t")).select("y", F.explode("t").alias("t"))
    counts = terms.groupBy("t").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("b") + 0.5) / (n_clean + 1.0))
    # some of many terms stand in toxic documents only by chance: the likelihood ratio has to outweigh their number
    share = n_toxic / (n_toxic + n_clean)
    log_of = lambda c, e: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (e * (F.col("a") + F.col("b"))))).otherwise(0.0)
    strong = counts.where(F.col("a") >= max(3, math.ceil(common * n_toxic))).withColumn("odds", odds).where((F.col("odds") > 2.5) & (F.col("a") >= 5 * F.col("b"))).withColumn("ratio", 2 * (log_of("a", share) + log_of("b", 1 - share)))
    least = 2 * np.log(10.0 * max(counts.count(), 1))
    return [(r["t"], r["odds"]) for r in strong.where(F.col("ratio") >= float(least)).orderBy(F.desc("ratio"), "t").limit(entries).collect()]


def _longer(n: int) -> Column:
    return F.filter("w", lambda x: F.length(x) > n)


def _begin(n: int):
    return lambda x: F.concat(F.substring(x, 1, n), F.lit("-"))


def lookup(lexicon: dict[str, int]) -> Remembered:
    """The voter of a word (0: none): that of the word itself, or of its longest beginning in the lexicon."""

    def of(word: str) -> int:
        if word in lexicon:
            return lexicon[word]
        for n in reversed(PREFIXES):
            if len(word) > n and (v := lexicon.get(word[:n] + "-")):
                return v
        return 0

    return Remembered(of)


def measure(texts: list[str], known: Remembered) -> np.ndarray:
    """For each whole text: logarithmic counts and shares of words of each voter, and of patterns."""
    out = np.zeros((len(texts), WIDTH))
    for i, text in enumerate(texts):
        ws = words_of(text)
        of = np.fromiter(map(known.__getitem__, ws), dtype=np.int64, count=len(ws))
        c = np.bincount(of, minlength=GROUPS + 1)[: GROUPS + 1]
        c[0] = c[1:].sum()
        n = max(len(ws), 1)
        out[i, : GROUPS + 1] = np.log1p(c)
        out[i, GROUPS + 1 : 2 * GROUPS + 2] = np.minimum(c / n * 20, 1)
        near = sum(any(w in ADDRESS for w in ws[max(at - 2, 0) : at + 3]) for at in np.flatnonzero(of))
        shout, masked, marks = (sum(1 for _ in found.finditer(text)) for found in (_SHOUT, _MASKED, _MARKS))
        out[i, 2 * GROUPS + 2 :] = np.log1p([near, shout, masked, marks, 0, 0])
        out[i, -2], out[i, -1] = np.log1p(text.count("!")) / np.log1p(n + 1), sum(map(text.count, "#$%&*")) / max(len(text), 1)
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """Of voters: 1 toxic, 0 not, -1 abstains. Each lexicon voter speaks when it sees an entry; two look at all entries:
    two or more of them, and one in at most twenty words. Four pattern voters speak when they see their pattern."""
    v = np.full((len(x), GROUPS + 6), -1)
    v[:, :GROUPS][x[:, 1 : GROUPS + 1] > 0] = 1
    v[:, GROUPS] = x[:, 0] >= np.log1p(2)
    v[:, GROUPS + 1] = x[:, GROUPS + 1] >= 1
    v[:, GROUPS + 2 :][x[:, 2 * GROUPS + 2 : 2 * GROUPS + 6] > 0] = 1
    return v


def label_model(v: np.ndarray, prior: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of label 1 of each row of votes, and P(vote | label) of each voter (label, voter, vote:
    abstains, 0, 1). prior: the share of label 1. Only votes are seen.

    After 20 rounds the weight of a voter in the posterior is divided by one plus the sum of its correlations with the
    others given the label."""
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    # to begin with, rows with more votes for label 1 than for label 0 have it
    said, weight = (v == 1).sum(1) - (v == 0).sum(1), np.ones(v.shape[1])
    p = np.where(said > 0, 0.9, 0.1 * prior)
    hot = np.stack([(v == a) for a in (-1, 0, 1)], 2).astype(float)  # rows, voters, votes
    for turn in range(rounds):
        tables = []
        for q in (1 - p, p):
            t = np.einsum("n,nmv->mv", q, hot) + 0.1
            tables.append(t / t.sum(1, keepdims=True))
        if turn == 20:  # before, labels are vague, and then all voters seem correlated
            rest = hot[:, :, 2] - np.stack([1 - p, p], 1) @ np.stack([t[:, 2] for t in tables])
            cov = rest.T @ rest
            s = np.sqrt(np.maximum(np.diag(cov), 1.0))  # of counts: what hardly varies is not correlated
            corr = np.abs(cov / s[:, None] / s[None, :])
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > 0.2, corr, 0).sum(1))
        says = np.einsum("nmv,mv,m->n", hot, np.log(tables[1]) - np.log(tables[0]), weight)
        new = 1 / (1 + np.exp(-np.clip(says + np.log(prior / (1 - prior)), -30, 30)))
        moved, p = np.abs(new - p).max() if len(p) else 0.0, new
        if turn >= 20 and moved < 1e-5:
            break
    return p, np.stack(tables)


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias fitted to probabilities p by Newton steps; the bias is not shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    shrink = np.full(a.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (s - p) + shrink * w
        h = (a * np.maximum(s * (1 - s), 1e-6)[:, None]).T @ a + np.diag(shrink)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1, rows: int = TRAINING_ROWS, entries: int = ENTRIES, common: float = COMMON, id_col: str = "doc_id", text_col: str = "text") -> Model:
    bounded_batches(docs)
    sample = labelled(docs, labels, label, folds, held_out, rows, id_col, text_col).select("text", "y", words(F.col("text")).alias("w")).cache()
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    found = _entries(sample, n[1], n[0], entries, common) if n.get(1) and n.get(0) else []
    lexicon = {t: 1 + i * GROUPS // len(found) for i, (t, _) in enumerate(found)}  # by strength
    share = (n.get(1, 0) + 0.5) / (n.get(0, 0) + n.get(1, 0) + 1.0)
    if not n.get(1) or not n.get(0):
        sample.unpersist()
        return Model(lexicon, np.zeros(WIDTH), float(np.log(share / (1 - share))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lookup(lexicon)
        for b in batches:
            yield pd.DataFrame({"x": list(measure(b["text"].tolist(), known))})

    both = sample.select("text").unionByName(unlabelled(docs, folds, held_out, rows, id_col, text_col))
    x = np.stack(both.mapInPandas(run, "x array<double>").toPandas()["x"].to_numpy())
    sample.unpersist()
    x = x[np.lexsort(x.T)]  # sums do not depend on the order of arrival
    weights, bias = logistic(x, label_model(votes(x), share)[0])
    return Model(lexicon, weights, bias)


def toxicity_score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        known = lookup(m.lexicon)
        for batch in texts:
            z = measure(batch.tolist(), known) @ m.weights + m.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        known.clear()
        give_back()

    return score(F.coalesce(F.col(text_col), F.lit("")))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAINING_ROWS, entries: int = ENTRIES, common: float = COMMON) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted (1 if score >= threshold).

    Labels are learned only outside the held-out fold (crc32 of the id as text, modulo folds), from `rows` labelled
    rows at most, of which at most `entries` lexicon entries are mined, each in the share `common` of toxic rows at least; the label model also sees the votes of about
    `rows` other rows outside that fold, without labels. Rows that repeat an id and its text are seen once in training.
    Scores use the whole text, of any length, and nothing else; null and empty texts get the score of a text without
    any entry. Null labels are left out. Without both labels every score is the same. Rows that repeat an id stay;
    equal texts get equal scores. An empty table gives an empty table. Other columns are not read.
    """
    model = fit_toxicity(docs, labels, folds=folds, held_out=held_out, rows=rows, entries=entries, common=common, id_col=id_col, text_col=text_col)
    out = bounded_batches(docs).select(F.col(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"), toxicity_score(docs, model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs of a lower score, with all their columns; nulls, ties, repeated rows and empty tables are as
    classify_toxicity has them."""
    model = fit_toxicity(docs, labels, **options)
    return bounded_batches(docs).where(toxicity_score(docs, model, options.get("text_col", "text")) < threshold)
