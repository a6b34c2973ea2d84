"""Language identification of code-switched text by a linear-chain conditional random field.

Every word has a label; a word of more than PIECE characters, as in text without spaces, is cut into consecutive tokens
of that length, each with a label, which share two characters so that no n-gram is lost. A word's features are affixes of one to three characters, character n-grams and the word itself (the
lexicon), hashed; between neighbouring words there are learned transitions. Forward-backward gives each word's label
probabilities. A document's language is the label with the largest sum of them.

Training text is a bounded sample of labelled documents, spliced from pieces of different documents, so that the
transitions learn how seldom languages change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, words_of
from .quality import fold

BITS = 18
#: Labelled documents of each language, and words of each, that the model is trained on at most.
TRAINING_DOCS, TRAINING_WORDS, EPOCHS = 300, 50_000, 4
#: Characters of a token at most.
PIECE = 40
#: Words whose scores a worker remembers; words that are labelled together; words of a long text.
REMEMBER, TOGETHER, LONG = 400_000, 600_000, 1500


def tokens_of(text: str | None) -> list[str]:
    """The words of a text, long ones in pieces that overlap by two characters and cover the whole word."""
    return [w[a : a + PIECE] for w in words_of(text) for a in range(0, max(len(w) - 2, 1), PIECE - 2)]


def word_features(word: str) -> list[int]:
    w = f"^{word}$"
    parts = [f"W{word}"]
    parts += [f"P{word[:n]}" for n in (1, 2, 3)] + [f"S{word[-n:]}" for n in (1, 2, 3)]
    parts += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    return [xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts]


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # feature, label
    transitions: np.ndarray  # from, to

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), dtype=np.float32)
        lists = [word_features(w) for w in words]
        flat = np.concatenate([np.array(f) for f in lists])
        return np.add.reduceat(self.weights[flat], np.cumsum([0, *map(len, lists)])[:-1])


def _passes(score: np.ndarray, start: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions, forward and backward messages of every word, each up to a factor of the word."""
    e = np.exp(score - score.max(1, keepdims=True)).astype(np.float64)
    move = np.exp(transitions)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), side="right")
    for t, m in enumerate(alive):
        at = start[:m] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        b = (e[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    return e, alpha, beta


def forward_backward(score: np.ndarray, start: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word. score: words of all texts, one after the other; texts in order of falling
    length, so that those that have a t-th word come first."""
    _, alpha, beta = _passes(score, start, length, transitions)
    p = alpha * beta
    return p / p.sum(1, keepdims=True)


def expected_moves(score: np.ndarray, start: np.ndarray, length: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and how often each label is expected to follow each other one."""
    e, alpha, beta = _passes(score, start, length, transitions)
    p = alpha * beta
    later = np.ones(len(score), dtype=bool)
    later[start] = False
    to = np.flatnonzero(later)
    joint = alpha[to - 1][:, :, None] * np.exp(transitions)[None] * (e[to] * beta[to])[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    return p / p.sum(1, keepdims=True), joint.sum(0)


def train(texts: list[list[str]], langs: list[str], seed: int = 8, words_each: int = TRAINING_WORDS) -> Crf:
    """texts: words of documents; langs: their labels. Adaptive gradient ascent of the likelihood. Of each language
    shuffled pieces are taken until they have words_each words."""
    labels = sorted(set(langs))
    crf = Crf(labels, np.zeros((1 << BITS, len(labels)), dtype=np.float32), np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return crf
    rng = np.random.default_rng(seed)
    pieces = []
    for ws, lang in zip(texts, langs):
        at = 0
        while at < len(ws):
            n = int(rng.integers(20, 80))
            pieces.append((ws[at : at + n], labels.index(lang)))
            at += n
    rng.shuffle(pieces)
    total, kept = [0] * len(labels), []
    for p in pieces:
        if total[p[1]] < words_each:
            kept.append(p)
            total[p[1]] += len(p[0])
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _ in kept for w in ws}))}
    lists = [word_features(w) for w in vocabulary]
    flat, first = np.concatenate([np.array(f) for f in lists]), np.cumsum([0, *map(len, lists)])
    sizes = np.diff(first)
    g2, t2 = np.full(crf.weights.shape, 1e-2, dtype=np.float32), np.full(crf.transitions.shape, 1e-2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(kept))
        for a in range(0, len(order), 192):  # 64 sequences of three pieces
            chosen = [order[b : b + 3] for b in range(a, min(a + 192, len(order)), 3)]
            ids = [np.array([vocabulary[w] for k in c for w in kept[k][0]]) for c in chosen]
            gold = [np.array([kept[k][1] for k in c for _ in kept[k][0]]) for c in chosen]
            rank = np.argsort([-len(i) for i in ids], kind="stable")
            ids, gold = [ids[r] for r in rank], [gold[r] for r in rank]
            length = np.array(list(map(len, ids)))
            start = np.cumsum([0, *length])[:-1]
            word, y = np.concatenate(ids), np.concatenate(gold)
            own, back = np.unique(word, return_inverse=True)
            span = np.concatenate([np.arange(first[w], first[w + 1]) for w in own])
            group = np.repeat(np.arange(len(own)), sizes[own])
            em = np.add.reduceat(crf.weights[flat[span]], np.cumsum([0, *sizes[own]])[:-1])
            p, moves = expected_moves(em[back], start, length, crf.transitions)
            error = -p
            error[np.arange(len(y)), y] += 1
            per_word = np.zeros((len(own), len(labels)))
            np.add.at(per_word, back, error)
            feats, where = np.unique(flat[span], return_inverse=True)
            grad = np.zeros((len(feats), len(labels)))
            np.add.at(grad, where, per_word[group])
            grad -= 0.01 * crf.weights[feats]
            g2[feats] += grad**2
            crf.weights[feats] += (0.3 * grad / np.sqrt(g2[feats])).astype(np.float32)
            # transitions: seen moves less expected ones
            later = np.ones(len(y), dtype=bool)
            later[start] = False
            to = np.flatnonzero(later)
            seen = np.zeros_like(crf.transitions)
            np.add.at(seen, (y[to - 1], y[to]), 1)
            tg = seen - moves - 0.1 * crf.transitions
            t2 += tg**2
            crf.transitions += 0.3 * tg / np.sqrt(t2)
    return crf


def fit_languages(docs: DataFrame, folds: int = 4, held_out: int = 2, docs_each: int = TRAINING_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", words_each: int = TRAINING_WORDS) -> Crf:
    """Trained on documents outside the held-out fold: docs_each at most of each language, chosen by a hash of id and
    text. Rows that repeat both count once, so no language is lost or crowded out by an id on many rows."""
    known = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("_id"), folds) != held_out))
    known = known.withColumn("_h", F.xxhash64("_id", "text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang", "_h").agg(F.lit(1)).groupBy("lang").count().collect()}
    if not counts:
        return train([], [])
    slots = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, max(1, n // docs_each))])
    # one slot of n // docs_each holds about docs_each different rows of a language; those go to its window
    some = known.where(F.pmod(F.xxhash64("_h", F.lit("slot")), slots[F.col("lang")]) == 0).dropDuplicates(["lang", "_h"])
    first = Window.partitionBy("lang").orderBy(F.xxhash64("_h", F.lit("crf")), "_h")
    some = some.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= docs_each).orderBy(F.xxhash64("_h", F.lit("crf")), "lang", "text").select("text", "lang").toPandas()
    return train([tokens_of(t) for t in some["text"]], some["lang"].tolist(), words_each=words_each)


def label_languages(texts: DataFrame, crf: Crf) -> DataFrame:
    """Adds lang_pred and score to rows of (_id string, _t, held_out)."""
    shared = texts.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        k = len(m.labels)
        known: dict[str, int] = {}
        table = [np.zeros((0, k), dtype=np.float32)]
        queues: dict[bool, list] = {False: [], True: []}
        waiting = {False: 0, True: 0}

        def label(rows: list) -> pd.DataFrame:
            rows.sort(key=lambda r: -len(r[2]))
            length = np.array([len(r[2]) for r in rows])
            score = np.concatenate(table)[np.concatenate([r[2] for r in rows])]
            start = np.cumsum([0, *length])[:-1]
            p = np.add.reduceat(forward_backward(score, start, length, m.transitions), start) / length[:, None]
            best = p.argmax(1)
            return pd.DataFrame({"_id": [r[0] for r in rows], "held_out": [r[1] for r in rows], "lang_pred": [m.labels[b] for b in best], "score": p[np.arange(len(rows)), best]})

        def flush(long: bool) -> pd.DataFrame:
            rows, queues[long], waiting[long] = queues[long], [], 0
            return label(rows)

        for batch in batches:
            plain = []
            for key, text, held in zip(batch["_id"], batch["_t"], batch["held_out"]):
                ws = tokens_of(text) if k and text and any(map(str.isalpha, text)) else []
                if not ws:
                    plain.append((key, held, "und", 0.0))
                    continue
                fresh = [w for w in set(ws) if w not in known]
                if fresh:
                    if len(known) > REMEMBER:
                        for long in (False, True):
                            if queues[long]:
                                yield flush(long)
                        known.clear()
                        table[:] = table[:1]
                        fresh = list(set(ws))
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                    table.append(m.emissions(fresh).astype(np.float32))
                ids = np.fromiter(map(known.__getitem__, ws), dtype=np.int32, count=len(ws))
                long = len(ids) > LONG
                queues[long].append((key, held, ids))
                waiting[long] += len(ids)
                if waiting[long] > TOGETHER:
                    yield flush(long)
            if len(table) > 1000:
                table[:] = [np.concatenate(table)]
            if plain:
                yield pd.DataFrame(plain, columns=["_id", "held_out", "lang_pred", "score"])
        for long in (False, True):
            if queues[long]:
                yield flush(long)

    return texts.mapInPandas(run, "_id string, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = TRAINING_DOCS, words_each: int = TRAINING_WORDS) -> DataFrame:
    """One row for each row of docs: id, held_out, lang_pred, score (mean probability of that label over the words).

    Learned from text and non-null lang of documents outside the held-out fold (crc32 of the id as text, modulo
    folds), about `docs_each` documents and `words_each` words of each language at most; predictions read only the
    whole text, of any length. Null texts, texts without a letter, and all texts where nothing could be learned are
    `und` with score 0. Of equally likely languages the first by name is taken. Rows that repeat an id stay. An empty
    table gives an empty table. Other columns are not read. No shuffle after training.
    """
    crf = fit_languages(docs, folds, held_out, docs_each, id_col, text_col, lang_col, words_each)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = bounded_batches(docs).select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_t"), (fold(F.col(id_col), folds) == held_out).alias("held_out"))
    return label_languages(texts, crf).select(F.col("_id").cast(kind).alias(id_col), "held_out", "lang_pred", "score")
