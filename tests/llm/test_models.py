"""Token counts, packing, nearest neighbours and classifiers against brute force, round trips and held-out labels."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm.ann import nearest
from tidewater.llm.bpe import Counter, count_tokens, vocabulary_path
from tidewater.llm.langid import expected_moves, forward_backward, identify_languages
from tidewater.llm.packing import Knapsack, pack, solve
from tidewater.llm.quality import AdditiveModel, _tree, classify_quality, keep_quality
from tidewater.llm.toxicity import classify_toxicity, drop_toxic, label_model

from .helpers import awkward, prose, table

ODD = ["", "  a  b\n\n c\t d", "<|endoftext|>x<|endoftext|> <|endoftext|>", "don't  we'll 's", "a b c　", "\x1c x\x1f y", " ", "\n", "é" * 300, "a" * 5000, "日本語 テキスト 123 ½ ² x_y", "'s 't\n'll  \n  z ", "🙂🙂 👩‍👩‍👧 x", "tab\tend "]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def test_token_counts(spark, library):
    count = Counter(vocabulary_path())
    texts = ODD + [prose(500, 1), prose(50, 2).upper()]
    assert [count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = {r.doc_id: r for r in count_tokens(table(spark, [*texts, None])).collect()}
    assert rows[len(texts)][1:] == (0, 0, False) and rows[9].over_limit and rows[8].n_bytes == 600
    assert count_tokens(table(spark, [])).count() == 0 and count_tokens(awkward(spark)).count() == 9


def test_packing_round_trip(spark, library):
    texts = [*ODD, None, *(prose(n, n) for n in range(1, 700, 23)), prose(3000, 5)]
    pieces = pack(table(spark, texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        mine = pieces[pieces.doc_id == i].sort_values("piece")
        assert mine.piece.tolist() == list(range(len(mine))) and mine.length.sum() * 4 == len(ids)
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
        assert len(ids) > 4096 or len(mine) == 1
        assert (mine.length[1:] == 1024).all()
    laid = pieces.sort_values(["sequence_id", "offset"])
    assert (laid.groupby("sequence_id").length.cumsum() - laid.length == laid.offset).all()
    assert laid.groupby("sequence_id").length.sum().max() <= 1024
    assert laid.sequence_id.nunique() <= np.ceil(pieces.length.sum() / 1024) * 1.05 + 1
    assert pack(table(spark, [])).count() == 0 and pack(awkward(spark)).groupBy("doc_id").count().count() == 8


def test_configurations_keep_counts_and_come_close():
    rng = np.random.default_rng(0)
    for n, top in ((5000, 1023), (300, 700), (40, 1023), (0, 5)):
        counts = np.bincount(rng.integers(1, top + 1, n), minlength=1025)[1:].astype(np.int64)
        plan = solve(counts, 1024)
        total = sum((a * times for a, times in plan.uses), np.zeros(1024, dtype=np.int64))
        assert (total == counts).all() and all((a * np.arange(1, 1025)).sum() <= 1024 for a, _ in plan.uses)
        least = np.ceil((counts * np.arange(1, 1025)).sum() / 1024)
        assert plan.bound <= plan.sequences + 1e-6 and plan.bound >= least - 1.01
        assert plan.sequences <= np.ceil(plan.bound) * 1.015 + 1 and plan.from_program >= 0.7 * plan.sequences
    worth = np.zeros(1024)
    worth[[299, 340]] = [3.0, 3.5]
    sack = Knapsack(worth, 1024)
    assert sack.best[1024] == max(i * 3.0 + j * 3.5 for i in range(4) for j in range(4) if 300 * i + 341 * j <= 1024)
    assert sum(worth[s - 1] for s in sack.holding(341, 1.0, np.ones(1024))) == sack.best[1024]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[40:70] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] * 8), (None, [1.0] * 16)]
    got = nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).repartition(3)).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 1500, 20)) and (got.groupby("query_id").size() == 20).all()
    found = 0
    for q, g in got.groupby("query_id"):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, score[g.vec_id], rtol=0, atol=1e-9)
        assert list(zip(-g.score, g.vec_id)) == sorted(zip(-g.score, g.vec_id))
        found += len(set(order) & set(g.vec_id))
    assert found >= 0.97 * len(got)
    short = nearest(spark.createDataFrame([(0, [1.0, 0.0, 2.0]), (1, [2.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(short, key=lambda r: r["rank"])] == [(3, 4.0), (1, 2.0), (2, 0.0)]  # followed by zeros
    few = nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert len(few) == 3 and nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_of_repeated_rows(spark, monkeypatch):
    from tidewater.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 128)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[1] = 4 * x[0] / np.linalg.norm(x[0])  # near query 0
    x[41:44] = 3 * x[40] / np.linalg.norm(x[40])
    ids = [*range(600), *[1] * 30, *[41] * 2, *[60] * 300]  # rows that repeat an id and its vector, a query's too
    docs = spark.createDataFrame([(i, x[i].tolist()) for i in ids], "vec_id long, embedding array<double>").repartition(3)
    got = nearest(docs).toPandas()
    assert sorted(got.query_id.unique()) == list(range(0, 600, 20)) and (got.groupby("query_id").size() == 20).all()
    found = 0
    for q, g in got.groupby("query_id"):
        want = sorted((-round(float(x[i] @ x[q]), 6), i) for i in ids if i != q)[:20]
        mine = [(-round(s, 6), i) for s, i in zip(g.score, g.vec_id)]
        found += sum(min(want.count(w), mine.count(w)) for w in set(want))
    assert found >= 0.97 * len(got)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    length, k = np.array([5, 3, 1]), 3
    score, move = rng.standard_normal((9, k)), rng.standard_normal((k, k))
    got = forward_backward(score, np.array([0, 5, 8]), length, move)
    for a, n in zip((0, 5, 8), length):
        want = np.zeros((n, k))
        for path in np.ndindex(*[k] * n):
            w = np.exp(sum(score[a + t, y] for t, y in enumerate(path)) + sum(move[i, j] for i, j in zip(path, path[1:])))
            want[np.arange(n), path] += w
        assert np.allclose(got[a : a + n], want / want.sum(1, keepdims=True))


def test_expected_moves_are_exact():
    rng = np.random.default_rng(3)
    length, k = np.array([4, 3, 1]), 3
    score, move = rng.standard_normal((8, k)), rng.standard_normal((k, k))
    p, moves = expected_moves(score, np.array([0, 4, 7]), length, move)
    want, log_z = np.zeros((k, k)), lambda t: sum(np.log(sum(np.exp(sum(score[a + i, y] for i, y in enumerate(path)) + sum(t[i, j] for i, j in zip(path, path[1:]))) for path in np.ndindex(*[k] * n))) for a, n in zip((0, 4, 7), length))
    for i, j in np.ndindex(k, k):  # the gradient of the partition function
        up, down = move.copy(), move.copy()
        up[i, j] += 1e-5
        down[i, j] -= 1e-5
        want[i, j] = (log_z(up) - log_z(down)) / 2e-5
    assert np.allclose(moves, want, atol=1e-6) and np.allclose(p, forward_backward(score, np.array([0, 4, 7]), length, move))


def test_label_model_against_a_plain_one():
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    v = np.where(rng.random((3000, 5)) < right, y[:, None], ~y[:, None]).astype(int)
    v[rng.random((3000, 5)) < 0.1] = -1
    p, tables = label_model(v, 0.4)
    assert (np.abs(tables[1, :, 2] / (1 - tables[1, :, 0]) - right) < 0.05).all() and ((p > 0.5) == y).mean() > 0.95
    for row in range(0, 3000, 97):  # the posterior, by hand
        says = np.log(0.4 / 0.6) + sum(np.log(tables[1, j, v[row, j] + 1] / tables[0, j, v[row, j] + 1]) for j in range(5))
        assert abs(1 / (1 + np.exp(-says)) - p[row]) < 0.01


def test_trees_and_tables_against_plain_loops():
    rng = np.random.default_rng(7)
    g, h = rng.standard_normal(9), rng.random(9) + 0.1
    best = max(range(1, 9), key=lambda c: g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1))
    one = _tree(g, h, 1)
    assert np.allclose(one, [g[:best].sum() / (h[:best].sum() + 1)] * best + [g[best:].sum() / (h[best:].sum() + 1)] * (9 - best))
    x = rng.standard_normal((400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = AdditiveModel(x, y, rounds=200)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.93
    for r in range(0, 400, 41):
        total = m.base + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(m.tables, m.edges, x[r]))
        total += sum(t[np.searchsorted(m.coarse[i], x[r, i], side="right"), np.searchsorted(m.coarse[j], x[r, j], side="right")] for (i, j), t in zip(m.pairs, m.pair_tables))
        assert abs(1 / (1 + np.exp(-total)) - m.score(x[r : r + 1])[0]) < 1e-9


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in identify_languages(table(spark, ["", None, "123 ...", "plain words here"])).collect()}
    assert [odd[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"]
    assert identify_languages(awkward(spark)).count() == 9 and identify_languages(table(spark, [])).count() == 0


def test_languages_of_text_without_spaces(spark):
    rng, both = np.random.default_rng(4), [chr(c) for c in range(0x4E00, 0x4E20)]
    rows = []
    for i in range(120):  # the first and last characters are the same in both languages
        own = [chr(c) for c in (range(0x5000, 0x5040) if i % 2 else range(0x6000, 0x6040))]
        rows.append((i, "".join([*both, *both, *rng.choice(own, 300), *both]), "zh" if i % 2 else "ja"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 20 and (got.lang == got.lang_pred).all()


def test_each_language_has_its_share_of_training_words(spark):
    rows = [(i, " ".join(["alpha", "beta", "gamma"] * 200), "big") for i in range(60)] + [(60 + i, "delta epsilon " * 10, "small") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify_languages(docs, words_each=300).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).all()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_quality_and_toxicity(spark):
    texts, labels = [], []
    for i in range(240):
        bad, rude = i % 4 == 0, i % 5 == 1
        t = prose(80, i) + (" you idiot clod" if rude else "")
        texts.append("!! ".join(t.upper().split()) if bad else t)
        labels.append((i, int(not bad), int(rude), "clash"))
    docs, gold = table(spark, texts), pd.DataFrame(labels, columns=["doc_id", "quality", "toxic", "_"])
    marks = labels_of(spark, [*labels, (None, 1, 1, ""), (3, None, None, "")])
    for run, label, keep in ((classify_quality, "quality", lambda d: keep_quality(d, marks)), (classify_toxicity, "toxic", lambda d: drop_toxic(d, marks))):
        got = run(docs, marks).toPandas().merge(gold, on="doc_id")
        held = got[got.held_out]
        assert len(held) > 20 and (held.predicted == held[label]).mean() > 0.95 and got.score.between(0, 1).all()
        kept = keep(docs)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got.doc_id[got.predicted == (label == "quality")])
        assert run(awkward(spark), marks).count() == 9 and run(table(spark, []), marks).count() == 0
        assert {r.score for r in run(docs, labels_of(spark, [])).collect()} == {0.5}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = table(spark, [prose(30, i) for i in range(60)])
    fold = docs.select("doc_id", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).alias("f")).toPandas()
    one = [(int(r.doc_id), int(r.doc_id % 2), 0, "") for r in fold.itertuples()]
    other = [(i, 1 - q if f == 0 else q, t, x) for (i, q, t, x), f in zip(one, fold.f)]
    a, b = (classify_quality(docs, labels_of(spark, x)).toPandas().sort_values("doc_id") for x in (one, other))
    assert np.allclose(a.score, b.score)
