"""Resampled intervals and fitted models against plain versions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewater.functions.models import Boosted, auc_by, best_split, fit_boosted, fit_logistic, fit_ridge, permutation_importance
from tidewater.functions.resample import block_bootstrap_effect, drawn, merged_ledger, monte_carlo


def test_draws_are_even_and_apart():
    u = drawn(np.arange(20_000)[:, None], np.arange(1, 9)[None], 3)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and u.min() > 0 and u.max() < 1
    assert np.abs(np.corrcoef(u.T) - np.eye(8)).max() < 0.03 and abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.03


def test_block_errors_see_what_rows_have_in_common(spark):
    """For a mean of a moving-average series the error of blocks is near theory, and that of single rows far too small."""
    r = np.random.default_rng(3)
    rows, n, span = [], 4000, 6
    for one in (True, False):
        e = r.normal(0, 1, n + span)
        x = np.convolve(e, np.ones(span), "valid")[:n]
        rows.append(pd.DataFrame({"cell": "c", "stratum": np.arange(n) % 2 * 0, "one": one, "y": x + (0.5 if one else 0.0), "id": np.arange(n) + (0 if one else n), "ts": pd.date_range("2024-01-01", periods=n, freq="h")}))
    d = pd.concat(rows)
    d.loc[d.id == 5, "y"] = np.nan
    df = spark.createDataFrame(d)
    df = df.unionByName(df.withColumn("cell", F.lit(None).cast("string")))
    theory = span * np.sqrt(2 / n)  # a sum of `span` shocks, long-run deviation `span`
    got = {r.cell: r for r in block_bootstrap_effect(df, ["cell"], ["stratum"], "one", "y", "id", 40, 200).collect()}
    single = block_bootstrap_effect(df.where("cell = 'c'"), ["cell"], ["stratum"], "one", "y", "id", 1, 200).first()
    assert set(got) == {"c", None} and np.isclose(got["c"].se, got[None].se)
    assert 0.75 * theory < got["c"].se < 1.25 * theory and single.se < 0.6 * theory
    assert got["c"].lo < got["c"].effect < got["c"].hi and got["c"].n_chosen == n - 1 and got["c"].rounds == 200
    ledger = spark.createDataFrame([("c", 1.0, 0.5), ("other", 2.0, 0.25)], "cell string, effect double, p double")
    both = {r.cell: r for r in merged_ledger(ledger, block_bootstrap_effect(df, ["cell"], ["stratum"], "one", "y", "id", 40, 20), ["cell"]).collect()}
    assert both["other"].se_boot is None and both["other"].p == 0.25 and both["c"].se_boot > 0 and both["c"].p != 0.5


def test_few_rows_give_no_effect(spark):
    df = spark.createDataFrame([("a", 1, True, 1.0, 1, None), ("a", 1, False, 2.0, 2, None)], "cell string, stratum int, one boolean, y double, id long, ts timestamp")
    assert block_bootstrap_effect(df, ["cell"], ["stratum"], "one", "y", "id", 4, 5).collect() == []


def test_monte_carlo_of_trades(spark):
    r = np.random.default_rng(1)
    pnl = r.normal(1.0, 5.0, 400)
    d = pd.DataFrame({"symbol": "a", "net_pnl": pnl, "exit_ts": pd.date_range("2024-01-01", periods=400, freq="h"), "entry_i": range(400)})
    few = d.head(4).assign(symbol="few")
    (m,) = monte_carlo(spark.createDataFrame(pd.concat([d, few])), rounds=300, equity=1000.0).collect()
    assert m.symbol == "a" and m.rounds == 300 and m.final_p05 < m.final_p50 < m.final_p95
    assert abs(m.final_p50 - 1000 - pnl.sum()) < 30 and abs((m.final_p95 - m.final_p05) / 3.29 - pnl.std() * 20) < 20 and 0 < m.fall_p50 < m.fall_p95 < 40


def test_logistic_and_ridge_equal_plain_solutions(spark):
    r = np.random.default_rng(2)
    x = np.column_stack([r.normal(3, 2, 700), r.normal(-1, 0.1, 700), np.full(700, 4.0)])
    y = (r.random(700) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 3) - 5 * (x[:, 1] + 1))))).astype(float)
    d = pd.DataFrame(x, columns=["a", "b", "flat"]).assign(y=y, z=2 * x[:, 0] + 30 * x[:, 1] + r.normal(0, 1, 700))
    bad = d.head(3).assign(a=[np.nan, 1.0, 2.0], y=[1.0, np.nan, np.nan], z=[1.0, np.nan, np.nan])
    df = spark.createDataFrame(pd.concat([d, bad])).repartition(5)
    s = np.where(x.std(0) == 0, 1, x.std(0))
    z = np.column_stack([np.ones(700), (x - x.mean(0)) / s])
    w = np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(0.5 * (z * (p * (1 - p))[:, None]).T @ z + np.diag([0, 1, 1, 1]), 0.5 * z.T @ (p - y) + np.array([0, *w[1:]]))
    m = fit_logistic(df, ["a", "b", "flat"], "y")
    assert np.allclose([m.intercept, *m.coef], w, atol=1e-8)
    q = df.select(m.probability().alias("p"), "a", "b").where("not isnan(a) and y is not null and not isnan(y)").toPandas()
    assert np.allclose(sorted(q.p), sorted(1 / (1 + np.exp(-z @ w))), atol=1e-8)
    t = d.z.to_numpy()
    plain = np.linalg.solve(z.T @ z + np.diag([0, 2, 2, 2]), z.T @ t)
    m = fit_ridge(df, ["a", "b", "flat"], "z")
    assert np.allclose([m.intercept, *m.coef], plain, atol=1e-8)


def test_a_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    for _ in range(20):
        b, g, h = r.integers(0, 6, (60, 2)), r.normal(0, 1, 60), r.random(60) + 0.1
        hist = np.zeros((2, 6, 3))
        for j in range(2):
            for k, v in enumerate((g, h, np.ones(60))):
                hist[j, :, k] = np.bincount(b[:, j], v, 6)
        best, score = None, lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        for j in range(2):
            for last in range(1, 5):
                for missing_left in (False, True):
                    left = ((b[:, j] > 0) & (b[:, j] <= last)) | ((b[:, j] == 0) & missing_left)
                    if left.sum() >= 5 and (~left).sum() >= 5:
                        gain = score(left) + score(~left) - score(np.ones(60, bool))
                        best = max(best or (gain, j, last, missing_left), (gain, j, last, missing_left), key=lambda x: x[0])
        got = best_split(hist, 1.0, 5)
        assert np.isclose(got[0], best[0])


def test_boosting_finds_what_a_line_cannot(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (3000, 3))
    t = (x[:, 0] * x[:, 1] > 0) ^ (r.random(3000) < 0.1)
    x[r.random(3000) < 0.1, 0] = np.nan
    t = np.where(np.isnan(x[:, 0]), r.random(3000) < 0.9, t)  # what is missing says much
    d = pd.DataFrame(x, columns=["a", "b", "noise"]).assign(id=range(3000), y=t.astype(int))
    df = spark.createDataFrame(d).repartition(4).cache()
    train, test = df.where("id < 2200"), df.where("id >= 2200")
    m = fit_boosted(train, ["a", "b", "noise"], "y", "id", trees=15, rate=0.3)
    p = m.probability()
    line = fit_logistic(train, ["a", "b", "noise"], "y")
    of = lambda column: auc_by(test.select(F.lit(1).alias("g"), column.alias("s"), "y"), ["g"], "s", "y").first().auc
    assert of(p("a", "b", "noise")) > 0.8 > 0.7 > of(line.probability())
    shown = {i.feature: i.importance for i in permutation_importance(test, p, ["a", "b", "noise"], "y", "id", 2).collect()}
    assert shown["a"] > 0.1 and shown["b"] > 0.1 and abs(shown["noise"]) < 0.05
    assert 0 < len(m.trees) <= 15
    stopped = fit_boosted(train.withColumn("y", (F.rand(1) > 0.5).cast("int")), ["noise"], "y", "id", trees=12, patience=2, least=200)
    assert len(stopped.trees) < 12
    assert np.isclose(Boosted(["a"], [[0.0]], 0.3).raw(np.array([[0], [2]])), 0.3).all()


def test_drawn_paths_are_made_once(spark):
    """Paths over several chunks equal plain sums, and are drawn once, not for every use."""
    r = np.random.default_rng(6)
    net = r.normal(0.5, 4, 45).round(2)
    d = spark.createDataFrame([(None, float(x), i, i) for i, x in enumerate(net)], "symbol string, net_pnl double, exit_ts long, entry_i long")
    d = d.withColumn("exit_ts", F.timestamp_seconds("exit_ts"))
    m = monte_carlo(d, rounds=9, equity=100.0, size=7)
    assert "explode" not in m._jdf.queryExecution().toString()
    finals, falls = [], []
    for k in range(1, 10):
        e = 100 + np.cumsum([net[int(drawn(i, k, 0) * 45)] for i in range(45)])
        finals.append(e[-1])
        falls.append(-100 * (e / np.maximum(np.maximum.accumulate(e), 100) - 1).min())
    got = m.first()
    want = [*np.quantile(finals, [0.05, 0.5, 0.95]), np.mean(np.array(finals) > 100), *np.quantile(falls, [0.5, 0.95])]
    assert np.allclose([got[c] for c in ("final_p05", "final_p50", "final_p95", "prob_profit", "fall_p50", "fall_p95")], want)


def test_boosting_passes_over_combinations_of_bins(spark, monkeypatch):
    from tidewater.functions import models

    r = np.random.default_rng(9)
    x = r.integers(0, 3, 3000)
    d = spark.createDataFrame(pd.DataFrame({"i": range(3000), "x": np.where(x == 2, np.nan, x), "t": ((x == 1) ^ (r.random(3000) < 0.1)).astype(int)}))
    seen, summed = [], models._summed
    monkeypatch.setattr(models, "_summed", lambda df, *a: (seen.append(df.count()), summed(df, *a))[1])
    m = fit_boosted(d, ["x"], "t", "i", trees=1, depth=1)
    assert seen == [12]  # three bins, two labels, two parts
    assert m.trees[0][0][0] is not None


def test_draws_take_little_disk_and_few_at_a_time(spark, monkeypatch):
    """Paths of several chunks, drawn in several turns from several blocks, equal plain sums; no table has a row for each draw."""
    from tidewater.functions import resample

    monkeypatch.setattr(resample, "BLOCK", 16)
    monkeypatch.setattr(resample, "WIDE", 3)
    monkeypatch.setattr(resample, "AT_ONCE", 300)
    r = np.random.default_rng(7)
    series = {None: r.normal(0.5, 4, 100).round(2), "b": r.normal(-0.2, 4, 9).round(2), "few": r.normal(0, 1, 4)}
    rows = [(s, None if i == 3 else float("nan") if i == 5 else float(x), i, i) for s, net in series.items() for i, x in enumerate(net)]
    d = spark.createDataFrame(rows, "symbol string, net_pnl double, exit_ts long, entry_i long").withColumn("exit_ts", F.timestamp_seconds("exit_ts"))
    made, plain = [], resample.Written.table
    monkeypatch.setattr(resample.Written, "table", lambda self, df, keep=False: (made.append((out := plain(self, df, keep)).count()), out)[1])
    got = {x.symbol: x for x in monte_carlo(d, rounds=8, equity=100.0, size=7).collect()}
    assert set(got) == {None, "b"} and max(made) <= 3 * 5 + 3 and len(made) == 2 + 2 * 4
    for s, net in list(series.items())[:2]:
        net[[3, 5]] = 0
        n, finals, falls = len(net), [], []
        for k in range(1, 9):
            e = 100 + np.cumsum([net[int(drawn(i, k, 0) * n)] for i in range(n)])
            finals.append(e[-1])
            falls.append(-100 * (e / np.maximum(np.maximum.accumulate(e), 100) - 1).min())
        want = [*np.quantile(finals, [0.05, 0.5, 0.95]), np.mean(np.array(finals) > 100), *np.quantile(falls, [0.5, 0.95])]
        assert got[s].rounds == 8 and np.allclose([got[s][c] for c in ("final_p05", "final_p50", "final_p95", "prob_profit", "fall_p50", "fall_p95")], want)
