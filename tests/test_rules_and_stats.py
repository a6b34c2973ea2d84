import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.resample import bootstrap_mean
from tidewater.functions.stats import auc, average_ranks, benjamini_hochberg, chi_square_sf, normal_two_sided, stratified_effect
from tidewater.plans.rules import compile_group, compile_rule, in_hours, signals
from tidewater.sources.market import event_schedule, load_bars
from tidewater.sources.sinks import replace_window, throttle, upsert, write_partitions


def test_rules(spark):
    closes = [1.0, 3.0, 2.0, 5.0, 5.0, 1.0]
    d = spark.createDataFrame(pd.DataFrame({"symbol": "s", "ts": pd.date_range("2024-01-01", periods=6), "open": closes, "high": closes, "low": closes, "close": closes}))
    close, two = {"kind": "price", "field": "close"}, {"kind": "value", "value": 2}
    spec = {"long": {"rules": [{"left": close, "op": "cross_above", "right": two}]}, "exit": {"rules": [{"left": close, "op": "==", "right": two}]}, "stop": {"type": "atr", "mult": 2, "n": 3}}
    got = signals(d, spec).orderBy("ts").collect()
    assert [r.long_entry for r in got] == [False, True, False, True, False, False]
    assert [r.exit_signal for r in got] == [False, False, True, False, False, False] and not any(r.short_entry for r in got)
    assert got[0].stop_dist == 0 and got[1].stop_dist == pytest.approx(2 * 2 / 3) and got[0].target_dist is None
    with pytest.raises(ValueError):
        compile_rule({"left": close, "op": "near", "right": two})
    assert spark.range(1).select(compile_group({}).alias("x")).first().x is False


def test_hours(spark):
    d = spark.sql("SELECT make_timestamp(2024, 1, 1, id, 0, 0) AS ts, id FROM range(24)")
    assert [r.id for r in d.where(in_hours(22, 3)).collect()] == [0, 1, 2, 22, 23]
    assert [r.id for r in d.where(in_hours(9, 11)).collect()] == [9, 10]


def test_guarded_split_and_schedule(spark):
    bars = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["1998-12-31", "1999-01-01", "2000-06-01"])}))
    assert load_bars(bars, "walk_forward").count() == 1
    with pytest.raises(PermissionError):
        load_bars(bars, "out_of_sample")
    assert load_bars(bars, "out_of_sample", allow_oos=True).count() == 1
    s = {(r.kind, str(r.when)) for r in event_schedule(spark, "2024-03-01", "2024-04-01").collect()}
    assert s == {("jobs", "2024-03-01 13:30:00"), ("inflation", "2024-03-13 12:30:00"), ("jobs", "2024-04-05 12:30:00"), ("inflation", "2024-04-13 12:30:00")}


def test_ranks_and_auc(spark):
    x = pd.DataFrame({"x": [3.0, 1, 2, 2, 5, 2, None], "y": [1, 0, 0, 1, 1, 0, 1]})
    d = spark.createDataFrame(x)
    got = {(r.x, r["rank"]) for r in average_ranks(d, "x").collect()}
    assert got == {(3.0, 5.0), (1.0, 1.0), (2.0, 3.0), (5.0, 6.0), (None, None)}
    assert auc(d, "x", "y").first().auc == pytest.approx((3 + 2 + 3) / 9)  # 3 beats all, 2 one and ties with two, 5 all


def test_tails(spark):
    r = spark.range(1).select(normal_two_sided(F.lit(1.959963985)).alias("a"), chi_square_sf(F.lit(7.814728), 3).alias("b"), chi_square_sf(F.lit(5.991465), 2).alias("c"), chi_square_sf(F.lit(3.841459), 1).alias("d")).first()
    assert all(abs(v - 0.05) < 1e-6 for v in r)


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.random(200), rng.random(30) / 500])
    got = benjamini_hochberg(spark.createDataFrame(pd.DataFrame({"p": [*p, None]})), "p").toPandas()
    s = np.sort(p)
    ok = s <= 0.1 * np.arange(1, len(s) + 1) / len(s)
    assert got.significant.sum() == (p <= s[ok].max()).sum() and not got[got.p.isna()].significant.any()


def test_effect_is_the_plain_formula(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"c": 1, "s": rng.integers(0, 4, 500), "on": rng.random(500) < 0.4, "y": rng.standard_normal(500)})
    got = stratified_effect(spark.createDataFrame(d), ["c"], ["s"], "on", "y").first()
    parts = [(g.on.sum(), g.y[g.on].mean() - g.y[~g.on].mean(), g.y[g.on].var() / g.on.sum() + g.y[~g.on].var() / (~g.on).sum()) for _, g in d.groupby("s")]
    w = sum(p[0] for p in parts)
    assert got.effect == pytest.approx(sum(a * b for a, b, _ in parts) / w) and got.se == pytest.approx(math.sqrt(sum(a * a * v for a, _, v in parts)) / w)


def test_bootstrap_matches_theory(spark):
    x = np.random.default_rng(3).standard_normal(2000) + 5
    r = bootstrap_mean(spark.createDataFrame(pd.DataFrame({"_id": range(2000), "g": "a", "x": x})), ["g"], "x").first()
    half = 1.96 * x.std() / 2000**0.5
    assert abs(r.mid - x.mean()) < half / 3 and abs((r.hi - r.lo) / 2 - half) < half / 4


def test_sinks(spark, tmp_path):
    day = lambda *d: spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime([f"2024-01-{x:02}" for x in d]), "v": [float(x) for x in d]}))
    got = replace_window(day(1, 2, 3, 4), day(2, 3, 4, 5), days=2)
    assert sorted(r.v for r in got.collect()) == [1, 2, 3, 4, 5]
    for new in (day(4), day(5)):
        with pytest.raises(ValueError):
            replace_window(day(1, 2, 3, 4), new, days=3, may_lose=0)
    a, b = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, upsert(a, b, ["k"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    path = str(tmp_path / "p")
    write_partitions(a.withColumn("y", F.lit(1)).unionByName(a.withColumn("y", F.lit(2))), path, ["y"], ["k"])
    write_partitions(b.withColumn("y", F.lit(2)), path, ["y"], ["k"])
    assert sorted((r.y, r.v) for r in spark.read.parquet(path).collect()) == [(1, "old"), (1, "old"), (2, "new"), (2, "new")]
    t = spark.createDataFrame(pd.DataFrame({"s": "a", "ts": pd.to_datetime(["2024-01-01 00:00:01", "2024-01-01 00:00:03", "2024-01-01 00:00:06"]), "v": [1, 2, 3]}))
    assert sorted(r.v for r in throttle(t, "ts", 5, ["s"]).collect()) == [1, 3]


def test_profit_factor_needs_wins_and_losses(spark):
    from tidewater.functions.stats import trade_metrics

    d = spark.createDataFrame([("lost", -2.0, -1.0, 1.0), ("lost", -4.0, -3.0, 1.0), ("won", 2.0, 3.0, 1.0), ("both", 6.0, 7.0, 1.0), ("both", -3.0, -2.0, 1.0)], "symbol string, net_pnl double, gross_pnl double, cost double")
    m = {x.symbol: x for x in trade_metrics(d, ["symbol"]).collect()}
    assert [m[k].profit_factor for k in ("lost", "won", "both")] == [None, None, 2.0] and m["lost"].win_rate == 0 and m["lost"].avg_win is None


def test_places_are_rounded_as_sql_rounds(spark):
    import duckdb

    from tidewater.registry import r4_scaled

    r = np.random.default_rng(3)
    x = [2.26285, -2.26285, 0.00005, 1e12 + 0.5, *(r.integers(-(10**6), 10**6, 500) / 10_000 + 0.00005).tolist(), None, math.nan]
    got = [y.r for y in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", r4_scaled("x").alias("r")).orderBy("i").collect()]
    want = [y[0] for y in duckdb.execute("SELECT round(x, 4) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x]).fetchall()]
    assert got[:-1] == want[:-1] and math.isnan(got[-1])
