"""Positions, stakes, quotes, quantiles and file sources on small tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.stats import auc, exact_quantiles, spearman
from tidewater.operators.positions import martingale, position_pnl
from tidewater.operators.quotes import clean_quotes, quote_bars
from tidewater.sources.files import append_csv, append_jsonl, list_months, read_csv, read_jsonl, read_months, tail


def test_exact_quantiles(spark):
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(501)], [1.0] * 300 + [2.0, 3.0], [5.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
        shares = [0, 0.01, 1 / 3, 0.5, 0.95, 1]
        assert exact_quantiles(df, "x", shares) == pytest.approx(list(pd.Series(values).quantile(shares)))
    assert exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_ranks_of_few_values(spark):
    one = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, y int")
    assert auc(one, "x", "y").first()["auc"] == 0.5
    two = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0)], "x double, y double")
    assert spearman(two, "x", "y").first()["ic"] == pytest.approx(1.0)


def test_martingale_by_loop(spark):
    rng = random.Random(5)
    rows = [(s, i, rng.random() < p) for s, p in (("a", 0.4), ("b", 0.05), (None, 0.3)) for i in range(60)]
    frame = pd.DataFrame(rows, columns=["symbol", "i", "won"]).assign(ts=lambda d: pd.Timestamp("2024-01-01") + pd.to_timedelta(d["i"], "D"))
    got = {(r["symbol"], r["i"]): (r["lots"], r["equity"]) for r in martingale(spark.createDataFrame(frame), "won", ("ts",), start=40.0).collect()}
    want = {}
    for s in ("a", "b", None):
        lots, equity = 1.0, 40.0
        for symbol, i, won in rows:
            if symbol != s or equity <= 0:
                continue
            equity += lots * (2.0 if won else -1.0)
            want[s, i] = (lots, equity)
            lots = 1.0 if won else min(16.0, lots * 2)
    assert got == want and len(want) < len(rows)


def test_position_pnl(spark):
    d = spark.createDataFrame([("a", f"2024-01-0{i + 1}", p, r) for i, (p, r) in enumerate([(1, None), (1, 0.1), (-1, 0.2), (0, 0.3)])], "symbol string, ts string, pos int, r double").selectExpr("symbol", "cast(ts as timestamp) ts", "pos", "r")
    got = [(r["held"], r["pnl"]) for r in position_pnl(d, "pos", "r", 0.01).orderBy("ts").collect()]
    assert [h for h, _ in got] == [0, 1, 1, -1]
    assert got[0][1] is None and [p for _, p in got[1:]] == pytest.approx([0.09, 0.2, -0.32])


def test_quotes(spark):
    rows = [("a", f"2024-01-01 00:00:{i:02d}", 10.0, 10.0 + s, i) for i, s in enumerate([0.1, 0.1, -0.1, 0.0, 5.0, 0.2])] + [("a", "2024-01-01 00:01:00", None, 1.0, 6), (None, "2024-01-01 00:01:00", 5.0, 5.5, 7)]
    q = spark.createDataFrame(rows, "symbol string, ts string, bid double, ask double, seq int").withColumn("ts", F.to_timestamp("ts"))
    kept = clean_quotes(q)
    assert sorted(r["seq"] for r in kept.collect()) == [0, 1, 3, 5, 7]  # 5.0 is beyond 25 times the median 0.15
    bar = quote_bars(kept, "1 minute", ["seq"]).where("symbol = 'a'").first()
    assert (bar["tick_count"], bar["bid_close"], bar["ask_close"]) == (4, 10.0, 10.2)
    assert (bar["open"], bar["spread_mean"]) == pytest.approx((10.05, 0.1))


def test_files(spark, tmp_path):
    d = spark.sql("select 2023 + int(id / 12) as year, int(id % 12) + 1 as month, make_timestamp(2023 + int(id / 12), int(id % 12) + 1, 15, 0, 0, 0) as ts, double(id) as price from range(18)")
    d.write.partitionBy("year", "month").parquet(f"{tmp_path}/m")
    assert [tuple(r) for r in list_months(spark, f"{tmp_path}/m").collect()][:2] == [(2023, 1), (2023, 2)]
    some = read_months(spark, f"{tmp_path}/m", "2023-11-20", "2024-02-16", ["price"])
    assert sorted(r["price"] for r in some.collect()) == [11.0, 12.0, 13.0]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]

    append_csv(spark.createDataFrame([("2024-01-01", "1.5"), ("soon", "n/a")], "day string, x string").coalesce(1), f"{tmp_path}/c")
    append_csv(spark.createDataFrame([("2024-01-02", "2")], "day string, x string"), f"{tmp_path}/c")
    got = read_csv(spark, f"{tmp_path}/c", ["day"], ["x"])
    assert got.count() == 3 and sorted(r["x"] for r in got.where("x is not null").collect()) == [1.5, 2.0] and got.where("day is null").count() == 1

    append_jsonl(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, x double"), f"{tmp_path}/j")
    (tmp_path / "j" / "more.json").write_text('{"k": 3, "x": 1.0}\nnot json\n')
    log = read_jsonl(spark, f"{tmp_path}/j", "k int, x double")
    assert [(r["k"], r["x"]) for r in log.orderBy("k").collect()] == [(1, None), (2, 0.5), (3, 1.0)]
    assert [r["k"] for r in tail(log, 2, "k").collect()] == [2, 3]
