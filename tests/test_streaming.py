"""Streams give what the same rows give as a table."""

import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators.resample import to_bars
from tidewater.sources.market import ticks
from tidewater.streaming.live import closed_bars, first_outcome, oco_orders, resolve_labels, without_repeats

SF = "/root/testdata/sf0.001"
TICK = "symbol string, ts timestamp, price double, seq long"


def files(spark, path, df, n=3):
    """n files in the order of time."""
    rows = df.orderBy("ts", "seq").toPandas()
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_closed_bars_equal_batch(spark, tmp_path):
    t = ticks(spark, SF).select("symbol", "ts", "price", "seq")
    got = drained(closed_bars(files(spark, tmp_path, t), "1 hour", "1 minute"), "bars").toPandas()
    want = to_bars(t, "1 hour").select("symbol", "ts", "open", "high", "low", "close", "tick_count").toPandas()
    last = want.ts.max()
    assert len(got) >= 0.9 * len(want) and last not in set(got.ts)
    both = got.merge(want, on=["symbol", "ts", "open", "high", "low", "close", "tick_count"])
    assert len(both) == len(got)


def test_repeats_go(spark, tmp_path):
    t = ticks(spark, SF).select("symbol", "ts", "price", "seq").limit(200)
    twice = t.unionByName(t)
    assert drained(without_repeats(files(spark, tmp_path, twice), ["seq"], "40 days"), "once").count() == 200


def test_labels_resolve_at_the_first_price_after_due(spark, tmp_path):
    at = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    predictions = spark.createDataFrame(pd.DataFrame({"symbol": "x", "ts": [at(0), at(5)], "price": [10.0, 30.0], "seq": [1, 2], "id": [1, 2]}))
    prices = spark.createDataFrame(pd.DataFrame({"symbol": "x", "ts": [at(30), at(61), at(63), at(66)], "price": [99.0, 11.0, 9.0, 20.0], "seq": [1, 2, 3, 4]}))
    p = files(spark, tmp_path / "p", predictions, 1)
    q = files(spark, tmp_path / "q", prices, 1)
    got = {r.id: r for r in first_outcome(drained(resolve_labels(p, q), "labels")).collect()}
    assert got[1].future_price == 11.0 and got[1].realised_up == 1 and got[2].future_price == 20.0 and got[2].realised_up == 0


def test_order_pairs(spark, tmp_path):
    prices = [100, 101, 106, 104, 94, 120, 50]
    rows = pd.DataFrame({"symbol": "x", "ts": pd.date_range("2024-01-01 10:00", periods=7, freq="10min"), "price": map(float, prices), "half_width": 5.0, "seq": range(7)})
    got = drained(oco_orders(files(spark, tmp_path, spark.createDataFrame(rows), 3)), "orders").orderBy("ts").collect()
    assert [(r.action, r.side, r.price) for r in got] == [("fill", 1, 106.0), ("stop", 1, 95.0)]
