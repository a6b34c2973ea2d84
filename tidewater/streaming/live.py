"""Structured Streaming counterparts: closed bars, de-duplication, and labels that resolve later."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.market import ohlc
from .snapshot import publish_latest


def read_ticks(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream of tick files. Times without a zone become timestamps, as watermarks need them."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def closed_bars(ticks: DataFrame, width: str, late: str, price: str = "price", seq: str = "seq") -> DataFrame:
    """Bars of windows that the watermark has passed: the one still forming is left out. For append mode."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    out = g.agg(*ohlc(price, F.struct("ts", seq)), F.count("*").alias("tick_count"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "tick_count")


def sliding(ticks: DataFrame, width: str, slide: str, late: str, price: str = "price") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, slide).alias("w"))
    return g.agg(F.count("*").alias("n"), F.avg(price).alias("mean")).select("symbol", F.col("w.start").alias("ts"), "n", "mean")


def sessions(ticks: DataFrame, gap: str, late: str, by: str = "user_id") -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("ts"), "n")


def without_repeats(ticks: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Re-sent rows go, as long as they are no later than the watermark allows."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def resolve_labels(predictions: DataFrame, prices: DataFrame, due: str = "60 minutes", patience: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """Each prediction (id, ts, price) with the prices (symbol, ts, price) from its due time on, within patience: a
    stream-stream interval join. The first of them is the outcome; first_outcome picks it from the sink."""
    p = predictions.withWatermark("ts", late).select("id", "symbol", F.col("ts").alias("p_ts"), F.col("price").alias("p_price"))
    q = prices.withWatermark("ts", late).select(F.col("symbol").alias("q_symbol"), F.col("ts").alias("q_ts"), F.col("price").alias("q_price"))
    on = f"symbol = q_symbol AND q_ts >= p_ts + INTERVAL {due} AND q_ts < p_ts + INTERVAL {due} + INTERVAL {patience}"
    return p.join(q, F.expr(on)).select("id", "symbol", "p_ts", "p_price", "q_ts", "q_price")


def first_outcome(resolved: DataFrame) -> DataFrame:
    """id, realised_up: whether the first price after the due time was above that of the prediction."""
    g = resolved.groupBy("id", "p_price").agg(F.min_by("q_price", "q_ts").alias("future_price"))
    return g.select("id", "future_price", (F.col("future_price") > F.col("p_price")).cast("int").alias("realised_up"))


def oco_orders(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """One order pair a day and symbol: the first tick sets a box of half_width around it, a tick beyond an edge fills
    that side, and the other edge is then its stop. Ticks: symbol, ts, price, half_width. Emits fills and stops.

    State: (day, low, high, side, entry). A new day starts anew; ticks of a batch are taken in their order."""
    schema = "symbol string, ts timestamp, action string, side int, price double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, low, high, side, entry = state.get if state.exists else (None, 0.0, 0.0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for ts, price, half in zip(rows["ts"], rows["price"], rows["half_width"]):
            if str(ts.date()) != day:
                day, low, high, side, entry = str(ts.date()), price - half, price + half, 0, 0.0
            elif side == 0 and not low < price < high:
                side, entry = (1, max(price, high)) if price >= high else (-1, min(price, low))
                out.append((key[0], ts, "fill", side, entry))
            elif side in (1, -1) and (price <= low if side > 0 else price >= high):
                out.append((key[0], ts, "stop", side, low if side > 0 else high))
                side = 2 * side  # done for the day
        state.update((day, low, high, side, entry))
        yield pd.DataFrame(out, columns=["symbol", "ts", "action", "side", "price"])

    return ticks.withWatermark("ts", late).groupBy("symbol").applyInPandasWithState(step, schema, "day string, low double, high double, side int, entry double", "append", GroupStateTimeout.NoTimeout)


def write_latest(df: DataFrame, path: str, checkpoint: str):
    """Keeps the latest state as a table that readers always see whole: see tidewater.streaming.snapshot."""
    return publish_latest(df, path, checkpoint)
