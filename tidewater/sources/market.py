"""Ticks, bars and calendars as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The frozen splits, half-open in UTC. The last is guarded.
SPLITS = {"in_sample": ("1995-01-01", "1999-01-01"), "walk_forward": ("1999-01-01", "2000-01-01"), "out_of_sample": ("2000-01-01", "2002-01-01")}
TIMEFRAMES = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "1h": "1 hour", "4h": "4 hours", "1D": "1 day"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, time_ms, price, seq: one-sided quotes in the order of (ts, seq). time_ms is the nearest millisecond,
    halves away from the epoch."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    time_ms = F.expr("(unix_micros(cast(ts AS timestamp)) + if(unix_micros(cast(ts AS timestamp)) < 0, -500, 500)) div 1000")
    return e.select(F.col("event_type").alias("symbol"), ts.alias("ts"), time_ms.alias("time_ms"), F.col("value").alias("price"), F.col("event_id").alias("seq"), "user_id")


def side(quotes: DataFrame, symbol: str) -> DataFrame:
    return quotes.where(F.col("symbol") == symbol)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, open, high, low, close, volume, ticks: a bar for each symbol and day that has any."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))
    out = o.groupBy("symbol", "day").agg(*ohlc("price", "seq"), F.sum("price").alias("volume"), F.count("*").alias("ticks"))
    return out.select("symbol", F.col("day").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def ohlc(price: str, order: str | Column) -> list[Column]:
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")]


def bounds(split: str | None = None, start: str | None = None, end: str | None = None) -> tuple[str | None, str | None]:
    """The intersection of a split and dates, half-open; None is open."""
    lo, hi = SPLITS[split] if split else (None, None)
    return max(filter(None, (lo, start)), default=None), min(filter(None, (hi, end)), default=None)


def load_bars(bars: DataFrame, split: str | None = None, start: str | None = None, end: str | None = None, allow_oos: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A half-open range of bars. The held-out split has to be asked for twice."""
    if split == "out_of_sample" and not allow_oos:
        raise PermissionError("out_of_sample is held out; pass allow_oos=True")
    lo, hi = bounds(split, start, end)
    for at, ok in ((lo, lambda c, v: c >= v), (hi, lambda c, v: c < v)):
        if at is not None:
            bars = bars.where(ok(F.col("ts"), F.lit(at).cast("timestamp")))
    return bars.select(*columns) if columns else bars


def split_of(ts: Column) -> Column:
    """Name of the split that a time falls in; null outside."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in SPLITS.items():
        out = F.when((ts >= F.lit(lo).cast("timestamp")) & (ts < F.lit(hi).cast("timestamp")), name).otherwise(out)
    return out


def event_schedule(spark: SparkSession, first: str, last: str) -> DataFrame:
    """kind, when: first Friday (jobs report) and the 13th (inflation) of each month at 08:30 in New York."""
    months = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)) AS m")
    friday = F.next_day(F.date_sub("m", 1), "FRI")
    rows = months.select(F.explode(F.array(F.struct(F.lit("jobs").alias("kind"), friday.alias("d")), F.struct(F.lit("inflation").alias("kind"), F.date_add("m", 12).alias("d")))).alias("x"))
    local = F.col("x.d").cast("timestamp") + F.expr("INTERVAL '08:30' HOUR TO MINUTE")
    return rows.select("x.kind", F.to_utc_timestamp(local, "America/New_York").alias("when"))
