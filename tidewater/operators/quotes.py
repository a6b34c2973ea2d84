"""Two-sided quotes: crossed or absurd ones, and bars with both sides and their spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import missing_as_null, same_series


def clean_quotes(quotes: DataFrame, by: str = "symbol", times: float = 25.0) -> DataFrame:
    """quotes: ts, bid, ask. Keeps those that are not crossed and not wider than `times` the median of the positive
    spreads of their month, where there is one. Rows without both prices go."""
    q = missing_as_null(quotes, ["bid", "ask"]).where("bid is not null and ask is not null")
    q = q.withColumn("spread", F.col("ask") - F.col("bid")).withColumn("_month", F.date_trunc("month", "ts"))
    usual = q.where("spread > 0").groupBy(by, "_month").agg(F.median("spread").alias("_usual"))
    absurd = F.coalesce(F.col("spread") > times * F.col("_usual"), F.lit(False))
    return same_series(q, usual, [by, "_month"], "left").where((F.col("spread") >= 0) & ~absurd).drop("_month", "_usual")


def quote_bars(quotes: DataFrame, width: str, seq: list[str], by: str = "symbol") -> DataFrame:
    """Bars of the mid price with the last bid and ask, the spread's mean and median, and the number of ticks."""
    order, mid = F.struct("ts", *seq), (F.col("bid") + F.col("ask")) / 2
    q = quotes.withColumns({"_mid": mid, "_order": order, "spread": F.col("ask") - F.col("bid")})
    first, last = (lambda c: F.min_by(c, "_order")), (lambda c: F.max_by(c, "_order"))
    out = q.groupBy(by, F.window("ts", width).start.alias("bucket")).agg(
        first("_mid").alias("open"), F.max("_mid").alias("high"), F.min("_mid").alias("low"), last("_mid").alias("close"),
        last("bid").alias("bid_close"), last("ask").alias("ask_close"), F.avg("spread").alias("spread_mean"), F.median("spread").alias("spread_median"), F.count("*").alias("tick_count"),
    )
    return out.withColumnRenamed("bucket", "ts")
