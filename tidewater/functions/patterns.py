"""Candlestick patterns of one to three bars as predicates over a bar and the bars before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import along, over, windowed

#: Name, direction (as SQL), and when it shows. o, h, l, c are prices of the bar; o1, o2, ... of the bars
#: before; rng and body the range and the body; upper and lower the wicks; atr the mean range of 14 bars (3 at least);
#: rising and falling the trend of the three bars before the last.
CANDLES: dict[str, tuple[str, str]] = {
    "doji": ("0", "body < 0.1 * rng and rng > 0.4 * atr"),
    "hammer": ("1", "body < 0.3 * rng and lower > 2 * body and upper < body and falling"),
    "hanging_man": ("-1", "body < 0.3 * rng and lower > 2 * body and upper < body and rising"),
    "shooting_star": ("-1", "body < 0.3 * rng and upper > 2 * body and lower < body and rising"),
    "inverted_hammer": ("1", "body < 0.3 * rng and upper > 2 * body and lower < body and falling"),
    "marubozu_bull": ("1", "c > o and upper < 0.05 * rng and lower < 0.05 * rng and body > atr"),
    "marubozu_bear": ("-1", "c < o and upper < 0.05 * rng and lower < 0.05 * rng and body > atr"),
    "bullish_engulfing": ("1", "c1 < o1 and c > o and c >= o1 and o <= c1 and body > body1"),
    "bearish_engulfing": ("-1", "c1 > o1 and c < o and o >= c1 and c <= o1 and body > body1"),
    "bullish_harami": ("1", "c1 < o1 and c > o and greatest(o, c) < o1 and least(o, c) > c1"),
    "bearish_harami": ("-1", "c1 > o1 and c < o and greatest(o, c) < c1 and least(o, c) > o1"),
    "piercing_line": ("1", "c1 < o1 and c > o and o < l1 and c > (o1 + c1) / 2 and c < o1"),
    "dark_cloud_cover": ("-1", "c1 > o1 and c < o and o > h1 and c < (o1 + c1) / 2 and c > o1"),
    "inside_bar": ("0", "h < h1 and l > l1"),
    "outside_bar": ("int(sign(c - o))", "h > h1 and l < l1"),
    "morning_star": ("1", "c2 < o2 and body2 > 0.6 * atr and body1 < 0.4 * rng1 and c > o and c > (o2 + c2) / 2"),
    "evening_star": ("-1", "c2 > o2 and body2 > 0.6 * atr and body1 < 0.4 * rng1 and c < o and c < (o2 + c2) / 2"),
    "three_white_soldiers": ("1", "c > o and c1 > o1 and c2 > o2 and c > c1 and c1 > c2 and body > 0.5 * rng and body1 > 0.5 * rng1 and body2 > 0.5 * rng2"),
    "three_black_crows": ("-1", "c < o and c1 < o1 and c2 < o2 and c < c1 and c1 < c2 and body > 0.5 * rng and body1 > 0.5 * rng1 and body2 > 0.5 * rng2"),
}


def candle_columns(bars: DataFrame, names: tuple[str, ...] = tuple(CANDLES)) -> DataFrame:
    """Adds patterns (names that show, from the fifth bar of a series on) and lean (the sum of their directions)."""
    shape = {"rng": F.greatest(F.col("high") - F.col("low"), F.lit(1e-9)), "body": F.abs(F.col("close") - F.col("open"))}
    short = {"o": "open", "h": "high", "l": "low", "c": "close"}
    ready = bars.withColumns({**{k: F.col(v) for k, v in short.items()}, **shape})
    before: dict[str, Column] = {f"{c}{k}": F.lag(c, k).over(along()) for k in (1, 2) for c in (*short, *shape)}
    before |= {"c4": F.lag("c", 4).over(along()), "atr": over(F.avg("rng"), "rng", 14, 3)}
    ready = windowed(ready, before, back=13)
    ready = ready.withColumns({"upper": F.expr("h - greatest(o, c)"), "lower": F.expr("least(o, c) - l"), "rising": F.expr("c1 > c4"), "falling": F.expr("c1 < c4")})
    found = F.array(*[F.when(F.expr(CANDLES[n][1]) & (F.col("rn") >= 4), F.struct(F.lit(n).alias("name"), F.expr(CANDLES[n][0]).cast("int").alias("direction"))) for n in names])
    out = ready.withColumn("_f", F.array_compact(found))
    lean = F.aggregate("_f", F.lit(0), lambda a, p: a + p.direction)
    return out.select(*bars.columns, F.transform("_f", lambda p: p["name"]).alias("patterns"), lean.alias("lean"))
