"""What bars of a higher timeframe say at a bar: only of those that have closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.ordered import along, numbered, over, windowed
from ..operators.scan import ewm
from .impulses import once

CONTEXT = ("slope", "rsi", "ret", "place", "above")


def rolled_up(bars: DataFrame, width: str, by: str = "symbol") -> DataFrame:
    """Bars of a greater width (an interval that divides a day) from bars: by, ts, open, high, low, close, n (bars within)."""
    return bars.groupBy(by, F.window("ts", width)["start"].alias("at")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("n")).withColumnRenamed("at", "ts")


def higher_context(bars: DataFrame, width: str = "1 hour", pip: float = 0.1, means: tuple[int, int] = (20, 50), back: tuple[int, int, int] = (3, 6, 20), prefix: str = "h1_", by: str = "symbol") -> DataFrame:
    """bars with the features of the last bar of `width` before the one that they are part of: slope of an exponential mean over back[0] bars in pips, RSI of 14, return over back[1] bars,
    place of the close in the range of back[2] bars, and whether the close is above the slower mean (1 or 0).

    A feature is null until there are bars enough, for a zero denominator, and before the first higher bar has been followed by another. The last bar before may be an old one, as it is after a weekend."""
    slope, ret, reach = back
    h = once(numbered(rolled_up(bars, width, by), by))
    change = F.col("close") - F.lag("close").over(along(by))
    up, down = F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))
    past = F.lag("close", ret).over(along(by))
    high, low = over(F.max("high"), "high", reach, by=by), over(F.min("low"), "low", reach, by=by)
    h = windowed(h, {"_up": up, "_down": down, "_ret": F.col("close") / F.when(past != 0, past) - 1, "_hi": high, "_lo": low}, back=max(ret, reach), by=by)
    h = once(ewm(h, {"_fast": ("close", 2 / (means[0] + 1)), "_slow": ("close", 2 / (means[1] + 1)), "_g": ("_up", 1 / 14), "_l": ("_down", 1 / 14)}, by))
    h = windowed(h, {"_then": F.lag("_fast", slope).over(along(by)), "_next": F.lead("ts").over(along(by))}, back=slope, ahead=1, by=by)
    found = [
        ((F.col("_fast") - F.col("_then")) / pip).alias("slope"), (100 - 100 / (1 + F.col("_g") / F.when(F.col("_l") != 0, F.col("_l")))).alias("rsi"), F.col("_ret").alias("ret"),
        ((F.col("close") - F.col("_lo")) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo"))).alias("place"), (F.col("close") > F.col("_slow")).cast("int").alias("above"),
    ]
    h = h.where("_next is not null").select(by, F.col("_next").alias("_from"), *found)
    return asof_join(bars, h, "ts", "_from", [by], bucket="month", prefix=prefix).drop(f"{prefix}_from")
