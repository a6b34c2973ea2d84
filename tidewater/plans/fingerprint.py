"""What happened after anchor bars, over several horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import along, windowed


def fingerprint(numbered_bars: DataFrame, anchor: Column, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each anchor and horizon h whose h bars are there: symbol, rn, ts, h, return r (logarithm), largest and
    smallest move mfe and mae (shares of the anchor's close), and after how many bars they first came.

    The bars ahead of an anchor are one frame of at most max(horizons) rows, sliced for each horizon."""
    most = max(horizons)
    ahead = F.collect_list(F.struct("high", "low", "close")).over(along().rowsBetween(1, most))
    rows = windowed(numbered_bars, {"_next": ahead}, ahead=most).where(anchor)
    each = rows.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).where(F.size("_next") >= F.col("h")).withColumn("_n", F.expr("slice(_next, 1, h)"))
    hi, lo = F.array_max(F.col("_n.high")), F.array_min(F.col("_n.low"))
    return each.select(
        "symbol", "rn", "ts", "h",
        F.log(F.element_at(F.col("_n.close"), -1) / F.col("close")).alias("r"),
        (hi / F.col("close") - 1).alias("mfe"),
        (lo / F.col("close") - 1).alias("mae"),
        F.array_position(F.col("_n.high"), hi).alias("t_mfe"),
        F.array_position(F.col("_n.low"), lo).alias("t_mae"),
    )
