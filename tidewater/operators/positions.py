"""What positions and stakes make, without a loop over bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import lag, numbered, running, streaks, windowed


def position_pnl(d: DataFrame, position: str, change: str, cost: float = 0.0002, by: str = "symbol") -> DataFrame:
    """Adds held, the position of the row before (0 for the first), and pnl: what it makes of the row's change, less
    cost for what was turned over to reach it."""
    none = F.lit(0)
    d = windowed(d, {"held": F.coalesce(lag(position), none), "_before": F.coalesce(lag(position, 2), none)}, back=2, by=by)
    return d.withColumn("pnl", F.col("held") * F.col(change) - cost * F.abs(F.col("held") - F.col("_before"))).drop("_before")


def martingale(trades: DataFrame, won: str, order: tuple[str, ...], gain: float = 2.0, cap: int = 16, start: float = 100.0, by: str = "symbol") -> DataFrame:
    """Stakes that double after each loss, up to cap, and fall back to 1 after a win. Adds lots, made and equity; what
    comes after ruin (equity of 0 or less) is not traded and goes.

    The stake depends only on the losses since the last win, so it is a run length; equity is a running sum."""
    d = streaks(numbered(trades, by, order), won, "_run", by, order)
    d = windowed(d, {"_lost": F.greatest(F.lit(0), -F.coalesce(lag("_run"), F.lit(0)))}, back=1, by=by, order=order)
    lots = F.least(F.lit(float(cap)), F.pow(F.lit(2.0), F.least(F.col("_lost"), F.lit(62))))
    d = d.withColumn("lots", lots).withColumn("made", F.col("lots") * F.when(F.col(won), gain).otherwise(-1.0))
    d = running(d, {"_sum": ("sum", "made")}, by).withColumn("equity", start + F.col("_sum"))
    d = windowed(running(d, {"_low": ("min", "equity")}, by), {"_was": lag("_low")}, back=1, by=by, order=order)
    return d.where("_was is null or _was > 0").drop("_run", "_lost", "_sum", "_low", "_was")
