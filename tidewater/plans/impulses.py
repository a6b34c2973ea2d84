"""Impulses over groups of bars, what becomes of them, and new extremes in quiet markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import along, lag, numbered, rolling_std, same_series, windowed
from ..operators.ranks import above_quantile, earlier_ranks
from ..operators.scan import cooldown
from ..shared import Written


def once(df: DataFrame) -> DataFrame:
    """df as a table: what is built on it several times is computed once."""
    return Written(df.sparkSession).table(df, keep=True)


def grouped_bars(bars: DataFrame, rows: int = 4, by: str = "symbol") -> DataFrame:
    """Bars of `rows` consecutive rows each, from the first row at a full hour on: by, g (number), first (number of the first
    row), last, ts, open, close, n. A group has to end before the last row of its series."""
    b = bars if "rn" in bars.columns else numbered(bars, by)
    starts = b.groupBy(by).agg(F.coalesce(F.min(F.when(F.minute("ts") == 0, F.col("rn"))), F.lit(0)).alias("_start"), F.count("*").alias("n"))
    b = same_series(b, starts, [by]).where(F.col("rn") >= F.col("_start")).withColumn("g", F.floor((F.col("rn") - F.col("_start")) / rows))
    out = b.groupBy(by, "g", "n").agg(F.min("rn").alias("first"), F.max("rn").alias("last"), F.min_by("ts", "rn").alias("ts"), F.min_by("open", "rn").alias("open"), F.max_by("close", "rn").alias("close"))
    return out.where(F.col("first") < F.col("n") - rows)


def impulses(bars: DataFrame, rows: int = 4, window: int = 20, deviations: float = 2.0, by: str = "symbol") -> DataFrame:
    """grouped_bars whose move is at least so many deviations of the groups' returns; with dir and the close of the next such
    group (next_last: its last row, null if none)."""
    g = once(grouped_bars(bars, rows, by)).withColumn("_ret", F.col("close") / F.col("open") - 1).withColumn("rn", F.col("g"))
    g = windowed(g, {"_sd": rolling_std("_ret", window)}, back=window - 1, by=by)
    g = g.where(F.abs(F.col("close") - F.col("open")) / (F.col("_sd") * F.col("open")) >= deviations).drop("rn", "_ret", "_sd")
    g = windowed(g, {"next_last": F.lead("last").over(along(by))}, ahead=1, by=by).drop("rn")
    return once(g.withColumn("dir", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)))


def resolved(bars: DataFrame, found: DataFrame, gap: int = 16, timeout: int = 96, warm: int = 20, by: str = "symbol") -> DataFrame:
    """What came of impulses at least `gap` rows apart: by, at (last row of the impulse), dir, origin, price, kind, res (row), duration, and
    bucket, the tercile of the duration among those of earlier impulses (null for the first `warm`).

    The first of three wins: the close gives half of the move back (retraced), goes on by half of it (extended), or the next
    impulse, whichever it is, has ended (superseded, which also wins a tie). After `timeout` rows it is a timeout."""
    b = bars if "rn" in bars.columns else numbered(bars, by)
    kept = cooldown(found.withColumn("rn", F.col("last")), gap, by).select(by, F.col("rn").alias("at"), "ts", "dir", F.col("open").alias("origin"), F.col("close").alias("price"), "next_last", "n")
    kept = once(kept)
    e = kept.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("at") + 1) / timeout), F.floor((F.col("at") + timeout) / timeout))))
    rows = b.select(by, "rn", F.col("close").alias("_c"), F.floor(F.col("rn") / timeout).alias("_cell"))
    met = same_series(e, rows, [by, "_cell"]).where((F.col("rn") > F.col("at")) & (F.col("rn") <= F.col("at") + timeout))
    half, height = 0.5 * F.abs(F.col("price") - F.col("origin")), F.col("dir") * (F.col("_c") - F.col("price"))
    hit = F.when(height <= -half, "retraced").when(height >= half, "extended")
    first = met.groupBy(by, "at").agg(F.min(F.when(hit.isNotNull(), F.struct("rn", hit.alias("kind")))).alias("_x"))
    out = same_series(kept, first, [by, "at"], "left")
    over = F.col("next_last") <= F.least(F.col("at") + timeout, F.col("n") - 1)
    cut = F.coalesce(over & (F.col("_x").isNull() | (F.col("next_last") <= F.col("_x.rn"))), F.lit(False))
    res = F.when(cut, F.col("next_last")).otherwise(F.coalesce("_x.rn", F.least(F.col("at") + timeout, F.col("n") - 1)))
    kind = F.when(cut, "superseded").otherwise(F.coalesce("_x.kind", F.lit("timeout")))
    out = out.withColumns({"res": res, "kind": kind}).withColumn("duration", F.when(F.col("kind") == "timeout", F.lit(timeout)).otherwise(F.col("res") - F.col("at")))
    ranked = earlier_ranks(out.withColumn("duration", F.col("duration").cast("double")), "duration", by, ("ts",))
    bucket = sum((above_quantile(k / 3, "duration").cast("int") for k in (1, 2)), F.lit(0))
    return ranked.select(by, "at", "ts", "dir", "origin", "price", "kind", "res", F.col("duration").cast("long").alias("duration"), F.when(F.col("n_before") >= warm, bucket).alias("bucket"))


def last_resolution(events: DataFrame, by: str = "symbol") -> DataFrame:
    """For each row at which impulses were resolved the latest of them: by, res, dir, origin, duration, bucket."""
    pick = F.max_by(F.struct("dir", "origin", "duration", "bucket"), "at").alias("_e")
    return events.groupBy(by, "res").agg(pick).select(by, "res", "_e.*")


def quiet_days(daily_close: DataFrame, window: int = 20, warm: int = 504, by: str = "symbol") -> DataFrame:
    """by, ts, quiet, rv, share: whether the deviation of daily returns of the day before was in the lowest third of all before it, that deviation,
    and the share of earlier ones below it. daily_close: by, ts, close. Days before `warm` are not quiet."""
    d = numbered(daily_close, by)
    d = windowed(d, {"_r": F.col("close") / lag("close") - 1}, back=1, by=by)
    d = windowed(d, {"rv": rolling_std("_r", window)}, back=window - 1, by=by)
    d = earlier_ranks(d, "rv", by)
    low = F.coalesce(~above_quantile(1 / 3, "rv") & (F.col("n_before") >= warm), F.lit(False))
    d = d.withColumns({"_low": low, "_share": F.when(F.col("n_before") >= max(warm - 1, 1), F.col("below") / F.col("n_before"))})
    return windowed(d, {"quiet": F.coalesce(F.lag("_low").over(along(by)), F.lit(False)), "rv_before": F.lag("rv").over(along(by)), "share": F.lag("_share").over(along(by))}, back=1, by=by).select(by, "ts", "quiet", F.col("rv_before").alias("rv"), "share")


def new_extremes(bars: DataFrame, gate: Column, lookback: int = 96, gap: int = 32, by: str = "symbol") -> DataFrame:
    """Bars that pass the gate and reach the extreme of `lookback` bars, at least `gap` bars after the last such bar of their direction: by, rn, ts, side,
    entry_ts and entry (open of the next bar). Only bars that pass start a pause; a bar is taken upwards before downwards."""
    b = bars if "rn" in bars.columns else numbered(bars, by)
    w = along(by).rowsBetween(-(lookback - 1), 0)
    b = windowed(b, {"_top": F.max("high").over(w), "_low": F.min("low").over(w), "entry": F.lead("open").over(along(by)), "entry_ts": F.lead("ts").over(along(by))}, back=lookback - 1, ahead=1, by=by)
    ready = once(b.where(F.coalesce(gate, F.lit(False)) & (F.col("rn") >= lookback) & F.col("entry").isNotNull()))
    columns = [by, "rn", "ts", "side", "entry_ts", "entry"]
    up = once(cooldown(ready.where(F.col("high") >= F.col("_top")).withColumn("side", F.lit(1)).select(*columns), gap, by))
    taken = up.select(by, "rn", F.lit(True).alias("_up"))
    down = same_series(ready.where(F.col("low") <= F.col("_low")).withColumn("side", F.lit(-1)).select(*columns), taken, [by, "rn"], "left").where("_up is null").drop("_up")
    return up.unionByName(cooldown(down, gap, by))
