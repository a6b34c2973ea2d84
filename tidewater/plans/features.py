"""The feature frame of a monitor: about thirty columns of every bar, from that bar and earlier ones only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import along, numbered, over, rank_pct, streaks, windowed
from ..operators.scan import ewm
from .impulses import once

#: Minutes of the day (UTC) of the London morning and of the box before New York.
LONDON, BOX = (420, 780), (810, 840)
FEATURES = (
    "ret_a", "ret_b", "ret_c", "ret_d", "ema_f_gap", "ema_s_gap", "trend", "atr", "atr_pct", "atr_norm", "rsi", "macd_hist", "range_pos", "streak", "dist_hi_atr", "dist_lo_atr",
    "session", "dow", "mod", "london_drift_atr", "box_width_atr", "box_pos", "rv_long", "rv_short", "season",
)


def session_of(minute: Column) -> Column:
    """0 Asia, 1 London, 2 New York morning, 3 afternoon, by starts at 07:00, 12:00 and 17:00."""
    return F.when(minute < 420, 0).when(minute < 720, 1).when(minute < 1020, 2).otherwise(3)


def feature_frame(
    bars: DataFrame, steps: tuple[int, int, int, int] = (1, 3, 12, 288), rank: tuple[int, int] = (60 * 288, 288), reach: tuple[int, int] = (288, 20), volatility: tuple[int, int] = (12, 3), season: tuple[int, int] = (20 * 288, 288), by: str = "symbol"
) -> DataFrame:
    """by, rn, ts, close and FEATURES for each bar (by, ts, open, high, low, close). Missing values and zero denominators give null.

    What a day's London morning and box are is known as far as the bar: the drift so far, and the box as far as it has formed. The usual size of a change at a
    minute of the day is the mean over earlier days, so no feature looks ahead."""
    b = once(numbered(bars.select(by, "ts", "open", "high", "low", "close"), by))
    before = F.lag("close").over(along(by))
    minute = F.hour("ts") * 60 + F.minute("ts")
    change = F.col("close") - before
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    first = {"_tr": true_range, "_r": F.col("close") / F.when(before != 0, before) - 1, "_d": change, "_gain": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), "_loss": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0))), "mod": minute}
    for name, k in zip(("ret_a", "ret_b", "ret_c", "ret_d"), steps):
        past = F.lag("close", k).over(along(by))
        first[name] = F.col("close") / F.when(past != 0, past) - 1
    span, least = reach
    first |= {"_hi": over(F.max("high"), "high", span, least, by), "_lo": over(F.min("low"), "low", span, least, by)}
    b = once(windowed(b, first, back=max(*steps, span), by=by))
    means = {"_f": ("close", 2 / 21), "_s": ("close", 2 / 51), "_t": ("close", 2 / 201), "atr": ("_tr", 1 / 14), "_g": ("_gain", 1 / 14), "_l": ("_loss", 1 / 14), "_m12": ("close", 2 / 13), "_m26": ("close", 2 / 27)}
    b = once(ewm(b, means, by).withColumn("_macd", F.col("_m12") - F.col("_m26")))
    b = once(ewm(b, {"_sig": ("_macd", 2 / 10)}, by))
    long, short = volatility
    wide, enough = season
    mean_change = F.avg(F.abs("_r")).over(along(by).rowsBetween(-(wide - 1), 0))
    last = {
        "atr_pct": rank_pct("atr", *rank), "rv_long": F.sqrt(over(F.sum(F.col("_r") ** 2), "_r", long, by=by)), "rv_short": F.sqrt(over(F.sum(F.col("_r") ** 2), "_r", short, by=by)),
        "_mean": F.when(F.count("_r").over(along(by).rowsBetween(-(wide - 1), 0)) >= enough, mean_change),
    }
    b = windowed(b, last, back=max(rank[0], long, wide), by=by)
    b = once(streaks(b.withColumn("_up", F.coalesce(F.col("_d") > 0, F.lit(False))), "_up", "_run", by))
    # a day and a minute of the day are windows of bounded length
    day = Window.partitionBy(by, F.to_date("ts")).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    minutes = Window.partitionBy(by, "mod").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda span, c: F.when((F.col("mod") >= span[0]) & (F.col("mod") < span[1]), F.col(c))
    b = b.withColumns({
        "_open": F.first(inside(LONDON, "close"), True).over(day), "_last": F.last(inside(LONDON, "close"), True).over(day), "_top": F.max(inside(BOX, "high")).over(day), "_bottom": F.min(inside(BOX, "low")).over(day),
        "_usual": F.avg(F.abs("_r")).over(minutes),
    })
    c, atr = F.col("close"), F.when(F.col("atr") != 0, F.col("atr"))
    some = lambda x: F.when(x != 0, x)
    out = {
        "ema_f_gap": (c - F.col("_f")) / atr, "ema_s_gap": (c - F.col("_s")) / atr, "trend": F.signum(F.col("_f") - F.col("_s")) + F.signum(F.col("_s") - F.col("_t")), "atr_norm": F.col("atr") / some(c),
        "rsi": 100 - 100 / (1 + F.col("_g") / some(F.col("_l"))), "macd_hist": (F.col("_macd") - F.col("_sig")) / atr, "range_pos": (c - F.col("_lo")) / some(F.col("_hi") - F.col("_lo")),
        "streak": F.when(F.col("_d") > 0, F.col("_run")).when(F.col("_d") < 0, F.col("_run")).otherwise(0), "dist_hi_atr": (F.col("_hi") - c) / atr, "dist_lo_atr": (c - F.col("_lo")) / atr,
        "session": session_of(F.col("mod")), "dow": F.weekday("ts"), "london_drift_atr": (F.col("_last") - F.col("_open")) / atr, "box_width_atr": (F.col("_top") - F.col("_bottom")) / atr, "box_pos": (c - F.col("_bottom")) / some(F.col("_top") - F.col("_bottom")),
        "season": F.col("_usual") / some(F.col("_mean")),
    }
    return b.withColumns(out).select(by, "rn", "ts", "close", *FEATURES)
