"""States of a market by day, anchors of a study, and patterns of a bar in its context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.ordered import along, numbered, over, windowed
from ..operators.ranks import above_quantile, earlier_ranks
from ..operators.scan import cooldown, ewm
from .impulses import impulses, new_extremes, once, resolved

THIRDS, FIFTHS = (1 / 3, 2 / 3), (0.2, 0.4, 0.6, 0.8)
STATES = ("m1", "m2", "m3", "m4", "m5")
#: Hours (UTC) at which sessions begin; minutes of the day of the London morning, of the box, and of the time in which its break counts.
SESSION_STARTS = (0, 7, 12, 17)
LONDON, BOX, BREAK = (420, 780), (810, 840), (840, 1080)
#: Weights of patterns in the lean.
WEIGHTS = {"ema_detach": 2, "box_break": 2, "london_agrees": 2, "range_extreme": 1, "pullback": 1, "rsi_extreme": 1}


def trailing_buckets(df: DataFrame, columns: dict[str, tuple[str, tuple[float, ...]]], warm: int, by: str = "symbol") -> DataFrame:
    """by, rn, ts and for each new name: (column, shares) the number of quantiles of all its earlier values that the column exceeds; null until `warm` values came before, 0 for
    a missing one after that. df is numbered. All columns are ranked at once, as series of their own."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(x).cast("double").alias("x")) for n, (x, _) in columns.items()]))
    long = df.select(by, "rn", "ts", each.alias("_e")).select(by, "rn", "ts", F.col("_e.n").alias("_n"), F.col("_e.x").alias("_x_"), F.to_json(F.struct(F.col(by).alias("by"), "_e.n")).alias("_key"))
    r = earlier_ranks(long, "_x_", "_key")
    count = lambda shares: sum((F.coalesce(above_quantile(q, "_x_"), F.lit(False)).cast("int") for q in shares), F.lit(0))
    out = [F.max(F.when((F.col("_n") == n) & (F.col("n_before") >= warm), count(shares))).alias(n) for n, (_, shares) in columns.items()]
    return r.groupBy(by, "rn", "ts").agg(*out)


def sign_memory(sign: str, n: int, by: str = "symbol") -> Column:
    """Correlation of the last n signs with the ones before them (n - 1 pairs), 0 where either side does not vary; null with fewer than n rows. Sums of
    whole numbers, so exact up to the last division. `_past` has to hold the sign before."""
    w = along(by).rowsBetween(-(n - 2), 0)
    s = lambda x: F.sum(x).over(w)
    a, b = F.col("_past"), F.col(sign)
    va, vb = (n - 1) * s(a * a) - s(a) * s(a), (n - 1) * s(b * b) - s(b) * s(b)
    r = F.when((va == 0) | (vb == 0), 0.0).otherwise(((n - 1) * s(a * b) - s(a) * s(b)) / F.sqrt((va * vb).cast("double")))
    return F.when(F.count(a).over(w) == n - 1, r)


def market_states(daily: DataFrame, driver: DataFrame, short: int = 5, long: int = 20, memory: int = 40, trend: int = 200, warm: int = 504, delay: int = 1, by: str = "symbol") -> DataFrame:
    """by, ts and STATES, as far as known `delay` days (rows) before: terciles of volatility (m1), of the logarithm of short over long volatility (m2), of the
    memory of signs (m3), quintiles of the distance from a long mean in daily moves (m4), terciles of a driver's change over five calendar days, two days old (m5).

    daily: by, ts, close. driver: ts, value, one row a date; between its dates the last value stands. A state is null until `warm` earlier values, and null on the first `delay` days."""
    d = numbered(daily.select(by, "ts", "close"), by)
    d = windowed(d, {"_r": F.col("close") / F.when(F.lag("close").over(along(by)) != 0, F.lag("close").over(along(by))) - 1}, back=1, by=by)
    d = once(d.withColumn("_sign", F.coalesce(F.signum("_r"), F.lit(0.0)).cast("long")))
    back = max(long, memory, trend)
    d = windowed(d, {"_past": F.lag("_sign").over(along(by)), "_sd": over(F.stddev_samp("_r"), "_r", long, by=by), "_sds": over(F.stddev_samp("_r"), "_r", short, by=by), "_mean": over(F.avg("close"), "close", trend, by=by), "_memory": sign_memory("_sign", memory, by)}, back=back, by=by)
    some = lambda x: F.when(F.col(x) != 0, F.col(x))
    d = d.withColumns({"_term": F.log(some("_sds") / some("_sd")), "_far": (F.col("close") - F.col("_mean")) / (some("_sd") * some("close")), "_seen": F.date_sub(F.to_date("ts"), 2).cast("timestamp"), "_seen5": F.date_sub(F.to_date("ts"), 7).cast("timestamp")})
    for at, name in (("_seen", "_now"), ("_seen5", "_then")):
        d = asof_join(d, driver.where(F.col("value").isNotNull()).select(F.col("ts").alias("_at_"), F.col("value").alias(name)), at, "_at_", bucket="month", prefix="").drop("_at_")
    d = d.withColumn("_moved", F.col("_now") / some("_then") - 1)
    d = trailing_buckets(d, {"m1": ("_sd", THIRDS), "m2": ("_term", THIRDS), "m3": ("_memory", THIRDS), "m4": ("_far", FIFTHS), "m5": ("_moved", THIRDS)}, warm, by)
    return windowed(d.select(by, "rn", "ts", *[F.col(s).alias(f"_{s}") for s in STATES]), {s: F.lag(f"_{s}", delay).over(along(by)) for s in STATES}, back=delay, by=by).select(by, "ts", *STATES)


def release_bars(bars: DataFrame, schedule: DataFrame, seconds: int, by: str = "symbol") -> DataFrame:
    """The last bar (by, rn, ts) that has begun when a release comes out, if it lasts (`seconds`) beyond it: one row for each series and release. A release meets the bars of its own
    cell of time and of the cell before, so this is a join on equality."""
    cell = lambda c: F.floor(F.unix_micros(c) / (seconds * 1_000_000))
    s = schedule.select("kind", "when").withColumn("_cell", F.explode(F.array(cell("when"), cell("when") - 1)))
    b = bars.select(by, "rn", "ts").withColumn("_cell", cell("ts"))
    late = F.unix_micros("when") - F.unix_micros("ts")
    met = b.join(s, "_cell").where((late >= 0) & (late < seconds * 1_000_000))
    return met.groupBy(by, "kind", "when").agg(F.max_by(F.struct("rn", "ts"), "rn").alias("_b")).select(by, "_b.rn", "_b.ts")


def lengthened(b: DataFrame, by: str = "symbol") -> DataFrame:
    """Numbered bars, and after each series its last bar once more, so that the last one has a next one."""
    ends = b.groupBy(by).agg(F.max_by(F.struct("ts", "rn", "open", "high", "low", "close"), "rn").alias("_e")).select(by, F.col("_e.ts"), (F.col("_e.rn") + 1).alias("rn"), "_e.open", "_e.high", "_e.low", "_e.close")
    return b.select(by, "ts", "rn", "open", "high", "low", "close").unionByName(ends)


def anchors(bars: DataFrame, schedule: DataFrame, rows: int = 4, deviations: float = 2.0, sigma: int = 480, gap: int = 16, lookback: int = 96, seconds: int = 900, by: str = "symbol") -> DataFrame:
    """by, anchor, rn, dir: where a study looks from. A1 every `rows`-th bar, A2 impulses, A3 new extremes of `lookback` bars (the last bar of a series among them), A4 starts of sessions,
    A5 bars in which a release falls (once for each release), A6 bars at which an impulse was resolved (once for each impulse). dir is 0 where an anchor has none.

    bars: by, ts, open, high, low, close. schedule: kind, when."""
    b = bars if "rn" in bars.columns else once(numbered(bars, by))
    put = lambda df, name, rn, side: df.select(by, F.lit(name).alias("anchor"), F.col(rn).cast("long").alias("rn"), side.cast("int").alias("dir"))
    none = F.lit(0)
    found = impulses(b, rows, sigma, deviations, by)
    kept = cooldown(found.withColumn("rn", F.col("last")).select(by, "rn", "ts", "dir"), gap, by)
    extremes = new_extremes(lengthened(b, by), F.lit(True), lookback, gap, by)
    starts = b.where((F.minute("ts") == 0) & F.hour("ts").isin(*SESSION_STARTS))
    parts = [
        put(b.where(F.col("rn") % rows == 0), "A1", "rn", none), put(kept, "A2", "rn", F.col("dir")), put(extremes, "A3", "rn", F.col("side")), put(starts, "A4", "rn", none),
        put(release_bars(b, schedule, seconds, by), "A5", "rn", none), put(resolved(b, found, gap, by=by), "A6", "res", F.col("dir")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context_patterns(bars: DataFrame, reach: int = 288, box_rows: int = 5, warm: int = 60, by: str = "symbol") -> DataFrame:
    """by, rn, ts, for each of WEIGHTS the direction in which the pattern fires (0: it does not), and lean, their weighted sum. Rows before `warm` bars are left out.

    ema_detach: the bar lies beyond its mean of 5, against it. box_break: the first break of the day's box of at least `box_rows` bars, up if it came before one down (both at once: down).
    london_agrees: the London morning moved the way of that break. range_extreme: the close is within 3 % of an end of the range, against it. pullback: the
    close is on the other side of the mean of 20 than the trend goes. rsi_extreme: below 30 or above 70, against it. A day's bars are one window."""
    b = once(numbered(bars.select(by, "ts", "open", "high", "low", "close"), by))
    change = F.col("close") - F.lag("close").over(along(by))
    w = along(by).rowsBetween(-(reach - 1), 0)
    b = windowed(b, {"_d": change, "_hi": F.max("high").over(w), "_lo": F.min("low").over(w)}, back=reach, by=by)
    b = once(b.withColumns({"_gain": F.greatest(F.col("_d"), F.lit(0.0)) * F.when(F.col("_d").isNotNull(), 1), "_loss": F.greatest(-F.col("_d"), F.lit(0.0)) * F.when(F.col("_d").isNotNull(), 1)}))
    b = ewm(b, {"_e5": ("close", 2 / 6), "_e20": ("close", 2 / 21), "_e50": ("close", 2 / 51), "_g": ("_gain", 1 / 14), "_l": ("_loss", 1 / 14)}, by)
    minute = F.hour("ts") * 60 + F.minute("ts")
    inside = lambda span, x: F.when((F.col("_m") >= span[0]) & (F.col("_m") < span[1]), x)
    day = Window.partitionBy(by, F.to_date("ts")).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("_m") >= BREAK[0]
    b = b.withColumn("_m", minute).withColumns({"_top": F.max(inside(BOX, F.col("high"))).over(day), "_bottom": F.min(inside(BOX, F.col("low"))).over(day), "_n": F.count(inside(BOX, F.lit(1))).over(day), "_first": F.first(inside(LONDON, F.col("close")), True).over(day), "_last": F.last(inside(LONDON, F.col("close")), True).over(day)})
    b = b.withColumns({"_up": F.min(F.when(after & (F.col("high") >= F.col("_top")), F.col("rn"))).over(day), "_down": F.min(F.when(after & (F.col("low") <= F.col("_bottom")), F.col("rn"))).over(day)})
    fires = (F.col("_n") >= box_rows) & inside(BREAK, F.lit(True)) & (F.col("_up").isNotNull() | F.col("_down").isNotNull())
    broke = F.when(fires, F.when(F.col("_up").isNotNull() & (F.col("_down").isNull() | (F.col("_up") < F.col("_down"))), 1).otherwise(-1)).otherwise(0)
    place = F.when(F.col("_hi") > F.col("_lo"), (F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    trend, gap = F.signum(F.col("_e20") - F.col("_e50")), F.col("close") - F.col("_e20")
    rsi = 100 - 100 / (1 + F.col("_g") / F.when(F.col("_l") != 0, F.col("_l")))
    b = b.withColumns({
        "ema_detach": F.when(F.col("low") > F.col("_e5"), -1).when(F.col("high") < F.col("_e5"), 1).otherwise(0), "box_break": broke, "range_extreme": F.when(place > 0.97, -1).when(place < 0.03, 1).otherwise(0),
        "pullback": F.when((trend > 0) & (gap < 0), 1).when((trend < 0) & (gap > 0), -1).otherwise(0), "rsi_extreme": F.when(rsi < 30, 1).when(rsi > 70, -1).otherwise(0),
    })
    b = b.withColumn("london_agrees", F.when((F.col("box_break") != 0) & (F.signum(F.col("_last") - F.col("_first")) == F.col("box_break")), F.col("box_break")).otherwise(0))
    lean = sum((weight * F.col(name) for name, weight in WEIGHTS.items()), F.lit(0))
    return b.where(F.col("rn") >= warm - 1).select(by, "rn", "ts", *WEIGHTS, lean.alias("lean"))
