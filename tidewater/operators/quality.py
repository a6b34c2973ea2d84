"""Quality of sources: coverage of trading sessions, clock offsets between two sources, agreement, and seams where the source changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import along, numbered, same_series, windowed

#: Minutes of trading on each day of the week from Monday: a break from 21:00 to 22:00, closed from Friday 21:00 to Sunday 22:00.
SESSION_MINUTES = (1380, 1380, 1380, 1380, 1260, 0, 120)


def in_session(ts: str = "ts") -> Column:
    day, hour = F.weekday(ts), F.hour(ts)
    return ~((day == 5) | ((day == 6) & (hour < 22)) | ((day == 4) & (hour >= 21)) | ((day <= 3) & (hour == 21)))


def session_coverage(ticks: DataFrame, by: str = "symbol", holidays: list[str] | None = None) -> DataFrame:
    """by, year, month, covered (session minutes with a tick), expected (session minutes of the month, holidays left out) and coverage in
    percent. The grid of a month is counted from its days, so no row is made for a minute without a tick. Null times are left out."""
    t = ticks.where(F.col("ts").isNotNull()).withColumn("_month", F.trunc(F.to_date("ts"), "month"))
    closed = F.array(*[F.lit(h).cast("date") for h in holidays]) if holidays else F.array().cast("array<date>")
    open_ = in_session() & ~F.array_contains(closed, F.to_date("ts"))
    seen = t.groupBy(by, "_month", F.when(open_, F.floor(F.unix_micros("ts") / 60_000_000)).alias("_minute")).agg(F.count("*").alias("_n"))
    covered = seen.groupBy(by, "_month").agg(F.count("_minute").alias("covered"))
    length = F.array(*map(F.lit, SESSION_MINUTES))
    days = F.filter(F.sequence(F.col("_month"), F.last_day("_month")), lambda d: ~F.array_contains(closed, d))
    expected = F.aggregate(days, F.lit(0), lambda n, d: n + F.element_at(length, F.weekday(d) + 1)).cast("long")
    out = covered.withColumn("expected", expected)
    return out.select(by, F.year("_month").alias("year"), F.month("_month").alias("month"), "covered", "expected", (100 * F.col("covered") / F.when(F.col("expected") > 0, F.col("expected"))).alias("coverage"))


def changes(points: DataFrame, by: str, unit_seconds: int, price: str = "price", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """by, period (month), t (number of the unit of time), p (last price of the unit) and r (logarithmic change from the unit before that has a price)."""
    cell = F.floor(F.unix_micros("ts") / (unit_seconds * 1_000_000))
    last = points.where(F.col("ts").isNotNull() & (F.col(price) > 0)).groupBy(by, cell.alias("t")).agg(F.max_by(price, F.struct(*order)).alias("p"))
    last = last.withColumn("ts", F.timestamp_seconds(F.col("t") * unit_seconds))
    return windowed(numbered(last, by), {"r": F.log(F.col("p") / F.lag("p").over(along(by)))}, back=1, by=by).select(by, "ts", "t", "p", "r")


def _correlations(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and offset: a moved back by the offset beside b."""
    moved = a.select(*keys, "off", (F.col("t") - F.col("off")).alias("t"), "r")
    both = moved.join(b.select("t", F.col("r").alias("_b")), "t").where("r is not null and _b is not null")
    return both.groupBy(*keys, "off").agg(F.corr("r", "_b").alias("corr"), F.count("*").alias("n"))


def clock_offsets(a: DataFrame, b: DataFrame, coarse: tuple[int, int], fine: tuple[int, int], snap: int, least: int, good: float = 0.95, fair: float = 0.9, coarser: int = 4) -> DataFrame:
    """How far the clock of a is ahead of b's, by period. a: period, t, p, r; b: t, p, r (as changes gives them, one series each).

    The best correlation on a coarse grid (reach, step) of offsets, then on a fine one around it (at least `least` common
    units; ties to the smaller offset), snapped to a multiple of `snap`. agreement is the correlation of changes over `coarser` units at that
    offset. flag: ok, ok_coarse or low_quality by these two, and no_overlap; a period of low quality takes the offset of the nearest good one (ties: the earlier)."""
    pick = lambda g, keys: g.where((F.col("n") >= least) & F.col("corr").isNotNull()).groupBy(*keys).agg(F.max_by(F.struct("off", "corr", "n"), F.struct("corr", -F.col("off"))).alias("_best"))
    reach, step = coarse
    first = pick(_correlations(a.withColumn("off", F.explode(F.sequence(F.lit(-reach), F.lit(reach), F.lit(step)))), b, ["period"]), ["period"])
    reach, step = fine
    near = a.join(first.select("period", F.col("_best.off").alias("_o")), "period").withColumn("off", F.explode(F.sequence(F.col("_o") - reach, F.col("_o") + reach, F.lit(step)))).drop("_o")
    best = pick(_correlations(near, b, ["period"]), ["period"]).select("period", (F.bround(F.col("_best.off") / snap) * snap).cast("int").alias("offset"), F.col("_best.corr").alias("corr"), F.col("_best.n").alias("n"))
    # changes over several units at the offset found
    def last(d: DataFrame, keys: list[str]) -> DataFrame:
        g = d.groupBy(*keys, F.floor(F.col("t") / coarser).alias("c")).agg(F.max_by("p", "t").alias("p"))
        return g.withColumn("r", F.log(F.col("p") / F.lag("p").over(Window.partitionBy(*keys, F.floor(F.col("c") / 4096)).orderBy("c"))))

    moved = last(a.join(best.select("period", "offset"), "period").withColumn("t", F.col("t") - F.col("offset")), ["period"])
    both = moved.join(last(b, []).select("c", F.col("r").alias("_b")), "c")
    agreed = both.groupBy("period").agg(F.corr("r", "_b").alias("agreement"))
    flag = F.when(F.col("corr").isNull(), "no_overlap").when(F.col("corr") >= good, "ok").when(F.col("agreement") >= fair, "ok_coarse").otherwise("low_quality")
    out = a.select("period").distinct().join(best, "period", "left").join(agreed, "period", "left").withColumn("flag", flag)
    # one row for each period from here on
    trusted = F.when(F.col("flag").isin("ok", "ok_coarse"), F.struct("period", "offset"))
    along_ = Window.orderBy("period")
    out = out.withColumn("_before", F.last(trusted, True).over(along_.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first(trusted, True).over(along_.rowsBetween(1, Window.unboundedFollowing)))
    nearer = F.when(F.col("_after").isNull() | (F.col("period") - F.col("_before.period") <= F.col("_after.period") - F.col("period")), F.col("_before")).otherwise(F.col("_after"))
    borrowed = F.when((F.col("flag") == "low_quality") & nearer.isNotNull(), nearer["offset"])
    return out.select("period", F.coalesce(borrowed, "offset").alias("offset"), "corr", "agreement", "n", "flag", (borrowed != F.col("offset")).alias("_b")).withColumn("borrowed", F.coalesce("_b", F.lit(False))).drop("_b")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sources on their common units: n, corr of changes, mean price difference, and the 95th percentile of its size in basis points. a, b: t, p, r."""
    both = a.select("t", F.col("p").alias("pa"), F.col("r").alias("ra")).join(b.select("t", F.col("p").alias("pb"), F.col("r").alias("rb")), "t")
    bps = F.abs(F.col("pa") - F.col("pb")) / F.col("pb") * 1e4
    return both.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("corr"), F.avg(F.col("pa") - F.col("pb")).alias("mean_diff"), F.percentile(F.round(bps, 4), F.lit(0.95)).alias("bps_p95"))


def seams(bars: DataFrame, reach_seconds: int, least: int = 5, by: str = "symbol") -> DataFrame:
    """Months whose usual source (ties: the smaller) differs from that of the month before, with bars on both sides of their start: by,
    month, before, after (sources), last_close, first_close, jump_bps, before_bps, after_bps (deviations of changes). Sides of fewer than `least` bars are left out.

    Boundaries are dealt to the cells of time that they reach, so bars meet them in an equi-join."""
    b = bars.withColumn("_month", F.date_trunc("month", "ts"))
    usual = b.groupBy(by, "_month", "source").agg(F.count("*").alias("_n")).groupBy(by, "_month").agg(F.max_by("source", F.struct("_n", -F.col("source"))).alias("after"))
    w = Window.partitionBy(by).orderBy("_month")
    turns = usual.withColumn("before", F.lag("after").over(w)).where("before != after")
    cell = lambda c: F.floor(F.unix_seconds(c) / reach_seconds)
    turns = turns.withColumn("_cell", F.explode(F.array(cell(F.col("_month")) - 1, cell(F.col("_month")), cell(F.col("_month")) + 1)))
    near = same_series(turns.withColumnRenamed("_month", "_at"), b.select(by, "ts", "close", cell(F.col("ts")).alias("_cell")), [by, "_cell"])
    gap = F.unix_seconds("ts") - F.unix_seconds("_at")
    near = near.where((gap >= -reach_seconds) & (gap < reach_seconds)).withColumn("_side", gap >= 0)
    near = near.withColumn("_r", F.log(F.col("close") / F.lag("close").over(Window.partitionBy(by, "_at", "_side").orderBy("ts"))))
    old, new = ~F.col("_side"), F.col("_side")
    g = near.groupBy(by, "_at", "before", "after").agg(
        F.count_if(old).alias("_n0"), F.count_if(new).alias("_n1"), F.max_by(F.when(old, F.col("close")), F.when(old, F.col("ts"))).alias("last_close"), F.min_by(F.when(new, F.col("close")), F.when(new, F.col("ts"))).alias("first_close"),
        (F.stddev_samp(F.when(old, F.col("_r"))) * 1e4).alias("before_bps"), (F.stddev_samp(F.when(new, F.col("_r"))) * 1e4).alias("after_bps"),
    )
    g = g.where((F.col("_n0") >= least) & (F.col("_n1") >= least))
    return g.select(by, F.col("_at").alias("month"), "before", "after", "last_close", "first_close", ((F.col("first_close") / F.col("last_close") - 1) * 1e4).alias("jump_bps"), "before_bps", "after_bps")
