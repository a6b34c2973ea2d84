"""Weekly positions of groups of traders, made into daily positions, and what they would have earned.

A report is dated on its Tuesday and counts from the first trading day four days later on; a later report that falls on
the same day replaces the earlier one. Missing values of a signal are skipped, so the one before stays in force.

Tables are small beside their sources (a row for each series and week, or day), but no series is one task: rows are
numbered and cut into chunks. The random baseline is never a table of seeds by days: what a day earns is linear in the
position, and what a change costs depends on two reports only, so means over all seeds are taken for each report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.ordered import along, carry_last, missing_as_null, numbered, over, running, same_series, windowed
from .impulses import once

GROUPS = ("spec", "comm", "small")
#: In the order of the report.
VARIANTS = ("fade_z", "fade_extreme", "follow_comm", "fade_managed", "fade_change", "agree", "always", "random")
SIGNALS = VARIANTS[:6]
#: Earnings no larger than this are rounding.
NOTHING = 1e-12


def nets(report: DataFrame, second: DataFrame, by: str = "symbol") -> DataFrame:
    """Net positions and their share of open interest: spec, comm and small of the report, mm of a second source of the same date.

    report: by, ts, {spec,comm,small}_{long,short}, interest. second: ts, mm_long, mm_short, mm_interest, one row for each ts. Shares are null where nothing is open."""
    share = lambda n, of: F.col(n) / F.when(F.col(of) != 0, F.col(of))
    out = same_series(report, second, ["ts"], "left")
    out = out.withColumns({f"{g}_net": F.col(f"{g}_long") - F.col(f"{g}_short") for g in (*GROUPS, "mm")})
    out = out.withColumns({f"{g}_pct": share(f"{g}_net", "mm_interest" if g == "mm" else "interest") for g in (*GROUPS, "mm")})
    return out.select(by, "ts", *[f"{g}_net" for g in (*GROUPS, "mm")], *[f"{g}_pct" for g in (*GROUPS, "mm")])


def share_exceeded(x: str, n: int, by: str = "symbol") -> Column:
    """Share of the other rows of a window of n that x exceeds, missing ones among them; null if x is missing or fewer than half of n have a value."""
    w = along(by).rowsBetween(-(n - 1), 0)
    values = F.collect_list(x).over(w)
    rows = F.count(F.lit(1)).over(w) - 1
    return F.when(F.col(x).isNotNull() & (F.size(values) >= n // 2) & (rows > 0), F.size(F.filter(values, lambda v: v < F.col(x))) / rows)


def weekly_signals(net: DataFrame, window: int = 156, extreme: float = 0.2, by: str = "symbol") -> DataFrame:
    """by, ts, spec_pct and the six SIGNALS in [-1, 1] for each report. Those of extremes are 0 where nothing is extreme or known."""
    z = lambda x: (F.col(x) - over(F.avg(x), x, window, window // 2, by)) / F.when(over(F.stddev_samp(x), x, window, window // 2, by) > 0, over(F.stddev_samp(x), x, window, window // 2, by))
    held = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / 1.5))
    n = once(windowed(numbered(net, by), {"change": F.col("spec_pct") - F.lag("spec_pct").over(along(by))}, back=1, by=by))
    n = windowed(n, {
        "_zs": z("spec_pct"), "_zc": z("comm_pct"), "_zd": z("change"),
        "_rs": share_exceeded("spec_pct", window, by), "_rc": share_exceeded("comm_pct", window, by), "_rm": share_exceeded("mm_pct", window, by),
    }, back=window - 1, by=by)
    high, low = (lambda r: F.col(r) > 1 - extreme), (lambda r: F.col(r) < extreme)
    against = lambda r: F.when(high(r), -1.0).when(low(r), 1.0).otherwise(0.0)
    bounded = lambda x, sign: F.when(F.col(x).isNotNull(), held(sign * F.col(x)))
    return n.select(
        by, "ts", "spec_pct", bounded("_zs", -1).alias("fade_z"), against("_rs").alias("fade_extreme"), bounded("_zc", 1).alias("follow_comm"), against("_rm").alias("fade_managed"), bounded("_zd", -1).alias("fade_change"),
        F.when(high("_rs") & low("_rc"), -1.0).when(low("_rs") & high("_rc"), 1.0).otherwise(0.0).alias("agree"),
    )


def in_force(weekly: DataFrame, daily: DataFrame, columns: tuple[str, ...], delay: int = 4, by: str = "symbol") -> DataFrame:
    """by, ts, report (date of the last one) and the columns, for the days on which reports take effect: the first day of `daily` at least `delay` days after."""
    dated = weekly.select(by, F.col("ts").alias("report"), *columns).withColumn("_from", F.date_add(F.to_date("report"), delay).cast("timestamp"))
    days = daily.select(by, "ts")
    at = asof_join(dated, days, "_from", "ts", [by], "forward", bucket="year", prefix="day_").where("day_ts is not null")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("report"))).alias(c) for c in columns]
    return at.groupBy(by, F.col("day_ts").alias("ts")).agg(F.max("report").alias("report"), *last)


def drawn_side(seed: Column, report: Column) -> Column:
    """1 or -1 for a seed and a date."""
    return F.when(F.md5(F.concat(seed.cast("string"), F.lit(":"), F.date_format(report, "yyyy-MM-dd"))).substr(1, 1) < "8", -1).otherwise(1)


def random_means(taken: DataFrame, seeds: int = 200, by: str = "symbol") -> DataFrame:
    """taken (by, ts, report) with random (mean side over all seeds) and random_change (mean size of the change from the report before; from none: 1)."""
    sides = lambda c: F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), lambda s: drawn_side(s, F.col(c)))
    t = windowed(numbered(taken, by), {"_past": F.lag("report").over(along(by))}, back=1, by=by).drop("rn")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, v: x + v)
    moved = total(F.zip_with(sides("report"), sides("_past"), lambda a, b: F.abs(a - b))) / seeds
    return t.withColumns({"random": total(sides("report")) / seeds, "random_change": F.when(F.col("_past").isNull(), 1.0).otherwise(moved)}).drop("_past")


def daily_earnings(weekly: DataFrame, daily: DataFrame, cost_bps: float = 2.0, delay: int = 4, seeds: int = 200, by: str = "symbol") -> DataFrame:
    """by, rn, ts, hold (the series' own return) and a column for each of VARIANTS: position of the day before times the return since, less what that position's change cost.

    weekly: by, ts, SIGNALS. daily: by, ts, close, one row for each by and ts. The first day of a series is left out."""
    taken = once(random_means(in_force(weekly, daily, SIGNALS, delay, by), seeds, by))
    d = same_series(numbered(missing_as_null(daily.select(by, "ts", "close"), ["close"]), by), taken.drop("report"), [by, "ts"], "left")
    d = carry_last(d, {c: f"_{c}" for c in (*SIGNALS, "random")}, by)
    d = once(d.select(by, "rn", "ts", "close", *[F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in (*SIGNALS, "random")], F.lit(1.0).alias("always"), F.coalesce("random_change", F.lit(0.0)).alias("_c_random")))
    lag = lambda c: F.lag(c).over(along(by))
    columns: dict[str, Column] = {f"_c_{v}": F.abs(F.col(v) - F.coalesce(lag(v), F.lit(0.0))) for v in (*SIGNALS, "always")}
    columns["hold"] = F.col("close") / F.when(lag("close") != 0, lag("close")) - 1
    columns |= {f"_e_{v}": lag(v) * F.col("hold") - lag(f"_c_{v}") * (cost_bps / 1e4) for v in VARIANTS}
    return windowed(d, columns, back=2, by=by).where("rn > 0").select(by, "rn", "ts", "hold", *[F.col(f"_e_{v}").alias(v) for v in VARIANTS])


def by_windows(earned: DataFrame, windows: list[tuple[str, str, str]], least: int = 60, by: str = "symbol") -> DataFrame:
    """by, variant, span, n, cagr, sharpe, max_drawdown, hit and hold_cagr for each named half-open span of at least `least` days with a value. Spans may overlap.

    Growth is compounded; a day that loses all or more leaves nothing for the rest of the span. hit is the share of gains among days that earn or lose more than NOTHING."""
    spans = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(a).cast("timestamp").alias("a"), F.lit(z).cast("timestamp").alias("z")) for n, a, z in windows])
    each = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("r")) for v in VARIANTS])
    e = earned.withColumn("_s", F.explode(F.filter(spans, lambda s: (F.col("ts") >= s["a"]) & (F.col("ts") < s["z"])))).withColumn("_v", F.explode(each))
    log = lambda r: F.when(r > -1, F.log1p(r)).when(r.isNotNull(), F.lit(float("-inf")))
    e = e.select(F.struct(F.col(by), "_v.variant", "_s.span").alias("_k"), "rn", F.col("_v.r").alias("r"), log(F.col("_v.r")).alias("_l"), log(F.col("hold")).alias("_h")).where("r is not null")
    e = running(running(e, {"_eq": ("sum", "_l")}, "_k"), {"_peak": ("max", "_eq")}, "_k")
    years = F.count("*") / 252
    sd = F.stddev_samp("r")
    out = e.groupBy("_k").agg(
        F.count("*").alias("n"), (F.exp(F.sum("_l") / years) - 1).alias("cagr"), F.coalesce(F.avg("r") / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("sharpe"),
        F.min(F.nanvl(F.exp(F.col("_eq") - F.col("_peak")) - 1, F.lit(-1.0))).alias("max_drawdown"), F.avg(F.when(F.abs("r") > NOTHING, (F.col("r") > 0).cast("double"))).alias("hit"), (F.exp(F.sum("_h") / (F.count("_h") / 252)) - 1).alias("hold_cagr"),
    ).where(F.col("n") >= least)
    return out.select(f"_k.{by}", "_k.variant", "_k.span", "n", "cagr", "sharpe", "max_drawdown", "hit", "hold_cagr")


def weekly_outlook(taken: DataFrame, daily: DataFrame, signal: str, until: str | None = None, by: str = "symbol") -> DataFrame:
    """What followed a signal: by, ts (Friday of a week), signal as it stood at the end of the week, fwd (return of the next calendar week, null if that has no day), group 1 to 5 by
    quintiles (upper ends belong to a group) and ic, the rank correlation of the two. A series has a row for each week, few enough for one task."""
    d = same_series(numbered(daily.select(by, "ts", "close"), by), taken.select(by, "ts", F.col(signal).alias("_x")), [by, "ts"], "left")
    d = carry_last(d, {"_x": signal}, by)
    friday = F.next_day(F.date_sub(F.to_date("ts"), 1), "FRI")
    w = d.groupBy(by, friday.cast("timestamp").alias("ts")).agg(F.max_by("close", "rn").alias("close"), F.max_by(signal, "rn").alias(signal))
    series = Window.partitionBy(by)
    follows = F.lead("ts").over(series.orderBy("ts"))
    w = w.withColumn("fwd", F.when(F.datediff(follows, "ts") == 7, F.lead("close").over(series.orderBy("ts")) / F.when(F.col("close") != 0, F.col("close")) - 1))
    w = w.where(F.col(signal).isNotNull() & F.col("fwd").isNotNull())
    if until:
        w = w.where(F.col("ts") < F.lit(until).cast("timestamp"))
    cuts = F.percentile(signal, F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)])).over(series)
    rank = lambda c: F.rank().over(series.orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    w = w.withColumns({"_cuts": cuts, "_a": rank(signal), "_b": rank("fwd")})
    return w.select(by, "ts", signal, "fwd", (F.size(F.filter("_cuts", lambda c: c < F.col(signal))) + 1).alias("group"), F.corr("_a", "_b").over(series).alias("ic"))
