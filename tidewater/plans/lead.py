"""A frozen signal on paper: new extremes on quiet days, held for fixed times, its verdict and its state at the last bar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resample import bootstrap_mean
from ..operators.ordered import along, numbered, same_series, windowed
from ..operators.scan import ewm
from .impulses import new_extremes, once
from .states import lengthened


def with_regime(bars: DataFrame, days: DataFrame, by: str = "symbol") -> DataFrame:
    """Numbered bars with atr (of 14, exponential) and quiet, rv and share of their day. days: by, ts, quiet, rv, share."""
    b = once(numbered(bars, by))
    before = F.lag("close").over(along(by))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    b = ewm(windowed(b, {"_tr": tr}, back=1, by=by), {"atr": ("_tr", 1 / 14)}, by).drop("_tr")
    d = days.select(by, F.to_date("ts").alias("_day"), "quiet", "rv", "share")
    return once(same_series(b.withColumn("_day", F.to_date("ts")), d, [by, "_day"], "left").drop("_day"))


def lead_book(regime: DataFrame, books: dict[str, int], floor: float, friction: float = 0.3, lookback: int = 96, gap: int = 16, by: str = "symbol") -> DataFrame:
    """by, rn, ts, side, rv, share, atr, entry_ts, entry, book, status, exit_ts, exit, gross and net (in atr) for each signal and book (name: bars held).

    A signal is a new extreme on a quiet day whose atr is at least `floor`. It enters at the next open and leaves at the close of the last bar held; without
    such a bar it is open, and what it earned is null. regime: with_regime."""
    found = new_extremes(regime, F.col("quiet") & (F.col("atr") >= floor), lookback, gap, by)
    known = same_series(found, regime.select(by, "rn", "rv", "share", "atr"), [by, "rn"])
    held = F.array(*[F.struct(F.lit(n).alias("book"), F.lit(h).alias("h")) for n, h in books.items()])
    each = known.withColumn("_b", F.explode(held)).withColumns({"book": F.col("_b.book"), "_x": F.col("rn") + F.col("_b.h")}).drop("_b")
    exits = regime.select(by, F.col("rn").alias("_x"), F.col("ts").alias("exit_ts"), F.col("close").alias("exit"))
    out = same_series(each, exits, [by, "_x"], "left")
    gross = F.col("side") * (F.col("exit") - F.col("entry")) / F.col("atr")
    return out.select(by, "rn", "ts", "side", "rv", "share", "atr", "entry_ts", "entry", "book", F.when(F.col("exit_ts").isNull(), "open").otherwise("resolved").alias("status"), "exit_ts", "exit", gross.alias("gross"), (gross - friction).alias("net"))


def verdicts(book: DataFrame, id_col: str, rounds: int = 4000, enough: int = 150, least: int = 10, pass_mean: float = 0.05, fail_high: float = 0.1, by: tuple[str, ...] = ("book",)) -> DataFrame:
    """by, n, n_open, mean_net, won (share above 0), lo and hi (null below `least` results) and verdict: FEW below `enough` results; PASS if the mean is at least `pass_mean` and lo above 0;
    FAIL if the mean is not above 0 and hi below `fail_high`; else INCONCLUSIVE. id_col: a whole number for each row, from which draws are made."""
    done = book.where(F.col("net").isNotNull())
    n = F.count("net")
    g = book.groupBy(*by).agg(n.alias("n"), F.count(F.when(F.col("net").isNull(), 1)).alias("n_open"), F.avg("net").alias("mean_net"), F.avg(F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double"))).alias("won"))
    g = same_series(g, bootstrap_mean(done, list(by), "net", rounds, id_col=id_col).drop("mid"), list(by), "left")
    g = g.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("lo", "hi")})
    verdict = F.when(F.col("n") < enough, "FEW").when((F.col("mean_net") >= pass_mean) & (F.col("lo") > 0), "PASS").when((F.col("mean_net") <= 0) & (F.col("hi") < fail_high), "FAIL").otherwise("INCONCLUSIVE")
    return g.withColumn("verdict", verdict)


def lead_status(regime: DataFrame, days: DataFrame, book: DataFrame, floor: float, lookback: int = 96, gap: int = 16, reach: int = 4000, by: str = "symbol") -> DataFrame:
    """One row for each series: as_of (last bar), share and gate_open of the last day that has a share (gate shut if none), atr, atr_ok, extreme_ts and extreme_side (last new extreme among the last `reach` bars,
    whatever the day; pauses before them do not count), signal_now, signal_side, n_signals and last_signal of the book."""
    of = regime.groupBy(by).agg(F.max_by(F.struct("ts", "atr"), "rn").alias("_l"), F.max("rn").alias("_n"))
    known = days.where(F.col("share").isNotNull()).groupBy(by).agg(F.max_by(F.struct("share", "quiet"), "ts").alias("_d"))
    late = same_series(lengthened(regime, by), of.select(by, "_n"), [by])
    extremes = new_extremes(late, F.col("rn") > F.col("_n") - reach, lookback, gap, by).groupBy(by).agg(F.max_by(F.struct("ts", "side"), "rn").alias("_x"))
    signals = book.groupBy(by).agg(F.countDistinct("rn").alias("_s"), F.max("ts").alias("last_signal"))
    out = same_series(same_series(same_series(of, known, [by], "left"), extremes, [by], "left"), signals, [by], "left")
    gate, ok = F.coalesce("_d.quiet", F.lit(False)), F.coalesce(F.col("_l.atr") >= floor, F.lit(False))
    now = gate & ok & F.coalesce(F.col("_x.ts") == F.col("_l.ts"), F.lit(False))
    return out.select(by, F.col("_l.ts").alias("as_of"), F.col("_d.share").alias("share"), gate.alias("gate_open"), F.col("_l.atr").alias("atr"), ok.alias("atr_ok"), F.col("_x.ts").alias("extreme_ts"), F.col("_x.side").alias("extreme_side"), now.alias("signal_now"), F.when(now, F.col("_x.side")).alias("signal_side"), F.coalesce("_s", F.lit(0)).alias("n_signals"), "last_signal")
