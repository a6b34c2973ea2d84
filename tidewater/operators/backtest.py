"""Trade simulation: runs of one position at a time over series of any length, and first-touch brackets of independent trades.

A trade's way out depends only on its way in: from the bar of the entry on, the first bar where the stop, the target, a
time or a signal ends it is found by comparing whole stretches of bars with levels. The next trade starts at the first
bar from there that offers an entry. A run is thus a chain of jumps, entry to exit to entry; what passes from chunk to
chunk of a series is an open trade or nothing, and chunks whose extremes do not reach an open trade are jumped over.
Money comes after: lots, costs and the end of the account are running sums over trades.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chain import SIZE, chained
from .ordered import along, carry_last, numbered, running, same_series, windowed

TRADE = "side int, entry_i long, exit_i long, entry_ts timestamp, exit_ts timestamp, entry_mid double, exit_mid double, size_lots double, bars_held long, gross_pnl double, cost double, net_pnl double, r_multiple double, mae double, mfe double, exit_reason string, stop_lvl double, tgt_lvl double"
WAY = "side int, entry_i long, exit_i long, entry_ts timestamp, exit_ts timestamp, entry_mid double, exit_mid double, risk double, mae double, mfe double, exit_reason string, stop_lvl double, tgt_lvl double, spreads double"
REASONS = ("stop", "target", "session_flat", "time_stop", "signal", "reverse")


@dataclass(frozen=True)
class Rules:
    """Contract, tick, commission, slippage and account; and how a run trades."""

    contract: float = 100.0
    tick: float = 0.01
    commission: float = 6.0
    slippage_ticks: float = 1.0
    equity: float = 1000.0
    lots: float = 0.01
    lot_step: float = 0.01
    min_lots: float = 0.01
    risk_pct: float | None = None
    allow_short: bool = True
    reverse: bool = False
    one_trade_per_day: bool = False
    rest_a_bar: bool = False  # no entry on the bar of an exit
    flat_hour: int | None = None
    max_hold: int | None = None
    trail_after_r: float | None = None
    trail_on_close: bool = True


#: An open trade as it passes between chunks.
OPEN = ("side", "at", "ts", "day", "price", "stop", "target", "risk", "trail", "best", "mae", "mfe", "spread")


class Bars:
    """A stretch of bars as arrays, and where it offers entries."""

    def __init__(self, g: pd.DataFrame, rules: Rules):
        self.rules, self.n = rules, len(g)
        self.rn, self.ts, self.day, self.hour = (g[c].to_numpy() for c in ("rn", "_us", "_day", "_hour"))
        self.open, self.high, self.low, self.close, self.spread = (g[c].to_numpy(float) for c in ("open", "high", "low", "close", "spread_mean"))
        self.seen = (self.close, self.close) if rules.trail_on_close else (self.high, self.low)
        self.asked, self.leave = g["_asked"].to_numpy(float), g["_leave"].to_numpy(bool)
        self.at_market = [g[c].to_numpy(float) for c in ("_stop_before", "_target_before")]
        self.at_order = [g[c].to_numpy(float) for c in ("stop_dist", "target_dist")]
        self.trail, self.buy, self.sell = (g[c].to_numpy(float) for c in ("trail_dist", "long_stop", "short_stop"))
        self.bought, self.sold = self.high >= self.buy, self.low <= self.sell
        self.offers = np.flatnonzero(self.bought | self.sold | (self.asked != 0))
        self.day_before = g["_day_before"].iloc[0] if self.n else None

    def entry(self, i: int, reverse: bool) -> dict:
        """The trade that starts at bar i: by a resting order, or at the open as the bar before asked for."""
        order = not reverse and (self.bought[i] or self.sold[i])
        if order:
            side = 1 if self.bought[i] else -1
            price = max(self.open[i], self.buy[i]) if side > 0 else min(self.open[i], self.sell[i])
        else:
            side, price = int(self.asked[i]), self.open[i]
        risk, reward = ((x[i] if x[i] != 0 else np.nan) for x in (self.at_order if order else self.at_market))
        return dict(side=side, at=int(self.rn[i]), ts=int(self.ts[i]), day=int(self.day[i]), price=price, stop=price - side * risk, target=price + side * reward, risk=risk, trail=self.trail[i], best=price, mae=0.0, mfe=0.0, spread=self.spread[i])

    def way_out(self, p: dict, i: int) -> tuple[int, str, float] | None:
        """The first bar from i on that ends the trade, why, and at what price; p takes what happens until then. Heights
        are measured in the direction of the trade."""
        r, s, width = self.rules, p["side"], 64
        trailing = r.trail_after_r is not None and not np.isnan(p["trail"]) and p["risk"] > 0
        while i < self.n:
            z = slice(i, min(i + width, self.n))
            worst, best = (self.low[z], self.high[z]) if s > 0 else (-self.high[z], -self.low[z])
            stops = np.full(len(worst), s * p["stop"])
            if trailing:
                tops = np.fmax.accumulate(np.concatenate([[s * p["best"]], s * self.seen[s < 0][z]]))
                reached = tops - s * p["price"] >= r.trail_after_r * p["risk"]
                pulled = np.fmax(s * p["stop"], np.where(reached, tops - p["trail"], np.nan))
                pulled[0] = s * p["stop"]  # what the bar before has moved is in the stop already
                pulled = np.fmax.accumulate(pulled)
                stops = pulled[:-1]
            ends = np.stack([
                worst <= stops, best >= s * p["target"], self.hour[z] >= r.flat_hour if r.flat_hour is not None else np.zeros(len(worst), bool),
                self.rn[z] - p["at"] >= r.max_hold if r.max_hold is not None else np.zeros(len(worst), bool), self.leave[z], r.reverse & (self.asked[z] == -s),
            ])
            any_end = ends.any(0)
            j = int(any_end.argmax()) if any_end.any() else None
            upto = len(worst) if j is None else j + 1
            p["mae"] = max(p["mae"], s * p["price"] - worst[:upto].min())
            p["mfe"] = max(p["mfe"], best[:upto].max() - s * p["price"])
            reason = None if j is None else REASONS[int(ends[:, j].argmax())]
            if trailing:
                moved = upto if reason in (None, "reverse") else j  # a reversal comes after the stop has moved
                p["best"], p["stop"] = s * tops[moved], s * pulled[moved]
            if reason:
                return i + j, reason, p["stop"] if reason == "stop" else p["target"] if reason == "target" else self.open[i + j]
            i, width = z.stop, width * 2
        return None

    def next_offer(self, i: int, taken_day: int | None) -> int | None:
        """The first bar from i on with an entry; taken_day: a day of which no bar may start a trade."""
        if taken_day is not None:
            i = max(i, int(np.searchsorted(self.day, taken_day, "right")))
        k = int(np.searchsorted(self.offers, i))
        return int(self.offers[k]) if k < len(self.offers) else None


def _run(rules: Rules):
    def run(g: pd.DataFrame, state: list, last: bool) -> tuple[pd.DataFrame, list]:
        """Trades that end within a chunk. A state is an open trade, or the day of the last entry alone if no more may start on it."""
        bars, out = Bars(g, rules), []
        p = dict(zip(OPEN, state)) if len(state) > 1 else None
        if p:
            p |= {k: np.nan if p[k] is None else p[k] for k in ("stop", "target", "risk", "trail")}
        taken, i = (None, 0) if p else (state[0], 0)
        while True:
            if not p:
                i = bars.next_offer(i, taken)
                if i is None:
                    break
                p, i = bars.entry(i, False), i + 1
            found = bars.way_out(p, i)
            if found is None and not last:
                break
            j, reason, price = found or (bars.n - 1, "eod", bars.close[-1])
            out.append((p["side"], p["at"], bars.rn[j], p["ts"], bars.ts[j], p["price"], price, p["risk"], p["mae"], p["mfe"], reason, p["stop"], p["target"], p["spread"] + bars.spread[j]))
            taken = p["day"] if rules.one_trade_per_day else None
            p, i = (bars.entry(j, True), j + 1) if reason == "reverse" else (None, j + rules.rest_a_bar)
            if reason == "eod":
                break
        names = [c.split()[0] for c in WAY.split(", ")]
        trades = pd.DataFrame(out, columns=names).astype({"entry_ts": "int64", "exit_ts": "int64"})
        for c in ("entry_ts", "exit_ts"):
            trades[c] = pd.to_datetime(trades[c], unit="us")
        if p:
            state = [None if isinstance(p[c], float) and np.isnan(p[c]) else p[c].item() if isinstance(p[c], np.generic) else p[c] for c in OPEN]
        else:  # a day that is over by the end of the chunk blocks nothing
            state = [int(taken) if taken is not None and bars.day[-1] <= taken else None]
        return trades, state

    return run


def _summary(rules: Rules):
    def summary(g: pd.DataFrame) -> list:
        """Extremes of a chunk, and whether anything but a level can end a trade in it, by side."""
        b = Bars(g, rules)
        up, down = b.seen
        fall = float((np.fmax.accumulate(np.concatenate([[-np.inf], up[:-1]])) - b.low).max())
        rise = float((b.high - np.fmin.accumulate(np.concatenate([[np.inf], down[:-1]]))).max())
        ends = bool(b.leave.any() or (rules.flat_hour is not None and (b.hour >= rules.flat_hour).any()))
        turns = [bool(ends or (rules.reverse and (b.asked == -s).any())) for s in (1, -1)]
        finite = lambda x: None if np.isinf(x) else x
        return [float(b.low.min()), float(b.high.max()), float(up.max()), float(down.min()), finite(fall), finite(rise), *turns, int(b.rn[-1])]

    return summary


def _leap(rules: Rules):
    def leap(state: list, chunk: int, summaries: list) -> tuple[int, list]:
        """The next chunk that can end an open trade (the last one in any case), and the trade as it comes there."""
        if len(state) == 1:
            return chunk, state
        p = dict(zip(OPEN, state))
        s = p["side"]
        trailing = rules.trail_after_r is not None and p["trail"] is not None and p["risk"] is not None and p["risk"] > 0
        while chunk < len(summaries) - 1:
            low, high, up, down, fall, rise, long_ends, short_ends, end = summaries[chunk]
            worst, best, top, drop = (low, high, up, fall) if s > 0 else (-high, -low, -down, rise)
            if (long_ends if s > 0 else short_ends) or (rules.max_hold is not None and end - p["at"] >= rules.max_hold):
                break
            if (p["stop"] is not None and worst <= s * p["stop"]) or (p["target"] is not None and best >= s * p["target"]):
                break
            if trailing:
                peak = max(s * p["best"], top)
                if peak - s * p["price"] >= rules.trail_after_r * p["risk"]:
                    if s * p["best"] - worst >= p["trail"] or (drop is not None and drop >= p["trail"]):
                        break
                    p["stop"] = s * (peak - p["trail"] if p["stop"] is None else max(s * p["stop"], peak - p["trail"]))
                p["best"] = s * peak
            p["mae"], p["mfe"] = max(p["mae"], s * p["price"] - worst), max(p["mfe"], best - s * p["price"])
            chunk += 1
        return chunk, [p[c] for c in OPEN]

    return leap


def _prepared(signals: DataFrame, rules: Rules, by: str) -> DataFrame:
    """Numbered bars with what the bar before asked for."""
    d = signals if "rn" in signals.columns else numbered(signals, by)
    have = lambda c, fill: F.coalesce(F.col(c).cast("double"), F.lit(fill).cast("double")) if c in signals.columns else F.lit(fill).cast("double")
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in signals.columns else F.lit(False)
    short = flag("short_entry") & F.lit(rules.allow_short)
    d = d.select(
        by, "rn", F.col("ts").alias("_ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), F.hour("ts").alias("_hour"), F.unix_date(F.to_date("ts")).cast("long").alias("_day"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], have("spread_mean", 0.0).alias("spread_mean"),
        *[have(c, None).alias(c) for c in ("stop_dist", "target_dist", "trail_dist", "long_stop")], (have("short_stop", None) if rules.allow_short else F.lit(None).cast("double")).alias("short_stop"),
        F.when(flag("long_entry"), 1).when(short, -1).otherwise(0).alias("_side"), flag("exit_signal").alias("_exit"),
    )
    before = lambda c, fill=None: F.coalesce(F.lag(c).over(along(by)), F.lit(fill)) if fill is not None else F.lag(c).over(along(by))
    d = windowed(d, {"_asked": before("_side", 0), "_leave": before("_exit", False), "_stop_before": before("stop_dist"), "_target_before": before("target_dist"), "_day_before": before("_day")}, back=1, by=by)
    return d.drop("_side", "_exit", "_ts")


def ways(signals: DataFrame, rules: Rules = Rules(), by: str = "symbol", size: int = SIZE) -> DataFrame:
    """Trades of each run by bars and prices, before money."""
    key = signals.schema[by].dataType.simpleString()
    return chained(_prepared(signals, rules, by), _run(rules), [None], f"{by} {key}, {WAY}", by, size, _summary(rules), _leap(rules))


def _sized(trades: DataFrame, rules: Rules, by: str) -> DataFrame:
    """Lots from the equity before each trade, which depends on the lots before: one row for each trade, run by run."""

    def sizes(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("entry_i", ignore_index=True)
        equity, lots = rules.equity, []
        for side, a, b, risk, spreads in zip(g["side"], g["entry_mid"], g["exit_mid"], g["risk"], g["spreads"]):
            n = rules.lots
            if risk > 0:
                n = max(rules.min_lots, round(rules.risk_pct * equity / (risk * rules.contract) / rules.lot_step) * rules.lot_step)
            lots.append(n)
            equity += (side * (b - a) - spreads / 2 - 2 * rules.slippage_ticks * rules.tick) * n * rules.contract - rules.commission * n
        return g.assign(size_lots=lots)

    return trades.groupBy(by).applyInPandas(sizes, trades.withColumn("size_lots", F.lit(0.0)).schema)


def backtest(signals: DataFrame, rules: Rules = Rules(), by: str = "symbol", size: int = SIZE) -> DataFrame:
    """Trades of each run (a value of `by`, null too). Bars are spread over the cluster in chunks of `size`, also those of
    one run. signals: ts, open, high, low, close and, as far as there are, spread_mean, long_entry, short_entry,
    exit_signal, stop_dist, target_dist, trail_dist, long_stop, short_stop; null is none. Within a bar an open trade is
    looked after first (stop, target, flat hour, holding time, exit signal of the bar before; then the trail for the next
    bar), then resting orders fill, then entries of the bar before. A run ends with the trade that leaves no equity."""
    t = ways(signals, rules, by, size)
    t = _sized(t, rules, by) if rules.risk_pct is not None else t.withColumn("size_lots", F.lit(rules.lots))
    units = F.col("size_lots") * rules.contract
    gross = F.col("side") * (F.col("exit_mid") - F.col("entry_mid")) * units
    cost = (F.col("spreads") / 2 + 2 * rules.slippage_ticks * rules.tick) * units + rules.commission * F.col("size_lots")
    t = t.withColumn("gross_pnl", gross).withColumn("cost", cost).withColumn("net_pnl", F.col("gross_pnl") - F.col("cost"))
    t = numbered(t, by, ("exit_ts", "entry_i"))
    t = running(t, {"_sum": ("sum", "net_pnl")}, by)
    t = t.where(rules.equity + F.col("_sum") - F.col("net_pnl") > 0)  # the first trade that leaves none is the last: see below
    broke = t.where(rules.equity + F.col("_sum") <= 0).groupBy(by).agg(F.min("rn").alias("_broke"))
    t = same_series(t, broke, [by], "left").where(F.col("_broke").isNull() | (F.col("rn") <= F.col("_broke")))
    own = F.when(F.col("risk") > 0, F.col("risk") * units)
    out = {"bars_held": F.col("exit_i") - F.col("entry_i"), "r_multiple": F.col("net_pnl") / own}
    return t.withColumns(out).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("stop_lvl", "tgt_lvl")}).select(by, *[c.split()[0] for c in TRADE.split(", ")])


def equity_curve(signals: DataFrame, rules: Rules = Rules(), by: str = "symbol", size: int = SIZE) -> DataFrame:
    """by, ts, equity at the close of every bar: what trades have made until then, and the open one at its close."""
    d = numbered(signals, by)
    t = backtest(d, rules, by, size)
    t = running(numbered(t, by, ("exit_ts", "entry_i")), {"_sum": ("sum", "net_pnl")}, by)
    made = (F.col("_sum") - F.col("net_pnl")).alias("before")
    last = t.select(by, F.col("entry_i").alias("rn"), F.struct("exit_i", "exit_reason", "side", "entry_mid", "size_lots", made, F.col("_sum").alias("after")).alias("_t"))
    d = carry_last(same_series(d, last, [by, "rn"], "left"), {"_t": "_in"}, by)
    x = F.col("_in")
    open_ = x["before"] + x["side"] * (F.col("close") - x["entry_mid"]) * x["size_lots"] * rules.contract
    return d.select(by, "ts", (F.coalesce(F.when(F.col("rn") < x["exit_i"], open_).otherwise(x["after"]), F.lit(0.0)) + rules.equity).alias("equity"))


def brackets(numbered_bars: DataFrame, entries: DataFrame, hold: int, stop_first: bool = True, by: str = "symbol") -> DataFrame:
    """First touch of independent trades. entries: (by, id, at, price, risk, reward) and, if there is one, side (-1:
    short): from bar `at` on, for `hold` bars, price - side risk is the stop and price + side reward the target; a bar that
    touches both counts as the stop, or, if not stop_first, as the target. Adds outcome (stop, target, timeout), exit_rn
    and made (in risks). A null `by` is a series; an entry that no bar follows is a timeout of null exit.

    A range join by buckets of bars: an entry goes to the buckets that its life touches."""
    width = max(hold, 1)
    if "side" not in entries.columns:
        entries = entries.withColumn("side", F.lit(1))
    e = entries.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("at") / width), F.floor((F.col("at") + width - 1) / width))))
    b = numbered_bars.select(by, "rn", "high", "low", "close", F.floor(F.col("rn") / width).alias("_cell"))
    met = same_series(e, b, [by, "_cell"]).where((F.col("rn") >= F.col("at")) & (F.col("rn") < F.col("at") + hold))
    up = F.col("side") > 0
    worst, best = F.when(up, F.col("low")).otherwise(-F.col("high")), F.when(up, F.col("high")).otherwise(-F.col("low"))
    height = F.col("side") * F.col("price")
    stop, target = worst <= height - F.col("risk"), best >= height + F.col("reward")
    hit = F.when(stop & (F.lit(stop_first) | ~target), "stop").when(target, "target")
    seen = met.groupBy(by, "id").agg(F.min(F.when(hit.isNotNull(), F.struct("rn", hit.alias("hit")))).alias("x"), F.max("rn").alias("last"), F.max_by("close", "rn").alias("end"))
    out = same_series(entries, seen, [by, "id"], "left")
    made: Column = F.when(F.col("x.hit") == "stop", F.lit(-1.0)).when(F.col("x.hit") == "target", F.col("reward") / F.col("risk")).otherwise(F.col("side") * (F.col("end") - F.col("price")) / F.col("risk"))
    return out.select(by, "id", F.coalesce("x.hit", F.lit("timeout")).alias("outcome"), F.coalesce("x.rn", "last").alias("exit_rn"), made.alias("made"))
