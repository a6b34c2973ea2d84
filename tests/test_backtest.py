"""Golden trades, and runs in chunks against a plain loop over bars."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewater.operators.backtest import Rules, backtest, brackets, equity_curve

FREE = Rules(commission=0.0, slippage_ticks=0.0)
FLAT = (100, 100, 100, 100, 0.0)
NAN = float("nan")


def frame(rows, symbol="s", **signals):
    d = pd.DataFrame(rows, columns=["open", "high", "low", "close", "spread_mean"]).astype(float)
    d["ts"] = pd.date_range("2024-01-02 13:00", periods=len(d), freq="5min")
    d["symbol"] = symbol
    for k, v in signals.items():
        d[k] = [v.get(i, False) for i in range(len(d))] if isinstance(v, dict) else v
    return d


def traded(spark, d, rules=FREE, **more):
    return sorted((r.asDict() for r in backtest(spark.createDataFrame(d), rules, **more).collect()), key=lambda t: (str(t["symbol"]), t["exit_i"], t["entry_i"]))


def plain(d, r):
    """Trades (side, entry, exit, prices, reason, mae, mfe, stop, net) and equity, bar after bar."""
    get = lambda c, i, default=NAN: d[c].iloc[i] if c in d and i >= 0 else default
    money, trades, curve, open_, last_day = r.equity, [], [], None, None

    def finish(i, price, why):
        nonlocal open_, money
        units = open_["lots"] * r.contract
        gross = open_["side"] * (price - open_["price"]) * units
        net = gross - ((get("spread_mean", open_["at"]) + get("spread_mean", i)) / 2 + 2 * r.slippage_ticks * r.tick) * units - r.commission * open_["lots"]
        money += net
        trades.append((open_["side"], open_["at"], i, open_["price"], price, why, open_["mae"], open_["mfe"], open_["stop"], net))
        open_ = None

    def begin(i, side, price, k):
        nonlocal open_, last_day
        risk, reward = get("stop_dist", k) or NAN, get("target_dist", k) or NAN
        lots = r.lots if r.risk_pct is None or not risk > 0 else max(r.min_lots, round(r.risk_pct * money / (risk * r.contract) / r.lot_step) * r.lot_step)
        open_ = dict(side=side, at=i, price=price, lots=lots, risk=risk, stop=price - side * risk, target=price + side * reward, trail=get("trail_dist", i), peak=price, mae=0.0, mfe=0.0)
        last_day = d.ts.iloc[i].date()

    for i in range(len(d)):
        o, h, lo, c = (d[x].iloc[i] for x in ("open", "high", "low", "close"))
        asked = 0 if i == 0 else 1 if get("long_entry", i - 1, False) else -1 if r.allow_short and get("short_entry", i - 1, False) else 0
        if open_:
            s = open_["side"]
            worst, best = (lo, h) if s > 0 else (h, lo)
            open_["mae"], open_["mfe"] = max(open_["mae"], s * (open_["price"] - worst)), max(open_["mfe"], s * (best - open_["price"]))
            rules = [(s * worst <= s * open_["stop"], open_["stop"], "stop"), (s * best >= s * open_["target"], open_["target"], "target"),
                     (r.flat_hour is not None and d.ts.iloc[i].hour >= r.flat_hour, o, "session_flat"), (r.max_hold is not None and i - open_["at"] >= r.max_hold, o, "time_stop"), (bool(get("exit_signal", i - 1, False)), o, "signal")]
            met = next((x for x in rules if x[0]), None)
            if met:
                finish(i, met[1], met[2])
            elif r.trail_after_r is not None and open_["trail"] == open_["trail"] and open_["risk"] > 0:
                seen = c if r.trail_on_close else best
                open_["peak"] = s * max(s * open_["peak"], s * seen)
                if s * (open_["peak"] - open_["price"]) >= r.trail_after_r * open_["risk"]:
                    open_["stop"] = s * max(s * open_["stop"], s * open_["peak"] - open_["trail"])
        may = money > 0 and not (r.one_trade_per_day and last_day == d.ts.iloc[i].date())
        buy, sell = get("long_stop", i), get("short_stop", i) if r.allow_short else NAN
        if not open_ and may and h >= buy:
            begin(i, 1, max(o, buy), i)
        elif not open_ and may and lo <= sell:
            begin(i, -1, min(o, sell), i)
        elif not open_ and may and asked:
            begin(i, asked, o, i - 1)
        elif open_ and open_["at"] < i and r.reverse and asked == -open_["side"]:
            finish(i, o, "reverse")
            if money > 0:
                begin(i, asked, o, i - 1)
        curve.append(money + (open_["side"] * (c - open_["price"]) * open_["lots"] * r.contract if open_ else 0.0))
    if open_:
        finish(len(d) - 1, d.close.iloc[-1], "eod")
        curve[-1] = money
    return trades, curve


def test_hand_computed_long(spark):
    d = frame([(100, 100, 100, 100, 0.2), (100, 101, 100, 101, 0.2), (101, 102, 101, 102, 0.2), (103, 103, 103, 103, 0.2), (103, 103, 103, 103, 0.2)], long_entry={0: True}, exit_signal={2: True})
    (t,) = traded(spark, d, Rules(allow_short=False))
    assert (t["entry_i"], t["exit_i"], t["entry_mid"], t["exit_mid"], t["bars_held"], t["stop_lvl"]) == (1, 3, 100, 103, 2, None)
    assert np.allclose((t["gross_pnl"], t["cost"], t["net_pnl"]), (3.00, 0.28, 2.72))
    assert math.isclose(equity_curve(spark.createDataFrame(d), Rules(allow_short=False)).orderBy("ts").tail(1)[0].equity, 1002.72)


def test_stop_before_target(spark):
    (t,) = traded(spark, frame([FLAT, FLAT, (100, 105, 95, 100, 0.0), FLAT], long_entry={0: True}, stop_dist=3.0, target_dist=3.0))
    assert (t["exit_reason"], t["exit_mid"]) == ("stop", 97)


def test_buy_and_hold_makes_the_price_move(spark):
    line = np.linspace(1500, 1800, 5000)
    (t,) = traded(spark, frame([(x, x, x, x, 0.0) for x in line], long_entry={0: True}), size=100)
    assert t["exit_reason"] == "eod" and np.isclose(t["gross_pnl"], line[-1] - line[1]) and np.isclose(t["mfe"], line[-1] - line[1])


def test_trailing_stop(spark):
    d = frame([(c, c, c, c, 0.0) for c in (100, 100, 102, 104, 106, 105, 103)], long_entry={0: True}, stop_dist=2.0, trail_dist=2.0)
    for size in (3, 100):
        (t,) = traded(spark, d, Rules(commission=0.0, slippage_ticks=0.0, trail_after_r=1.0), size=size)
        assert (t["exit_reason"], t["exit_mid"]) == ("stop", 104) and t["net_pnl"] > 0


def test_resting_orders_and_one_trade_a_day(spark):
    d = frame([FLAT, (100, 103, 100, 102, 0.0), (102, 102, 97, 98, 0.0), (98, 104, 98, 104, 0.0)], long_stop=101.0, stop_dist=2.0)
    # bar 2 opens above the order: it stops the first trade at 99 and, being flat again, fills the order at its own open
    assert [(t["entry_i"], t["exit_i"], t["entry_mid"], t["exit_mid"]) for t in traded(spark, d)] == [(1, 2, 101, 99), (2, 3, 102, 100), (3, 3, 101, 104)]
    assert [t["entry_mid"] for t in traded(spark, d, Rules(commission=0.0, slippage_ticks=0.0, one_trade_per_day=True))] == [101]


def walk(seed, n, step=1.0):
    rng = np.random.default_rng(seed)
    close = 100 + np.round(rng.standard_normal(n).cumsum() * step, 1)
    start = np.concatenate([[100.0], close[:-1]]) + np.round(rng.standard_normal(n) * 0.2, 1)
    reach = np.round(np.abs(rng.standard_normal((2, n))) * step, 1)
    d = frame(list(zip(start, np.maximum(start, close) + reach[0], np.minimum(start, close) - reach[1], close, np.full(n, 0.1))))
    d["ts"] = pd.date_range("2024-01-02", periods=n, freq="47min")
    pick = lambda p: rng.random(n) < p
    maybe = lambda x, p: np.where(pick(p), x, np.nan)
    return d, pick, maybe, rng


CASES = {
    "plain": (dict(), Rules(equity=1e9)),
    "long_only_holding": (dict(), Rules(equity=1e9, allow_short=False, max_hold=7)),
    "reverse_flat": (dict(), Rules(equity=1e9, reverse=True, flat_hour=20)),
    "trail_close": (dict(trail=3.0), Rules(equity=1e9, trail_after_r=0.5, reverse=True)),
    "trail_extreme_day": (dict(trail=2.0), Rules(equity=1e9, trail_after_r=1.0, trail_on_close=False, one_trade_per_day=True)),
    "ruin": (dict(), Rules(equity=12.0, reverse=True)),
    "sized": (dict(), Rules(equity=500.0, risk_pct=0.02)),
    "orders_day": (dict(orders=True), Rules(equity=1e9, one_trade_per_day=True, reverse=True)),
    "no_levels": (dict(levels=False), Rules(equity=1e9, reverse=True)),
}


@pytest.mark.parametrize("case", CASES)
def test_chunks_give_the_trades_of_a_plain_loop(spark, case):
    options, rules = CASES[case]
    frames, expected, curves = [], [], {}
    for k, name in enumerate(("a", "b", None)):
        d, pick, maybe, rng = walk(7 * k + len(case), 150)
        rate = 0.02 if k == 2 else 0.12
        d = d.assign(symbol=name, long_entry=pick(rate), short_entry=pick(rate), exit_signal=pick(0.03 if k else 0.0))
        if options.get("levels", True):
            d = d.assign(stop_dist=maybe(4.0, 0.9), target_dist=maybe(7.0, 0.8))
        if "trail" in options:
            d = d.assign(trail_dist=maybe(options["trail"], 0.9))
        if options.get("orders"):
            d = d.assign(long_stop=maybe(np.round(d.open + rng.random(150) * 3, 1), 0.3), short_stop=maybe(np.round(d.open - rng.random(150) * 3, 1), 0.3))
        trades, curve = plain(d, rules)
        frames.append(d), curves.update({(str(name), t): v for t, v in zip(d.ts, curve)})
        expected += [(str(name), *t) for t in trades]
    df = spark.createDataFrame(pd.concat(frames), "open double, high double, low double, close double, spread_mean double, ts timestamp, symbol string, long_entry boolean, short_entry boolean, exit_signal boolean" + "".join(f", {c} double" for c in frames[0].columns[10:]))
    for size in (24, 1000) if case == "plain" else (24,):
        got = [(str(t.symbol), t.side, t.entry_i, t.exit_i, t.entry_mid, t.exit_mid, t.exit_reason, t.mae, t.mfe, NAN if t.stop_lvl is None else t.stop_lvl, t.net_pnl) for t in backtest(df, rules, size=size).collect()]
        assert len(got) == len(expected) > 2
        for a, b in zip(sorted(got, key=lambda t: t[:4]), sorted(expected, key=lambda t: t[:4])):
            assert a[:4] == b[:4] and a[6] == b[6] and np.allclose(a[4:6] + a[7:], b[4:6] + b[7:], equal_nan=True), (size, a, b)
    for r in equity_curve(df, rules, size=50).collect():
        assert math.isclose(r.equity, curves[str(r.symbol), r.ts], rel_tol=1e-9, abs_tol=1e-6)


def test_no_bars_and_no_signals(spark):
    d = frame([FLAT, FLAT])
    assert traded(spark, d) == [] and backtest(spark.createDataFrame(d).limit(0), FREE).collect() == []


def test_random_entries_lose_their_costs(spark):
    rng = np.random.default_rng(5)
    close = 2000 + rng.standard_normal(6000).cumsum()
    d = frame([(a, max(a, b) + 0.1, min(a, b) - 0.1, b, 0.3) for a, b in zip([2000, *close[:-1]], close)], long_entry=rng.random(6000) < 0.05)
    t = pd.DataFrame(traded(spark, d, Rules(equity=1e9, max_hold=10), size=500))
    assert len(t) > 150 and (t.cost > 0).all() and np.allclose(t.gross_pnl - t.cost, t.net_pnl) and abs(t.gross_pnl.mean()) < 4 * t.gross_pnl.std() / len(t) ** 0.5


def test_brackets_of_shorts_nulls_and_last_bars(spark):
    bars = spark.createDataFrame([(s, i, *x) for s in ("a", None) for i, x in enumerate([(101.0, 99.0, 100.0), (104.0, 100.0, 103.0), (106.0, 101.0, 102.0)])], "symbol string, rn long, high double, low double, close double")
    entries = spark.createDataFrame([(s, k, at, 100.0, 3.0, 5.0, side) for s in ("a", None) for k, (at, side) in enumerate([(0, 1), (0, -1), (3, 1), (2, 1)])], "symbol string, id long, at long, price double, risk double, reward double, side int")
    rows = {(r.symbol, r.id): (r.outcome, r.exit_rn, r.made) for r in brackets(bars, entries, 3).collect()}
    for s in ("a", None):
        assert [rows[s, k] for k in range(4)] == [("target", 2, 5 / 3), ("stop", 1, -1.0), ("timeout", None, None), ("target", 2, 5 / 3)]
