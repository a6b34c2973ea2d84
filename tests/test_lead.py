"""The signal on paper, and context of a higher timeframe, by hand and against pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidewater.plans.higher import higher_context
from tidewater.plans.lead import lead_book, lead_status, verdicts, with_regime

START = dt.datetime(2024, 3, 4)
SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double"


def _rising(symbol, n=30):
    """Flat bars, then a new high at bar 12 and at the last one."""
    rows = []
    for i in range(n):
        c = 10.0 + (5.0 if i == 12 else 9.0 if i == n - 1 else 0.0)
        rows.append((symbol, START + dt.timedelta(hours=i), 10.0, max(c, 10.5 - 0.001 * i), 9.5 + 0.001 * i, c))
    return rows


def _days(symbol, quiet):
    return [(symbol, START + dt.timedelta(days=i), q, 0.01, s) for i, (q, s) in enumerate(quiet)]


DAYS = "symbol string, ts timestamp, quiet boolean, rv double, share double"


def test_book_and_status(spark):
    bars = spark.createDataFrame(_rising("x") + _rising(None) + _rising("loud"), SCHEMA)
    days = spark.createDataFrame(_days("x", [(True, 0.2), (True, 0.1)]) + _days(None, [(True, 0.2), (False, None)]) + _days("loud", [(False, 0.9), (False, 0.8)]), DAYS)
    regime = with_regime(bars, days)
    book = lead_book(regime, {"a": 1, "b": 40}, 0.1, 0.3, lookback=5, gap=3)
    rows = {(r.symbol, r.rn, r.side, r.book): r for r in book.collect()}
    assert not any(k[0] == "loud" for k in rows)  # no quiet day, no signal
    one, late = rows["x", 12, 1, "a"], rows["x", 12, 1, "b"]
    assert one.status == "resolved" and one.entry == 10.0 and one.exit == 10.0 and one.gross == 0.0 and one.net == pytest.approx(-0.3)
    assert late.status == "open" and late.exit is None and late.net is None
    assert (None, 12, 1, "a") in rows and not any(k[1] == 29 for k in rows)  # the last bar has no next one to enter at
    s = {r.symbol: r for r in lead_status(regime, days, book, 0.1, lookback=5, gap=3).collect()}
    assert s["x"].signal_now and s["x"].signal_side == 1 and s["x"].extreme_ts == START + dt.timedelta(hours=29) and s["x"].share == 0.1 and s["x"].n_signals >= 1
    assert s[None].gate_open and s[None].share == 0.2  # the last day that has a share counts
    assert not s["loud"].signal_now and s["loud"].signal_side is None and s["loud"].n_signals == 0 and s["loud"].last_signal is None
    high = lead_status(regime, days, book, 99.0, lookback=5, gap=3).where("symbol = 'x'").first()
    assert not high.atr_ok and not high.signal_now


def test_verdicts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for book, mean, n in (("good", 1.0, 200), ("bad", -1.0, 200), ("even", 0.02, 200), ("few", 1.0, 30), ("none", 1.0, 5)):
        rows += [(book, i, float(x)) for i, x in enumerate(rng.normal(mean, 1.0, n))]
    rows += [("good", 999, None), ("open", 0, None)]
    v = {r.book: r for r in verdicts(spark.createDataFrame(rows, "book string, id long, net double"), "id", rounds=300).collect()}
    assert {k: r.verdict for k, r in v.items()} == {"good": "PASS", "bad": "FAIL", "even": "INCONCLUSIVE", "few": "FEW", "none": "FEW", "open": "FEW"}
    assert v["good"].n == 200 and v["good"].n_open == 1 and v["good"].lo < v["good"].mean_net < v["good"].hi
    assert v["none"].lo is None and v["few"].lo is not None and v["open"].mean_net is None


def test_higher_context(spark):
    rng = np.random.default_rng(2)
    at = [START + dt.timedelta(minutes=10 * i) for i in range(900) if not 200 <= i < 380]  # a long gap
    close = 100 + np.cumsum(rng.normal(0, 1, len(at)))
    b = pd.DataFrame({"symbol": "x", "ts": at, "open": close, "high": close + 1, "low": close - 1, "close": close})
    got = higher_context(spark.createDataFrame(pd.concat([b, b.assign(symbol=None)]), SCHEMA)).toPandas().sort_values("ts")
    h = b.set_index("ts").resample("1h").agg({"high": "max", "low": "min", "close": "last"}).dropna()
    c, d = h["close"], h["close"].diff()
    wilder = lambda s: s.ewm(alpha=1 / 14, adjust=False).mean()
    mean = c.ewm(span=20, adjust=False).mean()
    lo, hi = h.low.rolling(20).min(), h.high.rolling(20).max()
    f = pd.DataFrame({"h1_slope": (mean - mean.shift(3)) / 0.1, "h1_rsi": 100 - 100 / (1 + wilder(d.clip(lower=0).iloc[1:]) / wilder(-d.clip(upper=0).iloc[1:]).replace(0, np.nan)), "h1_ret": c.pct_change(6), "h1_place": (c - lo) / (hi - lo), "h1_above": (c > c.ewm(span=50, adjust=False).mean()).astype(float)})
    want = f.shift(1).reindex(b["ts"], method="ffill")
    for symbol in ("x", None):
        mine = got[got["symbol"].isna() if symbol is None else got["symbol"] == symbol]
        for name in want:
            np.testing.assert_allclose(mine[name].to_numpy(float), want[name].to_numpy(), atol=1e-7, err_msg=name)


def test_empty(spark):
    bars, days = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], DAYS)
    regime = with_regime(bars, days)
    book = lead_book(regime, {"a": 1}, 0.1)
    assert book.count() == 0 and lead_status(regime, days, book, 0.1).count() == 0 and higher_context(bars).count() == 0
