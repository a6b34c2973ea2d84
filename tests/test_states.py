"""States, anchors and patterns against plain loops over one series."""

import datetime as dt

import numpy as np
import pandas as pd

from tidewater.plans.states import WEIGHTS, anchors, context_patterns, market_states, release_bars

START = dt.datetime(2024, 3, 4)


def _bars(n: int, minutes: int, seed: int = 5, skip: float = 0.1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    at = [START + dt.timedelta(minutes=minutes * i) for i in range(n) if rng.random() >= skip]
    close = 100 + np.cumsum(rng.normal(0, 0.5, len(at)))
    open_ = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(open_, close) + rng.random(len(at)) * 0.3, np.minimum(open_, close) - rng.random(len(at)) * 0.3
    return pd.DataFrame({"symbol": "x", "ts": at, "open": open_, "high": high, "low": low, "close": close})


def test_states_of_days(spark):
    rng = np.random.default_rng(3)
    days = pd.DataFrame({"symbol": "x", "ts": [START + dt.timedelta(days=i) for i in range(260) if i % 7 < 5]})
    days["close"] = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
    driver = pd.DataFrame({"ts": [START + dt.timedelta(days=i) for i in range(0, 260, 3)]})
    driver["value"] = 50 + np.cumsum(rng.normal(0, 1, len(driver)))
    both = pd.concat([days, days.assign(symbol=None)])  # a null symbol is a series
    out = market_states(spark.createDataFrame(both, "symbol string, ts timestamp, close double"), spark.createDataFrame(driver), trend=30, warm=25).toPandas().sort_values("ts")
    c = days.set_index("ts")["close"]
    r = c.pct_change()
    sign = np.sign(r.fillna(0.0)).to_numpy()
    memory = pd.Series(np.nan, c.index)
    for i in range(39, len(c)):
        a, b = sign[i - 39 : i], sign[i - 38 : i + 1]
        memory.iloc[i] = 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
    calendar = driver.set_index("ts")["value"].reindex(pd.date_range(driver.ts.min(), c.index.max())).ffill()
    moved = (calendar / calendar.shift(5) - 1).shift(2).reindex(c.index)
    sd = r.rolling(20).std()
    plain = {"m1": (sd, [1 / 3, 2 / 3]), "m2": (np.log(r.rolling(5).std() / sd), [1 / 3, 2 / 3]), "m3": (memory, [1 / 3, 2 / 3]), "m4": ((c - c.rolling(30).mean()) / (sd * c), [0.2, 0.4, 0.6, 0.8]), "m5": (moved, [1 / 3, 2 / 3])}
    for name, (x, shares) in plain.items():
        want = []
        for i in range(len(x)):
            past = x.iloc[:i].dropna()
            want.append(sum(x.iloc[i] > np.quantile(past, q) for q in shares) if len(past) >= 25 else np.nan)
        want = pd.Series(want, dtype=float).shift(1)
        for symbol in ("x", None):
            mine = out[out["symbol"].isna() if symbol is None else out["symbol"] == symbol]
            clear = np.ones(len(want), bool)
            if name == "m3":  # equal memories stand for equal ones only up to rounding here
                clear = np.array([i == 0 or not np.isclose(np.quantile(x.iloc[: i - 1].dropna(), shares) if x.iloc[: i - 1].notna().any() else 9, x.iloc[i - 1]).any() for i in range(len(x))])
            np.testing.assert_array_equal(mine[name].to_numpy(float)[clear], want.to_numpy()[clear], err_msg=name)
        assert want.nunique() > 1


def test_anchors(spark):
    b = _bars(600, 15)
    releases = [("a", b.ts[50].to_pydatetime() + dt.timedelta(minutes=7)), ("b", b.ts[50].to_pydatetime() + dt.timedelta(minutes=7)), ("a", b.ts[80].to_pydatetime()), ("a", START - dt.timedelta(minutes=1)), ("b", START + dt.timedelta(days=99))]
    out = anchors(spark.createDataFrame(b), spark.createDataFrame(releases, "kind string, when timestamp"), deviations=1.5, sigma=20, lookback=24).toPandas()
    got = {k: sorted(zip(g["rn"], g["dir"])) for k, g in out.groupby("anchor")}
    n, o, c = len(b), b.open.to_numpy(), b.close.to_numpy()
    assert got["A1"] == [(i, 0) for i in range(0, n, 4)]
    start = int(np.argmax(b.ts.dt.minute.to_numpy() == 0))
    first = np.arange(start, n - 4, 4)
    sd = pd.Series(c[first + 3] / o[first] - 1).rolling(20).std().to_numpy()
    a2, free = [], -999
    for m in np.flatnonzero(np.abs(c[first + 3] - o[first]) / (sd * o[first]) >= 1.5):
        k = first[m] + 3
        if k - free >= 16:
            a2.append((k, 1 if c[k] > o[first[m]] else -1))
            free = k
    assert a2 and got["A2"] == a2
    a3, up, down = [], -999, -999
    for i in range(24, n):
        if b.high[i] >= b.high[i - 23 : i + 1].max() and i - up >= 16:
            a3.append((i, 1))
            up = i
        elif b.low[i] <= b.low[i - 23 : i + 1].min() and i - down >= 16:
            a3.append((i, -1))
            down = i
    assert got["A3"] == a3
    assert got["A4"] == [(i, 0) for i in range(n) if b.ts[i].minute == 0 and b.ts[i].hour in (0, 7, 12, 17)]
    assert got["A5"] == [(50, 0), (50, 0), (80, 0)]
    assert len(got["A6"]) == len(a2)


def test_last_bar_can_be_an_extreme(spark):
    rows = [("x", START + dt.timedelta(minutes=15 * i), 1.0, 1.0, 1.0, 1.0) for i in range(30)] + [("x", START + dt.timedelta(minutes=450), 1.0, 5.0, 1.0, 5.0)]
    out = anchors(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double"), spark.createDataFrame([], "kind string, when timestamp"), lookback=28, gap=2)
    assert (30, 1) in {(r.rn, r.dir) for r in out.where("anchor = 'A3'").collect()}


def test_releases_fall_into_gaps(spark):
    bars = spark.createDataFrame([("x", 0, START), ("x", 1, START + dt.timedelta(minutes=5)), ("x", 2, START + dt.timedelta(hours=2)), (None, 0, START)], "symbol string, rn long, ts timestamp")
    at = [("k", START + dt.timedelta(minutes=m)) for m in (6, 19, 21, 125)]
    out = release_bars(bars, spark.createDataFrame(at, "kind string, when timestamp"), 900).collect()
    assert sorted((str(r.symbol), r.rn) for r in out) == [("None", 0), ("x", 1), ("x", 1), ("x", 2)]


def _plain_patterns(d: pd.DataFrame, reach: int, box_rows: int) -> dict:
    """Patterns of the last bar of d."""
    mean = lambda s: d["close"].ewm(span=s, adjust=False).mean().iloc[-1]
    bar, minute = d.iloc[-1], (d.ts.dt.hour * 60 + d.ts.dt.minute)
    out = dict.fromkeys(WEIGHTS, 0)
    e5, e20, e50 = mean(5), mean(20), mean(50)
    out["ema_detach"] = -1 if bar.low > e5 else 1 if bar.high < e5 else 0
    today = d.ts.dt.date == bar.ts.date()
    box, since, london = d[today & (minute >= 810) & (minute < 840)], d[today & (minute >= 840)], d[today & (minute >= 420) & (minute < 780)]
    if len(box) >= box_rows and 840 <= minute.iloc[-1] < 1080:
        up, down = since.index[since.high >= box.high.max()], since.index[since.low <= box.low.min()]
        if len(up) or len(down):
            out["box_break"] = 1 if len(up) and (not len(down) or up[0] < down[0]) else -1
            if len(london) and np.sign(london.close.iloc[-1] - london.close.iloc[0]) == out["box_break"]:
                out["london_agrees"] = out["box_break"]
    hi, lo = d.high.tail(reach).max(), d.low.tail(reach).min()
    place = (bar.close - lo) / (hi - lo) if hi > lo else 0.5
    out["range_extreme"] = -1 if place > 0.97 else 1 if place < 0.03 else 0
    trend, gap = np.sign(e20 - e50), bar.close - e20
    out["pullback"] = int(trend) if trend * gap < 0 else 0
    change = d.close.diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False).mean().iloc[-1] for x in (change.clip(lower=0), -change.clip(upper=0)))
    rsi = 100 - 100 / (1 + gain / loss) if loss else np.nan
    out["rsi_extreme"] = 1 if rsi < 30 else -1 if rsi > 70 else 0
    return out


def test_patterns(spark):
    b = _bars(900, 5, seed=8)
    got = context_patterns(spark.createDataFrame(b), reach=100, box_rows=5).toPandas().sort_values("rn").set_index("rn")
    assert list(got.index) == list(range(59, len(b)))
    for i in got.index:
        want = _plain_patterns(b.iloc[: i + 1], 100, 5)
        assert {k: int(got.loc[i, k]) for k in WEIGHTS} == want, i
        assert got.loc[i, "lean"] == sum(WEIGHTS[k] * v for k, v in want.items())
    assert all((got[k] != 0).any() for k in WEIGHTS)


def test_empty(spark):
    bars = spark.createDataFrame([], "symbol string, ts timestamp, open double, high double, low double, close double")
    assert context_patterns(bars).count() == 0
    assert anchors(bars, spark.createDataFrame([], "kind string, when timestamp")).count() == 0
    assert market_states(bars, spark.createDataFrame([], "ts timestamp, value double")).count() == 0
