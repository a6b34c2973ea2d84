"""Weekly positions against plain pandas, and what missing values, replaced reports and total losses give."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest

from tidewater.plans.positioning import SIGNALS, VARIANTS, by_windows, daily_earnings, in_force, nets, random_means, weekly_outlook, weekly_signals

MONDAY = dt.datetime(2001, 1, 1)


def _days(n: int, seed: int = 1) -> pd.DataFrame:
    """Weekdays with some holidays."""
    rng = np.random.default_rng(seed)
    days = [MONDAY + dt.timedelta(days=i) for i in range(n) if i % 7 < 5]
    days = [d for d in days if rng.random() > 0.15]
    return pd.DataFrame({"symbol": "x", "ts": days, "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))})


def _reports(n: int, seed: int = 2) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    columns = [f"{g}_{s}" for g in ("spec", "comm", "small") for s in ("long", "short")]
    r = pd.DataFrame(rng.integers(0, 1000, (n, 6)).astype(float), columns=columns)
    r["interest"] = 6000.0
    r["ts"] = [MONDAY + dt.timedelta(days=1 + 7 * i) for i in range(n)]
    return r.assign(symbol="x")


def _second(n: int, first: int = 0, seed: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"ts": [MONDAY + dt.timedelta(days=1 + 7 * i) for i in range(first, n)], "mm_long": rng.integers(0, 99, n - first).astype(float), "mm_short": rng.integers(0, 99, n - first).astype(float), "mm_interest": 200.0})


def _plain_signals(n: pd.DataFrame, window: int) -> pd.DataFrame:
    roll = lambda s: s.rolling(window, min_periods=window // 2)
    z = lambda s: (s - roll(s).mean()) / roll(s).std()

    def rank(s):
        r = roll(s).apply(lambda x: (x[-1] > x[:-1]).mean(), raw=True)
        return r.where(s.notna())

    against = lambda r: np.where(r > 0.8, -1.0, np.where(r < 0.2, 1.0, 0.0))
    rs, rc = rank(n.spec_pct), rank(n.comm_pct)
    return pd.DataFrame({
        "fade_z": (-z(n.spec_pct) / 1.5).clip(-1, 1), "fade_extreme": against(rs), "follow_comm": (z(n.comm_pct) / 1.5).clip(-1, 1), "fade_managed": against(rank(n.mm_pct)),
        "fade_change": (-z(n.spec_pct.diff()) / 1.5).clip(-1, 1), "agree": np.where((rs > 0.8) & (rc < 0.2), -1.0, np.where((rs < 0.2) & (rc > 0.8), 1.0, 0.0)),
    }, index=n.index)


def _plain_earned(signal: pd.Series, close: pd.Series, cost: float) -> pd.Series:
    """signal and close by date."""
    placed = {}
    for day, value in signal.dropna().items():
        at = close.index.searchsorted(day + pd.Timedelta(days=4))
        if at < len(close):
            placed[close.index[at]] = value
    held = pd.Series(placed, dtype=float).reindex(close.index).ffill().fillna(0.0)
    paid = held.diff().abs().fillna(held.abs()) * cost / 1e4
    return (held.shift(1) * close.pct_change() - paid.shift(1)).iloc[1:]


def test_against_pandas(spark):
    days, reports, second = _days(900), _reports(120), _second(120, 30)
    reports.loc[40, "interest"] = 0.0  # no share that week
    net = nets(spark.createDataFrame(reports), spark.createDataFrame(second))
    weekly = weekly_signals(net, 20)
    got = weekly.toPandas().set_index("ts").sort_index()
    plain = _plain_signals(net.toPandas().set_index("ts").sort_index(), 20)
    for c in SIGNALS:
        np.testing.assert_allclose(got[c], plain[c], atol=1e-9, err_msg=c)
    assert (got["fade_managed"] != 0).any() and (got["agree"] != 0).any() and np.isnan(got["fade_z"].iloc[40])
    earned = daily_earnings(weekly, spark.createDataFrame(days), cost_bps=50.0, seeds=7).toPandas().set_index("ts").sort_index()
    close = days.set_index("ts")["close"]
    for c in SIGNALS:
        np.testing.assert_allclose(earned[c], _plain_earned(plain[c], close, 50.0), atol=1e-9, err_msg=c)
    paths = []
    for seed in range(7):
        side = {d: -1.0 if hashlib.md5(f"{seed}:{d:%Y-%m-%d}".encode()).hexdigest()[0] < "8" else 1.0 for d in plain.index}
        paths.append(_plain_earned(pd.Series(side), close, 50.0))
    np.testing.assert_allclose(earned["random"], np.mean(paths, axis=0), atol=1e-9)


def test_reports_that_share_a_day_and_late_ones(spark):
    """Two reports before a long holiday: the later one counts, but a missing value lets the earlier one stand; a report after the last day has no effect."""
    day = lambda d: MONDAY + dt.timedelta(days=d)
    weekly = spark.createDataFrame([("x", day(1), 1.0, 0.5), ("x", day(8), -1.0, None), ("x", day(90), 1.0, 1.0), (None, day(1), 0.25, 0.25)], "symbol string, ts timestamp, a double, b double")
    daily = spark.createDataFrame([("x", day(0), 1.0), ("x", day(30), 1.0), ("x", day(31), 1.0), (None, day(400), 1.0)], "symbol string, ts timestamp, close double")
    rows = {r.symbol: r for r in in_force(weekly, daily, ("a", "b")).collect()}
    assert (rows["x"].ts, rows["x"].report, rows["x"].a, rows["x"].b) == (day(30), day(8), -1.0, 0.5)
    assert rows[None].ts == day(400) and rows[None].a == 0.25  # a null symbol is a series, years between make no difference
    one = random_means(in_force(weekly, daily, ("a",)), 50).where("symbol = 'x'").first()
    assert one.random_change == 1.0 and -1 <= one.random <= 1


def test_spans(spark):
    days = [MONDAY + dt.timedelta(days=i) for i in range(6)]
    r = [0.1, -0.5, 0.0, 0.2, -1.5, 0.3]
    earned = spark.createDataFrame([("x", i, d, 0.01, *([v] * len(VARIANTS))) for i, (d, v) in enumerate(zip(days, r))], "symbol string, rn long, ts timestamp, hold double, " + ", ".join(f"{v} double" for v in VARIANTS))
    out = {x.span: x for x in by_windows(earned, [("four", "2001-01-01", "2001-01-05"), ("all", "2001-01-01", "2002-01-01"), ("none", "2005-01-01", "2006-01-01")], 3).where("variant = 'agree'").collect()}
    assert set(out) == {"four", "all"}
    assert out["four"].max_drawdown == pytest.approx(-0.5) and out["four"].hit == pytest.approx(2 / 3)
    assert out["four"].cagr == pytest.approx((1.1 * 0.5 * 1.2) ** (252 / 4) - 1)
    assert out["all"].cagr == -1.0 and out["all"].max_drawdown == -1.0  # a loss of everything


def test_outlook_skips_weeks_without_days(spark):
    days = [MONDAY + dt.timedelta(days=7 * i) for i in range(14) if i != 6]
    daily = spark.createDataFrame([("x", d, 100.0 + i * i) for i, d in enumerate(days)], "symbol string, ts timestamp, close double")
    taken = spark.createDataFrame([("x", d, float(i)) for i, d in enumerate(days)], "symbol string, ts timestamp, s double")
    rows = weekly_outlook(taken, daily, "s").orderBy("ts").collect()
    assert len(rows) == 11 and all(r.ts.weekday() == 4 for r in rows)  # the last week and the one before the gap have no next one
    assert [r.group for r in rows] == sorted(r.group for r in rows) and {r.group for r in rows} == {1, 2, 3, 4, 5}


def test_empty(spark):
    weekly = spark.createDataFrame([], "symbol string, ts timestamp, spec_pct double, " + ", ".join(f"{c} double" for c in SIGNALS))
    daily = spark.createDataFrame([], "symbol string, ts timestamp, close double")
    assert by_windows(daily_earnings(weekly, daily), [("all", "1990-01-01", "2020-01-01")]).count() == 0
