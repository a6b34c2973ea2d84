"""Folded exits, impulses, aftermath, ledgers and source quality against plain versions, with nulls and empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators.exits import MODELS, fixed, folded_exits, swing_trail
from tidewater.operators.quality import changes, clock_offsets, seams, session_coverage
from tidewater.plans.impulses import impulses, last_resolution, new_extremes, quiet_days, resolved
from tidewater.plans.ledger import aftermath, inflation, ledger

BARS = "symbol string, rn long, high double, low double, close double"


def series(spark, closes, symbol="a", reach=0.0):
    return spark.createDataFrame([(symbol, i, c + reach, c - reach, float(c)) for i, c in enumerate(closes)], BARS)


def entry(spark, rows):
    return spark.createDataFrame(rows, "symbol string, id long, at long, side int, price double, risk double, stop double, level double")


@pytest.mark.parametrize("side", [1, -1])
@pytest.mark.parametrize("first", [2, 16])
def test_exits_of_a_path(spark, side, first):
    """Up by 1.6 risks, back below the entry, then up again, turned around for shorts."""
    path = [100, 101, 103.2, 102, 99.5, 104, 105, 110]
    turn = lambda p: p if side > 0 else 200 - p
    bars = series(spark, [turn(p) for p in path]).withColumns({"low3": F.lit(turn(98.0)), "high3": F.lit(turn(98.0)), "range": F.lit(0.0), "mean": F.lit(float(turn(90)))})
    e = entry(spark, [("a", 1, 0, side, 100.0, 2.0, 100.0 - 2 * side, float(turn(103)))])
    r = folded_exits(bars, e, 6, first=first).first()
    assert (r.two_risks_r, r.two_risks_bars) == (2.0, 5)
    assert (r.half_then_swing_r, r.half_then_swing_bars) == (0.75, 4)  # half at 1.5 risks, the rest at the entry
    assert r.prior_extreme_r == 1.5 and r.prior_extreme_bars == 2
    assert (r.steps_r, r.steps_bars) == (0.0, 4)  # the stop went to the entry
    assert (r.swing_r, r.swing_bars) == (2.5, 6)  # six bars without the stop: out at the close of the next
    assert r.three_risks_r == 2.5 and r.mean_r != 0


def test_exits_of_nulls_and_ends(spark):
    bars = series(spark, [100, 101, 102]).unionByName(series(spark, [50, 40], None))
    e = entry(spark, [("a", 1, 2, 1, 100.0, 5.0, 95.0, None), (None, 2, 0, 1, 50.0, 5.0, 45.0, None), ("a", 3, 9, 1, 100.0, 5.0, 95.0, None)])
    rows = {r.id: r for r in folded_exits(bars, e, 4, {"x": fixed(2.0), "y": swing_trail(0.1)}).collect()}
    assert (rows[1].x_r, rows[1].x_bars) == (0.4, 0) and (rows[2].x_r, rows[2].x_bars) == (-1.0, 1) and rows[3].x_r is None
    assert folded_exits(bars, e.limit(0), 4, MODELS).count() == 0


def plain_impulses(close, open_, window, sds, gap, timeout):
    n = len(close)
    g = np.arange(0, n - 4, 4)
    ho, hc = open_[g], close[g + 3]
    sd = pd.Series(hc / ho - 1).rolling(window).std().to_numpy()
    imp = np.abs(hc - ho) / (sd * ho) >= sds
    out, last = [], -(10**9)
    for m in np.flatnonzero(imp):
        at = g[m] + 3
        if at - last < gap:
            continue
        last, later = at, [g[k] + 3 for k in np.flatnonzero(imp) if k > m]
        d, half = (1 if hc[m] > ho[m] else -1), abs(hc[m] - ho[m]) / 2
        kind, res = "timeout", min(at + timeout, n - 1)
        for k in range(at + 1, min(at + timeout + 1, n)):
            if later and k >= later[0]:
                kind, res = "superseded", later[0]
                break
            if abs(x := d * (close[k] - hc[m])) >= half:
                kind, res = ("extended" if x > 0 else "retraced"), k
                break
        out.append((int(at), d, kind, int(res), timeout if kind == "timeout" else int(res - at)))
    return out


def test_impulses_equal_a_plain_race(spark):
    parts, expected = [], {}
    for name, seed in (("a", 1), (None, 2)):
        r = np.random.default_rng(seed)
        close = 100 + np.round(r.standard_t(3, 700).cumsum() * 0.3, 2)
        open_ = np.concatenate([[100], close[:-1]])
        parts.append(pd.DataFrame({"symbol": name, "ts": pd.date_range("2024-01-01", periods=700, freq="15min"), "open": open_, "close": close}))
        expected[str(name)] = plain_impulses(close, open_, 10, 1.0, 6, 12)
    bars = spark.createDataFrame(pd.concat(parts), "symbol string, ts timestamp, open double, close double")
    found = resolved(bars, impulses(bars, window=10, deviations=1.0), gap=6, timeout=12, warm=5)
    for name in ("a", "None"):
        rows = sorted((r.at, r.dir, r.kind, r.res, r.duration) for r in found.collect() if str(r.symbol) == name)
        assert rows == expected[name] and len({r[2] for r in rows}) >= 3
    assert found.where("bucket is null").count() == 10
    assert last_resolution(found).count() == found.select("symbol", "res").distinct().count()
    assert resolved(bars.limit(0), impulses(bars.limit(0))).count() == 0


def test_quiet_days_look_back_only(spark):
    r = np.random.default_rng(3)
    d = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=120, freq="D"), "close": 100 + r.normal(0, 1, 120).cumsum()})
    whole = {x.ts: (x.quiet, x.rv) for x in quiet_days(spark.createDataFrame(d), 5, 20).collect()}
    part = {x.ts: (x.quiet, x.rv) for x in quiet_days(spark.createDataFrame(d.head(80)), 5, 20).collect()}
    assert all(whole[t] == part[t] for t in part) and {q for q, _ in whole.values()} == {True, False}
    rv = d.close.pct_change().rolling(5).std()
    for i in range(30, 119):
        past = rv[:i].dropna()
        assert whole[d.ts[i + 1]][0] == (len(past) >= 20 and rv[i] <= np.quantile(past, 1 / 3))


def test_extremes_pause_by_direction(spark):
    h = [1, 2, 3, 4, 5, 6, 7, 0, -1, 8, 9]
    d = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=11, freq="h"), "open": h, "high": h, "low": h}).astype({"open": float, "high": float, "low": float})
    got = new_extremes(spark.createDataFrame(d), F.lit(True), 3, 3).collect()
    assert sorted((r.rn, r.side) for r in got) == [(3, 1), (6, 1), (7, -1), (9, 1)]
    assert new_extremes(spark.createDataFrame(d), F.lit(None).cast("boolean"), 3, 3).count() == 0


def test_aftermath_of_a_path(spark):
    bars = series(spark, [10, 11, 10, 12, 13, 9], reach=0.5).unionByName(series(spark, [10, 11], None))
    a = spark.createDataFrame([("a", 1, 1.0, 11.5, None, 13.4), ("a", 4, 1.0, None, None, None), (None, 0, 1.0, 10.0, 10.0, None)], "symbol string, rn long, sigma double, sma double, start double, origin double")
    rows = {(r.symbol, r.rn, r.h): r for r in aftermath(bars, a, (1, 3)).collect()}
    r = rows["a", 1, 3]
    assert (r.r, r.mfe, r.mae, r.t_mfe, r.t_mae) == (2.0, 2.5, 1.5, 3.0, 1.0) and r.tail_up == 0.0 and r.mfe_before_mae == 0.0
    assert (r.race_1_1, r.race_2_1, r.race_1_2) == (0.0, 0.0, 1.0) and r.cross_sma == 1.0 and r.cross_start is None and r.ret_origin == 1.0
    assert rows["a", 4, 3].r is None and rows["a", 4, 1].r == -4.0 and rows["a", 4, 1].race_1_2 == 0.0
    assert rows[None, 0, 1].cross_sma is None and rows[None, 0, 3].r is None and rows[None, 0, 1].cross_start == 1.0


def test_inflation_and_ledger_see_what_was_planted(spark):
    r = np.random.default_rng(6)
    n = 6000
    noise = r.normal(0, 1, n)
    walk = np.convolve(r.normal(0, 1, n + 7), np.ones(8), "valid") / 8**0.5
    state = r.integers(0, 3, n)
    d = pd.DataFrame({"cell": "c", "state": state, "block": np.arange(n) * 4 // n, "session": np.arange(n) % 3, "y": noise + 0.5 * (state == 1), "z": walk, "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "h": 16})
    d.loc[5, "y"] = np.nan
    df = spark.createDataFrame(d)
    lags = F.bround(F.col("h") / 4)
    v = d.z - d.z.mean()
    plain = 1 + 2 * sum((v[:-k].to_numpy() * v[k:].to_numpy()).sum() for k in range(1, 5)) / (v**2).sum()
    assert math.isclose(inflation(df, ["cell"], "z", lags).first().inflation, plain, rel_tol=1e-9)
    assert inflation(df.where("session = 0 and state = 1").limit(20), ["cell"], "z", lags).first().inflation == 1.0
    rows = {x.state: x for x in ledger(df, ["cell"], "state", "block", "session", "y", lags).collect()}
    assert abs(rows[1].effect - 0.5) < 0.1 and rows[1].significant and rows[1].loo_ok and rows[1].n_blocks == 4 and rows[1].p < 1e-10
    assert sum(x.n_in for x in rows.values()) == n - 1 and abs(rows[0].effect + 0.25) < 0.1
    assert ledger(df.limit(50), ["cell"], "state", "block", "session", "y", lags).count() == 0


def test_clocks_and_seams_and_coverage(spark):
    r = np.random.default_rng(7)
    n = 4000
    price = 100 * np.exp(np.cumsum(r.normal(0, 0.001, n)))
    ts = pd.date_range("2024-01-01", periods=n, freq="min")
    a = pd.DataFrame({"symbol": "a", "ts": ts + pd.Timedelta("120min"), "price": price})  # a's clock is two hours ahead
    b = pd.DataFrame({"symbol": "b", "ts": ts, "price": price * (1 + r.normal(0, 1e-5, n))})
    b.loc[b.ts >= pd.Timestamp("2024-01-03"), "price"] = 100 * np.exp(r.normal(0, 0.001, (b.ts >= pd.Timestamp("2024-01-03")).sum()).cumsum())
    of = lambda d: changes(spark.createDataFrame(d), "symbol", 60)
    period = F.datediff(F.to_date(F.timestamp_seconds((F.col("t") - 120) * 60)), F.lit("2024-01-01").cast("date"))
    found = {x.period: x for x in clock_offsets(of(a).withColumn("period", period), of(b), (360, 30), (30, 5), 15, 200).collect()}
    assert (found[0].offset, found[0].flag, found[0].borrowed) == (120, "ok", False) and found[1].offset == 120
    assert found[2].flag == "low_quality" and found[2].offset == 120
    ticks = spark.createDataFrame(b).unionByName(spark.createDataFrame([(None, None, 1.0)], "symbol string, ts timestamp, price double"))
    c = session_coverage(ticks).first()
    month = pd.date_range("2024-01-01", "2024-02-01", freq="min", inclusive="left")
    closed = lambda t: t.weekday() == 5 or (t.weekday() == 6 and t.hour < 22) or (t.weekday() == 4 and t.hour >= 21) or (t.weekday() <= 3 and t.hour == 21)
    assert (c.year, c.month, c.expected) == (2024, 1, sum(not closed(t) for t in month))
    inside = [t for t in ts if not closed(t)]
    assert c.covered == len(inside)
    bars = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-25", periods=400, freq="h"), "close": np.linspace(100, 140, 400)})
    bars["source"] = np.where(bars.ts < pd.Timestamp("2024-02-01"), 1, 2)
    (s,) = seams(spark.createDataFrame(bars), 6 * 3600).collect()
    assert (s.before, s.after) == (1, 2) and s.month == pd.Timestamp("2024-02-01") and s.first_close > s.last_close and s.jump_bps > 0
    assert seams(spark.createDataFrame(bars).where("source = 1"), 6 * 3600).count() == 0


def test_features_do_not_look_ahead(spark):
    from tidewater.plans.features import FEATURES, feature_frame

    r = np.random.default_rng(8)
    n = 150
    close = 100 + r.normal(0, 1, n).cumsum()
    d = pd.DataFrame({"symbol": "a", "ts": pd.date_range("2024-01-01", periods=n, freq="30min"), "open": close, "high": close + 1, "low": close - 1, "close": close})
    args = ((1, 3, 12, 24), (60, 24), (24, 20), (12, 3), (60, 24))
    whole, part = (feature_frame(spark.createDataFrame(x), *args).toPandas().sort_values("rn").reset_index(drop=True) for x in (d, d.head(100)))
    assert np.allclose(whole.head(100)[list(FEATURES)].astype(float), part[list(FEATURES)].astype(float), equal_nan=True)
    assert np.isclose(whole.ret_c.iloc[-1], close[-1] / close[-13] - 1) and whole[list(FEATURES)].iloc[-1].notna().all()


def test_minutes_of_rounded_times_equal_sql(spark, tmp_path):
    """A quote half a millisecond before a minute's end belongs to the next; rows without a price or a seq; times before 1970."""
    import duckdb

    from tidewater.queries_basic import minute_last_price
    from tidewater.registry import SQL

    at = ["2024-01-25 05:36:55.2656", "2024-01-25 05:36:59.999499", "2024-01-25 05:36:59.9995", "2024-01-25 05:36:59.9997", "2024-01-25 05:37:10", "2024-01-25 05:38:00", "2024-01-25 05:38:00", "1969-12-31 23:58:59.9995", "1969-12-31 23:59:00.0006", "1969-12-31 23:58:10", "1960-05-05 12:00:01", None]
    price = [1.0, 2.0, 3.0, 4.0, None, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0]
    seq = [1, 2, 4, 3, 5, 6, None, 7, 8, 9, 10, 11]
    d = pd.DataFrame({"event_id": pd.array(seq, "Int64"), "ts": pd.to_datetime(pd.Series(at), format="mixed").astype("datetime64[us]"), "user_id": 1, "event_type": "x", "value": pd.array(price, "Float64"), "props": ""})
    d.to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    key = lambda r: (str(r[1]), str(r[2]))
    assert sorted((tuple(r) for r in minute_last_price(spark, str(tmp_path)).select("symbol", "minute", "price").collect()), key=key) == sorted(con.execute(SQL["minute_last_price"]).fetchall(), key=key)
