"""Operators over ordered series against pandas and plain loops, with chunks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.indicators import add_indicators
from tidewater.operators.asof import asof_join
from tidewater.operators.ordered import carry_last, chunked, numbered, running, sma, windowed
from tidewater.operators.scan import cooldown, ewm


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    parts = []
    for symbol, n in (("a", 400), ("b", 1), ("c", 37)):
        close = 100 + rng.standard_normal(n).cumsum()
        open_ = close + rng.standard_normal(n)
        parts.append(pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n, freq="7h"), "open": open_, "high": np.maximum(open_, close) + 1, "low": np.minimum(open_, close) - 1, "close": close}))
    return pd.concat(parts, ignore_index=True)


def same(got, want, by=("symbol", "ts")):
    got, want = (x.sort_values(list(by)).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, atol=1e-9)


def test_numbers_and_chunks(spark, bars):
    d = numbered(spark.createDataFrame(bars), bucket="day", of="of")
    want = bars.assign(rn=bars.groupby("symbol").cumcount())
    same(d.select("symbol", "ts", "rn").toPandas(), want[["symbol", "ts", "rn"]])
    cut = chunked(d, back=5, ahead=3, size=50, of="of")
    assert cut.where("_own").count() == len(bars) and cut.where("not _own").count() == 7 * 5 + 7 * 3


def test_windows_do_not_depend_on_chunks(spark, bars):
    d = windowed(spark.createDataFrame(bars), {"m": sma("close", 20)}, back=19, size=25)
    want = bars.assign(m=bars.groupby("symbol")["close"].transform(lambda s: s.rolling(20).mean()))
    same(d.select("symbol", "ts", "m").toPandas(), want[["symbol", "ts", "m"]])


def test_ewm_composes_over_chunks(spark, bars):
    x = bars.assign(x=bars["close"].where(bars.groupby("symbol").cumcount() > 2))
    d = ewm(spark.createDataFrame(x), {"e": ("close", 0.1), "f": ("x", 0.4)}, size=30)
    g = x.groupby("symbol")
    want = x.assign(e=g["close"].transform(lambda s: s.ewm(alpha=0.1, adjust=False).mean()), f=g["x"].transform(lambda s: s.ewm(alpha=0.4, adjust=False).mean()))
    same(d.select("symbol", "ts", "e", "f").toPandas(), want[["symbol", "ts", "e", "f"]])


def test_running_and_carry(spark, bars):
    x = bars.assign(v=bars["close"].where(bars.index % 17 == 0), one=1)
    d = numbered(spark.createDataFrame(x))
    d = carry_last(running(d, {"top": ("max", "close"), "n": ("sum", "one")}, size=30), {"v": "last"}, size=30).toPandas()
    g = x.groupby("symbol")
    same(d, x.assign(top=g["close"].cummax(), n=g["one"].cumsum(), last=g["v"].ffill())[["symbol", "ts", "top", "n", "last"]])


def test_no_row_is_lost(spark):
    rows = [(None, "2024-01-01", 1.0), ("a", None, 2.0), ("a", "2024-01-02", float("nan")), ("a", "2024-02-02", 4.0), (None, "2024-03-01", 5.0)]
    d = spark.createDataFrame(rows, "symbol string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    d = carry_last(running(ewm(numbered(d).withColumn("w", F.lit(1.0)), {"e": ("w", 0.5)}), {"top": ("max", "v")}, size=2), {"v": "last"}, size=2)
    got = {(r.symbol, r.rn): (r.e, r.top, r["last"]) for r in d.collect()}
    assert got == {(None, 0): (1.0, 1.0, 1.0), (None, 1): (1.0, 5.0, 5.0), ("a", 0): (1.0, 2.0, 2.0), ("a", 1): (1.0, 2.0, 2.0), ("a", 2): (1.0, 4.0, 4.0)}


def test_cooldown(spark, bars):
    events = bars[bars["close"].mul(1000).astype(int) % 3 == 0]
    d = numbered(spark.createDataFrame(bars)).join(spark.createDataFrame(events[["symbol", "ts"]]), ["symbol", "ts"])
    got, want = cooldown(d, 4).toPandas(), []
    for symbol, g in bars.groupby("symbol"):
        last = None
        for i, (ts, c) in enumerate(zip(g["ts"], g["close"])):
            if int(c * 1000) % 3 == 0 and (last is None or i - last >= 4):
                last = i
                want.append((symbol, ts))
    assert sorted(zip(got["symbol"], got["ts"])) == sorted(want)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_ties_and_tolerance(spark, direction):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.to_timedelta(s, unit="s")
    left = pd.DataFrame({"k": "x", "id": range(8), "ts": at([10, 20, 30, 100_000, 200_000, 200_000, 0, 86_400])})
    right = pd.DataFrame({"k": "x", "v": range(9), "ts": at([8, 12, 8, 12, 30, 30, 99_998, 200_002, 199_998])})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "ts", by=["k"], direction=direction, tolerance=5, tie="v").toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("ts", kind="stable"), right.sort_values("ts", kind="stable"), on="ts", by="k", direction=direction, tolerance=pd.Timedelta("5s")).sort_values("id")
    assert got["r_v"].fillna(-1).tolist() == want["v"].fillna(-1).tolist()


def test_supertrend_is_the_plain_loop(spark, bars):
    got = add_indicators(spark.createDataFrame(bars), [("supertrend", {"smooth_n": 5, "atr_n": 4, "mult": 1})]).toPandas()
    for symbol, g in bars.groupby("symbol"):
        h, l, c = (g[x].rolling(5).mean() for x in ("high", "low", "close"))
        tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1).where(h.notna())
        v = tr.ewm(alpha=1 / 4, adjust=False).mean()
        up, dn, way, price, ways = np.nan, np.nan, np.nan, np.nan, []
        for a, b, x in zip((h + l) / 2 + v, (h + l) / 2 - v, c):
            if np.isnan(a):
                ways.append(np.nan)
            elif np.isnan(up):
                up, dn, way = a, b, 1.0 if x > a else -1.0
                ways.append(way)
            else:
                way = 1.0 if x > up else -1.0 if x < dn else way
                up, dn = a if a < up or price > up else up, b if b > dn or price < dn else dn
                ways.append(way)
            price = x
        mine = got[got.symbol == symbol].sort_values("ts")["supertrend_direction"]
        assert np.allclose(mine.to_numpy(dtype=float), np.array(ways), equal_nan=True)


def test_unknown_parameters_are_refused(spark, bars):
    with pytest.raises(ValueError):
        add_indicators(spark.createDataFrame(bars), [("sma", {"m": 3})])
    with pytest.raises(KeyError):
        add_indicators(spark.createDataFrame(bars), [("nothing", {})])


def test_no_look_ahead(spark, bars):
    """Indicators of a prefix of a series are those of the series."""
    wanted = [("sma", {}), ("rsi", {}), ("adx", {}), ("macd", {}), ("stoch", {}), ("bollinger", {})]
    cols = ["symbol", "ts", "sma", "rsi", "adx", "macd_hist", "stoch_d", "bb_upper"]
    whole, part = (add_indicators(spark.createDataFrame(x), wanted).select(*cols).toPandas() for x in (bars, bars[bars.ts < "2024-03-01"]))
    same(whole[whole.ts < "2024-03-01"], part[cols])


def test_asof_looks_ahead_in_one_pass(spark):
    """A frame that ends with the partition costs the square of a day's rows; results are those of plain loops."""
    r = np.random.default_rng(5)
    at = lambda n: pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, 60, n) * 3600, unit="s")
    left, right = pd.DataFrame({"i": range(40), "ts": at(40)}), pd.DataFrame({"ts": at(25), "seq": r.permutation(25)})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    for direction in ("forward", "nearest"):
        for strict in (False, True):
            found = asof_join(a, b, "ts", direction=direction, strict=strict, tie="seq")
            assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
            got = {x.i: x.r_seq for x in found.collect()}
            for x in left.itertuples():
                after = min([(y.ts, y.seq) for y in right.itertuples() if (y.ts > x.ts if strict else y.ts >= x.ts)], default=None)
                before = max([(y.ts, y.seq) for y in right.itertuples() if (y.ts < x.ts if strict else y.ts <= x.ts)], default=None)
                pick = after if direction == "forward" or before is None else before if after is None or x.ts - before[0] <= after[0] - x.ts else after
                assert got[x.i] == (pick and pick[1])


def test_a_wrapped_shift_starts_with_the_last_value(spark, tmp_path):
    from tidewater.queries_signals import wrapped_shift

    day = pd.to_datetime(pd.Series(["2000-01-01", "2000-01-02", "2000-01-03", "2000-01-01"])).astype("datetime64[us]")
    pd.DataFrame({"o_orderkey": range(4), "o_orderpriority": ["a", "a", "a", "b"], "o_orderdate": day, "o_totalprice": [1.0, 2.0, 3.0, 7.0]}).to_parquet(tmp_path / "orders.parquet")
    assert [x.rolled for x in wrapped_shift(spark, str(tmp_path)).orderBy("symbol", "t").collect()] == [3.0, 1.0, 2.0, 7.0]
