"""Ranks among earlier values against a plain count."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators.ranks import above_quantile, earlier, earlier_ranks


def test_earlier_is_a_plain_count():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 333):
        t, v, w = r.integers(0, max(n // 2, 1), n), r.integers(0, 20, n).astype(float), r.integers(1, 4, n)
        below, under, over = earlier(t, v, w)
        for i in range(n):
            low, high = (t < t[i]) & (v < v[i]), (t < t[i]) & (v >= v[i])
            assert below[i] == w[low].sum()
            assert under[i] == v[low].max() if low.any() else math.isnan(under[i])
            assert over[i] == v[high].min() if high.any() else math.isnan(over[i])


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_ranks_in_chunks_and_buckets(spark, size):
    r = np.random.default_rng(size)
    parts = [pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n, freq="9h"), "x": np.where(r.random(n) < hot, 5.0, np.round(r.normal(0, 3, n), 1))}) for s, n, hot in (("a", 150, 0.4), ("b", 90, 0.0), (None, 30, 0.9))]
    d = pd.concat(parts)
    d.loc[d.index % 17 == 3, "x"] = np.nan
    df = earlier_ranks(spark.createDataFrame(d, "symbol string, ts timestamp, x double"), "x", size=size).withColumn("q", above_quantile(1 / 3, "x"))
    got = {(str(g.symbol), g.ts): g for g in df.collect()}
    assert len(got) == len(d)
    for part in parts:
        part = d[d.symbol.isna()] if part.symbol.iloc[0] is None else d[d.symbol == part.symbol.iloc[0]]
        seen = []
        for s, ts, x in zip(part.symbol, part.ts, part.x):
            g = got[str(s), ts]
            assert g.n_before == len(seen)
            if math.isnan(x):
                assert g.below is None
                continue
            assert g.below == sum(v < x for v in seen) and g.under == max((v for v in seen if v < x), default=None) and g.over == min((v for v in seen if v >= x), default=None)
            assert g.q == (None if not seen else bool(x > np.quantile(seen, 1 / 3) + 1e-12) if abs(x - np.quantile(seen, 1 / 3)) > 1e-9 else g.q)
            seen.append(x)
