"""Ranks of values among all earlier ones of their series, exact, in many tasks.

Earlier rows of a value are of two kinds. Those of its own chunk of rows are counted in the chunk's task. Those of
earlier chunks are counted by buckets of values: whole buckets below from a table of counts by chunk and bucket, summed
along chunks and then along buckets; those of its own bucket in the bucket's task, where rows that share value and chunk
are one row with a count, so a frequent value is no larger than the number of chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.shared import Written

from .ordered import CHUNK, missing_as_null, numbered, running, same_series


def earlier(time: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element the weight of smaller values at earlier times, the largest of them, and the smallest value not
    below it at an earlier time (NaN: none). Times are merged in halves: in each turn the later half of every pair of
    halves looks at the earlier one, all in one sort."""
    t = np.unique(time, return_inverse=True)[1]
    below, under, over = np.zeros(len(t), np.int64), np.full(len(t), -np.inf), np.full(len(t), np.inf)
    for bit in range(int(t.max()).bit_length() if len(t) else 0):
        left = (t >> bit) & 1 == 0
        order = np.lexsort((left, value, t >> (bit + 1)))  # of equal values the looking ones come first
        pair, l, v = (t >> (bit + 1))[order], left[order], value[order]
        fresh = np.concatenate([[True], np.diff(pair) != 0])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), 0))
        total = np.concatenate([[0], np.cumsum(np.where(l, weight[order], 0))])
        looks = ~l
        below[order[looks]] += (total[:-1] - total[start])[looks]
        last = np.maximum.accumulate(np.where(l, np.arange(len(t)), -1))
        at = order[looks & (last >= start)]
        under[at] = np.maximum(under[at], v[last[looks & (last >= start)]])
        end = np.concatenate([np.flatnonzero(fresh)[1:], [len(t)]])[np.cumsum(fresh) - 1]
        first = np.minimum.accumulate(np.where(l, np.arange(len(t)), len(t))[::-1])[::-1]
        at = order[looks & (first < end)]
        over[at] = np.minimum(over[at], v[first[looks & (first < end)]])
    return below, np.where(np.isinf(under), np.nan, under), np.where(np.isinf(over), np.nan, over)


def earlier_ranks(df: DataFrame, x: str, by: str = "symbol", order: tuple[str, ...] = ("ts",), size: int = CHUNK) -> DataFrame:
    """Adds n_before (earlier values of the series), below (those smaller than x), under (the largest of those) and over
    (the smallest earlier value of at least x). Null and NaN x have null in all but n_before, and count for no other row. A
    null `by` is a series."""
    written = Written(df.sparkSession)
    ready = written.table(missing_as_null(df if "rn" in df.columns else numbered(df, by, order), [x]), keep=True)
    key = ready.schema[by].dataType.simpleString()
    rows = ready.select(by, "rn", F.col(x).cast("double").alias("_x")).withColumn("_chunk", F.floor(F.col("rn") / size))
    held = rows.where(F.col("_x").isNotNull())
    # buckets of about `size` rows: edges for each series, between approximate quantiles
    shares = [i / 4096 for i in range(1, 4096)]
    per = held.groupBy(by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", F.array(*[F.lit(s) for s in shares]), 20_000).alias("_q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(4096) * size / F.col("_n"))).cast("int")
    edges = F.when(F.col("_n") > size, F.array_distinct(F.filter("_q", lambda v, i: (i + 1) % step == 0))).otherwise(F.array().cast("array<double>"))
    per = per.select(by, edges.alias("_edges"))
    placed = same_series(held, per.select(by, "_edges"), [by])
    placed = written.table(placed.withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col("_x")))).drop("_edges"), keep=True)
    three = "_b long, _u double, _o double"

    def in_chunk(g: pd.DataFrame) -> pd.DataFrame:
        b, u, o = earlier(g["rn"].to_numpy(), g["_x"].to_numpy(), np.ones(len(g), np.int64))
        return g[[by, "rn", "_x", "_chunk", "_bucket"]].assign(_b=b, _u=u, _o=o)

    def in_bucket(g: pd.DataFrame) -> pd.DataFrame:
        b, u, o = earlier(g["_chunk"].to_numpy(), g["_x"].to_numpy(), g["_w"].to_numpy())
        return g[[by, "_x", "_chunk"]].assign(_b=b, _u=u, _o=o)

    own = placed.groupBy(by, "_chunk").applyInPandas(in_chunk, f"{by} {key}, rn long, _x double, _chunk long, _bucket int, {three}")
    counts = placed.groupBy(by, "_bucket", "_x", "_chunk").agg(F.count("*").alias("_w"))
    same = counts.groupBy(by, "_bucket").applyInPandas(in_bucket, f"{by} {key}, _x double, _chunk long, {three}").select(by, "_x", "_chunk", F.col("_b").alias("_b2"), F.col("_u").alias("_u2"), F.col("_o").alias("_o2"))
    # whole buckets of earlier chunks: a table of chunks and buckets, summed along both
    cells = counts.groupBy(by, "_chunk", "_bucket").agg(F.sum("_w").alias("_w"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    grid = cells.groupBy(by).agg(F.max("_chunk").alias("_c"), F.max("_bucket").alias("_m")).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), "_c"))).withColumn("_bucket", F.explode(F.sequence(F.lit(0), "_m"))).drop("_c", "_m")
    table = same_series(grid, cells, [by, "_chunk", "_bucket"], "left")
    before = Window.partitionBy(by, "_bucket").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select(by, "_chunk", "_bucket", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"), F.min("_lo").over(before).alias("_lo"), F.max("_hi").over(before).alias("_hi"))
    lower = Window.partitionBy(by, "_chunk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.partitionBy(by, "_chunk").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    table = table.select(by, "_chunk", "_bucket", F.coalesce(F.sum("_w").over(lower), F.lit(0)).alias("_b3"), F.max("_hi").over(lower).alias("_u3"), F.min("_lo").over(higher).alias("_o3"), F.sum("_w").over(Window.partitionBy(by, "_chunk")).alias("_held"))
    found = same_series(same_series(own, same, [by, "_x", "_chunk"]), table, [by, "_chunk", "_bucket"])
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    found = found.select(by, "rn", (F.col("_b") + F.col("_b2") + F.col("_b3")).alias("below"), F.greatest(real("_u"), real("_u2"), "_u3").alias("under"), F.least(real("_o"), real("_o2"), "_o3").alias("over"))
    counted = running(ready, {"_upto": ("count", x)}, by)
    n_before = (F.col("_upto") - F.col(x).isNotNull().cast("long")).alias("n_before")
    return same_series(counted.select(*ready.columns, n_before), found, [by, "rn"], "left")


def above_quantile(share: float, x: str) -> Column:
    """Whether x is above a quantile (by linear interpolation) of the earlier values, over the columns of earlier_ranks;
    null without earlier values."""
    at = F.lit(share) * (F.col("n_before") - 1)
    low = F.floor(at)
    part = at - low
    between = F.col("under") + (F.col("over") - F.col("under")) * part
    # below counts values under x: place `low` holds one of them if below > low, and place low + 1 if below > low + 1
    return F.when(F.col("n_before") > 0, F.when(F.col("below") > low + 1, True).when(F.col("below") <= low, False).otherwise((part == 0) | F.col("over").isNull() | (F.col(x) > between)))


def share_below(least: int = 1) -> Column:
    """Share of the earlier values that are smaller, null with fewer than `least` of them."""
    return F.when(F.col("n_before") >= max(least, 1), F.col("below") / F.col("n_before"))
