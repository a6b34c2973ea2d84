"""Resampling of time-ordered rows: moving blocks as row weights, and Monte Carlo runs of trades.

Draws are hashes of a row's number, a round and a seed, so they are the same wherever and however often a task runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.ordered import along, missing_as_null, numbered, same_series, windowed
from tidewater.shared import Written

from .stats import normal_two_sided

P = 2147483647
#: Largest weight of a row in a round; with a mean of at most 1 a larger one has a probability below 1e-6.
MOST = 9
#: Trades of a block, whose places fit two bytes; chunks of `size` draws that are one unit of work; draws at a time.
BLOCK, WIDE, AT_ONCE = 1 << 16, 50, 16_000_000
_UNIT = ["_n", "_chunk", "_from", "_to", "_block"]


def drawn(row, round_, seed: int):
    """A number in (0, 1) for a row and a round: on columns, and on arrays of numpy."""
    a = (row % P * 48271 + round_ * 69621 + seed * 16807 + 12345) % P
    floor = F.floor if isinstance(a, Column) else lambda x: x
    b = a * 39373 % P
    c = (b * (a % 65536) + (floor(b / 7) if isinstance(a, Column) else b // 7) + row % P) % P
    return (c * 48271 % P + 0.5) / P


def drawn_sql(row: str, round_: str, seed: int) -> str:
    a = f"(({row} % {P} * 48271 + {round_} * 69621 + {seed * 16807 + 12345}) % {P})"
    b = f"({a} * 39373 % {P})"
    return f"((({b} * ({a} % 65536) + {b} // 7 + {row} % {P}) % {P} * 48271 % {P} + 0.5) / {P})"


def block_sums(
    df: DataFrame, keys: list[str], y: str, id_col: str, block: int, rounds: int, seed: int = 7, order: tuple[str, ...] = ("ts",), size: int = 50_000
) -> DataFrame:
    """keys, round, weight, total: in each round, every run of `block` consecutive rows of a group is taken as often as a
    Poisson draw of its first row says, so that a row is taken once on average; weight counts rows and total sums y. Groups of
    no more than `block` rows are drawn row by row. Null y is left out before. Rows never meet: a task adds up weights for its
    rows, and rounds x groups numbers leave it."""
    df = missing_as_null(df, [y]).where(F.col(y).isNotNull()).select(*keys, id_col, F.col(y).cast("double").alias("_y"), *[o for o in order if o not in (*keys, id_col)])
    if block == 1:
        rows = df.select(*keys, F.col(id_col).cast("long").alias("_id"), F.col("_y").alias("_s"), F.lit(1.0).alias("_l"), F.lit(1.0).alias("_rate"))
    else:
        df = numbered(df.withColumn("_key", F.struct(*keys)), "_key", order, of="_n")
        length = F.when(F.col("_n") > block, F.lit(block)).otherwise(1)
        ahead = along("_key").rowsBetween(0, block - 1)
        cut = windowed(df, {"_s": F.when(F.col("_n") > block, F.sum("_y").over(ahead)).otherwise(F.col("_y"))}, ahead=block - 1, by="_key", size=size)
        cut = cut.where(F.col("rn") <= F.col("_n") - length)
        rate = F.col("_n") / (length * (F.col("_n") - length + 1))
        rows = cut.select(*keys, F.col(id_col).cast("long").alias("_id"), "_s", length.cast("double").alias("_l"), rate.alias("_rate"))
    of = [f.name for f in rows.schema.fields[: len(keys)]]
    every = np.arange(1, rounds + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                u = drawn(part["_id"].to_numpy()[:, None], every[None], seed)
                rate_, term = part["_rate"].to_numpy()[:, None], np.exp(-part["_rate"].to_numpy())[:, None]
                taken, total = np.zeros(u.shape), np.zeros((len(part), 1))
                for k in range(MOST):
                    total = total + term
                    taken += u > total
                    term = term * rate_ / (k + 1)
                for key, rows_of in part.groupby(of, dropna=False, sort=False).indices.items() if len(of) > 1 else part.groupby(of[0], dropna=False, sort=False).indices.items():
                    key = key if isinstance(key, tuple) else (key,)
                    t = taken[rows_of]
                    both = np.stack([(t * part["_l"].to_numpy()[rows_of, None]).sum(0), (t * part["_s"].to_numpy()[rows_of, None]).sum(0)])
                    held[key] = held[key] + both if key in held else both
        for key, (weight, total) in held.items():
            out = pd.DataFrame({"round": every, "weight": weight, "total": total})
            for name, value in reversed(list(zip(of, key))):
                out.insert(0, name, [None if pd.isna(value) else value] * rounds)
            yield out

    schema = T.StructType([*rows.schema.fields[: len(keys)], T.StructField("round", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("total", T.DoubleType())])
    return rows.mapInPandas(sums, schema).groupBy(*keys, "round").agg(F.sum("weight").alias("weight"), F.sum("total").alias("total"))


def block_bootstrap_effect(
    df: DataFrame, cell: list[str], strata: list[str], chosen: str, y: str, id_col: str, block: int, rounds: int = 400, seed: int = 7, least: int = 5, order: tuple[str, ...] = ("ts",)
) -> DataFrame:
    """Mean of y of chosen rows less that of the others, within strata, weighted by the chosen rows of a stratum; with its
    standard error, interval and p over rounds of moving blocks. Strata with fewer than `least` rows of either kind are left
    out. One row for each cell: effect, se, lo, hi, p, n_strata, n_chosen, rounds (those in which every stratum was drawn)."""
    rows = missing_as_null(df, [y]).where(F.col(y).isNotNull())
    is_chosen = F.col(chosen).cast("boolean")
    rows = rows.withColumn("_one", is_chosen).where(F.col("_one").isNotNull())
    g = rows.groupBy(*cell, *strata).agg(F.count_if("_one").alias("_n1"), F.count_if(~F.col("_one")).alias("_n0"), F.avg(F.when(F.col("_one"), F.col(y))).alias("_m1"), F.avg(F.when(~F.col("_one"), F.col(y))).alias("_m0"))
    g = g.where((F.col("_n1") >= least) & (F.col("_n0") >= least))
    point = g.groupBy(*cell).agg((F.sum(F.col("_n1") * (F.col("_m1") - F.col("_m0"))) / F.sum("_n1")).alias("effect"), F.count("*").alias("n_strata"), F.sum("_n1").alias("n_chosen"))
    kept = same_series(rows, g.select(*cell, *strata, "_n1"), [*cell, *strata])
    sums = block_sums(kept, [*cell, *strata, "_one"], y, id_col, block, rounds, seed, order)
    means = sums.groupBy(*cell, *strata, "round").agg(F.sum(F.when(F.col("_one"), F.col("total"))).alias("s1"), F.sum(F.when(F.col("_one"), F.col("weight"))).alias("w1"), F.sum(F.when(~F.col("_one"), F.col("total"))).alias("s0"), F.sum(F.when(~F.col("_one"), F.col("weight"))).alias("w0"))
    diff = F.when((F.col("w1") > 0) & (F.col("w0") > 0), F.col("s1") / F.col("w1") - F.col("s0") / F.col("w0"))
    means = same_series(means.withColumn("_d", diff), g.select(*cell, *strata, "_n1"), [*cell, *strata])
    each = means.groupBy(*cell, "round").agg((F.sum(F.col("_n1") * F.col("_d")) / F.sum("_n1")).alias("e"), F.count("_d").alias("_k"), F.count("*").alias("_of")).where("_k = _of")
    spread = each.groupBy(*cell).agg(F.stddev_samp("e").alias("se"), F.percentile("e", F.lit(0.025)).alias("lo"), F.percentile("e", F.lit(0.975)).alias("hi"), F.count("*").alias("rounds"))
    out = same_series(point, spread, cell, "left")
    return out.withColumn("p", F.when(F.col("se") > 0, normal_two_sided(F.col("effect") / F.col("se")))).select(*cell, "effect", "se", "lo", "hi", "p", "n_strata", "n_chosen", "rounds")


def bootstrap_mean(df: DataFrame, by: list[str], x: str, rounds: int = 400, seed: int = 7, id_col: str = "_id") -> DataFrame:
    """Percentile interval (lo, mid, hi) of the mean over rounds in which every row counts as often as a Poisson draw from its id says. Rows never
    meet, and only sums leave a task."""
    means = block_sums(df, by, x, id_col, 1, rounds, seed, ()).withColumn("m", F.col("total") / F.when(F.col("weight") > 0, F.col("weight")))
    return means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.5)).alias("mid"), F.percentile("m", F.lit(0.975)).alias("hi"))


def merged_ledger(ledger: DataFrame, resampled: DataFrame, keys: list[str]) -> DataFrame:
    """A ledger of effects with the resampled standard error and p where there are any (se_boot), on the keys of a cell."""
    r = resampled.select(*keys, F.col("se").alias("se_boot"), F.col("p").alias("_p"))
    return same_series(ledger, r, keys, "left").withColumn("p", F.coalesce("_p", "p")).drop("_p")


def _picks(n: int, chunk: int, wide: int, first: int, last: int, seed: int) -> np.ndarray:
    """Numbers of the trades that a chunk of a path of n draws, for each of the rounds."""
    slots, rounds = np.arange(chunk * wide, min(n, (chunk + 1) * wide)), np.arange(first, last + 1)
    return np.floor(drawn(slots[None], rounds[:, None], seed) * n).astype(np.int64).ravel()


def _by_block(block: np.ndarray) -> np.ndarray:
    """The order in which draws of the same block stand together."""
    return np.argsort(block.astype(np.uint16) if block.max(initial=0) < 1 << 16 else block, kind="stable")


def _running(net: np.ndarray, size: int) -> np.ndarray:
    """Running sums along rows: within `size` places, and over the sums of these."""
    rounds, m = net.shape
    inner = np.pad(net, ((0, 0), (0, -m % size))).reshape(rounds, -1, size).cumsum(axis=2)
    before = np.pad(inner[:, :, -1].cumsum(axis=1), ((0, 0), (1, 0)))[:, :-1]
    return (inner + before[:, :, None]).reshape(rounds, -1)[:, :m]


def _fall(level: np.ndarray, top: float) -> np.ndarray:
    """The largest drawdown of each row in percent, from its own tops and one before."""
    return -np.fmin.reduce(level / np.maximum(np.maximum.accumulate(level, axis=1), top) - 1, axis=1) * 100


def _drawn_paths(blocks: DataFrame, sizes: DataFrame, by: str, first: int, last: int, seed: int, equity: float, size: int, wide: int, tasks: int) -> DataFrame:
    """by, round, _chunk, _all and _high: the sum of a chunk's trades and its largest running sum; of a path of one chunk
    its largest fall, of others the chunk's trades."""
    length = BLOCK
    kind = f"`{by}` {sizes.schema[by].dataType.simpleString()}"
    unit = f"{kind}, _n long, _chunk long, _from long, _to long, _block long"
    each = F.greatest(F.lit(1), F.floor(wide / F.least("_n", F.lit(wide))))  # rounds of short paths go together
    units = sizes.select(by, "_n", each.alias("_each"), F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / wide))).alias("_chunk"))
    units = units.select(by, "_n", "_chunk", "_each", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), "_each")).alias("_from"))
    units = units.select(by, "_n", "_chunk", "_from", F.least(F.col("_from") + F.col("_each") - 1, F.lit(last)).alias("_to")).repartition(tasks, by, "_chunk", "_from")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, n, chunk, a, b in batch.itertuples(index=False, name=None):
                picks = _picks(n, chunk, wide, a, b, seed)
                picks = picks[_by_block(picks // length)]
                pieces = np.split(picks, np.flatnonzero(np.diff(picks // length)) + 1)
                yield pd.DataFrame([(key, n, chunk, a, b, p[0] // length, (p % length).astype("<u2").tobytes()) for p in pieces], columns=[by, *_UNIT, "_at"])

    def answer(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        nets = np.asarray(block["_nets"].iloc[0], dtype="<f8")
        return asked.drop(columns="_at").assign(_got=[nets[np.frombuffer(at, "<u2")].tobytes() for at in asked["_at"]])

    def lay(got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("_block")
        n, chunk, a, b = (int(got[c].iloc[0]) for c in _UNIT[:4])
        at = _by_block(_picks(n, chunk, wide, a, b, seed) // length)
        net = np.empty(len(at))
        net[at] = np.frombuffer(b"".join(got["_got"]), "<f8")
        net = net.reshape(b - a + 1, -1)
        sums, whole = _running(net, size), n <= wide
        out = pd.DataFrame({"round": np.arange(a, b + 1), "_chunk": chunk, "_all": sums[:, -1], "_high": sums.max(axis=1)})
        out["_fall"] = _fall(sums + equity, equity) if whole else None
        out["_nets"] = None if whole else [x.tobytes() for x in net]
        out.insert(0, by, [got[by].iloc[0]] * len(out))
        return out

    asked = units.mapInPandas(ask, f"{unit}, _at binary")
    got = asked.groupBy(by, "_block").cogroup(blocks.select(by, "_block", "_nets").groupBy(by, "_block")).applyInPandas(answer, f"{unit}, _got binary")
    return got.groupBy(by, "_chunk", "_from").applyInPandas(lay, f"{kind}, round long, _chunk long, _all double, _high double, _fall double, _nets binary")


def _path_ends(paths: DataFrame, by: str, equity: float, size: int) -> DataFrame:
    """by, round, final, fall: of each path its last level and its largest fall. What came before a chunk is known from
    the sums of chunks."""
    earlier = Window.partitionBy(by, "round").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = paths.where("_nets is not null").select(by, "round", "_chunk", "_all", "_high").withColumn("_start", F.coalesce(F.sum("_all").over(earlier), F.lit(0.0)))
    chunks = chunks.withColumn("_top", F.coalesce(F.max(F.col("_high") + F.col("_start") + equity).over(earlier), F.lit(equity))).drop("_all", "_high")
    long = same_series(paths.where("_nets is not null").select(by, "round", "_chunk", "_nets"), F.broadcast(chunks), [by, "round", "_chunk"])  # a row for each WIDE * size draws

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, k, chunk, nets, start, top in batch[[by, "round", "_chunk", "_nets", "_start", "_top"]].itertuples(index=False, name=None):
                level = _running(np.frombuffer(nets, "<f8")[None], size) + start + equity
                rows.append((key, k, chunk, level[0, -1], _fall(level, max(top, equity))[0]))
            yield pd.DataFrame(rows, columns=[by, "round", "_chunk", "_level", "_fall"])

    parts = long.mapInPandas(follow, f"`{by}` {paths.schema[by].dataType.simpleString()}, round long, _chunk long, _level double, _fall double")
    ends = parts.groupBy(by, "round").agg(F.max_by("_level", "_chunk").alias("final"), F.max("_fall").alias("fall"))
    return ends.unionByName(paths.where("_nets is null").select(by, "round", (F.col("_all") + equity).alias("final"), F.col("_fall").alias("fall")))


def monte_carlo(trades: DataFrame, by: str = "symbol", net: str = "net_pnl", rounds: int = 2000, equity: float = 1000.0, least: int = 5, seed: int = 0, order: tuple[str, ...] = ("exit_ts", "entry_i"), size: int = 5_000) -> DataFrame:
    """Trades of each run drawn anew, as many as there are, in each round: p05, p50 and p95 of the final equity, the share
    of rounds with a profit, and p50 and p95 of the largest drawdown in percent. Runs of fewer than `least` trades are left
    out. A drawn path is itself a series: one of more than WIDE * size trades is gone through in chunks, and sums are made of sums of `size` rows, as sums of many rows one by one lose places.

    Draws are no rows. A task draws a chunk of a path, asks each block of trades for those at some of its places, in two
    bytes each, and gets their values. Rounds are drawn AT_ONCE draws at a time (a round at least), and their tables and
    shuffle files deleted, so that disk does not grow with the number of rounds."""
    spark, wide = trades.sparkSession, WIDE * size
    written, kept = Written(spark), Written(spark)
    t = missing_as_null(numbered(trades.select(by, net, *order), by, order, of="_n").where(F.col("_n") >= least), [net])
    t = t.select(by, "_n", F.floor(F.col("rn") / BLOCK).alias("_block"), F.col("rn").alias("_rn"), F.coalesce(F.col(net).cast("double"), F.lit(0.0)).alias("_net"))
    blocks = written.table(t.groupBy(by, "_n", "_block").agg(F.sort_array(F.collect_list(F.struct("_rn", "_net")))["_net"].alias("_nets")))
    sizes = written.table(blocks.groupBy(by).agg(F.first("_n").alias("_n")))
    total, ends = sizes.agg(F.sum("_n")).first()[0] or 0, []
    some = max(1, AT_ONCE // max(1, total))
    for first in range(1, rounds + 1, some):
        turn, last = Written(spark), min(rounds, first + some - 1)
        paths = turn.table(_drawn_paths(blocks, sizes, by, first, last, seed, equity, size, wide, max(1, total * (last - first + 1) // (2 * wide))))
        ends.append(kept.table(_path_ends(paths, by, equity, size), keep=True))
        turn.drop()
    written.drop()
    ends = reduce(DataFrame.unionByName, ends)
    quantile = lambda c, q: F.percentile(c, F.lit(q))
    return ends.groupBy(by).agg(
        quantile("final", 0.05).alias("final_p05"), quantile("final", 0.5).alias("final_p50"), quantile("final", 0.95).alias("final_p95"), F.avg((F.col("final") > equity).cast("double")).alias("prob_profit"),
        quantile("fall", 0.5).alias("fall_p50"), quantile("fall", 0.95).alias("fall_p95"), F.count("*").alias("rounds"),
    )


def poisson_at_least(u: str, rate: str) -> str:
    """SQL of a Poisson draw from a number in (0, 1), as block_sums makes it."""
    terms, cuts = [], []
    for k in range(MOST):
        terms.append(f"exp(-{rate}) * pow({rate}, {k}) / {math.factorial(k)}")
        cuts.append(f"({u} > {' + '.join(terms)})::INT")
    return " + ".join(cuts)
