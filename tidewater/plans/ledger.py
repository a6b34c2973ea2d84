"""What follows anchors, and a ledger of how it differs between states of the market."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, chi_square_sf, normal_two_sided
from ..operators.ordered import along, missing_as_null, numbered, same_series, windowed
from .impulses import once

#: Up and down moves, in deviations, of which the first reached is asked for.
RACES = ((1, 1), (2, 1), (1, 2))


def _deviation(x: Column) -> Column:
    """Population deviation of an array of numbers."""
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)


def _first(values: Column, reached) -> Column:
    """Position, from 1, of the first value for which reached holds; null if there is none."""
    at = F.array_position(F.transform(values, lambda v: F.coalesce(reached(v), F.lit(False))), True)
    return F.when(at > 0, at)


def aftermath(bars: DataFrame, anchors: DataFrame, horizons: tuple[int, ...], by: str = "symbol") -> DataFrame:
    """A row for each anchor and horizon h; all but by, rn and h are null where h bars do not follow.

    bars: by, rn, high, low, close. anchors: by, rn, sigma (> 0), sma, start (the session's first open) and origin; these three may be null.
    r, mfe, mae (in sigmas), t_mfe, t_mae (bars), tail_up, tail_dn (beyond two), mfe_before_mae, race_x_y (1 if a move up by x sigmas comes in an earlier bar than one down by y; null if neither comes),
    rv_ratio (deviation of the changes after, by that of the h before), cross_sma, cross_start (the close changes sides), ret_origin (the price is met again)."""
    most = max(horizons)
    width = most + 1
    e = anchors.select(by, "rn", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("rn") - most) / width), F.floor((F.col("rn") + most) / width))).alias("_cell"))
    b = bars.select(by, F.col("rn").alias("_at"), "high", "low", "close", F.floor(F.col("rn") / width).alias("_cell"))
    met = same_series(e, b, [by, "_cell"]).withColumn("_off", (F.col("_at") - F.col("rn")).cast("int")).where(F.abs("_off") <= most)
    framed = met.groupBy(by, "rn").agg(F.array_sort(F.collect_list(F.struct(F.col("_off").alias("off"), "high", "low", "close"))).alias("_f"))
    rows = same_series(anchors, framed, [by, "rn"]).withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    rows = rows.withColumn("_n", F.filter("_f", lambda x: (x["off"] > 0) & (x["off"] <= F.col("h")))).withColumn("_p", F.filter("_f", lambda x: (x["off"] <= 0) & (x["off"] >= -F.col("h"))))
    c0, s = F.element_at("_p", -1)["close"], F.col("sigma")
    closes, highs, lows, past = (F.col("_n")["close"], F.col("_n")["high"], F.col("_n")["low"], F.col("_p")["close"])
    rows = rows.select(by, "rn", "h", s, "sma", "start", "origin", (F.size("_n") == F.col("h")).alias("_ok"), c0.alias("_c0"), closes.alias("_c"), highs.alias("_hi"), lows.alias("_lo"), past.alias("_past"))
    c0, closes, highs, lows, past = (F.col(c) for c in ("_c0", "_c", "_hi", "_lo", "_past"))
    top, bottom = F.array_max(highs), F.array_min(lows)
    t_up, t_down = F.array_position(highs, top), F.array_position(lows, bottom)
    after = F.transform(closes, lambda x, i: (x - F.when(i == 0, c0).otherwise(F.element_at(closes, F.greatest(i, F.lit(1))))) / c0)
    before = F.transform(F.slice(past, 2, F.greatest(F.size(past) - 1, F.lit(0))), lambda x, i: (x - F.element_at(past, i + 1)) / F.element_at(past, i + 1))
    rv = F.when((F.size(before) > 2) & (_deviation(before) > 0), _deviation(after) / _deviation(before))
    side = lambda x, level: F.signum(x - level)
    cross = F.when(side(c0, F.col("sma")) != 0, F.exists(closes, lambda x: side(x, F.col("sma")) == -side(c0, F.col("sma"))).cast("double"))
    cross_start = F.exists(closes, lambda x: side(x, F.col("start")) != side(c0, F.col("start"))).cast("double")
    origin = F.when(F.col("origin").isNotNull(), (F.exists(lows, lambda x: x <= F.col("origin")) | F.exists(highs, lambda x: x >= F.col("origin"))).cast("double"))
    r = (F.element_at(closes, -1) - c0) / s
    races = {}
    for x, y in RACES:
        up, down = _first(highs, lambda v, x=x: (v - c0) / s >= x), _first(lows, lambda v, y=y: (c0 - v) / s >= y)
        races[f"race_{x}_{y}"] = F.when(up.isNotNull() | down.isNotNull(), (up.isNotNull() & (down.isNull() | (up < down))).cast("double"))
    out = {
        "r": r, "mfe": (top - c0) / s, "mae": (c0 - bottom) / s, "t_mfe": t_up.cast("double"), "t_mae": t_down.cast("double"), "tail_up": (r > 2).cast("double"), "tail_dn": (r < -2).cast("double"),
        "mfe_before_mae": (t_up < t_down).cast("double"), **races, "rv_ratio": rv, "cross_sma": cross, "cross_start": F.when(F.col("start").isNotNull(), cross_start), "ret_origin": origin,
    }
    return rows.select(by, "rn", "h", *[F.when(F.col("_ok"), c).alias(name) for name, c in out.items()])


METRICS = ("r", "mfe", "mae", "t_mfe", "t_mae", "tail_up", "tail_dn", "mfe_before_mae", *[f"race_{x}_{y}" for x, y in RACES], "rv_ratio", "cross_sma", "cross_start", "ret_origin")


def inflation(df: DataFrame, cell: list[str], y: str, lags: Column, order: tuple[str, ...] = ("ts",), cap: float = 10.0, least: int = 30) -> DataFrame:
    """cell, inflation: 1 + 2 (sum of autocorrelations up to `lags`, a number of each cell), between 1 and cap; 1 for fewer than `least` values.

    The lagged products of a value are one product with the sum of the values that follow it, so lags cost nothing."""
    df = missing_as_null(df, [y]).where(F.col(y).isNotNull())
    means = df.groupBy(*cell).agg(F.avg(y).alias("_m"), F.count("*").alias("_n"), F.max(lags).cast("int").alias("_l"))
    most = means.agg(F.max("_l")).first()[0] or 1
    d = once(numbered(same_series(df, means, cell).withColumn("_key", F.struct(*cell)).withColumn("_v", F.col(y) - F.col("_m")), "_key", order))
    ahead = F.collect_list("_v").over(along("_key").rowsBetween(1, most))
    total = F.aggregate(F.slice(F.col("_next"), F.lit(1), F.col("_l")), F.lit(0.0), lambda a, v: a + v)
    d = windowed(d, {"_next": ahead}, ahead=most, by="_key")
    g = d.groupBy(*cell).agg(F.sum(F.col("_v") * total).alias("_lagged"), F.sum(F.col("_v") * F.col("_v")).alias("_square"), F.max("_n").alias("_n"))
    value = F.least(F.lit(cap), F.greatest(F.lit(1.0), 1 + 2 * F.col("_lagged") / F.col("_square")))
    return g.select(*cell, F.when((F.col("_n") >= least) & (F.col("_square") > 0), value).otherwise(1.0).alias("inflation"))


def _effects(stats: DataFrame, cell: list[str], strata: list[str], bucket: str, least: int) -> DataFrame:
    """Effects of each bucket against all others, from counts, sums and sums of squares by stratum and bucket: what is not the bucket is the total less it."""
    w = Window.partitionBy(*cell, *strata)
    s = stats.withColumns({f"_t{c}": F.sum(c).over(w) for c in ("_n", "_s", "_q")})
    n1, n0 = F.col("_n"), F.col("_t_n") - F.col("_n")
    mean1, mean0 = F.col("_s") / n1, (F.col("_t_s") - F.col("_s")) / n0
    var = lambda n, total, square: (square - total * total / n) / (n - 1)
    error = var(n1, F.col("_s"), F.col("_q")) / n1 + var(n0, F.col("_t_s") - F.col("_s"), F.col("_t_q") - F.col("_q")) / n0
    s = s.where((n1 >= least) & (n0 >= least)).withColumns({"_e": mean1 - mean0, "_v": error, "_n0": n0})
    return s.groupBy(*cell, bucket).agg((F.sum(F.col("_n") * F.col("_e")) / F.sum("_n")).alias("effect"), (F.sqrt(F.sum(F.col("_n") * F.col("_n") * F.col("_v"))) / F.sum("_n")).alias("se"), F.count("*").alias("n_strata"))


def ledger(rows: DataFrame, cell: list[str], bucket: str, block: str, session: str, y: str, lags: Column, least: int = 60, least_block: int = 20, least_stratum: int = 5, least_strata: int = 2, q: float = 0.1, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A row for each cell and bucket with enough rows in it and outside: n_in, n_out, effect (stratified by block and session), se
    (widened by the inflation of the bucket's series), p, cochran_p, i2 and n_blocks over the effects of single blocks, loo_ok (leaving out any block keeps the sign and the size within half; null below three blocks), and
    significant (false discoveries at most q of all rows). Rows without bucket or y are left out."""
    d = missing_as_null(rows, [y]).where(F.col(y).isNotNull() & F.col(bucket).isNotNull())
    stats = once(d.groupBy(*cell, block, session, bucket).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"), F.sum(F.col(y).cast("double") * F.col(y)).alias("_q")))
    sizes = stats.groupBy(*cell, bucket).agg(F.sum("_n").alias("n_in")).withColumn("n_out", F.sum("n_in").over(Window.partitionBy(*cell)) - F.col("n_in"))
    sizes = sizes.where((F.col("n_in") >= least) & (F.col("n_out") >= least))
    whole = same_series(sizes, _effects(stats, cell, [block, session], bucket, least_stratum).where(F.col("n_strata") >= least_strata), [*cell, bucket])
    wider = inflation(d, [*cell, bucket], y, lags, order)
    whole = same_series(whole, wider, [*cell, bucket]).withColumn("se", F.col("se") * F.sqrt("inflation"))
    # single blocks, with gates of their own
    held = stats.groupBy(*cell, block, bucket).agg(F.sum("_n").alias("_in")).withColumn("_out", F.sum("_in").over(Window.partitionBy(*cell, block)) - F.col("_in")).where((F.col("_in") >= least_block) & (F.col("_out") >= least_block))
    single = _effects(stats, [*cell, block], [session], bucket, least_stratum).where((F.col("n_strata") >= least_strata) & (F.col("se") > 0))
    single = same_series(same_series(single.select(*cell, block, bucket, F.col("effect").alias("_be"), (F.col("se")).alias("_bs")), wider, [*cell, bucket]), held.select(*cell, block, bucket), [*cell, block, bucket])
    pair = F.struct(F.col("_be").alias("e"), (1 / (F.col("_bs") * F.col("_bs") * F.col("inflation"))).alias("w"))
    blocks = single.groupBy(*cell, bucket).agg(F.collect_list(pair).alias("_b"))  # one for each block
    out = once(same_series(whole, blocks, [*cell, bucket], "left"))
    b = F.coalesce("_b", F.array().cast("array<struct<e:double,w:double>>"))
    total = lambda f, x=b: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))
    mean = total(lambda v: v["w"] * v["e"]) / total(lambda v: v["w"])
    k = F.size(b)
    out = out.withColumns({"n_blocks": k, "_q": F.when(k >= 2, total(lambda v: v["w"] * (v["e"] - mean) * (v["e"] - mean)))})
    cochran_p = reduce(lambda a, n: F.when(F.col("n_blocks") == n + 1, chi_square_sf(F.col("_q"), n)).otherwise(a), (1, 2, 3), F.lit(None).cast("double"))
    weights, products = total(lambda v: v["w"]), total(lambda v: v["w"] * v["e"])
    left_out = F.transform(b, lambda v: (products - v["w"] * v["e"]) / (weights - v["w"]))
    e = F.col("effect")
    same = F.forall(left_out, lambda x: (F.signum(x) == F.signum(e)) & (F.abs(x) >= 0.5 * F.abs(e)) & (F.abs(x) <= 1.5 * F.abs(e)))
    out = out.withColumns({"cochran_p": cochran_p, "i2": F.when(k >= 2, F.when(F.col("_q") > 0, F.greatest(F.lit(0.0), (F.col("_q") - (k - 1)) / F.col("_q"))).otherwise(0.0)), "loo_ok": F.when((k >= 3) & (e != 0), same), "p": F.when(F.col("se") > 0, normal_two_sided(e / F.col("se")))})
    out = benjamini_hochberg(once(out.drop("_b", "_q")), "p", q)
    return out.select(*cell, bucket, "n_in", "n_out", "effect", "se", "p", "cochran_p", "i2", "n_blocks", "loo_ok", "significant")
