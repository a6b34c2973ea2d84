"""The indicator library: a registry of builders that add columns to bars (symbol, ts, open, high, low, close)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import along, mean_abs_dev, numbered, over, rolling_max, rolling_min, rolling_std, sma, windowed
from ..operators.scan import ewm, ratchet

Builder = Callable[..., DataFrame]


@dataclass(frozen=True)
class Indicator:
    name: str
    build: Builder
    params: dict[str, float] = field(default_factory=dict)
    outputs: tuple[str, ...] = ()


REGISTRY: dict[str, Indicator] = {}


def indicator(*outputs: str, **params: float) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        name = f.__name__.rstrip("_")
        REGISTRY[name] = Indicator(name, f, params, outputs)
        return f

    return add


def add_indicators(bars: DataFrame, wanted: list[tuple[str, dict]]) -> DataFrame:
    """Adds indicators by name with parameters; the outputs have the registry's names."""
    out = bars if "rn" in bars.columns else numbered(bars)
    for name, params in wanted:
        known = REGISTRY[name]
        if unknown := set(params) - set(known.params):
            raise ValueError(f"{name} has no parameter {sorted(unknown)}")
        out = known.build(out, **known.params | params)
    return out


def true_range(d: DataFrame, out: str = "_tr") -> DataFrame:
    """The first row's is high - low."""
    before = F.lag("close").over(along())
    spread = F.col("high") - F.col("low")
    gaps = F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return windowed(d, {out: gaps}, back=1)


@indicator("sma", n=20)
def sma_(d: DataFrame, n: int) -> DataFrame:
    return windowed(d, {"sma": sma("close", n)}, back=n - 1)


@indicator("ema", n=20)
def ema(d: DataFrame, n: int) -> DataFrame:
    return ewm(d, {"ema": ("close", 2 / (n + 1))})


@indicator("rsi", n=14)
def rsi(d: DataFrame, n: int) -> DataFrame:
    """Wilder's; null while there are no losses."""
    change = F.col("close") - F.lag("close").over(along())
    d = windowed(d, {"_up": F.greatest(change, F.when(change.isNotNull(), 0.0)), "_dn": F.greatest(-change, F.when(change.isNotNull(), 0.0))}, back=1)
    d = ewm(d, {"_gain": ("_up", 1 / n), "_loss": ("_dn", 1 / n)})
    loss = F.when(F.col("_loss") != 0, F.col("_loss"))
    return d.withColumn("rsi", 100 - 100 / (1 + F.col("_gain") / loss)).drop("_up", "_dn", "_gain", "_loss")


@indicator("atr", n=14)
def atr(d: DataFrame, n: int) -> DataFrame:
    return ewm(true_range(d), {"atr": ("_tr", 1 / n)}).drop("_tr")


@indicator("sma_atr", n=14)
def sma_atr(d: DataFrame, n: int) -> DataFrame:
    return windowed(true_range(d), {"sma_atr": sma("_tr", n)}, back=n - 1).drop("_tr")


@indicator("adx", "plus_di", "minus_di", n=14)
def adx(d: DataFrame, n: int) -> DataFrame:
    up, dn = F.col("high") - F.lag("high").over(along()), F.lag("low").over(along()) - F.col("low")
    moves = {"_up": F.when((up > dn) & (up > 0), up).otherwise(0.0), "_dn": F.when((dn > up) & (dn > 0), dn).otherwise(0.0)}
    d = windowed(true_range(d), moves, back=1)
    d = ewm(d, {"_a": ("_tr", 1 / n), "_p": ("_up", 1 / n), "_m": ("_dn", 1 / n)})
    range_ = F.when(F.col("_a") != 0, F.col("_a"))
    d = d.withColumn("plus_di", 100 * F.col("_p") / range_).withColumn("minus_di", 100 * F.col("_m") / range_)
    both = F.col("plus_di") + F.col("minus_di")
    d = d.withColumn("_dx", F.coalesce(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / F.when(both != 0, both), F.lit(0.0)))
    return ewm(d, {"adx": ("_dx", 1 / n)}).drop("_tr", "_up", "_dn", "_a", "_p", "_m", "_dx")


@indicator("stoch_k", "stoch_d", n=14, k=3)
def stoch(d: DataFrame, n: int, k: int) -> DataFrame:
    low, high = rolling_min("low", n), rolling_max("high", n)
    d = windowed(d, {"_lo": low, "_hi": high}, back=n - 1)
    width = F.col("_hi") - F.col("_lo")
    d = d.withColumn("stoch_k", 100 * (F.col("close") - F.col("_lo")) / F.when(width != 0, width))
    return windowed(d, {"stoch_d": sma("stoch_k", k)}, back=k - 1).drop("_lo", "_hi")


@indicator("cci", n=20)
def cci(d: DataFrame, n: int) -> DataFrame:
    d = d.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    d = windowed(d, {"_m": sma("_tp", n), "_dev": mean_abs_dev("_tp", n)}, back=n - 1)
    return d.withColumn("cci", (F.col("_tp") - F.col("_m")) / F.when(F.col("_dev") != 0, 0.015 * F.col("_dev"))).drop("_tp", "_m", "_dev")


@indicator("bb_upper", "bb_mid", "bb_lower", n=20, k=2)
def bollinger(d: DataFrame, n: int, k: float) -> DataFrame:
    d = windowed(d, {"bb_mid": sma("close", n), "_sd": rolling_std("close", n)}, back=n - 1)
    return d.withColumn("bb_upper", F.col("bb_mid") + k * F.col("_sd")).withColumn("bb_lower", F.col("bb_mid") - k * F.col("_sd")).drop("_sd")


@indicator("macd_line", "macd_signal", "macd_hist", fast=12, slow=26, signal=9)
def macd(d: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    d = ewm(d, {"_f": ("close", 2 / (fast + 1)), "_s": ("close", 2 / (slow + 1))}).withColumn("macd_line", F.col("_f") - F.col("_s"))
    d = ewm(d, {"macd_signal": ("macd_line", 2 / (signal + 1))})
    return d.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal")).drop("_f", "_s")


@indicator("donchian_upper", "donchian_lower", n=20)
def donchian(d: DataFrame, n: int) -> DataFrame:
    return windowed(d, {"donchian_upper": rolling_max("high", n), "donchian_lower": rolling_min("low", n)}, back=n - 1)


@indicator("supertrend_line", "supertrend_direction", smooth_n=20, atr_n=30, mult=3)
def supertrend(d: DataFrame, smooth_n: int, atr_n: int, mult: float) -> DataFrame:
    """On smoothed bars: a band of mult mean true ranges around their middle, which ratchets."""
    d = windowed(d, {f"_{c}": sma(c, smooth_n) for c in ("high", "low", "close")}, back=smooth_n - 1)
    before = F.lag("_close").over(along())
    d = windowed(d, {"_r": F.when(F.col("_high").isNotNull(), F.greatest(F.col("_high") - F.col("_low"), F.abs(F.col("_high") - before), F.abs(F.col("_low") - before)))}, back=1)
    d = ewm(d, {"_v": ("_r", 1 / atr_n)})
    mid = (F.col("_high") + F.col("_low")) / 2
    d = d.withColumn("_u", mid + mult * F.col("_v")).withColumn("_d", mid - mult * F.col("_v"))
    d = ratchet(d, "_u", "_d", "_close")
    return d.withColumnsRenamed({"line": "supertrend_line", "direction": "supertrend_direction"}).drop("_high", "_low", "_close", "_r", "_v", "_u", "_d")


@indicator("range_pos", "prev_year_high", "prev_year_low")
def yearly_range(d: DataFrame) -> DataFrame:
    """The place of the close in the range of the year before."""
    years = d.groupBy("symbol", (F.year("ts") + 1).alias("_y")).agg(F.max("high").alias("prev_year_high"), F.min("low").alias("prev_year_low"))
    d = d.withColumn("_y", F.year("ts")).join(years, ["symbol", "_y"], "left").drop("_y")
    width = F.col("prev_year_high") - F.col("prev_year_low")
    return d.withColumn("range_pos", (F.col("close") - F.col("prev_year_low")) / F.when(width != 0, width))


@indicator("rv", n=12)
def realised_volatility(d: DataFrame, n: int) -> DataFrame:
    """Root of the sum of squared logarithmic returns of n bars."""
    d = windowed(d, {"_r": F.log(F.col("close") / F.lag("close").over(along()))}, back=1)
    return windowed(d, {"rv": F.sqrt(over(F.sum(F.col("_r") ** 2), "_r", n))}, back=n - 1).drop("_r")
