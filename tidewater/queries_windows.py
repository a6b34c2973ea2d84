"""Queries over rolling, expanding and island windows, and over indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.indicators import add_indicators
from .functions.patterns import CANDLES, candle_columns
from .operators.ordered import along, carry_last, forward_max, forward_min, lag, numbered, rank_pct, rolling_median, running, sma, streaks, windowed, zscore
from .operators.ranks import above_quantile, earlier_ranks, share_below
from .operators.scan import cooldown
from .registry import DAILY, query, r4, rows_before, secs
from .sources.market import daily

_D = f"WITH {DAILY}"
_T = "symbol, epoch_us(ts) // 1000000 AS t"


def _n(x: str, n: int, expr: str, least: int | None = None) -> str:
    """SQL of a window value that is null until there are enough rows."""
    return f"CASE WHEN count({x}) OVER w{n} >= {least or n} THEN {expr} END"


def _out(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("symbol", secs("ts").alias("t"), *[r4(c).alias(c) for c in cols])


@query(f"{_D} SELECT {_T}, round({_n('close', 20, 'avg(close) OVER w20')}, 4) AS sma FROM daily WINDOW w20 AS {rows_before(20)}")
def rolling_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(windowed(daily(spark, sf_dir), {"sma": sma("close", 20)}, back=19), "sma")


@query(f"""{_D} SELECT {_T}, round({_n('close', 20, 'avg(close) OVER w20 + 2 * stddev_samp(close) OVER w20')}, 4) AS bb_upper, round({_n('close', 20, 'avg(close) OVER w20')}, 4) AS bb_mid,
 round({_n('close', 20, 'avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20')}, 4) AS bb_lower FROM daily WINDOW w20 AS {rows_before(20)}""")
def rolling_std_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("bollinger", {})]), "bb_upper", "bb_mid", "bb_lower")


@query(f"{_D} SELECT {_T}, {_n('high', 20, 'max(high) OVER w20')} AS donchian_upper, {_n('low', 20, 'min(low) OVER w20')} AS donchian_lower FROM daily WINDOW w20 AS {rows_before(20)}")
def donchian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("donchian", {})]), "donchian_upper", "donchian_lower")


@query(f"""{_D}, k AS (SELECT *, {_n('low', 14, '100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0)')} AS k FROM daily WINDOW w14 AS {rows_before(14)})
SELECT {_T}, round(k, 4) AS stoch_k, round({_n('k', 3, 'avg(k) OVER w3')}, 4) AS stoch_d FROM k WINDOW w3 AS {rows_before(3)}""")
def stoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("stoch", {})]), "stoch_k", "stoch_d")


@query(f"""{_D}, p AS (SELECT *, (high + low + close) / 3 AS tp FROM daily), m AS (SELECT *, avg(tp) OVER w20 AS mean, list(tp) OVER w20 AS l FROM p WINDOW w20 AS {rows_before(20)})
SELECT {_T}, round(CASE WHEN len(l) = 20 THEN (tp - mean) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - mean))), 0) END, 4) AS cci FROM m""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("cci", {})]), "cci")


@query(f"{_D} SELECT {_T}, round({_n('close', 100, 'quantile_cont(close, 0.5) OVER w100', 50)}, 4) AS median FROM daily WINDOW w100 AS {rows_before(100)}")
def rolling_median_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(windowed(daily(spark, sf_dir), {"median": rolling_median("close", 100, 50)}, back=99), "median")


@query(f"""{_D}, l AS (SELECT *, list(close) OVER {rows_before(200)} AS l FROM daily)
SELECT {_T}, round(CASE WHEN len(l) >= 50 THEN (len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2.0) / len(l) END, 4) AS pct FROM l""")
def rolling_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(windowed(daily(spark, sf_dir), {"pct": rank_pct("close", 200, 50)}, back=199), "pct")


@query(f"""{_D}, e AS (SELECT *, quantile_cont(close, 1.0 / 3) OVER w AS q1, quantile_cont(close, 2.0 / 3) OVER w AS q2, count(close) OVER w AS n FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT {_T}, CASE WHEN n >= 200 THEN (close > q1)::INT + (close > q2)::INT END AS bucket FROM e""")
def expanding_tercile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tercile of a value among all earlier ones."""
    d = earlier_ranks(daily(spark, sf_dir), "close")
    above = sum((above_quantile(k / 3, "close").cast("int") for k in (1, 2)), F.lit(0))
    return d.select("symbol", secs("ts").alias("t"), F.when(F.col("n_before") >= 200, above).alias("bucket"))


@query(f"""{_D}, l AS (SELECT *, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM daily)
SELECT {_T}, round(CASE WHEN len(l) >= 100 THEN len(list_filter(l, lambda x: x < close)) / len(l) END, 6) AS share FROM l""")
def expanding_share_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of earlier values that are smaller."""
    return earlier_ranks(daily(spark, sf_dir), "close").select("symbol", secs("ts").alias("t"), F.round(share_below(100), 6).alias("share"))


@query(f"{_D} SELECT {_T}, round((close - {_n('close', 156, 'avg(close) OVER w156', 78)}) / {_n('close', 156, 'stddev_samp(close) OVER w156', 78)}, 4) AS z FROM daily WINDOW w156 AS {rows_before(156)}")
def zscore_156(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(windowed(daily(spark, sf_dir), {"z": zscore("close", 156, 78)}, back=155), "z")


@query(f"""{_D}, y AS (SELECT symbol, year(ts) AS y, max(high) AS h, min(low) AS l FROM daily GROUP BY 1, 2)
SELECT {_T}, round((close - l) / nullif(h - l, 0), 4) AS range_pos, h AS prev_year_high, l AS prev_year_low FROM daily LEFT JOIN y ON y.symbol = daily.symbol AND y.y = year(ts) - 1""".replace("symbol, epoch", "daily.symbol AS symbol, epoch"))
def yearly_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("yearly_range", {})]), "range_pos", "prev_year_high", "prev_year_low")


@query(f"""{_D}, f AS (SELECT *, close > open AS up, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM daily), g AS (SELECT *, r - row_number() OVER (PARTITION BY symbol, up ORDER BY ts) AS g FROM f)
SELECT {_T}, CASE WHEN up THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY symbol, up, g ORDER BY ts) AS streak FROM g""")
def streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = streaks(daily(spark, sf_dir).withColumn("up", F.col("close") > F.col("open")), "up")
    return d.select("symbol", secs("ts").alias("t"), "streak")


@query(f"""{_D}, p AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS peak FROM daily) SELECT {_T}, peak, round(1 - close / peak, 6) AS drawdown FROM p""")
def running_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = running(numbered(daily(spark, sf_dir)), {"peak": ("max", "close")})
    return d.select("symbol", secs("ts").alias("t"), "peak", F.round(1 - F.col("close") / F.col("peak"), 6).alias("drawdown"))


_NEXT = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)"


@query(f"{_D} SELECT {_T}, CASE WHEN count(high) OVER w = 10 THEN max(high) OVER w END AS fwd_high, CASE WHEN count(low) OVER w = 10 THEN min(low) OVER w END AS fwd_low FROM daily WINDOW w AS {_NEXT}")
def forward_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(windowed(daily(spark, sf_dir), {"fwd_high": forward_max("high", 10), "fwd_low": forward_min("low", 10)}, ahead=10), "fwd_high", "fwd_low")


@query(f"{_D} SELECT {_T}, round(ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY ts) / close), 6) AS fwd_ret FROM daily")
def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"fwd_ret": F.round(F.log(F.lead("close", 5).over(along()) / F.col("close")), 6)}, ahead=5)
    return d.select("symbol", secs("ts").alias("t"), "fwd_ret")


@query(f"{_D} SELECT {_T}, first_value(open) OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts) AS session_open FROM daily")
def session_first_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol", F.date_trunc("month", "ts")).orderBy("ts")
    return daily(spark, sf_dir).select("symbol", secs("ts").alias("t"), F.first("open").over(w).alias("session_open"))


@query(f"""{_D}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM daily)
SELECT {_T}, coalesce(r - max(CASE WHEN close > 250000 THEN r END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 999) AS bars_since FROM r""")
def bars_since_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = numbered(daily(spark, sf_dir)).withColumn("ev", F.when(F.col("close") > 250_000, F.col("rn")))
    return carry_last(d, {"ev": "last"}, before=True).select("symbol", secs("ts").alias("t"), F.coalesce(F.col("rn") - F.col("last"), F.lit(999)).alias("bars_since"))


_PIVOT = """(high = max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AND coalesce(high > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false)
 AND count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7)"""


def _pivot() -> F.Column:
    around, before = along().rowsBetween(-3, 3), along().rowsBetween(-3, -1)
    return (F.col("high") == F.max("high").over(around)) & F.coalesce(F.col("high") > F.max("high").over(before), F.lit(False)) & (F.count("*").over(around) == 7)


@query(f"{_D}, p AS (SELECT *, {_PIVOT} AS peak FROM daily) SELECT {_T}, high FROM p WHERE peak")
def swing_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost strict highs of three bars on either side."""
    return windowed(daily(spark, sf_dir), {"pivot": _pivot()}, back=3, ahead=3).where("pivot").select("symbol", secs("ts").alias("t"), "high")


@query(f"""{_D}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r, {_PIVOT} AS peak FROM daily),
q AS (SELECT *, lag(r) OVER w AS r0, lag(high) OVER w AS h0, lag(volume) OVER w AS v0 FROM p WHERE peak WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT {_T}, r - r0 AS gap FROM q WHERE r - r0 BETWEEN 5 AND 60 AND high > h0 AND volume < v0""")
def pivot_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive pivots 5 to 60 bars apart, of which the second is higher on less volume."""
    p = windowed(daily(spark, sf_dir), {"pivot": _pivot()}, back=3, ahead=3).where("pivot").drop("pivot").withColumnRenamed("rn", "bar")
    q = windowed(p, {"r0": lag("bar"), "h0": lag("high"), "v0": lag("volume")}, back=1)
    gap = F.col("bar") - F.col("r0")
    return q.where(gap.between(5, 60) & (F.col("high") > F.col("h0")) & (F.col("volume") < F.col("v0"))).select("symbol", secs("ts").alias("t"), gap.alias("gap"))


@query(f"""{_D.replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM daily), e AS (SELECT * FROM c JOIN daily USING (symbol, ts) WHERE close > 250000),
nxt AS (SELECT a.symbol, a.ts, a.r, min(b.r) AS nr FROM e a LEFT JOIN e b ON a.symbol = b.symbol AND b.r >= a.r + 20 GROUP BY 1, 2, 3),
k AS (SELECT symbol, ts, r, nr FROM nxt WHERE (symbol, r) IN (SELECT (symbol, min(r)) FROM e GROUP BY symbol) UNION ALL SELECT n.symbol, n.ts, n.r, n.nr FROM nxt n JOIN k ON n.symbol = k.symbol AND n.r = k.nr)
SELECT {_T} FROM k""")
def cooldown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least 20 bars after the last one kept."""
    d = numbered(daily(spark, sf_dir)).where("close > 250000")
    return cooldown(d, 20).select("symbol", secs("ts").alias("t"))


# --- recursive indicators: pandas-like exponential means, checked by recursion ---------------------------------------


def _ewm_sql(x: str, alpha: str, source: str = "daily", name: str = "e") -> str:
    """Recursive SQL of an exponential mean y = (1 - alpha) y + alpha x, started with the first x."""
    return f"""{name}_s AS (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM {source}),
{name} AS (SELECT symbol, ts, r, x AS y FROM {name}_s WHERE r = 1 UNION ALL SELECT s.symbol, s.ts, s.r, (1 - {alpha}) * {name}.y + {alpha} * s.x FROM {name} JOIN {name}_s s ON s.symbol = {name}.symbol AND s.r = {name}.r + 1)"""


_R = _D.replace("WITH", "WITH RECURSIVE", 1)
_PREV = "c AS (SELECT *, lag(close) OVER o AS pc, lag(high) OVER o AS ph, lag(low) OVER o AS pl FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY ts))"
_TRUE = "t AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, close - pc AS d FROM c)"


@query(f"{_R}, {_ewm_sql('close', '(2.0 / 21)')} SELECT {_T}, round(y, 4) AS ema FROM e")
def ema_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("ema", {"n": 20})]), "ema")


@query(f"{_R}, {_PREV}, {_TRUE}, {_ewm_sql('tr', '(1.0 / 14)', 't')} SELECT {_T}, round(y, 4) AS atr FROM e")
def atr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("atr", {})]), "atr")


@query(f"""{_R}, {_PREV}, {_TRUE}, m AS (SELECT * FROM t WHERE d IS NOT NULL), {_ewm_sql('greatest(d, 0)', '(1.0 / 14)', 'm', 'g')}, {_ewm_sql('greatest(-d, 0)', '(1.0 / 14)', 'm', 'l')}
SELECT daily.symbol AS symbol, epoch_us(daily.ts) // 1000000 AS t, round(100 - 100 / (1 + g.y / nullif(l.y, 0)), 4) AS rsi FROM daily LEFT JOIN g USING (symbol, ts) LEFT JOIN l USING (symbol, ts)""")
def rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("rsi", {})]), "rsi")


@query(f"""{_R}, {_ewm_sql('close', '(2.0 / 13)', 'daily', 'fa')}, {_ewm_sql('close', '(2.0 / 27)', 'daily', 'sl')}, d AS (SELECT fa.symbol, fa.ts, fa.y - sl.y AS line FROM fa JOIN sl USING (symbol, ts)), {_ewm_sql('line', '(2.0 / 10)', 'd', 'g')}
SELECT d.symbol AS symbol, epoch_us(d.ts) // 1000000 AS t, round(line, 4) AS macd_line, round(g.y, 4) AS macd_signal, round(line - g.y, 4) AS macd_hist FROM d JOIN g USING (symbol, ts)""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("macd", {})]), "macd_line", "macd_signal", "macd_hist")


@query(f"""{_R}, {_PREV}, {_TRUE}, x AS (SELECT *, coalesce(CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph END, 0) AS up, coalesce(CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low END, 0) AS dn FROM t),
{_ewm_sql('tr', '(1.0 / 14)', 'x', 'a')}, {_ewm_sql('up', '(1.0 / 14)', 'x', 'u')}, {_ewm_sql('dn', '(1.0 / 14)', 'x', 'w')},
di AS (SELECT a.symbol, a.ts, 100 * u.y / nullif(a.y, 0) AS p, 100 * w.y / nullif(a.y, 0) AS m FROM a JOIN u USING (symbol, ts) JOIN w USING (symbol, ts)),
dx AS (SELECT *, coalesce(100 * abs(p - m) / nullif(p + m, 0), 0) AS dx FROM di), {_ewm_sql('dx', '(1.0 / 14)', 'dx', 'z')}
SELECT di.symbol AS symbol, epoch_us(di.ts) // 1000000 AS t, round(z.y, 4) AS adx, round(p, 4) AS plus_di, round(m, 4) AS minus_di FROM di JOIN z USING (symbol, ts)""")
def adx_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(add_indicators(daily(spark, sf_dir), [("adx", {})]), "adx", "plus_di", "minus_di")


@query(f"""{_R}, sm AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r, CASE WHEN count(*) OVER w = 20 THEN avg(high) OVER w END AS high, CASE WHEN count(*) OVER w = 20 THEN avg(low) OVER w END AS low, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS close FROM daily WINDOW w AS {rows_before(20)}),
tr AS (SELECT *, CASE WHEN high IS NOT NULL THEN greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) END AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM sm)),
m AS (SELECT * FROM tr WHERE tr IS NOT NULL), {_ewm_sql('tr', '(1.0 / 30)', 'm', 'v')},
b AS MATERIALIZED (SELECT tr.symbol, tr.r, tr.close, (high + low) / 2 + 3 * v.y AS u, (high + low) / 2 - 3 * v.y AS d FROM tr JOIN v USING (symbol, ts)),
z AS (SELECT b.symbol, b.r, b.u AS up, b.d AS dn, CASE WHEN b.close > b.u THEN 1.0 ELSE -1.0 END AS way, b.close AS pc FROM b JOIN (SELECT symbol, min(r) AS r FROM b GROUP BY 1) f USING (symbol, r)
UNION ALL SELECT b.symbol, b.r, CASE WHEN b.u < z.up OR z.pc > z.up THEN b.u ELSE z.up END, CASE WHEN b.d > z.dn OR z.pc < z.dn THEN b.d ELSE z.dn END,
 CASE WHEN b.close > z.up THEN 1.0 WHEN b.close < z.dn THEN -1.0 ELSE z.way END, b.close FROM z JOIN b ON b.symbol = z.symbol AND b.r = z.r + 1)
SELECT sm.symbol AS symbol, epoch_us(sm.ts) // 1000000 AS t, round(CASE WHEN way > 0 THEN dn ELSE up END, 4) AS line, way::DOUBLE AS direction FROM sm LEFT JOIN z USING (symbol, r)""")
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratchet over each series; compared with a plain loop in the tests too."""
    d = add_indicators(daily(spark, sf_dir), [("supertrend", {})])
    return d.select("symbol", secs("ts").alias("t"), r4("supertrend_line").alias("line"), F.col("supertrend_direction").alias("direction"))


_BEFORE = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for k in (1, 2) for c in ("o", "h", "l", "c", "rng", "body"))
_FOUND = ", ".join(f"CASE WHEN {rule.replace('int(sign', 'CAST(sign')} THEN '{name}' END" for name, (_, rule) in CANDLES.items())


@query(f"""{_D}, s AS (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c, greatest(high - low, 1e-9) AS rng, abs(close - open) AS body, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r FROM daily),
b AS (SELECT *, {_BEFORE}, lag(c, 1) OVER w > lag(c, 4) OVER w AS rising, lag(c, 1) OVER w < lag(c, 4) OVER w AS falling, h - greatest(o, c) AS upper, least(o, c) - l AS lower,
 CASE WHEN r >= 3 THEN avg(rng) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
n AS (SELECT symbol, ts, unnest([{_FOUND}]) AS pattern FROM b WHERE r >= 5)
SELECT {_T}, pattern FROM n WHERE pattern IS NOT NULL""")
def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = candle_columns(daily(spark, sf_dir))
    return d.select("symbol", secs("ts").alias("t"), F.explode("patterns").alias("pattern"))
