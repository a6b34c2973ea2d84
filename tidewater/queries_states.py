"""Queries over states of a market, anchors of a study, and patterns of a bar in its context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.resample import to_bars
from .plans.higher import higher_context
from .plans.states import FIFTHS, STATES, THIRDS, WEIGHTS, anchors, context_patterns, market_states
from .queries_trades import _IMPULSES
from .queries_windows import _ewm_sql
from .registry import DAILY, TICKS, bars_sql, query, secs
from .sources.market import daily, event_schedule, table, ticks

_W = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_DRIVEN = {"m1": ("sd", THIRDS), "m2": ("term", THIRDS), "m3": ("memory", THIRDS), "m4": ("far", FIFTHS), "m5": ("moved", THIRDS)}
_BUCKETS = ", ".join(
    f"CASE WHEN count({x}) OVER p >= 50 THEN {' + '.join(f'coalesce({x} > quantile_cont({x}, {q!r}) OVER p, false)::INT' for q in shares)} END AS {m}" for m, (x, shares) in _DRIVEN.items()
)


def _states_sql(delay: int) -> str:
    return f"""WITH {DAILY}, v AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) / count(*) AS value FROM lineitem GROUP BY 1),
r AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM daily), s AS (SELECT *, coalesce(sign(r), 0)::BIGINT AS b FROM r),
a AS (SELECT *, lag(b) OVER (PARTITION BY symbol ORDER BY ts) AS a, CASE WHEN count(r) OVER {_W.format(19)} = 20 THEN stddev_samp(r) OVER {_W.format(19)} END AS sd, CASE WHEN count(r) OVER {_W.format(4)} = 5 THEN stddev_samp(r) OVER {_W.format(4)} END AS sds, CASE WHEN count(*) OVER {_W.format(59)} = 60 THEN avg(close) OVER {_W.format(59)} END AS mean FROM s),
m AS (SELECT *, count(a) OVER w AS n, 39 * sum(a * b) OVER w - sum(a) OVER w * sum(b) OVER w AS ab, 39 * sum(a * a) OVER w - (sum(a) OVER w) ** 2 AS va, 39 * sum(b * b) OVER w - (sum(b) OVER w) ** 2 AS vb FROM a WINDOW w AS {_W.format(38)}),
d AS MATERIALIZED (SELECT *, ln(nullif(sds, 0) / nullif(sd, 0)) AS term, CASE WHEN n = 39 THEN CASE WHEN va = 0 OR vb = 0 THEN 0 ELSE ab::DOUBLE / sqrt((va * vb)::DOUBLE) END END AS memory, (close - mean) / (nullif(sd, 0) * close) AS far,
 (SELECT arg_max(value, day) FROM v WHERE day <= CAST(m.ts AS DATE) - 2) / nullif((SELECT arg_max(value, day) FROM v WHERE day <= CAST(m.ts AS DATE) - 7), 0) - 1 AS moved FROM m),
k AS (SELECT symbol, ts, {_BUCKETS} FROM d WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, epoch_us(ts) // 1000000 AS t, {', '.join(f'lag({m}, {delay}) OVER (PARTITION BY symbol ORDER BY ts) AS {m}' for m in STATES)} FROM k"""


def _states(spark: SparkSession, sf_dir: str, delay: int) -> DataFrame:
    value = (F.sum("l_quantity") / F.count("*")).alias("value")
    driver = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp").alias("ts")).agg(value)
    return market_states(daily(spark, sf_dir), driver, trend=60, warm=50, delay=delay).select("symbol", secs("ts").alias("t"), *STATES)


@query(_states_sql(1))
def daily_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states of each day from the days before it; the mean quantity shipped is the driver."""
    return _states(spark, sf_dir, 1)


@query(_states_sql(2))
def daily_states_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one day staler: a study whose effects vanish with it has looked ahead."""
    return _states(spark, sf_dir, 2)


@query(f"""{_IMPULSES}, w AS MATERIALIZED (SELECT *, max(high) OVER v AS top, min(low) OVER v AS bottom FROM b WINDOW v AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
cu AS MATERIALIZED (SELECT symbol, rn FROM w WHERE rn >= 24 AND high >= top), eu AS (SELECT symbol, min(rn) AS rn FROM cu GROUP BY 1 UNION ALL SELECT eu.symbol, (SELECT min(cu.rn) FROM cu WHERE cu.symbol = eu.symbol AND cu.rn >= eu.rn + 16) FROM eu WHERE eu.rn IS NOT NULL),
cd AS MATERIALIZED (SELECT symbol, rn FROM w WHERE rn >= 24 AND low <= bottom AND NOT EXISTS (SELECT 1 FROM eu WHERE eu.symbol = w.symbol AND eu.rn = w.rn)), ed AS (SELECT symbol, min(rn) AS rn FROM cd GROUP BY 1 UNION ALL SELECT ed.symbol, (SELECT min(cd.rn) FROM cd WHERE cd.symbol = ed.symbol AND cd.rn >= ed.rn + 16) FROM ed WHERE ed.rn IS NOT NULL)
SELECT symbol, 'A1' AS anchor, rn, 0 AS dir FROM b WHERE rn % 4 = 0 UNION ALL SELECT symbol, 'A2', here, dir FROM e UNION ALL SELECT symbol, 'A3', rn, 1 FROM eu WHERE rn IS NOT NULL UNION ALL SELECT symbol, 'A3', rn, -1 FROM ed WHERE rn IS NOT NULL
UNION ALL SELECT symbol, 'A4', rn, 0 FROM b WHERE minute(ts) = 0 AND hour(ts) IN (0, 7, 12, 17) UNION ALL SELECT symbol, 'A5', max(rn), 0 FROM b, (VALUES (TIMESTAMP '2024-01-05 13:30:00'), (TIMESTAMP '2024-01-13 13:30:00'), (TIMESTAMP '2024-02-02 13:30:00'), (TIMESTAMP '2024-02-13 13:30:00')) s(due) WHERE ts <= due AND due < ts + INTERVAL 15 MINUTE GROUP BY symbol, due
UNION ALL SELECT symbol, 'A6', res, dir FROM r""")
def study_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of anchors on bars of a quarter of an hour."""
    bars = to_bars(ticks(spark, sf_dir), "15 minutes").select("symbol", "ts", "open", "high", "low", "close")
    return anchors(bars, event_schedule(spark, "2024-01-01", "2024-02-01"), deviations=1.0, sigma=20, lookback=24)


_IN = "minute_ >= {} AND minute_ < {}"
_CONTEXT = f"""WITH RECURSIVE {TICKS}, {bars_sql('15 minutes')}, q AS MATERIALIZED (SELECT symbol, ts, high, low, close, row_number() OVER o - 1 AS rn, close - lag(close) OVER o AS d, max(high) OVER {_W.format(95)} AS hi, min(low) OVER {_W.format(95)} AS lo, hour(ts) * 60 + minute(ts) AS minute_ FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
qd AS (SELECT * FROM q WHERE d IS NOT NULL), {_ewm_sql('close', '(2.0 / 6)', 'q', 'ea')}, {_ewm_sql('close', '(2.0 / 21)', 'q', 'eb')}, {_ewm_sql('close', '(2.0 / 51)', 'q', 'ec')}, {_ewm_sql('greatest(d, 0)', '(1.0 / 14)', 'qd', 'eg')}, {_ewm_sql('greatest(-d, 0)', '(1.0 / 14)', 'qd', 'el')},
u AS (SELECT q.*, ea.y AS e5, eb.y AS e20, ec.y AS e50, 100 - 100 / (1 + eg.y / nullif(el.y, 0)) AS rsi FROM q JOIN ea USING (symbol, ts) JOIN eb USING (symbol, ts) JOIN ec USING (symbol, ts) LEFT JOIN eg USING (symbol, ts) LEFT JOIN el USING (symbol, ts)),
x AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS top, min(low) AS bottom FROM q WHERE {_IN.format(810, 840)} GROUP BY 1, 2),
f AS (SELECT symbol, day, min(rn) FILTER (high >= top) AS up, min(rn) FILTER (low <= bottom) AS down FROM q JOIN x USING (symbol) WHERE CAST(q.ts AS DATE) = day AND minute_ >= 840 GROUP BY 1, 2),
l AS (SELECT symbol, CAST(ts AS DATE) AS day, sign(arg_max(close, ts) - arg_min(close, ts)) AS drift FROM q WHERE {_IN.format(420, 780)} GROUP BY 1, 2),
p AS (SELECT u.*, drift, CASE WHEN {_IN.format(840, 1080)} AND least(up, down) <= rn THEN CASE WHEN up <= rn AND (down IS NULL OR up < down) THEN 1 ELSE -1 END ELSE 0 END AS box_break FROM u LEFT JOIN f ON f.symbol = u.symbol AND f.day = CAST(u.ts AS DATE) LEFT JOIN l ON l.symbol = u.symbol AND l.day = CAST(u.ts AS DATE)),
z AS (SELECT symbol, rn, epoch_us(ts) // 1000000 AS t, CASE WHEN low > e5 THEN -1 WHEN high < e5 THEN 1 ELSE 0 END AS ema_detach, box_break, CASE WHEN box_break <> 0 AND drift = box_break THEN box_break ELSE 0 END AS london_agrees,
 CASE WHEN hi > lo AND (close - lo) / (hi - lo) > 0.97 THEN -1 WHEN hi > lo AND (close - lo) / (hi - lo) < 0.03 THEN 1 ELSE 0 END AS range_extreme, CASE WHEN e20 > e50 AND close < e20 THEN 1 WHEN e20 < e50 AND close > e20 THEN -1 ELSE 0 END AS pullback, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS rsi_extreme FROM p WHERE rn >= 59)
SELECT symbol, t, {', '.join(WEIGHTS)}, {' + '.join(f'{k} * {n}' for n, k in WEIGHTS.items())} AS lean FROM z"""


@query(_CONTEXT)
def patterns_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six patterns of each bar and where they lean."""
    return context_patterns(to_bars(ticks(spark, sf_dir), "15 minutes"), reach=96, box_rows=1).select("symbol", secs("ts").alias("t"), *WEIGHTS, "lean")


_HIGHER = f"""WITH RECURSIVE {TICKS}, {bars_sql('15 minutes')}, h AS MATERIALIZED (SELECT symbol, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS ts, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2),
q AS (SELECT *, close - lag(close) OVER o AS d, close / nullif(lag(close, 6) OVER o, 0) - 1 AS ret, CASE WHEN count(*) OVER {_W.format(19)} = 20 THEN max(high) OVER {_W.format(19)} END AS hi, CASE WHEN count(*) OVER {_W.format(19)} = 20 THEN min(low) OVER {_W.format(19)} END AS lo, lead(ts) OVER o AS next FROM h WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
qd AS (SELECT * FROM q WHERE d IS NOT NULL), {_ewm_sql('close', '(2.0 / 21)', 'q', 'ea')}, {_ewm_sql('close', '(2.0 / 51)', 'q', 'eb')}, {_ewm_sql('greatest(d, 0)', '(1.0 / 14)', 'qd', 'eg')}, {_ewm_sql('greatest(-d, 0)', '(1.0 / 14)', 'qd', 'el')},
c AS (SELECT q.symbol, next AS since, (ea.y - lag(ea.y, 3) OVER (PARTITION BY q.symbol ORDER BY q.ts)) / 0.1 AS slope, 100 - 100 / (1 + eg.y / nullif(el.y, 0)) AS rsi, ret, (close - lo) / nullif(hi - lo, 0) AS place, (close > eb.y)::INT AS above FROM q JOIN ea USING (symbol, ts) JOIN eb USING (symbol, ts) LEFT JOIN eg USING (symbol, ts) LEFT JOIN el USING (symbol, ts))
SELECT b.symbol, epoch_us(b.ts) // 1000000 AS t, round(b.close, 4) AS close, round(slope, 4) AS h1_slope, round(rsi, 4) AS h1_rsi, round(ret, 4) AS h1_ret, round(place, 4) AS h1_place, above AS h1_above FROM bars b ASOF LEFT JOIN (SELECT * FROM c WHERE since IS NOT NULL) c ON b.symbol = c.symbol AND b.ts >= c.since"""


@query(_HIGHER)
def hour_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a quarter of an hour with what the last closed hour says."""
    b = higher_context(to_bars(ticks(spark, sf_dir), "15 minutes").select("symbol", "ts", "open", "high", "low", "close"))
    return b.select("symbol", secs("ts").alias("t"), *[F.round(c, 4).alias(c) for c in ("close", "h1_slope", "h1_rsi", "h1_ret", "h1_place")], "h1_above")
