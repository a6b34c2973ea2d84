"""Queries over exits, impulses, quiet markets and runs of stakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.backtest import Rules, backtest
from .operators.exits import MODELS, folded_exits
from .operators.ordered import along, numbered, sma, windowed
from .operators.positions import martingale
from .operators.resample import to_bars
from .plans.impulses import once, impulses, last_resolution, new_extremes, quiet_days, resolved
from .plans.rules import signals
from .queries_studies import CROSS
from .registry import DAILY, TICKS, bars_sql, query, r4, r4_scaled, rows_before, secs
from .sources.market import daily, ticks

_R = f"WITH RECURSIVE {DAILY}"

_EXITS = f"""{_R}, s AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma FROM daily WINDOW w AS {rows_before(20)}),
b AS MATERIALIZED (SELECT symbol, row_number() OVER o - 1 AS rn, open, high, low, close, sma, lag(close) OVER o AS c1, lag(sma) OVER o AS s1, high - low AS range, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean,
 min(low) OVER t AS low3, max(high) OVER t AS high3, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS bottom, lead(open) OVER o AS next
 FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts), t AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN close > sma AND c1 <= s1 THEN 1 WHEN close < sma AND c1 >= s1 THEN -1 END AS side FROM b),
e AS (SELECT symbol, rn AS id, rn + 1 AS start, side, side * next AS height, 15000.0 AS risk, side * next - 15000 AS stop, side * CASE WHEN side > 0 THEN top ELSE bottom END AS level FROM g WHERE side IS NOT NULL AND next IS NOT NULL),
z AS (SELECT e.*, model, false AS took, 0.0::DOUBLE AS made, NULL::DOUBLE AS r, -1 AS off, NULL::DOUBLE AS ends FROM e, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) m(model)
UNION ALL SELECT symbol, id, start, side, height, risk, CASE WHEN model = 'swing' AND off >= 3 OR model = 'half_then_swing' AND took AND off >= 3 THEN greatest(stop, swing - 0.1 * range) WHEN model = 'mean' THEN greatest(stop, worst)
  WHEN model = 'steps' AND best >= height + 2 * risk THEN greatest(stop, height + risk) WHEN model = 'steps' AND best >= height + risk THEN greatest(stop, height) ELSE stop END, level, model, took, made,
  CASE WHEN off = 30 THEN was_made + (CASE WHEN was THEN 0.5 ELSE 1.0 END) * (ends - height) / risk WHEN worst <= stop THEN made + (CASE WHEN took THEN 0.5 ELSE 1.0 END) * (stop - height) / risk WHEN best >= target THEN (target - height) / risk WHEN model = 'mean' AND ends < mean THEN (ends - height) / risk END, off, ends
 FROM (SELECT symbol, id, start, side, height, risk, level, model, off, ends, worst, best, swing, range, mean, took AS was, made AS was_made, took OR now AS took, made + CASE WHEN now THEN 0.75 ELSE 0 END AS made, CASE WHEN now THEN greatest(stop, height) ELSE stop END AS stop,
  CASE WHEN model = 'two_risks' THEN height + 2 * risk WHEN model IN ('three_risks', 'steps') THEN height + 3 * risk WHEN model = 'prior_extreme' THEN CASE WHEN level > height THEN level ELSE height + 2 * risk END END AS target
  FROM (SELECT *, model = 'half_then_swing' AND NOT took AND best >= height + 1.5 * risk AS now FROM (
   SELECT z.symbol, z.id, z.start, z.side, z.height, z.risk, z.stop, z.level, z.model, z.took, z.made, z.off + 1 AS off, z.side * b.close AS ends, CASE WHEN z.side > 0 THEN b.low ELSE -b.high END AS worst, CASE WHEN z.side > 0 THEN b.high ELSE -b.low END AS best,
    CASE WHEN z.side > 0 THEN b.low3 ELSE -b.high3 END AS swing, b.range, z.side * b.mean AS mean FROM z JOIN b ON b.symbol = z.symbol AND b.rn = z.start + z.off + 1 WHERE z.r IS NULL AND z.off < 30))))
SELECT symbol, id, {', '.join(f"round(max(CASE WHEN model = '{m}' THEN v END), 4) AS {m}_r, max(CASE WHEN model = '{m}' THEN off END) AS {m}_bars" for m in MODELS)}
FROM (SELECT symbol, id, model, coalesce(r, made + (CASE WHEN took THEN 0.5 ELSE 1.0 END) * (ends - height) / risk) AS v, off FROM z QUALIFY off = max(off) OVER (PARTITION BY symbol, id, model)) GROUP BY 1, 2"""


@query(_EXITS)
def exit_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven exits of every cross of a mean."""
    d = signals(daily(spark, sf_dir), CROSS)
    three, twenty = along().rowsBetween(-3, -1), along().rowsBetween(-20, -1)
    d = windowed(d, {"low3": F.min("low").over(three), "high3": F.max("high").over(three), "mean": F.avg("close").over(along().rowsBetween(-4, 0)), "_top": F.max("high").over(twenty), "_bottom": F.min("low").over(twenty), "_next": F.lead("open").over(along())}, back=20, ahead=1)
    d = d.withColumn("range", F.col("high") - F.col("low"))
    side = F.when(F.col("long_entry"), 1).when(F.col("short_entry"), -1)
    e = d.withColumn("side", side).where("side is not null and _next is not null")
    e = e.select("symbol", F.col("rn").alias("id"), (F.col("rn") + 1).alias("at"), "side", F.col("_next").alias("price"), F.lit(15000.0).alias("risk"), (F.col("_next") - 15000 * F.col("side")).alias("stop"), F.when(F.col("side") > 0, F.col("_top")).otherwise(F.col("_bottom")).alias("level"))
    out = folded_exits(d, e, 30)
    return out.select("symbol", "id", *[r4_scaled(f"{m}_r").alias(f"{m}_r") for m in MODELS], *[f"{m}_bars" for m in MODELS])


_IMPULSES = f"""WITH RECURSIVE {TICKS}, {bars_sql('15 minutes')}, b AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
f AS (SELECT symbol, coalesce(min(rn) FILTER (minute(ts) = 0), 0) AS start FROM b GROUP BY 1),
g AS (SELECT symbol, n, (rn - start) // 4 AS g, min(rn) AS first, max(rn) AS last, arg_min(ts, rn) AS ts, arg_min(open, rn) AS open, arg_max(close, rn) AS close FROM b JOIN f USING (symbol) WHERE rn >= start GROUP BY 1, 2, 3 HAVING min(rn) < n - 4),
h AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN stddev_samp(close / open - 1) OVER w END AS sd FROM g WINDOW w AS (PARTITION BY symbol ORDER BY g ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
i AS MATERIALIZED (SELECT *, lead(last) OVER (PARTITION BY symbol ORDER BY g) AS next_last, CASE WHEN close > open THEN 1 ELSE -1 END AS dir FROM h WHERE abs(close - open) / (sd * open) >= 1),
k AS (SELECT symbol, min(last) AS here FROM i GROUP BY 1 UNION ALL SELECT k.symbol, (SELECT min(i.last) FROM i WHERE i.symbol = k.symbol AND i.last >= k.here + 16) FROM k WHERE k.here IS NOT NULL),
e AS (SELECT i.*, here FROM k JOIN i ON i.symbol = k.symbol AND i.last = k.here),
x AS (SELECT e.*, (SELECT min(b.rn) FROM b WHERE b.symbol = e.symbol AND b.rn > here AND b.rn <= here + 96 AND abs(b.close - e.close) >= 0.5 * abs(e.close - e.open)) AS hit FROM e),
y AS (SELECT x.*, b.close AS hit_close, coalesce(next_last <= least(here + 96, x.n - 1) AND (hit IS NULL OR next_last <= hit), false) AS cut FROM x LEFT JOIN b ON b.symbol = x.symbol AND b.rn = x.hit),
r AS (SELECT symbol, here, ts, dir, open AS origin, close AS price, CASE WHEN cut THEN 'superseded' WHEN hit IS NULL THEN 'timeout' WHEN dir * (hit_close - close) < 0 THEN 'retraced' ELSE 'extended' END AS kind, CASE WHEN cut THEN next_last ELSE coalesce(hit, least(here + 96, n - 1)) END AS res FROM y),
d AS (SELECT *, CASE WHEN kind = 'timeout' THEN 96 ELSE res - here END AS duration FROM r),
q AS (SELECT *, count(*) OVER p AS before, quantile_cont(duration::DOUBLE, 1.0 / 3) OVER p AS q1, quantile_cont(duration::DOUBLE, 2.0 / 3) OVER p AS q2 FROM d WINDOW p AS (PARTITION BY symbol ORDER BY here ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN before >= 10 THEN (duration > q1)::INT + (duration > q2)::INT END AS bucket FROM q)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = once(numbered(to_bars(ticks(spark, sf_dir), "15 minutes")))
    return resolved(bars, impulses(bars, deviations=1.0), warm=10)


@query(f"{_IMPULSES} SELECT symbol, here AS row, dir, round(origin, 4) AS origin, round(price, 4) AS price, kind, res, duration::BIGINT AS duration, bucket FROM t")
def impulse_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impulses of four bars: retraced, extended, superseded or timed out, and terciles of how long it took."""
    return _resolved(spark, sf_dir).select("symbol", F.col("at").alias("row"), "dir", r4("origin").alias("origin"), r4("price").alias("price"), "kind", "res", "duration", "bucket")


@query(f"{_IMPULSES} SELECT symbol, res, arg_max(dir, here) AS dir, round(arg_max(origin, here), 4) AS origin, arg_max(duration::BIGINT, here) AS duration FROM t GROUP BY 1, 2")
def resolution_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row at which impulses were resolved stands for: the latest of them."""
    return last_resolution(_resolved(spark, sf_dir)).select("symbol", "res", "dir", r4("origin").alias("origin"), "duration")


_HOURS = f"{TICKS}, {bars_sql('1 hour')}, dc AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2)"
_QUIET = f"""WITH RECURSIVE {_HOURS}, dr AS (SELECT *, close / lag(close) OVER o - 1 AS r FROM dc WINDOW o AS (PARTITION BY symbol ORDER BY day)), dv AS (SELECT *, CASE WHEN count(r) OVER w = 5 THEN stddev_samp(r) OVER w END AS rv FROM dr WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
dq AS (SELECT *, count(rv) OVER p AS before, quantile_cont(rv, 1.0 / 3) OVER p AS q FROM dv WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ds AS (SELECT symbol, day, coalesce(lag(coalesce(rv <= q AND before >= 5, false)) OVER (PARTITION BY symbol ORDER BY day), false) AS quiet FROM dq),
b AS MATERIALIZED (SELECT bars.*, row_number() OVER o - 1 AS rn, quiet, max(high) OVER w AS top, min(low) OVER w AS bottom, lead(open) OVER o AS entry FROM bars JOIN ds ON ds.symbol = bars.symbol AND ds.day = CAST(bars.ts AS DATE) WINDOW o AS (PARTITION BY bars.symbol ORDER BY ts), w AS (PARTITION BY bars.symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
c AS MATERIALIZED (SELECT symbol, rn, high >= top AS up, low <= bottom AS down, entry FROM b WHERE quiet AND rn >= 24 AND entry IS NOT NULL),
u AS (SELECT symbol, min(rn) AS rn FROM c WHERE up GROUP BY 1 UNION ALL SELECT u.symbol, (SELECT min(c.rn) FROM c WHERE c.symbol = u.symbol AND up AND c.rn >= u.rn + 8) FROM u WHERE u.rn IS NOT NULL),
o AS MATERIALIZED (SELECT * FROM c WHERE down AND NOT EXISTS (SELECT 1 FROM u WHERE u.symbol = c.symbol AND u.rn = c.rn)),
v AS (SELECT symbol, min(rn) AS rn FROM o GROUP BY 1 UNION ALL SELECT v.symbol, (SELECT min(o.rn) FROM o WHERE o.symbol = v.symbol AND o.rn >= v.rn + 8) FROM v WHERE v.rn IS NOT NULL)"""


@query(f"{_QUIET} SELECT symbol, rn, 1 AS side, round(entry, 4) AS entry FROM u JOIN c USING (symbol, rn) UNION ALL SELECT symbol, rn, -1, round(entry, 4) FROM v JOIN c USING (symbol, rn)")
def quiet_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New extremes of a day on days after a quiet one, at least eight bars apart in each direction."""
    bars = once(to_bars(ticks(spark, sf_dir), "1 hour"))
    days = bars.groupBy("symbol", F.to_date("ts").cast("timestamp").alias("ts")).agg(F.max_by("close", F.col("ts")).alias("close"))
    q = quiet_days(days, 5, 5).select("symbol", F.col("ts").alias("_day"), "quiet")
    b = bars.withColumn("_day", F.to_date("ts").cast("timestamp")).join(q, ["symbol", "_day"]).drop("_day")
    return new_extremes(b, F.col("quiet"), 24, 8).select("symbol", "rn", "side", r4("entry").alias("entry"))


def _held_sql(stop: str, target: str) -> str:
    """Trades with a stop and a target, in the direction of the mean at the close before; none starts on the bar of an exit."""
    return f"""{_R}, s AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma FROM daily WINDOW w AS {rows_before(20)}),
b AS MATERIALIZED (SELECT symbol, row_number() OVER o - 1 AS r, open, high, low, close, coalesce(lag(CASE WHEN close > sma THEN 1 WHEN close < sma THEN -1 ELSE 0 END) OVER o, 0) AS asked FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT symbol, r, 0 AS side, r AS since, open AS price, NULL::VARCHAR AS hit, 0 AS was, r AS was_since, open AS was_price FROM b WHERE r = 0
UNION ALL SELECT symbol, r, CASE WHEN side = 0 THEN asked WHEN hit IS NOT NULL THEN 0 ELSE side END, CASE WHEN side = 0 THEN r ELSE since END, CASE WHEN side = 0 THEN open ELSE price END, hit, side, since, price
 FROM (SELECT b.*, z.side, z.since, z.price, CASE WHEN z.side = 0 THEN NULL WHEN (z.side > 0 AND b.low <= z.price - {stop}) OR (z.side < 0 AND b.high >= z.price + {stop}) THEN 'stop'
   WHEN (z.side > 0 AND b.high >= z.price + {target}) OR (z.side < 0 AND b.low <= z.price - {target}) THEN 'target' END AS hit FROM z JOIN b ON b.symbol = z.symbol AND b.r = z.r + 1)),
c AS (SELECT symbol, was AS side, was_since AS entry_i, r AS exit_i, hit AS exit_reason FROM z WHERE hit IS NOT NULL)"""


def _held(spark: SparkSession, sf_dir: str, **levels: float) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"_m": sma("close", 20)}, back=19)
    d = d.withColumns({"long_entry": F.col("close") > F.col("_m"), "short_entry": F.col("close") < F.col("_m"), **{k: F.lit(v) for k, v in levels.items()}})
    return backtest(d.drop("_m"), Rules(equity=1e12, rest_a_bar=True))


@query(f"""{_held_sql('15000', '15000')}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY exit_i) AS k FROM c),
l AS (SELECT *, k - 1 - coalesce(max(CASE WHEN exit_reason = 'target' THEN k END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM n),
m AS (SELECT *, least(64.0, pow(2, lost)) AS lots FROM l), e AS (SELECT *, 1000 + sum(lots * CASE WHEN exit_reason = 'target' THEN 1.0 ELSE -1.0 END) OVER (PARTITION BY symbol ORDER BY k) AS equity FROM m)
SELECT symbol, side, entry_i, exit_i, exit_reason, lots::DOUBLE AS lots, equity::DOUBLE AS equity FROM e QUALIFY coalesce(min(equity) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) > 0""")
def martingale_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the direction of a mean with equal stop and target, and stakes that double after each stop."""
    t = _held(spark, sf_dir, stop_dist=15000.0, target_dist=15000.0).where("exit_reason != 'eod'").withColumn("won", F.col("exit_reason") == "target")
    return martingale(t, "won", ("exit_ts",), gain=1.0, cap=64, start=1000.0).select("symbol", "side", "entry_i", "exit_i", "exit_reason", "lots", "equity")


@query(f"""{_held_sql('1e18', '30000')} SELECT symbol, side, entry_i, exit_i, exit_reason FROM c UNION ALL SELECT symbol, side, since, r, 'eod' FROM z JOIN (SELECT symbol, max(r) AS r FROM b GROUP BY 1) USING (symbol, r) WHERE side <> 0""")
def hold_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the direction of a mean that are held until their target, without a stop."""
    return _held(spark, sf_dir, target_dist=30000.0).select("symbol", "side", "entry_i", "exit_i", "exit_reason")
