"""Queries over what follows anchors, and over effects of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import along, numbered, windowed
from .operators.resample import to_bars
from .plans.features import FEATURES, feature_frame
from .plans.impulses import new_extremes, once
from .plans.ledger import METRICS, aftermath, ledger
from .queries_windows import _ewm_sql
from .registry import TICKS, bars_sql, query, secs
from .sources.market import table, ticks

_HORIZONS = (2, 4, 8, 16)
_AFTER = f"""WITH RECURSIVE {TICKS}, {bars_sql('1 hour')}, b AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, row_number() OVER o - 1 AS rn, max(high) OVER w AS top, min(low) OVER w AS bottom, avg(close) OVER m AS sma, count(*) OVER m AS nm, avg(high - low) OVER s AS sigma, lag(open, 4) OVER o AS origin,
 first_value(open) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS start, lead(open) OVER o AS entry FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), m AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
c AS MATERIALIZED (SELECT symbol, rn, high >= top AS up, low <= bottom AS down FROM b WHERE rn >= 24 AND entry IS NOT NULL AND sigma > 0),
u AS (SELECT symbol, min(rn) AS rn FROM c WHERE up GROUP BY 1 UNION ALL SELECT u.symbol, (SELECT min(c.rn) FROM c WHERE c.symbol = u.symbol AND up AND c.rn >= u.rn + 4) FROM u WHERE u.rn IS NOT NULL),
o AS MATERIALIZED (SELECT * FROM c WHERE down AND NOT EXISTS (SELECT 1 FROM u WHERE u.symbol = c.symbol AND u.rn = c.rn)),
v AS (SELECT symbol, min(rn) AS rn FROM o GROUP BY 1 UNION ALL SELECT v.symbol, (SELECT min(o.rn) FROM o WHERE o.symbol = v.symbol AND o.rn >= v.rn + 4) FROM v WHERE v.rn IS NOT NULL),
a AS (SELECT b.*, CASE WHEN nm = 20 THEN sma END AS mean FROM (SELECT * FROM u UNION ALL SELECT * FROM v) x JOIN b USING (symbol, rn)),
n AS (SELECT a.symbol, a.rn, h, a.close AS c0, a.sigma, a.mean, a.start, a.origin, x.rn - a.rn AS off, x.high, x.low, x.close, lag(x.close) OVER (PARTITION BY a.symbol, a.rn, h ORDER BY x.rn) AS before FROM a, (VALUES {', '.join(f'({h})' for h in _HORIZONS)}) t(h), b x WHERE x.symbol = a.symbol AND x.rn BETWEEN a.rn - h AND a.rn + h),
g AS (SELECT symbol, rn, h, count(*) FILTER (off > 0) AS k, (arg_max(close, off) - any_value(c0)) / any_value(sigma) AS r, (max(high) FILTER (off > 0) - any_value(c0)) / any_value(sigma) AS mfe, (any_value(c0) - min(low) FILTER (off > 0)) / any_value(sigma) AS mae,
 (arg_max(off, (high, -off)) FILTER (off > 0))::DOUBLE AS t_mfe, (arg_min(off, (low, off)) FILTER (off > 0))::DOUBLE AS t_mae, min(off) FILTER (off > 0 AND (high - c0) / sigma >= 1) AS u1, min(off) FILTER (off > 0 AND (high - c0) / sigma >= 2) AS u2, min(off) FILTER (off > 0 AND (c0 - low) / sigma >= 1) AS d1, min(off) FILTER (off > 0 AND (c0 - low) / sigma >= 2) AS d2,
 stddev_pop((close - before) / c0) FILTER (off > 0) AS va, stddev_pop((close - before) / before) FILTER (off <= 0 AND before IS NOT NULL) AS vb, count(before) FILTER (off <= 0) AS nb, bool_or(sign(close - mean) = -sign(c0 - mean)) FILTER (off > 0) AS xm, any_value(sign(c0 - mean)) AS sm, bool_or(sign(close - start) <> sign(c0 - start)) FILTER (off > 0) AS xs, bool_or(low <= origin OR high >= origin) FILTER (off > 0) AS xo
 FROM n GROUP BY 1, 2, 3),
f AS (SELECT symbol, rn, h, k = h AS ok, r, mfe, mae, t_mfe, t_mae, (r > 2)::INT::DOUBLE AS tail_up, (r < -2)::INT::DOUBLE AS tail_dn, (t_mfe < t_mae)::INT::DOUBLE AS mfe_before_mae,
 CASE WHEN u1 IS NOT NULL OR d1 IS NOT NULL THEN (coalesce(u1, 999) < coalesce(d1, 999))::INT::DOUBLE END AS race_1_1, CASE WHEN u2 IS NOT NULL OR d1 IS NOT NULL THEN (coalesce(u2, 999) < coalesce(d1, 999))::INT::DOUBLE END AS race_2_1, CASE WHEN u1 IS NOT NULL OR d2 IS NOT NULL THEN (coalesce(u1, 999) < coalesce(d2, 999))::INT::DOUBLE END AS race_1_2,
 CASE WHEN nb > 2 AND vb > 0 THEN va / vb END AS rv_ratio, CASE WHEN sm <> 0 THEN xm::INT::DOUBLE END AS cross_sma, xs::INT::DOUBLE AS cross_start, xo::INT::DOUBLE AS ret_origin FROM g)
SELECT symbol, rn, h, {', '.join(f'CASE WHEN ok THEN round({m}, 4) END AS {m}' for m in METRICS)} FROM f"""


@query(_AFTER)
def extreme_aftermath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed every new extreme of a day, over four horizons."""
    twenty, day = along().rowsBetween(-19, 0), F.date_trunc("day", F.col("ts"))
    b = numbered(to_bars(ticks(spark, sf_dir), "1 hour"))
    b = windowed(b, {"sma": F.when(F.count("*").over(twenty) == 20, F.avg("close").over(twenty)), "sigma": F.avg(F.col("high") - F.col("low")).over(along().rowsBetween(-13, 0)), "origin": F.lag("open", 4).over(along())}, back=19)
    b = once(b)
    starts = b.groupBy("symbol", day.alias("_d")).agg(F.min_by("open", "ts").alias("start"))
    b = once(b.withColumn("_d", day).join(starts, ["symbol", "_d"]).drop("_d"))
    a = new_extremes(b, F.col("sigma") > 0, 24, 4).select("symbol", "rn").join(b.select("symbol", "rn", "sigma", "sma", "start", "origin"), ["symbol", "rn"])
    out = aftermath(b, a, _HORIZONS)
    return out.select("symbol", "rn", "h", *[F.round(m, 4).alias(m) for m in METRICS])


@query("""WITH o AS (SELECT o_orderpriority AS anchor, CASE WHEN o_orderkey % 7 < 3 THEN 8 ELSE 16 END AS h, month(o_orderdate) % 3 AS state, year(o_orderdate) // 2 AS block, isodow(o_orderdate) >= 6 AS session, o_totalprice AS y, o_orderdate AS ts, o_orderkey AS id FROM orders),
s AS (SELECT anchor, h, block, session, state, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM o GROUP BY 1, 2, 3, 4, 5),
t AS (SELECT *, sum(n) OVER w AS tn, sum(s) OVER w AS ts, sum(q) OVER w AS tq FROM s WINDOW w AS (PARTITION BY anchor, h, block, session)),
e AS (SELECT *, s / n - (ts - s) / (tn - n) AS e, ((q - s * s / n) / (n - 1)) / n + ((tq - q - (ts - s) * (ts - s) / (tn - n)) / (tn - n - 1)) / (tn - n) AS v FROM t WHERE n >= 5 AND tn - n >= 5),
m AS (SELECT *, y - avg(y) OVER g AS d, count(*) OVER g AS k, row_number() OVER (PARTITION BY anchor, h, state ORDER BY ts, id) AS r FROM o WINDOW g AS (PARTITION BY anchor, h, state)),
l AS (SELECT *, coalesce(CASE WHEN h = 8 THEN sum(d) OVER (PARTITION BY anchor, h, state ORDER BY r ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) ELSE sum(d) OVER (PARTITION BY anchor, h, state ORDER BY r ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) END, 0) AS ahead FROM m),
i AS (SELECT anchor, h, state, CASE WHEN max(k) >= 30 AND sum(d * d) > 0 THEN least(10, greatest(1, 1 + 2 * sum(d * ahead) / sum(d * d))) ELSE 1 END AS f FROM l GROUP BY 1, 2, 3),
z AS (SELECT anchor, h, state, sum(n) AS n_in, sum(sum(n)) OVER (PARTITION BY anchor, h) - sum(n) AS n_out FROM s GROUP BY 1, 2, 3),
w AS (SELECT anchor, h, state, sum(n * e) / sum(n) AS effect, sqrt(sum(n * n * v)) / sum(n) * sqrt(any_value(f)) AS se FROM e JOIN i USING (anchor, h, state) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
bz AS (SELECT anchor, h, block, state, sum(n) AS bi, sum(sum(n)) OVER (PARTITION BY anchor, h, block) - sum(n) AS bo FROM s GROUP BY 1, 2, 3, 4),
bl AS (SELECT anchor, h, state, block, sum(n * e) / sum(n) AS be, 1 / (sum(n * n * v) / sum(n) ** 2 * any_value(f)) AS bw FROM e JOIN i USING (anchor, h, state) JOIN bz USING (anchor, h, state, block) WHERE bi >= 20 AND bo >= 20 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
bs AS (SELECT anchor, h, state, count(*) AS nb, sum(bw) AS sw, sum(bw * be) AS swe, sum(bw * be * be) - sum(bw * be) ** 2 / sum(bw) AS q FROM bl GROUP BY 1, 2, 3),
lo AS (SELECT anchor, h, state, bool_and(sign((swe - bw * be) / (sw - bw)) = sign(effect) AND abs((swe - bw * be) / (sw - bw)) BETWEEN 0.5 * abs(effect) AND 1.5 * abs(effect)) AS ok FROM bl JOIN bs USING (anchor, h, state) JOIN w USING (anchor, h, state) GROUP BY 1, 2, 3)
SELECT anchor, h, state::INTEGER AS state, n_in::BIGINT AS n_in, n_out::BIGINT AS n_out, round(effect, 2) AS effect, round(se, 2) AS se, coalesce(nb, 0)::INTEGER AS n_blocks, CASE WHEN nb >= 2 THEN round(CASE WHEN q > 0 THEN greatest(0, (q - (nb - 1)) / q) ELSE 0 END, 4) END AS i2, CASE WHEN nb >= 3 THEN ok END AS loo_ok
FROM w JOIN z USING (anchor, h, state) LEFT JOIN bs USING (anchor, h, state) LEFT JOIN lo USING (anchor, h, state) WHERE n_in >= 60 AND n_out >= 60""")
def state_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of three states by anchor and horizon, with errors widened by their own autocorrelation and a test of every block."""
    ts = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("anchor"), F.when(F.col("o_orderkey") % 7 < 3, 8).otherwise(16).alias("h"), (F.month(ts) % 3).alias("state"), F.floor(F.year(ts) / 2).alias("block"), (F.weekday(ts) >= 5).alias("session"), F.col("o_totalprice").alias("y"), ts.alias("ts"), F.col("o_orderkey").alias("id"))
    out = ledger(o, ["anchor", "h"], "state", "block", "session", "y", F.greatest(F.lit(1), F.bround(F.col("h") / 4)), order=("ts", "id"))
    return out.select("anchor", "h", "state", "n_in", "n_out", F.round("effect", 2).alias("effect"), F.round("se", 2).alias("se"), "n_blocks", F.round("i2", 4).alias("i2"), "loo_ok")


_W = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_FRAME = f"""WITH RECURSIVE {TICKS}, {bars_sql('1 hour')}, p AS (SELECT symbol, ts, open, high, low, close, row_number() OVER o - 1 AS rn, lag(close) OVER o AS pc, lag(close, 3) OVER o AS c3, lag(close, 12) OVER o AS c12, lag(close, 24) OVER o AS c24,
 CASE WHEN count(*) OVER r >= 20 THEN max(high) OVER r END AS hi, CASE WHEN count(*) OVER r >= 20 THEN min(low) OVER r END AS lo, hour(ts) * 60 + minute(ts) AS mod FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts), r AS {_W.format(23)}),
q AS MATERIALIZED (SELECT *, close - pc AS d, close / nullif(pc, 0) - 1 AS r, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM p), qd AS (SELECT * FROM q WHERE d IS NOT NULL),
{_ewm_sql('close', '(2.0 / 21)', 'q', 'e1')}, {_ewm_sql('close', '(2.0 / 51)', 'q', 'e2')}, {_ewm_sql('close', '(2.0 / 201)', 'q', 'e3')}, {_ewm_sql('tr', '(1.0 / 14)', 'q', 'e4')}, {_ewm_sql('greatest(d, 0)', '(1.0 / 14)', 'qd', 'e5')}, {_ewm_sql('greatest(-d, 0)', '(1.0 / 14)', 'qd', 'e6')},
{_ewm_sql('close', '(2.0 / 13)', 'q', 'e7')}, {_ewm_sql('close', '(2.0 / 27)', 'q', 'e8')}, mm AS (SELECT e7.symbol, e7.ts, e7.y - e8.y AS m FROM e7 JOIN e8 USING (symbol, ts)), {_ewm_sql('m', '(2.0 / 10)', 'mm', 'e9')},
u AS (SELECT q.*, e1.y AS ef, e2.y AS es, e3.y AS et, e4.y AS atr, e5.y AS ag, e6.y AS al, mm.m, e9.y AS sig, coalesce(d > 0, false) AS up FROM q JOIN e1 USING (symbol, ts) JOIN e2 USING (symbol, ts) JOIN e3 USING (symbol, ts) JOIN e4 USING (symbol, ts) LEFT JOIN e5 USING (symbol, ts) LEFT JOIN e6 USING (symbol, ts) JOIN mm USING (symbol, ts) JOIN e9 USING (symbol, ts)),
v AS (SELECT *, rn - max(CASE WHEN turned THEN rn END) OVER (PARTITION BY symbol ORDER BY rn) + 1 AS run FROM (SELECT *, coalesce(up <> lag(up) OVER (PARTITION BY symbol ORDER BY rn), true) AS turned FROM u)),
k AS (SELECT *, list(atr) OVER k AS la, CASE WHEN count(r) OVER {_W.format(11)} = 12 THEN sqrt(sum(r * r) OVER {_W.format(11)}) END AS rv_long, CASE WHEN count(r) OVER {_W.format(2)} = 3 THEN sqrt(sum(r * r) OVER {_W.format(2)}) END AS rv_short, CASE WHEN count(r) OVER {_W.format(119)} >= 24 THEN avg(abs(r)) OVER {_W.format(119)} END AS mean,
 first_value(CASE WHEN mod >= 420 AND mod < 780 THEN close END IGNORE NULLS) OVER y AS lo_open, last_value(CASE WHEN mod >= 420 AND mod < 780 THEN close END IGNORE NULLS) OVER y AS lo_last, max(high) FILTER (mod >= 810 AND mod < 840) OVER y AS top, min(low) FILTER (mod >= 810 AND mod < 840) OVER y AS bottom,
 avg(abs(r)) OVER (PARTITION BY symbol, mod ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS usual FROM v WINDOW k AS {_W.format(119)}, y AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, epoch_us(ts) // 1000000 AS t, {{}} FROM k"""
_VALUES = {
    "ret_a": "close / nullif(pc, 0) - 1", "ret_b": "close / nullif(c3, 0) - 1", "ret_c": "close / nullif(c12, 0) - 1", "ret_d": "close / nullif(c24, 0) - 1", "ema_f_gap": "(close - ef) / nullif(atr, 0)", "ema_s_gap": "(close - es) / nullif(atr, 0)", "trend": "sign(ef - es)::DOUBLE + sign(es - et)",
    "atr": "atr", "atr_pct": "CASE WHEN len(la) >= 24 THEN (len(list_filter(la, lambda e: e < atr)) + (len(list_filter(la, lambda e: e = atr)) + 1) / 2.0) / len(la) END", "atr_norm": "atr / nullif(close, 0)", "rsi": "100 - 100 / (1 + ag / nullif(al, 0))", "macd_hist": "(m - sig) / nullif(atr, 0)",
    "range_pos": "(close - lo) / nullif(hi - lo, 0)", "streak": "CASE WHEN d > 0 THEN run WHEN d < 0 THEN -run ELSE 0 END", "dist_hi_atr": "(hi - close) / nullif(atr, 0)", "dist_lo_atr": "(close - lo) / nullif(atr, 0)", "session": "(mod >= 420)::INT + (mod >= 720)::INT + (mod >= 1020)::INT", "dow": "(isodow(ts) - 1)::INT", "mod": "mod::INT",
    "london_drift_atr": "(lo_last - lo_open) / nullif(atr, 0)", "box_width_atr": "(top - bottom) / nullif(atr, 0)", "box_pos": "(close - bottom) / nullif(top - bottom, 0)", "rv_long": "rv_long", "rv_short": "rv_short", "season": "usual / nullif(mean, 0)",
}
_WHOLE = ("streak", "session", "dow", "mod")


@query(_FRAME.format(", ".join(f"{_VALUES[n]} AS {n}" if n in _WHOLE else f"round({_VALUES[n]}, 4)::DOUBLE AS {n}" for n in FEATURES)))
def monitor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature frame of hourly bars."""
    f = feature_frame(to_bars(ticks(spark, sf_dir), "1 hour"), (1, 3, 12, 24), (120, 24), (24, 20), (12, 3), (120, 24))
    return f.select("symbol", secs("ts").alias("t"), *[n if n in _WHOLE else F.round(n, 4).alias(n) for n in FEATURES])
