"""Queries over rules, simulations, statistics and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.resample import bootstrap_mean, drawn_sql, poisson_at_least
from .functions.stats import auc, benjamini_hochberg, cochran, sharpe, spearman, stratified_effect, trade_metrics
from .operators.backtest import Rules, backtest, brackets
from .operators.ordered import along, numbered, windowed
from .plans.fingerprint import fingerprint
from .plans.rules import in_hours, signals
from .registry import DAILY, TICKS, bars_sql, query, r4, rows_before, secs
from .sources.market import daily, split_of, table, ticks
from .operators.resample import to_bars

_D = f"WITH {DAILY}"
_T = "symbol, epoch_us(ts) // 1000000 AS t"
_CLOSE, _SMA = {"kind": "price", "field": "close"}, {"kind": "indicator", "id": "sma", "params": {"n": 20}}
CROSS = {
    "long": {"logic": "and", "rules": [{"left": _CLOSE, "op": "cross_above", "right": _SMA}, {"left": {"kind": "price", "field": "ticks"}, "op": ">=", "right": {"kind": "value", "value": 1}}]},
    "short": {"logic": "or", "rules": [{"left": _CLOSE, "op": "cross_below", "right": _SMA}]},
    "stop": {"type": "fixed", "value": 20000},
    "target": {"type": "fixed", "value": 40000},
}


@query(f"""{_D}, s AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma FROM daily WINDOW w AS {rows_before(20)}),
l AS (SELECT *, lag(close) OVER o AS c1, lag(sma) OVER o AS s1 FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT {_T}, coalesce(close > sma AND c1 <= s1, false) AS long_entry, coalesce(close < sma AND c1 >= s1, false) AS short_entry FROM l""")
def rule_eval_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(daily(spark, sf_dir), CROSS).select("symbol", secs("ts").alias("t"), "long_entry", "short_entry")


@query(f"WITH {TICKS}, {bars_sql('1 hour')} SELECT {_T} FROM bars WHERE hour(ts) >= 22 OR hour(ts) < 3")
def entry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours around midnight."""
    return to_bars(ticks(spark, sf_dir), "1 hour").where(in_hours(22, 3)).select("symbol", secs("ts").alias("t"))


@query(f"""WITH {TICKS}, {bars_sql('1 hour')}, d AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), box AS (SELECT symbol, day, max(high) AS bh, min(low) AS bl FROM d WHERE hour(ts) < 6 GROUP BY 1, 2),
t AS (SELECT symbol, day, bh, bl, min(ts) FILTER (high > bh) AS up, min(ts) FILTER (low < bl) AS dn FROM d JOIN box USING (symbol, day) WHERE hour(ts) >= 6 GROUP BY 1, 2, 3, 4)
SELECT symbol, CAST(day AS VARCHAR) AS day, bh AS box_high, bl AS box_low, CASE WHEN up IS NULL AND dn IS NULL THEN 0 WHEN dn IS NULL OR up <= dn THEN 1 ELSE -1 END AS side FROM t""")
def opening_range_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first break of the range of a day's first six hours."""
    d = to_bars(ticks(spark, sf_dir), "1 hour").withColumn("day", F.to_date("ts"))
    box = d.where(F.hour("ts") < 6).groupBy("symbol", "day").agg(F.max("high").alias("bh"), F.min("low").alias("bl"))
    later = d.where(F.hour("ts") >= 6).join(box, ["symbol", "day"]).groupBy("symbol", "day", "bh", "bl")
    t = later.agg(F.min(F.when(F.col("high") > F.col("bh"), F.col("ts"))).alias("up"), F.min(F.when(F.col("low") < F.col("bl"), F.col("ts"))).alias("dn"))
    side = F.when(F.col("up").isNull() & F.col("dn").isNull(), 0).when(F.col("dn").isNull() | (F.col("up") <= F.col("dn")), 1).otherwise(-1)
    return t.select("symbol", F.col("day").cast("string").alias("day"), F.col("bh").alias("box_high"), F.col("bl").alias("box_low"), side.alias("side"))


def _bracket_sql(stop_first: bool) -> str:
    stop, target = "b.low <= e.close - 20000", "b.high >= e.close + 40000"
    hit = f"CASE WHEN {stop} THEN 'stop' WHEN {target} THEN 'target' END" if stop_first else f"CASE WHEN {target} THEN 'target' WHEN {stop} THEN 'stop' END"
    return f"""{_D}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM daily), e AS (SELECT * FROM n),
m AS (SELECT e.symbol, e.rn AS id, e.close AS price, b.rn, b.close, {hit} AS hit FROM e JOIN n b ON b.symbol = e.symbol AND b.rn > e.rn AND b.rn <= e.rn + 30),
g AS (SELECT symbol, id, min(rn) FILTER (hit IS NOT NULL) AS x, arg_min(hit, rn) FILTER (hit IS NOT NULL) AS hit, max(rn) AS last, arg_max(close, rn) AS close, any_value(price) AS price FROM m GROUP BY 1, 2)
SELECT e.symbol AS symbol, e.rn AS id, coalesce(hit, 'timeout') AS outcome, coalesce(x, last) AS exit_rn, round(CASE hit WHEN 'stop' THEN -1.0 WHEN 'target' THEN 2.0 ELSE (g.close - price) / 20000 END, 4)::DOUBLE AS made FROM e LEFT JOIN g ON g.symbol = e.symbol AND g.id = e.rn"""


def _brackets(spark: SparkSession, sf_dir: str, stop_first: bool) -> DataFrame:
    d = numbered(daily(spark, sf_dir))
    e = d.select("symbol", F.col("rn").alias("id"), (F.col("rn") + 1).alias("at"), F.col("close").alias("price"), F.lit(20000.0).alias("risk"), F.lit(40000.0).alias("reward"))
    return brackets(d, e, 30, stop_first).select("symbol", "id", "outcome", "exit_rn", r4("made").alias("made"))


@query(_bracket_sql(True))
def bracket_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brackets(spark, sf_dir, True)


@query(_bracket_sql(False))
def bracket_optimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brackets(spark, sf_dir, False)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(daily(spark, sf_dir), CROSS).withColumn("spread_mean", F.lit(10.0))
    return backtest(s, Rules(equity=1e6, reverse=True))


#: A run bar by bar: what ends the open trade, and what is open afterwards. Trades after the one that leaves no equity go.
_RUN = f"""{_D.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS sma FROM daily WINDOW w AS {rows_before(20)}),
l AS (SELECT *, lag(close) OVER o AS c1, lag(sma) OVER o AS s1, row_number() OVER o - 1 AS r FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
b AS MATERIALIZED (SELECT symbol, r, open, high, low, close, coalesce(lag(CASE WHEN close > sma AND c1 <= s1 THEN 1 WHEN close < sma AND c1 >= s1 THEN -1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY r), 0) AS asked FROM l),
z AS (SELECT symbol, r, 0 AS side, r AS since, open AS price, NULL::VARCHAR AS hit, 0 AS was, r AS was_at, open AS was_price, open AS out FROM b WHERE r = 0
UNION ALL SELECT symbol, r, CASE WHEN side = 0 OR hit IS NOT NULL THEN asked ELSE side END, CASE WHEN side = 0 OR hit IS NOT NULL THEN r ELSE since END, CASE WHEN side = 0 OR hit IS NOT NULL THEN open ELSE price END,
 hit, side, since, price, CASE hit WHEN 'stop' THEN price - side * 20000 WHEN 'target' THEN price + side * 40000 ELSE open END
 FROM (SELECT b.*, z.side, z.since, z.price, CASE WHEN z.side = 0 THEN NULL WHEN (z.side > 0 AND b.low <= z.price - 20000) OR (z.side < 0 AND b.high >= z.price + 20000) THEN 'stop'
   WHEN (z.side > 0 AND b.high >= z.price + 40000) OR (z.side < 0 AND b.low <= z.price - 40000) THEN 'target' WHEN b.asked = -z.side THEN 'reverse' END AS hit FROM z JOIN b ON b.symbol = z.symbol AND b.r = z.r + 1)),
e AS (SELECT symbol, arg_max(close, r) AS close, max(r) AS r FROM b GROUP BY 1),
c AS (SELECT symbol, was AS side, was_at AS entry_i, r AS exit_i, was * (out - was_price) AS gross_pnl, hit AS exit_reason FROM z WHERE hit IS NOT NULL
UNION ALL SELECT symbol, side, since, r, side * (e.close - price), 'eod' FROM z JOIN e USING (symbol, r) WHERE side <> 0),
m AS (SELECT *, 1e6 + sum(gross_pnl - 10.08) OVER (PARTITION BY symbol ORDER BY exit_i, entry_i) AS equity FROM c),
t AS (SELECT m.*, 10.08 AS cost, gross_pnl - 10.08 AS net_pnl FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.symbol = m.symbol AND o.equity <= 0 AND (o.exit_i, o.entry_i) < (m.exit_i, m.entry_i)))"""


@query(f"""{_RUN} SELECT symbol, side, entry_i, exit_i, round(gross_pnl, 4) AS gross_pnl, round(cost, 4)::DOUBLE AS cost, round(net_pnl, 4) AS net_pnl, exit_reason FROM t""")
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosses of a mean with a stop, a target and reversals; golden cases and other rules are in the tests."""
    t = _trades(spark, sf_dir)
    return t.select("symbol", "side", "entry_i", "exit_i", r4("gross_pnl").alias("gross_pnl"), r4("cost").alias("cost"), r4("net_pnl").alias("net_pnl"), "exit_reason")


@query(f"""{_RUN} SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS win_rate, round(avg(net_pnl), 4) AS expectancy,
 round(sum(net_pnl) FILTER (net_pnl > 0) / -sum(net_pnl) FILTER (net_pnl <= 0), 4) AS profit_factor, round(avg(net_pnl) FILTER (net_pnl > 0), 4) AS avg_win, round(avg(net_pnl) FILTER (net_pnl <= 0), 4) AS avg_loss, round(sum(cost) / sum(abs(gross_pnl)), 4)::DOUBLE AS cost_drag FROM t GROUP BY 1""")
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trade_metrics(_trades(spark, sf_dir), ["symbol"])
    return m.select("symbol", "n_trades", *[r4(c).alias(c) for c in ("win_rate", "expectancy", "profit_factor", "avg_win", "avg_loss", "cost_drag")])


@query("""WITH t AS (SELECT o_orderpriority AS symbol, o_totalprice - 150000 AS gross_pnl, 100.0 AS cost, o_totalprice - 150100 AS net_pnl FROM orders)
SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS win_rate, round(avg(net_pnl), 2) AS expectancy,
 round(sum(net_pnl) FILTER (net_pnl > 0) / -sum(net_pnl) FILTER (net_pnl <= 0), 6) AS profit_factor, round(avg(net_pnl) FILTER (net_pnl > 0), 2) AS avg_win, round(avg(net_pnl) FILTER (net_pnl <= 0), 2) AS avg_loss, round(sum(cost) / sum(abs(gross_pnl)), 6)::DOUBLE AS cost_drag FROM t GROUP BY 1""")
def trade_metrics_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderpriority").alias("symbol"), (F.col("o_totalprice") - 150_000).alias("gross_pnl"), F.lit(100.0).alias("cost"), (F.col("o_totalprice") - 150_100).alias("net_pnl"))
    m = trade_metrics(t, ["symbol"])
    places = {"win_rate": 6, "expectancy": 2, "profit_factor": 6, "avg_win": 2, "avg_loss": 2, "cost_drag": 6}
    return m.select("symbol", "n_trades", *[F.round(c, k).alias(c) for c, k in places.items()])


@query(f"""{_D}, r AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM daily)
SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(252), 4) AS sortino FROM r GROUP BY 1""")
def sharpe_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"r": F.col("close") / F.lag("close").over(along()) - 1}, back=1)
    return sharpe(d, "r", ["symbol"]).select("symbol", r4("sharpe").alias("sharpe"), r4("sortino").alias("sortino"))


@query("""WITH l AS (SELECT l_quantity AS x, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM l)
SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)::DOUBLE AS auc FROM r""")
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return auc(x, "x", "y").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS ic FROM r""")
def spearman_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spearman(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(F.round("ic", 6).alias("ic"))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 2) AS mean, round(stddev_samp(l_extendedprice), 2) AS sd, round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / (avg(x * x) - avg(x) ** 2) ** 1.5, 4) AS skew, round(kurtosis_pop(x), 4) AS kurt FROM (SELECT *, l_extendedprice / 10000 AS x FROM lineitem) GROUP BY 1")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_extendedprice") / 10000).groupBy("l_returnflag")
    return g.agg(F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 2).alias("sd"), r4(F.skewness("x")).alias("skew"), r4(F.kurtosis("x")).alias("kurt"))


_Q = (0.05, 0.25, 0.5, 0.75, 0.95)


@query(f"SELECT l_returnflag, {', '.join(f'round(quantile_cont(l_extendedprice, {q}), 4) AS q{round(q * 100)}' for q in _Q)} FROM lineitem GROUP BY 1")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(*map(F.lit, _Q))).alias("q"))
    return g.select("l_returnflag", *[r4(F.col("q")[i]).alias(f"q{round(q * 100)}") for i, q in enumerate(_Q)])


@query("""WITH c AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2 WHEN o_totalprice <= q[3] THEN 3 WHEN o_totalprice <= q[4] THEN 4 ELSE 5 END AS quintile, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders, c GROUP BY 1""")
def qcut_quintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets with right-closed quantile edges."""
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    edges = o.agg(F.percentile("o_totalprice", F.array(*[F.lit(q) for q in (0.2, 0.4, 0.6, 0.8)]))).first()[0]
    bucket = F.lit(1) + sum(((F.col("o_totalprice") > e).cast("int") for e in edges), F.lit(0))
    return o.groupBy(bucket.alias("quintile")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


_EFFECT = """s AS (SELECT l_returnflag AS cell, l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS stratum, l_discount > 0.05 AS chosen, l_quantity AS y FROM lineitem),
g AS (SELECT cell, stratum, count(*) FILTER (chosen) AS n1, count(*) FILTER (NOT chosen) AS n0, avg(y) FILTER (chosen) AS m1, avg(y) FILTER (NOT chosen) AS m0, var_samp(y) FILTER (chosen) AS v1, var_samp(y) FILTER (NOT chosen) AS v0 FROM s GROUP BY 1, 2)"""


@query(f"""WITH {_EFFECT} SELECT cell, round(sum(n1 * (m1 - m0)) / sum(n1), 6) AS effect, round(sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0))) / sum(n1), 6) AS se, count(*) AS n_strata, CAST(sum(n1) AS BIGINT) AS n_chosen FROM g WHERE n1 >= 2 AND n0 >= 2 GROUP BY 1""")
def stratified_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("stratum"), (F.col("l_discount") > 0.05).alias("chosen"), F.col("l_quantity").alias("y"))
    e = stratified_effect(s, ["cell"], ["stratum"], "chosen", "y")
    return e.select("cell", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"), "n_strata", "n_chosen")


@query(f"""WITH {_EFFECT}, e AS (SELECT cell, m1 - m0 AS effect, sqrt(v1 / n1 + v0 / n0) AS se FROM g WHERE n1 >= 2 AND n0 >= 2),
a AS (SELECT cell, count(*) AS k, sum(effect * effect / se / se) - sum(effect / se / se) ** 2 / sum(1 / se / se) AS q FROM e GROUP BY 1) SELECT cell, k, round(q, 4) AS q, round(greatest(0, 1 - (k - 1) / q), 4) AS i2 FROM a""")
def cochran_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cell"), F.concat_ws("-", "l_linestatus", F.col("l_linenumber").cast("string")).alias("stratum"), (F.col("l_discount") > 0.05).alias("chosen"), F.col("l_quantity").alias("y"))
    e = stratified_effect(s, ["cell", "stratum"], [], "chosen", "y")
    return cochran(e, ["cell"]).select("cell", "k", r4("q").alias("q"), r4("i2").alias("i2"))


@query("""WITH p AS (SELECT l_partkey, min(l_discount * l_tax * l_quantity) / 5 AS p FROM lineitem GROUP BY 1), r AS (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r, count(*) OVER () AS m FROM p)
SELECT l_partkey, coalesce(p <= (SELECT max(p) FROM r WHERE p <= 0.1 * r / m), false) AS significant FROM p""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.min(F.col("l_discount") * F.col("l_tax") * F.col("l_quantity")) / 5).alias("p"))
    return benjamini_hochberg(p, "p").select("l_partkey", "significant")


@query(f"""WITH {TICKS}, h AS (SELECT symbol, epoch_us(ts) // 3600000000 AS h, avg(price) AS p FROM ticks GROUP BY 1, 2), o AS (SELECT unnest(range(-6, 7)) AS k), c AS (SELECT k, corr(a.p, b.p) AS r, count(*) AS n FROM h a JOIN o ON true JOIN h b ON b.h = a.h + k AND b.symbol = 'click' WHERE a.symbol = 'view' GROUP BY 1)
SELECT CAST(k AS INTEGER) AS k, round(r, 6) AS r, n FROM c""")
def corr_offset_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two hourly series at each offset of a grid: the grid is exploded, so the join has a key."""
    h = ticks(spark, sf_dir).groupBy("symbol", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("h")).agg(F.avg("price").alias("p"))
    a = h.where("symbol = 'view'").withColumn("k", F.explode(F.sequence(F.lit(-6), F.lit(6)))).select("k", (F.col("h") + F.col("k")).alias("h"), F.col("p").alias("pa"))
    b = h.where("symbol = 'click'").select("h", F.col("p").alias("pb"))
    return a.join(b, "h").groupBy("k").agg(F.round(F.corr("pa", "pb"), 6).alias("r"), F.count("*").alias("n"))


MODEL = {"l_quantity": (0.8, 25.0, 14.0), "l_discount": (-0.5, 0.05, 0.03), "l_tax": (0.3, 0.04, 0.02)}  # coefficient, mean, deviation
_CONTRIB = {c: f"({w} * ({c} - {m}) / {s})" for c, (w, m, s) in MODEL.items()}


@query(f"SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(0.1 + {' + '.join(_CONTRIB.values())}))), 6) AS p FROM lineitem")
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.lit(0.1) + sum((w * (F.col(c) - m) / s for c, (w, m, s) in MODEL.items()), F.lit(0.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@query(f"""WITH i AS (SELECT *, row_number() OVER () AS id FROM lineitem), c AS (SELECT id, l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([{', '.join(f'round({x}, 9)' for x in _CONTRIB.values())}]) AS v FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, feature) AS r FROM c) SELECT l_orderkey, l_linenumber, string_agg(feature, ',' ORDER BY r) AS drivers FROM r WHERE r <= 2 GROUP BY id, 1, 2""")
def topk_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features of the largest absolute contribution."""
    parts = F.array(*[F.struct((-F.abs(F.round(w * (F.col(c) - m) / s, 9))).alias("v"), F.lit(c).alias("f")) for c, (w, m, s) in MODEL.items()])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.slice(F.transform(F.array_sort(parts), lambda x: x.f), 1, 2), ",").alias("drivers"))


@query(f"""WITH k AS (SELECT o_orderpriority AS symbol, o_totalprice AS x, round, {poisson_at_least('u', '1.0')} AS k FROM (SELECT *, {drawn_sql('o_orderkey', 'round', 7)} AS u FROM orders, range(1, 41) t(round))),
m AS (SELECT symbol, round, sum(k * x) / sum(k) AS m FROM k GROUP BY 1, 2) SELECT symbol, round(quantile_cont(m, 0.025), 2) AS lo, round(quantile_cont(m, 0.5), 2) AS mid, round(quantile_cont(m, 0.975), 2) AS hi FROM m GROUP BY 1""")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of a mean; the draws are hashes, so SQL makes the same. Compared with theory in the tests."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("symbol"), F.col("o_totalprice").alias("x"))
    b = bootstrap_mean(o, ["symbol"], "x", rounds=40)
    return b.select("symbol", *[F.round(c, 2).alias(c) for c in ("lo", "mid", "hi")])


@query(f"""{_D}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM daily), a AS (SELECT * FROM n), h AS (SELECT unnest([2, 4, 8, 16, 32, 96]) AS h),
f AS (SELECT a.symbol, a.rn AS id, h, a.close AS p0, count(*) AS n, max(b.high) AS hi, min(b.low) AS lo, arg_max(b.close, b.rn) AS p1, arg_max(b.rn, (b.high, -b.rn)) - a.rn AS t_mfe, arg_max(b.rn, (-b.low, -b.rn)) - a.rn AS t_mae
 FROM a JOIN h ON true JOIN n b ON b.symbol = a.symbol AND b.rn > a.rn AND b.rn <= a.rn + h GROUP BY 1, 2, 3, 4)
SELECT symbol, id, h, round(ln(p1 / p0), 6) AS r, round(hi / p0 - 1, 6) AS mfe, round(lo / p0 - 1, 6) AS mae, t_mfe, t_mae FROM f WHERE n = h""")
def fingerprint_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint(numbered(daily(spark, sf_dir)), F.lit(True), (2, 4, 8, 16, 32, 96))
    return f.select("symbol", F.col("rn").alias("id"), "h", *[F.round(c, 6).alias(c) for c in ("r", "mfe", "mae")], "t_mfe", "t_mae")


@query(f"""{_D}, s AS (SELECT symbol, CASE WHEN ts >= '1995-01-01' AND ts < '1999-01-01' THEN 'in_sample' WHEN ts >= '1999-01-01' AND ts < '2000-01-01' THEN 'walk_forward' WHEN ts >= '2000-01-01' AND ts < '2002-01-01' THEN 'out_of_sample' END AS split, close FROM daily),
a AS (SELECT symbol, split, sum(close) AS total FROM s GROUP BY 1, 2) SELECT split, count(*) AS n, round(max(total) / sum(total), 6) AS top_share FROM a GROUP BY 1""")
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).groupBy("symbol", split_of(F.col("ts")).alias("split")).agg(F.sum("close").alias("total"))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.round(F.max("total") / F.sum("total"), 6).alias("top_share"))
