"""Queries over weekly positioning: orders stand for positions, their mean price for the market."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import sma, windowed
from .plans.impulses import once
from .plans.positioning import GROUPS, SIGNALS, VARIANTS, by_windows, daily_earnings, in_force, nets, weekly_outlook, weekly_signals
from .registry import DAILY, query
from .sources.market import daily, table

_SPANS = [("early", "1995-01-01", "1999-01-01"), ("middle", "1999-01-01", "2000-01-01"), ("late", "2000-01-01", "2002-01-01"), ("all", "1990-01-01", "2010-01-01")]
_WINDOW = 52
_TUESDAY = "CAST({0} AS DATE) + CAST((9 - isodow({0})) % 7 AS INTEGER)"
_Z = "({0} - avg({0}) OVER w) / nullif(CASE WHEN count({0}) OVER w >= 26 THEN stddev_samp({0}) OVER w END, 0)"
_SHARE = "CASE WHEN {0} IS NOT NULL AND count({0}) OVER w >= 26 THEN len(list_filter(list({0}) OVER w, lambda v: v < {0})) / nullif(count(*) OVER w - 1, 0) END"
_AGAINST = "CASE WHEN {0} > 0.8 THEN -1.0 WHEN {0} < 0.2 THEN 1.0 ELSE 0.0 END"
_SIDES = "list_transform(range(200), lambda s: CASE WHEN md5(CAST(s AS VARCHAR) || ':' || strftime({}, '%Y-%m-%d'))[1] < '8' THEN -1 ELSE 1 END)"
_WEEKLY = f"""WITH {DAILY}, md AS (SELECT symbol, ts, avg(close) OVER w AS close, count(*) OVER w AS k FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS MATERIALIZED (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM md WHERE k = 20),
rep AS (SELECT o_orderpriority AS symbol, {_TUESDAY.format('o_orderdate')} AS week, {', '.join(f"sum(CASE WHEN o_custkey % 3 = {i} THEN CASE WHEN o_orderstatus = 'F' THEN v ELSE -v END ELSE 0 END) AS {g}_net" for i, g in enumerate(GROUPS))}, sum(v) AS interest FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders) GROUP BY 1, 2),
sec AS (SELECT {_TUESDAY.format('l_shipdate')} AS week, sum(CASE WHEN l_returnflag = 'N' THEN v ELSE -v END) AS mm_net, sum(v) AS mm_interest FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS v FROM lineitem) GROUP BY 1),
net AS (SELECT symbol, week, {', '.join(f'{g}_net, {g}_net / nullif(interest, 0) AS {g}_pct' for g in GROUPS)}, mm_net, mm_net / nullif(mm_interest, 0) AS mm_pct FROM rep LEFT JOIN sec USING (week)),
ch AS (SELECT *, spec_pct - lag(spec_pct) OVER (PARTITION BY symbol ORDER BY week) AS change FROM net),
sg AS (SELECT symbol, week, spec_pct, {', '.join(f'{_Z.format(x)} AS z{n}' for n, x in (('s', 'spec_pct'), ('c', 'comm_pct'), ('d', 'change')))}, {', '.join(f'{_SHARE.format(x)} AS r{n}' for n, x in (('s', 'spec_pct'), ('c', 'comm_pct'), ('m', 'mm_pct')))} FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
sv AS MATERIALIZED (SELECT symbol, week, spec_pct, greatest(-1, least(1, -zs / 1.5)) + 0 * zs AS fade_z, {_AGAINST.format('rs')} AS fade_extreme, greatest(-1, least(1, zc / 1.5)) + 0 * zc AS follow_comm, {_AGAINST.format('rm')} AS fade_managed, greatest(-1, least(1, -zd / 1.5)) + 0 * zd AS fade_change,
 CASE WHEN rs > 0.8 AND rc < 0.2 THEN -1.0 WHEN rs < 0.2 AND rc > 0.8 THEN 1.0 ELSE 0.0 END AS agree FROM sg),
af AS (SELECT sv.*, (SELECT min(d.ts) FROM d WHERE d.symbol = sv.symbol AND d.ts >= sv.week + 4) AS ts FROM sv),
tk AS MATERIALIZED (SELECT symbol, ts, max(week) AS report, {', '.join(f'arg_max({c}, week) FILTER ({c} IS NOT NULL) AS {c}' for c in ('spec_pct', *SIGNALS))} FROM af WHERE ts IS NOT NULL GROUP BY 1, 2)"""
_EARNED = f"""{_WEEKLY}, tp AS (SELECT *, lag(report) OVER (PARTITION BY symbol ORDER BY ts) AS past FROM tk),
tr AS MATERIALIZED (SELECT *, list_avg({_SIDES.format('report')}) AS random, CASE WHEN past IS NULL THEN 1.0 ELSE list_avg(list_transform(list_zip({_SIDES.format('report')}, {_SIDES.format('past')}), lambda z: abs(z[1] - z[2]))) END AS moved FROM tp),
ps AS (SELECT d.*, {', '.join(f'coalesce(last_value({c} IGNORE NULLS) OVER o, 0) AS {c}' for c in (*SIGNALS, 'random'))}, 1.0 AS always, coalesce(moved, 0) AS c_random FROM d LEFT JOIN tr USING (symbol, ts) WINDOW o AS (PARTITION BY d.symbol ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pc AS (SELECT *, close / lag(close) OVER o - 1 AS hold, {', '.join(f'abs({c} - coalesce(lag({c}) OVER o, 0)) AS c_{c}' for c in (*SIGNALS, 'always'))} FROM ps WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
ea AS (SELECT symbol, rn, ts, hold, {', '.join(f'lag({v}) OVER o * hold - lag(c_{v}) OVER o * 0.0002 AS {v}' for v in VARIANTS)} FROM pc WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(windowed(daily(spark, sf_dir).select("symbol", "ts", "close"), {"mean": sma("close", 20)}, back=19).where("mean is not null").select("symbol", "ts", F.col("mean").alias("close")))


def _net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of every Tuesday: finished orders are long positions, the others short ones; customers fall into three groups."""
    tuesday = lambda c: F.next_day(F.date_sub(F.to_date(c), 1), "TUE").cast("timestamp")
    long, v = F.col("o_orderstatus") == "F", F.floor("o_totalprice")
    sums = [F.sum(F.when((F.col("o_custkey") % 3 == i) & (long if s == "long" else ~long), v).otherwise(0)).alias(f"{g}_{s}") for i, g in enumerate(GROUPS) for s in ("long", "short")]
    report = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), tuesday("o_orderdate").alias("ts")).agg(*sums, F.sum(v).alias("interest"))
    q, kept = F.floor("l_quantity"), F.col("l_returnflag") == "N"
    second = table(spark, sf_dir, "lineitem").groupBy(tuesday("l_shipdate").alias("ts")).agg(F.sum(F.when(kept, q).otherwise(0)).alias("mm_long"), F.sum(F.when(~kept, q).otherwise(0)).alias("mm_short"), F.sum(q).alias("mm_interest"))
    return nets(report, second)


@query(f"{_WEEKLY} SELECT symbol, epoch_us(CAST(week AS TIMESTAMP)) // 1000000 AS t, {', '.join(f'CAST({g}_net AS BIGINT) AS {g}_net, round({g}_pct, 4) AS {g}_pct' for g in (*GROUPS, 'mm'))} FROM net")
def positioning_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net positions and shares of open interest for each report, with a second source of the same date."""
    g = (*GROUPS, "mm")
    return _net(spark, sf_dir).select("symbol", F.unix_seconds("ts").alias("t"), *[F.col(f"{x}_net").cast("long").alias(f"{x}_net") for x in g], *[F.round(f"{x}_pct", 4).alias(f"{x}_pct") for x in g])


@query(f"{_WEEKLY} SELECT symbol, epoch_us(CAST(week AS TIMESTAMP)) // 1000000 AS t, {', '.join(f'CASE WHEN abs({c}) < 0.00005 THEN 0.0 ELSE round({c}, 4) END::DOUBLE AS {c}' for c in SIGNALS)} FROM sv")
def positioning_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six readings of each report."""
    return weekly_signals(_net(spark, sf_dir), _WINDOW).select("symbol", F.unix_seconds("ts").alias("t"), *[F.when(F.abs(c) < 0.00005, 0.0).otherwise(F.round(c, 4)).alias(c) for c in SIGNALS])


@query(f"""{_EARNED}, un AS (UNPIVOT ea ON {', '.join(VARIANTS)} INTO NAME variant VALUE r),
wi AS (SELECT symbol, variant, span, ts, r, sum(ln(1 + r)) OVER (PARTITION BY symbol, variant, span ORDER BY ts) AS eq, hold FROM un, (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{z}')" for n, a, z in _SPANS)}) s(span, a, z) WHERE ts >= a AND ts < z AND r IS NOT NULL),
wp AS (SELECT *, max(eq) OVER (PARTITION BY symbol, variant, span ORDER BY ts) AS peak FROM wi)
SELECT symbol, variant, span, count(*) AS n, round(exp(sum(ln(1 + r)) / (count(*) / 252)) - 1, 4) AS cagr, round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0), 4) AS sharpe, round(min(exp(eq - peak) - 1), 4) AS max_drawdown, round(avg((r > 0)::INT) FILTER (abs(r) > 1e-12), 4) AS hit, round(exp(sum(ln(1 + hold)) / (count(hold) / 252)) - 1, 4) AS hold_cagr
FROM wp GROUP BY 1, 2, 3 HAVING count(*) >= 60""")
def positioning_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth, Sharpe ratio, drawdown and hits of six variants, always long, and the mean of 200 random ones, by spans."""
    earned = daily_earnings(weekly_signals(_net(spark, sf_dir), _WINDOW), _market(spark, sf_dir))
    out = by_windows(earned, _SPANS)
    return out.select("symbol", "variant", "span", "n", *[F.round(c, 4).alias(c) for c in ("cagr", "sharpe", "max_drawdown", "hit", "hold_cagr")])


@query(f"""{_WEEKLY}, dd AS (SELECT d.*, last_value(spec_pct IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM d LEFT JOIN tk USING (symbol, ts)),
wk AS (SELECT symbol, CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER) AS week, arg_max(close, ts) AS close, arg_max(x, ts) FILTER (x IS NOT NULL) AS x FROM dd GROUP BY 1, 2),
nx AS (SELECT symbol, x, week, CASE WHEN lead(week) OVER o - week = 7 THEN lead(close) OVER o / close - 1 END AS fwd FROM wk WINDOW o AS (PARTITION BY symbol ORDER BY week)),
ok AS (SELECT * FROM nx WHERE x IS NOT NULL AND fwd IS NOT NULL AND week < DATE '2000-01-01'),
rk AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY x) + (count(*) OVER (PARTITION BY symbol, x) - 1) / 2 AS a, rank() OVER (PARTITION BY symbol ORDER BY fwd) + (count(*) OVER (PARTITION BY symbol, fwd) - 1) / 2 AS b, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) OVER (PARTITION BY symbol) AS cuts FROM ok),
ic AS (SELECT symbol, corr(a, b) AS ic FROM rk GROUP BY 1)
SELECT symbol, (len(list_filter(cuts, lambda c: c < x)) + 1)::INTEGER AS "group", count(*) AS n, round(avg(fwd) * 10000, 4) AS fwd_bps, round(any_value(ic.ic), 4) AS ic FROM rk JOIN ic USING (symbol) GROUP BY 1, 2""")
def positioning_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's next week by quintiles of a group's share of open interest, before the held-back years."""
    market = _market(spark, sf_dir)
    w = weekly_outlook(in_force(_net(spark, sf_dir), market, ("spec_pct",)), market, "spec_pct", "2000-01-01")
    return w.groupBy("symbol", "group").agg(F.count("*").alias("n"), F.round(F.avg("fwd") * 10000, 4).alias("fwd_bps"), F.round(F.first("ic"), 4).alias("ic"))
