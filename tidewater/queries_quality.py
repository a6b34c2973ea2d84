"""Queries over the quality of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.quality import changes, clock_offsets, compared, seams, session_coverage
from .plans.impulses import once
from .registry import DAILY, TICKS, query, secs
from .sources.market import daily, ticks

_SESSION = "NOT (isodow(ts) = 6 OR (isodow(ts) = 7 AND hour(ts) < 22) OR (isodow(ts) = 5 AND hour(ts) >= 21) OR (isodow(ts) <= 4 AND hour(ts) = 21))"


@query(f"""WITH {TICKS}, c AS (SELECT symbol, date_trunc('month', ts) AS m, count(DISTINCT CASE WHEN {_SESSION} AND CAST(ts AS DATE) <> DATE '2024-01-01' THEN epoch_us(ts) // 60000000 END) AS covered FROM ticks GROUP BY 1, 2),
g AS (SELECT m, unnest(range(m::TIMESTAMP, m::TIMESTAMP + INTERVAL 1 MONTH, INTERVAL 1 MINUTE)) AS ts FROM (SELECT DISTINCT m FROM c)), e AS (SELECT m, count(*) AS expected FROM g WHERE {_SESSION} AND CAST(ts AS DATE) <> DATE '2024-01-01' GROUP BY 1)
SELECT symbol, year(m)::INTEGER AS year, month(m)::INTEGER AS month, covered, expected, round(100.0 * covered / expected, 4)::DOUBLE AS coverage FROM c JOIN e USING (m)""")
def session_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the minutes of trading sessions with a tick, by month, New Year left out."""
    return session_coverage(ticks(spark, sf_dir), holidays=["2024-01-01"]).withColumn("coverage", F.round("coverage", 4))


#: Two clocks: prices of views by the hour, and the same ones by a clock that is two hours behind in even weeks and three in odd ones, with noise; in every fifth week nothing but noise.
_CLOCKS = f"""WITH {TICKS}, v AS (SELECT ts, price, seq FROM ticks WHERE symbol = 'view' AND price > 0),
l AS (SELECT epoch_us(ts) // 3600000000 AS t, arg_max(price, (ts, seq)) AS p FROM v GROUP BY 1), a AS (SELECT t, p, ln(p / lag(p) OVER (ORDER BY t)) AS r, t // 168 AS period FROM l),
b AS (SELECT t, p, ln(p / lag(p) OVER (ORDER BY t)) AS r FROM (SELECT t - 2 - (t // 168) % 2 AS t, any_value(CASE WHEN (t // 168) % 5 = 0 THEN 1 + (t * 7919 % 100) / 100.0 ELSE p * (1 + (t * 31 % 7) / 1000.0) END ORDER BY t) AS p FROM l GROUP BY 1)),
c1 AS (SELECT period, off, corr(a.r, b.r) AS c, count(*) AS n FROM a, range(-8, 9, 4) o(off), b WHERE b.t = a.t - off AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2),
o1 AS (SELECT period, arg_max(off, (c, -off)) AS o FROM c1 WHERE n >= 20 AND c IS NOT NULL GROUP BY 1),
c2 AS (SELECT a.period, off, corr(a.r, b.r) AS c, count(*) AS n FROM a JOIN o1 USING (period), range(-16, 17) o(off), b WHERE off BETWEEN o1.o - 3 AND o1.o + 3 AND b.t = a.t - off AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT period, arg_max(off, (c, -off))::INTEGER AS off, arg_max(c, (c, -off)) AS corr, arg_max(n, (c, -off)) AS n FROM c2 WHERE n >= 20 AND c IS NOT NULL GROUP BY 1),
ma AS (SELECT period, (t - off) // 4 AS k, arg_max(p, t) AS p FROM a JOIN o2 USING (period) GROUP BY 1, 2), mb AS (SELECT t // 4 AS k, arg_max(p, t) AS p FROM b GROUP BY 1),
ra AS (SELECT period, k, ln(p / lag(p) OVER (PARTITION BY period, k // 4096 ORDER BY k)) AS r FROM ma), rb AS (SELECT k, ln(p / lag(p) OVER (PARTITION BY k // 4096 ORDER BY k)) AS r FROM mb),
ag AS (SELECT period, corr(ra.r, rb.r) AS agreement FROM ra JOIN rb USING (k) GROUP BY 1),
f AS (SELECT p.period, off, corr, agreement, n, CASE WHEN corr IS NULL THEN 'no_overlap' WHEN corr >= 0.95 THEN 'ok' WHEN agreement >= 0.9 THEN 'ok_coarse' ELSE 'low_quality' END AS flag FROM (SELECT DISTINCT period FROM a) p LEFT JOIN o2 USING (period) LEFT JOIN ag USING (period)),
h AS (SELECT f.*, (SELECT arg_min(g.off, (abs(g.period - f.period), g.period)) FROM f g WHERE g.flag LIKE 'ok%') AS nearest FROM f)
SELECT period, CASE WHEN flag = 'low_quality' THEN coalesce(nearest, off) ELSE off END AS "offset", round(corr, 6) AS corr, round(agreement, 6) AS agreement, n, flag, coalesce(flag = 'low_quality' AND nearest <> off, false) AS borrowed FROM h"""


def _clocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = once(changes(ticks(spark, sf_dir).where("symbol = 'view'"), "symbol", 3600, order=("ts", "seq")))
    week = F.floor(F.col("t") / 168)
    noise = F.when(week % 5 == 0, 1 + (F.col("t") * 7919 % 100) / 100).otherwise(F.col("p") * (1 + (F.col("t") * 31 % 7) / 1000))
    other = l.select(F.lit("b").alias("symbol"), (F.col("t") - 2 - week % 2).alias("_t"), noise.alias("_p"), "t").groupBy("symbol", "_t").agg(F.min_by("_p", "t").alias("price"))
    b = changes(other.select("symbol", F.timestamp_seconds(F.col("_t") * 3600).alias("ts"), "price"), "symbol", 3600)
    return l.withColumn("period", week), once(b)


@query(_CLOCKS)
def clock_offset_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a planted second clock, found coarse to fine; weeks of noise borrow from their neighbours."""
    a, b = _clocks(spark, sf_dir)
    out = clock_offsets(a, b, (8, 4), (3, 1), 1, 20)
    return out.select("period", "offset", F.round("corr", 6).alias("corr"), F.round("agreement", 6).alias("agreement"), "n", "flag", "borrowed")


@query(_CLOCKS[: _CLOCKS.index("c1 AS (")].rstrip().rstrip(",") + " SELECT count(*) AS n, round(corr(a.r, b.r), 6) AS corr, round(avg(a.p - b.p), 6) AS mean_diff, round(quantile_cont(round(abs(a.p - b.p) / b.p * 1e4, 4), 0.95), 3) AS bps_p95 FROM a JOIN b USING (t)")
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two clocks' prices at the same hours."""
    a, b = _clocks(spark, sf_dir)
    return compared(a, b).select("n", F.round("corr", 6).alias("corr"), F.round("mean_diff", 6).alias("mean_diff"), F.round("bps_p95", 3).alias("bps_p95"))


@query(f"""WITH {DAILY}, b AS (SELECT symbol, ts, close, date_trunc('month', ts) AS m, (CASE WHEN ticks % 3 = month(ts) % 3 THEN 1 ELSE 0 END) AS source FROM daily),
u AS (SELECT symbol, m, arg_max(source, (n, -source)) AS s FROM (SELECT symbol, m, source, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2), t AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY m) AS was FROM u) WHERE was <> s),
n AS (SELECT t.symbol, t.m AS edge, was, s, b.ts, close, b.ts >= t.m AS side, ln(close / lag(close) OVER (PARTITION BY t.symbol, t.m, b.ts >= t.m ORDER BY b.ts)) AS r FROM t JOIN b ON b.symbol = t.symbol AND b.ts >= t.m - INTERVAL 12 DAY AND b.ts < t.m + INTERVAL 12 DAY)
SELECT symbol, epoch_us(edge::TIMESTAMP) // 1000000 AS t, any_value(was) AS before, any_value(s) AS after, round(arg_max(close, ts) FILTER (NOT side), 4) AS last_close, round(arg_min(close, ts) FILTER (side), 4) AS first_close,
 round((arg_min(close, ts) FILTER (side) / arg_max(close, ts) FILTER (NOT side) - 1) * 1e4, 4) AS jump_bps, round(stddev_samp(r) FILTER (NOT side) * 1e4, 4) AS before_bps, round(stddev_samp(r) FILTER (side) * 1e4, 4) AS after_bps
FROM n GROUP BY 1, 2 HAVING count(*) FILTER (NOT side) >= 3 AND count(*) FILTER (side) >= 3""")
def source_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months whose usual source changes, with the days around their start."""
    b = daily(spark, sf_dir).withColumn("source", F.when(F.col("ticks") % 3 == F.month("ts") % 3, 1).otherwise(0))
    s = seams(b, 12 * 86_400, 3)
    return s.select("symbol", secs("month").alias("t"), "before", "after", *[F.round(c, 4).alias(c) for c in ("last_close", "first_close", "jump_bps", "before_bps", "after_bps")])
