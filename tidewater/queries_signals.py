"""Queries over signal builders, labels, and statistics of series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ordered import along, carry_last, lag, numbered, rolling_std, running, same_series, sma, windowed
from .registry import DAILY, query, rows_before, secs
from .sources.market import daily, split_of

_D = f"WITH {DAILY}"
_T = "symbol, epoch_us(ts) // 1000000 AS t"
_PREV = "(PARTITION BY symbol ORDER BY ts)"
_SPLIT = "CASE WHEN ts >= '1995-01-01' AND ts < '1999-01-01' THEN 'in_sample' WHEN ts >= '1999-01-01' AND ts < '2000-01-01' THEN 'walk_forward' WHEN ts >= '2000-01-01' AND ts < '2002-01-01' THEN 'out_of_sample' END"


def _side(up, down):
    """1, -1 or 0; down wins where both hold."""
    return F.when(down, -1).when(up, 1).otherwise(0)


@query(f"""{_D}, b AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m, stddev_samp(close) OVER w AS s FROM daily WINDOW w AS {rows_before(20)})
SELECT {_T}, CASE WHEN high > m + 2 * s AND close < m + 2 * s THEN -1 WHEN low < m - 2 * s AND close > m - 2 * s THEN 1 ELSE 0 END AS side FROM b""")
def band_bounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that pierce a band and close inside it; the upper band wins."""
    d = windowed(daily(spark, sf_dir), {"m": sma("close", 20), "s": rolling_std("close", 20)}, back=19)
    up, low = F.col("m") + 2 * F.col("s"), F.col("m") - 2 * F.col("s")
    return d.select("symbol", secs("ts").alias("t"), _side((F.col("low") < low) & (F.col("close") > low), (F.col("high") > up) & (F.col("close") < up)).alias("side"))


@query(f"""{_D}, c AS (SELECT *, CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS h, CASE WHEN count(low) OVER w = 20 THEN min(low) OVER w END AS l FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, coalesce(close > h, false) AS up, coalesce(close < l, false) AS dn FROM c)
SELECT {_T}, CASE WHEN dn AND NOT lag(dn, 1, false) OVER {_PREV} THEN -1 WHEN up AND NOT lag(up, 1, false) OVER {_PREV} THEN 1 ELSE 0 END AS side FROM b""")
def fresh_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first close beyond the channel of the 20 bars before: the previous bar had not broken its own."""
    w = along().rowsBetween(-20, -1)
    full = lambda c, x: F.when(F.count(c).over(w) == 20, x)
    up, down = F.coalesce(F.col("close") > full("high", F.max("high").over(w)), F.lit(False)), F.coalesce(F.col("close") < full("low", F.min("low").over(w)), F.lit(False))
    d = windowed(daily(spark, sf_dir), {"up": up, "dn": down, "up0": F.lag("up", 1, False).over(along()), "dn0": F.lag("dn", 1, False).over(along())}, back=21)
    return d.select("symbol", secs("ts").alias("t"), _side(F.col("up") & ~F.col("up0"), F.col("dn") & ~F.col("dn0")).alias("side"))


@query(f"""{_D}, m AS (SELECT *, avg(close) OVER a AS x, avg(close) OVER b AS y, count(*) OVER b AS n, row_number() OVER {_PREV} - 1 AS rn FROM daily WINDOW a AS {rows_before(10)}, b AS {rows_before(30)})
SELECT {_T}, CASE WHEN rn = 0 THEN 1 ELSE 0 END AS hold, CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END AS flip, CASE WHEN n < 30 THEN 0 WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS trend FROM m""")
def baseline_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines: buy and hold, flip with every bar, and the trend of two means."""
    d = windowed(daily(spark, sf_dir), {"x": sma("close", 10), "y": sma("close", 30)}, back=29)
    trend = F.when(F.col("x") > F.col("y"), 1).when(F.col("x") < F.col("y"), -1).otherwise(0)
    return d.select("symbol", secs("ts").alias("t"), (F.col("rn") == 0).cast("int").alias("hold"), F.when(F.col("rn") % 2 == 0, 1).otherwise(-1).alias("flip"), trend.alias("trend"))


@query(f"""{_D}, l AS (SELECT *, list(close) OVER {rows_before(156)} AS l FROM daily)
SELECT {_T}, round(CASE WHEN len(l) >= 78 THEN len(list_filter(l[:-2], lambda x: x < close)) / (len(l) - 1) END, 6) AS pct FROM l""")
def rank_of_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the window's other values that the last one exceeds."""
    values = F.collect_list("close").over(along().rowsBetween(-155, -1))
    pct = F.when(F.size(values) >= 77, F.size(F.filter(values, lambda v: v < F.col("close"))) / F.size(values))
    return windowed(daily(spark, sf_dir), {"pct": F.round(pct, 6)}, back=155).select("symbol", secs("ts").alias("t"), "pct")


@query(f"""{_D}, l AS (SELECT *, lag(close) OVER {_PREV} AS p, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, row_number() OVER {_PREV} AS r FROM daily)
SELECT {_T}, CASE WHEN r = 1 THEN z ELSE p END AS rolled FROM l""")
def wrapped_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shift by one row that wraps: the first row gets the last row's value."""
    d = numbered(daily(spark, sf_dir))
    ends = d.groupBy("symbol").agg(F.max_by("close", "rn").alias("z"))
    d = same_series(windowed(d, {"p": lag("close")}, back=1), ends, ["symbol"])
    return d.select("symbol", secs("ts").alias("t"), F.when(F.col("rn") == 0, F.col("z")).otherwise(F.col("p")).alias("rolled"))


@query(f"""{_D}, r AS (SELECT *, ln(close / lag(close) OVER {_PREV}) AS r FROM daily) SELECT {_T}, round(sqrt(CASE WHEN count(r) OVER w = 8 THEN sum(r * r) OVER w END), 6) AS fwd_rv
FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)""")
def forward_rv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Realised volatility of the next eight returns."""
    w = along().rowsBetween(1, 8)
    rv = F.when(F.count("r").over(w) == 8, F.sqrt(F.sum(F.col("r") * F.col("r")).over(w)))
    d = windowed(daily(spark, sf_dir), {"r": F.log(F.col("close") / lag("close")), "rv": rv}, back=1, ahead=8)
    return d.select("symbol", secs("ts").alias("t"), F.round("rv", 6).alias("fwd_rv"))


@query(f"""{_D}, r AS (SELECT *, sign(close - lag(close) OVER {_PREV}) AS s FROM daily), q AS (SELECT *, lag(s) OVER {_PREV} AS s0 FROM r),
m AS (SELECT *, count(s0) OVER w AS n, avg(s * s0) OVER w - avg(CASE WHEN s0 IS NOT NULL THEN s END) OVER w * avg(s0) OVER w AS c, stddev_pop(CASE WHEN s0 IS NOT NULL THEN s END) OVER w AS a, stddev_pop(s0) OVER w AS b FROM q WINDOW w AS {rows_before(40)})
SELECT {_T}, round(CASE WHEN n = 40 THEN CASE WHEN a < 1e-9 OR b < 1e-9 THEN 0 ELSE c / (a * b) END END, 4) AS ac FROM m""")
def sign_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag-one autocorrelation of the signs of returns over 40 rows, 0 where signs do not vary."""
    pair = F.col("s0").isNotNull()
    s, s0 = F.when(pair, F.col("s")), F.col("s0")
    w = along().rowsBetween(-39, 0)
    a, b = F.stddev_pop(s).over(w), F.stddev_pop(s0).over(w)
    ac = F.when((a < 1e-9) | (b < 1e-9), 0.0).otherwise((F.avg(s * s0).over(w) - F.avg(s).over(w) * F.avg(s0).over(w)) / (a * b))
    d = windowed(daily(spark, sf_dir), {"s": F.signum(F.col("close") - lag("close")), "s0": lag("s"), "ac": F.when(F.count(s0).over(w) == 40, ac)}, back=41)
    return d.select("symbol", secs("ts").alias("t"), F.round("ac", 4).alias("ac"))


@query(f"""{_D}, p AS (SELECT *, max(close) OVER {_PREV} AS peak FROM daily), k AS (SELECT symbol, peak, min(ts) AS t0, max(ts) AS t1 FROM p GROUP BY 1, 2)
SELECT symbol, max(date_diff('day', t0, t1)) AS longest_days FROM k GROUP BY 1""")
def longest_below_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest time from a peak to the last bar before the next one, in days."""
    d = running(numbered(daily(spark, sf_dir)), {"peak": ("max", "close")})
    k = d.groupBy("symbol", "peak").agg(F.min("ts").alias("at"), F.max("ts").alias("until"))
    return k.groupBy("symbol").agg(F.max(F.datediff("until", "at")).cast("long").alias("longest_days"))


@query(f"""{_D}, s AS (SELECT *, {_SPLIT} AS split FROM daily), r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, split ORDER BY ts) - 1 AS r FROM s WHERE split IS NOT NULL)
SELECT symbol, split, round(pow(arg_max(close, ts) / arg_min(close, ts), 365.25 / nullif(date_diff('day', min(ts), max(ts)), 0)) - 1, 6) AS cagr, round(avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END), 6) AS hit FROM r GROUP BY 1, 2""")
def growth_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly growth and share of rising bars in each named window."""
    d = daily(spark, sf_dir).withColumn("split", split_of(F.col("ts"))).where("split is not null").withColumn("k", F.concat_ws("|", "symbol", "split"))
    d = windowed(d, {"r": F.col("close") / F.lag("close").over(along("k")) - 1}, back=1, by="k")
    days = F.datediff(F.max("ts"), F.min("ts"))
    cagr = F.pow(F.max_by("close", "ts") / F.min_by("close", "ts"), 365.25 / F.when(days != 0, days)) - 1
    return d.groupBy("symbol", "split").agg(F.round(cagr, 6).alias("cagr"), F.round(F.avg((F.col("r") > 0).cast("double")), 6).alias("hit"))


@query(f"""{_D}, r AS (SELECT symbol, close / lag(close) OVER {_PREV} - 1 AS r FROM daily) SELECT symbol, count(r) AS n, round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 6) AS t_stat FROM r GROUP BY 1""")
def mean_t_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"r": F.col("close") / lag("close") - 1}, back=1)
    return d.groupBy("symbol").agg(F.count("r").alias("n"), F.round(F.avg("r") / (F.stddev_samp("r") / F.sqrt(F.count("r"))), 6).alias("t_stat"))


@query("SELECT event_type AS symbol, year(ts) AS y, quarter(ts) AS q, count(*) AS n FROM events GROUP BY 1, 2, 3")
def events_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("symbol"), F.year("ts").cast("long").alias("y"), F.quarter("ts").cast("long").alias("q")).agg(F.count("*").alias("n"))


@query(f"""{_D}, r AS (SELECT symbol, ts, close / lag(close) OVER {_PREV} - 1 AS r FROM daily), m AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s FROM r GROUP BY 1)
SELECT r.symbol AS symbol, epoch_us(ts) // 1000000 AS t, round(least(greatest(r, m - 2 * s), m + 2 * s), 6) AS clipped, CASE WHEN r <= -0.5 THEN 0 WHEN r <= 0 THEN 1 WHEN r <= 0.5 THEN 2 WHEN r > 0.5 THEN 3 END AS bin FROM r JOIN m USING (symbol) WHERE r IS NOT NULL""")
def winsorised_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns clipped at two deviations, and their fixed bins, closed on the right."""
    d = windowed(daily(spark, sf_dir), {"r": F.col("close") / lag("close") - 1}, back=1).where("r is not null")
    m = d.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    d = same_series(d, m, ["symbol"])
    clipped = F.least(F.greatest("r", F.col("m") - 2 * F.col("s")), F.col("m") + 2 * F.col("s"))
    cut = sum(((F.col("r") > edge).cast("int") for edge in (-0.5, 0.0, 0.5)), F.lit(0))
    return d.select("symbol", secs("ts").alias("t"), F.round(clipped, 6).alias("clipped"), cut.alias("bin"))


@query(f"""{_D}, a AS (SELECT symbol, ts, close FROM daily WHERE symbol = '1-URGENT'), b AS (SELECT ts, close AS other FROM daily WHERE symbol = '2-HIGH'), j AS (SELECT coalesce(a.ts, b.ts) AS ts, close, other FROM a FULL JOIN b ON a.ts = b.ts)
SELECT epoch_us(ts) // 1000000 AS t, last_value(close IGNORE NULLS) OVER w AS x, last_value(other IGNORE NULLS) OVER w AS y FROM j WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def outer_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two series on all their times, each carried forward."""
    d = daily(spark, sf_dir)
    both = d.where("symbol in ('1-URGENT', '2-HIGH')").groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for s, c in (("1-URGENT", "a"), ("2-HIGH", "b"))])
    filled = carry_last(numbered(both.withColumn("symbol", F.lit("both"))), {"a": "x", "b": "y"})
    return filled.select(secs("ts").alias("t"), "x", "y")


@query(f"""{_D}, n AS (SELECT *, row_number() OVER {_PREV} AS r, count(*) OVER (PARTITION BY symbol) AS n FROM daily), g AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s FROM n WHERE r <= floor(0.7 * n) GROUP BY 1)
SELECT n.symbol AS symbol, epoch_us(ts) // 1000000 AS t, CASE WHEN r <= floor(0.7 * n) THEN 'fit' ELSE 'test' END AS part, round((close - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM n JOIN g USING (symbol)""")
def standardised_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven tenths of a series fit its mean and population deviation (0 counts as 1), which scale all of it."""
    d = numbered(daily(spark, sf_dir), of="n").withColumn("fit", F.col("rn") + 1 <= F.floor(0.7 * F.col("n")))
    m = d.where("fit").groupBy("symbol").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("s"))
    z = (F.col("close") - F.col("m")) / F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return same_series(d, m, ["symbol"]).select("symbol", secs("ts").alias("t"), F.when(F.col("fit"), "fit").otherwise("test").alias("part"), F.round(z, 6).alias("z"))


@query("SELECT DISTINCT strftime(m, '%Y-%m') AS month FROM (SELECT o_orderdate::DATE AS m FROM orders UNION ALL SELECT l_shipdate::DATE FROM lineitem)")
def months_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months that any of two sources has."""
    o, i = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.date_format(c, "yyyy-MM").alias("month")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    return o.unionByName(i).distinct()
