"""Queries over research tables: displacement, labels, quotes, simulated stakes, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import auc_by
from .functions.stats import exact_quantiles
from .operators.ordered import along, lag, numbered, rolling_std, same_series, sma, windowed
from .operators.positions import martingale, position_pnl
from .operators.quotes import clean_quotes, quote_bars
from .operators.resample import to_bars
from .registry import DAILY, TICKS, bars_sql, query, rows_before, secs
from .sources.market import daily, table, ticks

_D = f"WITH {DAILY}"
_T = "symbol, epoch_us(ts) // 1000000 AS t"
_PREV = "(PARTITION BY symbol ORDER BY ts)"


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(x, digits)


@query(f"""{_D}, s AS (SELECT *, avg(close) OVER a AS x, avg(close) OVER b AS y, count(*) OVER b AS n, close / lag(close) OVER {_PREV} - 1 AS r FROM daily WINDOW a AS {rows_before(10)}, b AS {rows_before(30)}),
p AS (SELECT *, CASE WHEN n < 30 THEN 0 WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS pos FROM s), l AS (SELECT *, lag(pos, 1, 0) OVER {_PREV} AS held, lag(pos, 2, 0) OVER {_PREV} AS was FROM p)
SELECT {_T}, held, round(held * r - 0.0002 * abs(held - was), 6) + 0.0 AS pnl FROM l""")
def daily_position_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a position taken at a close makes over the next bar, less two basis points of turnover."""
    d = windowed(daily(spark, sf_dir), {"x": sma("close", 10), "y": sma("close", 30), "r": F.col("close") / lag("close") - 1}, back=29)
    d = d.withColumn("pos", F.when(F.col("x") > F.col("y"), 1).when(F.col("x") < F.col("y"), -1).otherwise(0))
    return position_pnl(d, "pos", "r").select("symbol", secs("ts").alias("t"), "held", (_r("pnl") + 0.0).alias("pnl"))  # no negative zero


_MOVES = f"""{_D}, c AS (SELECT *, close - lag(close) OVER {_PREV} AS d, close - lag(close, 5) OVER {_PREV} AS move, lead(close, 5) OVER {_PREV} - close AS ahead FROM daily),
s AS (SELECT *, CASE WHEN count(d) OVER w = 60 THEN stddev_samp(d) OVER w END AS sd FROM c WINDOW w AS {rows_before(60)}),
m AS (SELECT symbol, ts, move / nullif(sd * sqrt(5), 0) AS move_sd, -sign(move) * ahead / nullif(sd, 0) AS rev FROM s)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.lead("close", 5).over(along()) - F.col("close")
    d = windowed(daily(spark, sf_dir), {"d": F.col("close") - lag("close"), "move": F.col("close") - lag("close", 5), "ahead": ahead, "sd": rolling_std("d", 60)}, back=60, ahead=5)
    sd = F.when(F.col("sd") != 0, F.col("sd"))
    return d.select("symbol", "ts", (F.col("move") / (sd * F.sqrt(F.lit(5.0)))).alias("move_sd"), (-F.signum("move") * F.col("ahead") / sd).alias("rev"))


@query(f"{_MOVES} SELECT {_T}, round(move_sd, 4) AS move_sd, round(rev, 4) AS rev FROM m")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far five bars went in usual moves, and how far the next five came back."""
    return _moves(spark, sf_dir).select("symbol", secs("ts").alias("t"), _r("move_sd", 4).alias("move_sd"), _r("rev", 4).alias("rev"))


@query(f"""{_MOVES}, b AS (SELECT CASE WHEN abs(move_sd) <= 0.5 THEN 0 WHEN abs(move_sd) <= 1 THEN 1 WHEN abs(move_sd) <= 1.5 THEN 2 ELSE 3 END AS bucket, rev FROM m WHERE move_sd IS NOT NULL AND rev IS NOT NULL)
SELECT bucket, count(*) AS n, round(avg(rev), 6) AS mean, round(avg(rev) / (stddev_samp(rev) / sqrt(count(*))), 6) AS t_stat FROM b GROUP BY 1""")
def displacement_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return of what went far, by how far (bins closed on the right)."""
    m = _moves(spark, sf_dir).where("move_sd is not null and rev is not null")
    bucket = sum(((F.abs("move_sd") > edge).cast("int") for edge in (0.5, 1.0, 1.5)), F.lit(0))
    return m.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), _r(F.avg("rev")).alias("mean"), _r(F.avg("rev") / (F.stddev_samp("rev") / F.sqrt(F.count("*")))).alias("t_stat"))


@query(f"""{_D}, p AS (SELECT *, CASE WHEN high > max(high) OVER l AND high > max(high) OVER r THEN high END AS top, CASE WHEN low < min(low) OVER l AND low < min(low) OVER r THEN low END AS bottom FROM daily
 WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
k AS (SELECT *, last_value(top IGNORE NULLS) OVER w AS u, last_value(bottom IGNORE NULLS) OVER w AS d, list({{'h': high, 'l': low, 'c': close}}) OVER x AS past FROM p
 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 192 PRECEDING AND 3 PRECEDING), x AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING))
SELECT {_T}, u, d, least(2, coalesce(len(list_filter(past, lambda x: x.h > u AND x.c <= u)), 0) + coalesce(len(list_filter(past, lambda x: x.l < d AND x.c >= d)), 0)) AS failed FROM k""")
def failed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last confirmed high and low, and how often the bars before went beyond one and closed back (2 at most)."""
    before, after = along().rowsBetween(-2, -1), along().rowsBetween(1, 2)
    level, past = along().rowsBetween(-192, -3), F.collect_list(F.struct("high", "low", "close")).over(along().rowsBetween(-48, -1))
    columns = {
        "top": F.when((F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)), F.col("high")),
        "bottom": F.when((F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)), F.col("low")),
        "u": F.last("top", True).over(level),
        "d": F.last("bottom", True).over(level),
        "past": past,
    }
    d = windowed(daily(spark, sf_dir), columns, back=194, ahead=2)
    above = F.size(F.filter("past", lambda x: (x["high"] > F.col("u")) & (x["close"] <= F.col("u"))))
    below = F.size(F.filter("past", lambda x: (x["low"] < F.col("d")) & (x["close"] >= F.col("d"))))
    return d.select("symbol", secs("ts").alias("t"), "u", "d", F.least(F.lit(2), above + below).alias("failed"))


_HOURS = f"WITH {TICKS}, {bars_sql('1 hour')}"


@query(f"""{_HOURS}, a AS (SELECT *, abs(ln(close / lag(close) OVER {_PREV})) AS a FROM bars WHERE close > 0), h AS (SELECT symbol, hour(ts) AS h, avg(a) AS usual FROM a GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(a) OVER w >= 24 THEN avg(a) OVER w END AS mean FROM a WINDOW w AS {rows_before(480)})
SELECT m.symbol AS symbol, epoch_us(ts) // 1000000 AS t, round(usual / nullif(mean, 0), 4) AS season FROM m JOIN h ON h.symbol = m.symbol AND h.h = hour(m.ts)""")
def hour_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual absolute return of an hour of the day, by the mean of the last 480 bars."""
    w = along().rowsBetween(-479, 0)
    bars = to_bars(ticks(spark, sf_dir), "1 hour").where("close > 0")
    d = windowed(bars, {"a": F.abs(F.log(F.col("close") / lag("close"))), "mean": F.when(F.count("a").over(w) >= 24, F.avg("a").over(w))}, back=480)
    d = d.withColumn("h", F.hour("ts"))
    d = same_series(d, d.groupBy("symbol", "h").agg(F.avg("a").alias("usual")), ["symbol", "h"])
    return d.select("symbol", secs("ts").alias("t"), _r(F.col("usual") / F.when(F.col("mean") != 0, F.col("mean")), 4).alias("season"))


@query(f"""{_HOURS}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) - min(low) AS reach, count(*) AS hours FROM bars GROUP BY 1, 2)
SELECT b.symbol AS symbol, epoch_us(b.ts) // 1000000 AS t, round(reach, 4) AS reach, hours FROM bars b LEFT JOIN d ON d.symbol = b.symbol AND d.day = CAST(b.ts AS DATE) - 1""")
def day_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with the state of the calendar day before, null where it has no bars."""
    bars = to_bars(ticks(spark, sf_dir), "1 hour")
    state = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg((F.max("high") - F.min("low")).alias("reach"), F.count("*").alias("hours"))
    d = same_series(bars.withColumn("day", F.date_sub(F.to_date("ts"), 1)), state, ["symbol", "day"], "left")
    return d.select("symbol", secs("ts").alias("t"), _r("reach", 4).alias("reach"), "hours")


_BUCKETS = f"""{_D}, f AS (SELECT symbol, isodow(ts) AS dow, sign(close - lag(close) OVER {_PREV})::INT AS bucket, lead(close) OVER {_PREV} / close - 1 AS y FROM daily),
c AS (SELECT symbol, dow, bucket, count(*) AS n, sum(y) AS s FROM f WHERE bucket IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"bucket": F.signum(F.col("close") - lag("close")).cast("int"), "y": F.lead("close").over(along()) / F.col("close") - 1}, back=1, ahead=1)
    d = d.where("bucket is not null and y is not null").withColumn("dow", F.weekday("ts") + 1)
    return d.groupBy("symbol", "dow", "bucket").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


@query(f"""{_BUCKETS}, t AS (SELECT symbol, dow, sum(n) AS tn, sum(s) AS ts FROM c GROUP BY 1, 2)
SELECT symbol, dow, bucket, n, (tn - n)::BIGINT AS n_control, round(s / n, 6) AS mean, round((ts - s) / nullif(tn - n, 0), 6) AS control FROM c JOIN t USING (symbol, dow)""")
def matched_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a bucket and of all others of its stratum: totals less the bucket's own."""
    c = _buckets(spark, sf_dir)
    d = same_series(c, c.groupBy("symbol", "dow").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts")), ["symbol", "dow"])
    rest = F.col("tn") - F.col("n")
    return d.select("symbol", "dow", "bucket", "n", rest.alias("n_control"), _r(F.col("s") / F.col("n")).alias("mean"), _r((F.col("ts") - F.col("s")) / F.when(rest != 0, rest)).alias("control"))


@query(f"""{_BUCKETS}, g AS (SELECT symbol, dow, bucket FROM (SELECT DISTINCT symbol FROM daily), unnest(range(1, 8)) x(dow), unnest([-1, 0, 1]) y(bucket))
SELECT g.symbol AS symbol, g.dow AS dow, g.bucket AS bucket, coalesce(n, 0) AS n, coalesce(n, 0) >= 20 AS enough FROM g LEFT JOIN c ON c.symbol = g.symbol AND c.dow = g.dow AND c.bucket = g.bucket""")
def pairing_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol, weekday and bucket, with the ledger's count where it has one, and the gate on it."""
    g = daily(spark, sf_dir).select("symbol").distinct().withColumn("dow", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in (-1, 0, 1)])))
    n = F.coalesce("n", F.lit(0))
    return same_series(g, _buckets(spark, sf_dir), ["symbol", "dow", "bucket"], "left").select("symbol", F.col("dow").cast("long").alias("dow"), "bucket", n.alias("n"), (n >= 20).alias("enough"))


_FEATURES = {"reach": "high - low", "body": "close - open", "ticks": "CAST(ticks AS DOUBLE)", "volume": "volume"}
_LONG = f"{_D}, f AS (SELECT *, lead(close) OVER {_PREV} > close AS won FROM daily), l AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {e} AS x, won::INT AS won FROM f WHERE won IS NOT NULL" for k, e in _FEATURES.items()) + ")"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windowed(daily(spark, sf_dir), {"won": (F.lead("close").over(along()) > F.col("close")).cast("int")}, ahead=1).where("won is not null")
    return d.select("won", *[F.expr(e).alias(k) for k, e in _FEATURES.items()])


@query(f"{_LONG} SELECT feature, round(avg(x) FILTER (won = 1), 4) AS winners, round(avg(x) FILTER (won = 0), 4) AS losers, round(avg(x) FILTER (won = 1) - avg(x) FILTER (won = 0), 4) AS diff FROM l GROUP BY 1")
def winners_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each feature before rising and before other closes."""
    long = _features(spark, sf_dir).unpivot("won", list(_FEATURES), "feature", "x")
    up, down = F.avg(F.when(F.col("won") == 1, F.col("x"))), F.avg(F.when(F.col("won") == 0, F.col("x")))
    return long.groupBy("feature").agg(_r(up, 4).alias("winners"), _r(down, 4).alias("losers"), _r(up - down, 4).alias("diff"))


@query(f"""{_LONG}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS r FROM l),
a AS (SELECT feature, count(*) AS n, sum(won) AS p, count(DISTINCT x) AS kinds, sum(r) FILTER (won = 1) AS s FROM k GROUP BY 1)
SELECT feature, n, CASE WHEN n >= 500 AND kinds >= 3 THEN round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) END AS auc FROM a""")
def feature_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each feature alone ranks rising closes; null with fewer than 500 rows or three values."""
    long = _features(spark, sf_dir).unpivot("won", list(_FEATURES), "feature", "x")
    a = auc_by(long, ["feature"], "x", "won")
    return a.select("feature", "n", F.when((F.col("n") >= 500) & (F.col("n_distinct") >= 3), _r("auc")).alias("auc"))


@query(f"""{_D}, p AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN close > avg(close) OVER w END AS pred, lead(close) OVER {_PREV} > close AS up FROM daily WINDOW w AS {rows_before(20)}),
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM p WHERE pred IS NOT NULL AND up IS NOT NULL)
SELECT symbol, count(*) AS n, round(avg((pred = up)::INT), 6) AS hit, round(greatest(avg(up::INT), 1 - avg(up::INT)), 6) AS baseline, round(avg((pred = up)::INT) FILTER (back <= 150), 6) AS recent,
CASE WHEN count(*) < 30 THEN 'too few' WHEN avg((pred = up)::INT) > greatest(avg(up::INT), 1 - avg(up::INT)) THEN 'better' ELSE 'no better' END AS verdict FROM s GROUP BY 1""")
def outcome_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against what came: hits of all and of the last 150, and of always saying the commoner side."""
    pred, up = F.when(F.col("m").isNotNull(), F.col("close") > F.col("m")), F.lead("close").over(along()) > F.col("close")
    d = windowed(daily(spark, sf_dir), {"m": sma("close", 20), "up": up}, back=19, ahead=1).withColumn("pred", pred).where("pred is not null and up is not null")
    d = numbered(d.drop("rn"), of="n").withColumn("right", (F.col("pred") == F.col("up")).cast("int"))
    hit, share = F.avg("right"), F.avg(F.col("up").cast("int"))
    base = F.greatest(share, 1 - share)
    verdict = F.when(F.count("*") < 30, "too few").when(hit > base, "better").otherwise("no better")
    recent = F.avg(F.when(F.col("rn") >= F.col("n") - 150, F.col("right")))
    return d.groupBy("symbol").agg(F.count("*").alias("n"), _r(hit).alias("hit"), _r(base).alias("baseline"), _r(recent).alias("recent"), verdict.alias("verdict"))


@query(f"""{_D}, r AS (SELECT symbol, ts, close / lag(close) OVER {_PREV} - 1 AS r FROM daily), m AS (SELECT symbol, avg(r) AS m, sum(r * r) - count(r) * avg(r) * avg(r) AS v FROM r GROUP BY 1),
c AS (SELECT symbol, ts, r - m AS c, v FROM r JOIN m USING (symbol) WHERE r IS NOT NULL), k AS (SELECT symbol, any_value(v) AS v, {', '.join(f'sum(c * c{k}) AS p{k}' for k in range(1, 7))} FROM
 (SELECT *, {', '.join(f'lag(c, {k}) OVER {_PREV} AS c{k}' for k in range(1, 7))} FROM c) GROUP BY 1)
SELECT symbol, round(least(10, greatest(1, 1 + 2 * ({' + '.join(f'p{k}' for k in range(1, 7))}) / v)), 6) AS inflation FROM k""")
def acf_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much six lags of autocorrelation widen the variance of a mean, from 1 to 10."""
    d = windowed(daily(spark, sf_dir), {"r": F.col("close") / lag("close") - 1}, back=1).where("r is not null")
    m = d.groupBy("symbol").agg(F.avg("r").alias("m"), (F.sum(F.col("r") * F.col("r")) - F.count("r") * F.avg("r") * F.avg("r")).alias("v"))
    d = same_series(d.drop("rn"), m, ["symbol"]).withColumn("c", F.col("r") - F.col("m"))
    d = windowed(d, {f"p{k}": F.col("c") * lag("c", k) for k in range(1, 7)}, back=6)
    total = sum((F.sum(f"p{k}") for k in range(1, 7)), F.lit(0.0))
    return d.groupBy("symbol").agg(_r(F.least(F.lit(10.0), F.greatest(F.lit(1.0), 1 + 2 * total / F.max("v")))).alias("inflation"))


#: What a run has to reach.
_BAR = {"n": (">=", 100), "hit": (">", 0.5), "mean": (">", 0.0), "worst": (">=", -0.9)}
_RUN = f"{_D}, r AS (SELECT symbol, close / lag(close) OVER {_PREV} - 1 AS r FROM daily), a AS (SELECT symbol, count(r)::DOUBLE AS n, avg(CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END) AS hit, avg(r) AS mean, min(r) AS worst FROM r GROUP BY 1)"


@query(f"""{_RUN}, l AS ({' UNION ALL '.join(f"SELECT symbol, '{k}' AS metric, {k}::DOUBLE AS value, '{op}' AS op, {v}::DOUBLE AS bar, {k} {op} {v} AS pass FROM a" for k, (op, v) in _BAR.items())})
SELECT symbol, metric, round(value, 6) AS value, op, bar, pass, bool_and(pass) OVER (PARTITION BY symbol) AS all_pass FROM l""")
def success_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric of a run against its threshold, and whether all are met."""
    r = windowed(daily(spark, sf_dir), {"r": F.col("close") / lag("close") - 1}, back=1)
    a = r.groupBy("symbol").agg(F.count("r").cast("double").alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("hit"), F.avg("r").alias("mean"), F.min("r").alias("worst"))
    passed = {k: F.col(k) >= v if op == ">=" else F.col(k) > v for k, (op, v) in _BAR.items()}
    every = None
    for p in passed.values():
        every = p if every is None else every & p
    lines = [F.struct(F.lit(k).alias("metric"), _r(k).alias("value"), F.lit(op).alias("op"), F.lit(float(v)).alias("bar"), passed[k].alias("pass")) for k, (op, v) in _BAR.items()]
    return a.select("symbol", F.explode(F.array(*lines)).alias("l"), every.alias("all_pass")).select("symbol", "l.*", "all_pass")


_STACK = {"busy": "ticks >= 2", "rising": "close > open", "wide": "high - low > 50000", "monday": "dow = 1", "wide_and_rising": "high - low > 50000 AND close > open"}


@query(f"{_D}, f AS (SELECT *, isodow(ts) AS dow, lead(close) OVER {_PREV} / close - 1 AS y FROM daily), "
       f"g AS ({' UNION ALL '.join(f'''SELECT '{k}' AS name, count(*) FILTER ({p}) AS n, round(avg((y > 0)::INT) FILTER ({p}), 6) AS win_rate, round(avg(y) FILTER ({p}), 6) AS mean FROM f WHERE y IS NOT NULL''' for k, p in _STACK.items())}) SELECT * FROM g")  # fmt: skip
def filter_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of several named conditions leaves and makes, in one pass."""
    d = windowed(daily(spark, sf_dir), {"y": F.lead("close").over(along()) / F.col("close") - 1}, ahead=1).where("y is not null").withColumn("dow", F.weekday("ts") + 1)
    y = F.col("y")
    one = lambda k, c: F.struct(F.lit(k).alias("name"), F.count_if(c).alias("n"), _r(F.avg(F.when(c, (y > 0).cast("int")))).alias("win_rate"), _r(F.avg(F.when(c, y))).alias("mean"))
    return d.agg(F.array(*[one(k, F.expr(p)) for k, p in _STACK.items()]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


_QUOTES = """WITH q AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_orderkey AS k, l_linenumber AS i, l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * (1 + l_tax) - 500 AS ask FROM lineitem),
s AS (SELECT *, ask - bid AS spread, date_trunc('month', ts) AS m FROM q), u AS (SELECT symbol, m, median(spread) AS usual FROM s WHERE spread > 0 GROUP BY 1, 2),
c AS (SELECT s.* FROM s LEFT JOIN u ON u.symbol = s.symbol AND u.m = s.m WHERE spread >= 0 AND NOT coalesce(spread > 3 * usual, false))"""


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid, ask = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * (1 + F.col("l_tax")) - 500
    q = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), bid.alias("bid"), ask.alias("ask"))
    return clean_quotes(q, times=3.0)


@query(f"{_QUOTES} SELECT symbol, count(*) AS n, round(min(spread), 4) AS least, round(max(spread), 4) AS most, round(avg(spread), 4) AS mean FROM c GROUP BY 1")
def crossed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left without crossed quotes and those much wider than the month's median."""
    return _quotes(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), _r(F.min("spread"), 4).alias("least"), _r(F.max("spread"), 4).alias("most"), _r(F.avg("spread"), 4).alias("mean"))


@query(f"""{_QUOTES}, b AS (SELECT *, (bid + ask) / 2 AS mid, (ts, k, i) AS o FROM c)
SELECT symbol, epoch_us(ts) // 1000000 // 86400 * 86400 AS t, round(arg_min(mid, o), 6) AS open, round(max(mid), 6) AS high, round(min(mid), 6) AS low, round(arg_max(mid, o), 6) AS close, round(arg_max(bid, o), 6) AS bid_close,
round(arg_max(ask, o), 6) AS ask_close, round(avg(spread), 6) AS spread_mean, round(median(spread), 6) AS spread_median, count(*) AS tick_count FROM b GROUP BY 1, 2""")
def two_sided_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the mid price with both sides and their spread."""
    b = quote_bars(_quotes(spark, sf_dir), "1 day", ["k", "i"])
    prices = ["open", "high", "low", "close", "bid_close", "ask_close", "spread_mean", "spread_median"]
    return b.select("symbol", secs("ts").alias("t"), *[_r(c).alias(c) for c in prices], "tick_count")


@query("""SELECT event_type AS symbol, count(*) FILTER (isodow(ts) = 7 AND hour(ts) >= 22) AS week_open, count(*) FILTER (hour(ts) IN (21, 22)) AS near_break, count(*) FILTER (isodow(ts) = 5 AND hour(ts) >= 20) AS wind_down FROM events GROUP BY 1""")
def session_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks at the open of the week, near the daily break and before the weekend."""
    day, hour = F.weekday("ts"), F.hour("ts")
    flags = {"week_open": (day == 6) & (hour >= 22), "near_break": hour.isin(21, 22), "wind_down": (day == 4) & (hour >= 20)}
    return ticks(spark, sf_dir).groupBy("symbol").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


@query(f"""{_D}, s AS (SELECT symbol, ts, CASE WHEN count(close) OVER w = 20 THEN stddev_samp(close) OVER w END AS sigma FROM daily WINDOW w AS {rows_before(20)}), q AS (SELECT quantile_cont(sigma, 0.01) AS f, quantile_cont(sigma, [1 / 3, 2 / 3]) AS c FROM s)
SELECT {_T}, round(sigma, 4) AS sigma, CASE WHEN sigma <= c[1] THEN 'low' WHEN sigma <= c[2] THEN 'mid' ELSE 'high' END AS regime FROM s, q WHERE sigma >= f""")
def volatility_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose deviation is not in the lowest hundredth of all, by terciles of all."""
    d = windowed(daily(spark, sf_dir), {"sigma": rolling_std("close", 20)}, back=19)
    floor, low, mid = exact_quantiles(d, "sigma", [0.01, 1 / 3, 2 / 3])
    regime = F.when(F.col("sigma") <= F.lit(low), "low").when(F.col("sigma") <= F.lit(mid), "mid").otherwise("high")
    return d.where(F.col("sigma") >= F.lit(floor)).select("symbol", secs("ts").alias("t"), _r("sigma", 4).alias("sigma"), regime.alias("regime"))


@query(f"{_HOURS} SELECT {_T}, coalesce(len(list_distinct(list(close) OVER w)) <= 1 AND count(*) OVER w = 6, false) AS closed FROM bars WINDOW w AS {rows_before(6)}")
def market_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six bars of one close: nothing moved."""
    w = along().rowsBetween(-5, 0)
    d = windowed(to_bars(ticks(spark, sf_dir), "1 hour"), {"closed": (F.size(F.array_distinct(F.collect_list("close").over(w))) <= 1) & (F.count("*").over(w) == 6)}, back=5)
    return d.select("symbol", secs("ts").alias("t"), "closed")


@query("""WITH b AS (SELECT date_trunc('month', min(o_orderdate)) AS a, date_trunc('month', max(o_orderdate)) AS z FROM orders)
SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS first, CAST(CAST(m + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS until FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM b)""")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open months from the first to the last day of a source."""
    day = F.col("o_orderdate").cast("date")
    b = table(spark, sf_dir, "orders").agg(F.trunc(F.min(day), "month").alias("a"), F.trunc(F.max(day), "month").alias("z"))
    m = b.select(F.explode(F.expr("sequence(a, z, interval 1 month)")).alias("m"))
    return m.select(F.col("m").cast("string").alias("first"), F.add_months("m", 1).cast("string").alias("until"))


@query("""SELECT event_id, event_type AS kind, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type IN ('purchase', 'error') AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11' ORDER BY ts, event_id LIMIT 12""")
def upcoming_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve important events of a day, both ends with it."""
    day = F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp"))
    e = ticks(spark, sf_dir).where(F.col("symbol").isin("purchase", "error") & day)
    return e.orderBy("ts", "seq").limit(12).select(F.col("seq").alias("event_id"), F.col("symbol").alias("kind"), secs("ts").alias("t"))


@query(f"""WITH {TICKS}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k FROM ticks)
SELECT symbol, count(*) AS n, round((arg_min(price, k) - avg(price)) / CASE WHEN stddev_pop(price) = 0 THEN 1 ELSE stddev_pop(price) END, 6) AS z FROM l WHERE k <= 96 GROUP BY 1""")
def tone_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last point against the last 96 (population deviation, 0 counts as 1)."""
    d = numbered(ticks(spark, sf_dir), order=("ts", "seq"), of="n").where("rn >= n - 96")
    sd = F.stddev_pop("price")
    return d.groupBy("symbol").agg(F.count("*").alias("n"), _r((F.max_by("price", "rn") - F.avg("price")) / F.when(sd == 0, 1.0).otherwise(sd)).alias("z"))


@query(f"""{_D}, n AS (SELECT *, row_number() OVER {_PREV} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM daily) SELECT {_T}, rn, close FROM n WHERE rn < 3 OR rn >= n - 3""")
def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last three rows of each series."""
    return numbered(daily(spark, sf_dir), of="n").where("rn < 3 or rn >= n - 3").select("symbol", secs("ts").alias("t"), "rn", "close")


@query("""WITH r AS (SELECT 'even' AS run, o_orderpriority AS symbol, o_custkey AS k, sum(o_totalprice) AS made FROM orders WHERE o_orderstatus = 'F' GROUP BY 2, 3 UNION ALL SELECT 'rest', o_orderpriority, o_custkey, sum(o_totalprice) FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2, 3)
SELECT run, symbol, k, round(made, 4) AS made FROM r ORDER BY made DESC, run, symbol, k LIMIT 20 OFFSET 20""")
def leaderboard_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of two runs' results, best first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus is not null").withColumn("run", F.when(F.col("o_orderstatus") == "F", "even").otherwise("rest"))
    r = o.groupBy("run", F.col("o_orderpriority").alias("symbol"), F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("made"))
    return r.orderBy(F.desc("made"), "run", "symbol", "k").offset(20).limit(20).withColumn("made", _r("made", 4))


@query("""WITH o AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_orderkey AS k, o_orderstatus = 'F' AS won FROM orders), n AS (SELECT *, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts, k)),
l AS (SELECT *, rn - 1 - coalesce(max(CASE WHEN won THEN rn END) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM n),
m AS (SELECT *, least(16.0, pow(2, lost)) AS lots FROM l), e AS (SELECT *, 100 + sum(lots * CASE WHEN won THEN 2.0 ELSE -1.0 END) OVER (PARTITION BY symbol ORDER BY rn) AS equity FROM m),
x AS (SELECT *, min(equity) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM e)
SELECT symbol, k, lots::DOUBLE AS lots, equity::DOUBLE AS equity FROM x WHERE low IS NULL OR low > 0""")
def martingale_stakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes that double after losses, until ruin."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("won"))
    return martingale(o, "won", ("ts", "k")).select("symbol", "k", "lots", "equity")


_SWEEP = (0.25, 0.5, 1.0, 1.5)


@query(f"{_MOVES}, g AS ({' UNION ALL '.join(f'SELECT {t}::DOUBLE AS least, round(avg((abs(move_sd) >= {t})::INT), 6) AS coverage, round(avg((rev > 0)::INT) FILTER (abs(move_sd) >= {t}), 6) AS hit FROM m WHERE move_sd IS NOT NULL AND rev IS NOT NULL' for t in _SWEEP)}) SELECT * FROM g")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each threshold covers, and how often it is right, in one pass."""
    m = _moves(spark, sf_dir).where("move_sd is not null and rev is not null")
    right = (F.col("rev") > 0).cast("int")
    lines = [F.struct(F.lit(t).alias("least"), _r(F.avg((F.abs("move_sd") >= t).cast("int"))).alias("coverage"), _r(F.avg(F.when(F.abs("move_sd") >= t, right))).alias("hit")) for t in _SWEEP]
    return m.agg(F.array(*lines).alias("a")).select(F.explode("a").alias("x")).select("x.*")
