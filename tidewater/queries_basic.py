"""Queries over sources, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.asof import asof_join, interval_join
from .operators.ordered import numbered, windowed, along
from .operators.resample import minute_last, row_buckets, to_bars, to_larger_bars, weekly_last
from .registry import DAILY, TICKS, bars_sql, query, r4, secs
from .sources.market import daily, load_bars, side, split_of, table, ticks


@query(f"WITH {TICKS}, {bars_sql('1 hour')} SELECT symbol, epoch_us(ts) // 1000000 AS t, open, high, low, close, tick_count, round(price_mean, 4) AS price_mean, round(price_median, 4) AS price_median, last_seq FROM bars")
def bars_ohlc_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = to_bars(ticks(spark, sf_dir), "1 hour")
    return b.select("symbol", secs("ts").alias("t"), "open", "high", "low", "close", "tick_count", r4("price_mean").alias("price_mean"), r4("price_median").alias("price_median"), "last_seq")


@query(f"WITH {DAILY} SELECT symbol, epoch_us(ts) // 1000000 AS t, open, high, low, close, round(volume, 4) AS volume, ticks FROM daily")
def bars_daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily(spark, sf_dir).select("symbol", secs("ts").alias("t"), "open", "high", "low", "close", r4("volume").alias("volume"), "ticks")


@query(f"""WITH {TICKS}, {bars_sql('1 hour')} SELECT symbol, epoch_us(time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '1970-01-01')) // 1000000 AS t, arg_min(open, ts) AS open, max(high) AS high,
 min(low) AS low, arg_max(close, ts) AS close, CAST(sum(tick_count) AS BIGINT) AS tick_count FROM bars GROUP BY 1, 2""")
def bars_htf_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = to_larger_bars(to_bars(ticks(spark, sf_dir), "1 hour"), "4 hours")
    return b.select("symbol", secs("ts").alias("t"), "open", "high", "low", "close", "tick_count")


@query(f"WITH {TICKS} SELECT symbol, time_ms // 60000 AS minute, arg_max(price, (time_ms, seq)) AS price FROM ticks GROUP BY 1, 2")
def minute_last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minute_last(ticks(spark, sf_dir))


@query(f"WITH {DAILY} SELECT symbol, CAST(CAST(ts AS DATE) + CAST((12 - dayofweek(ts)) % 7 AS INTEGER) AS VARCHAR) AS week, arg_max(close, ts) AS close FROM daily GROUP BY 1, 2")
def weekly_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly_last(daily(spark, sf_dir), "close", F.to_date("ts"))
    return w.select("symbol", F.col("week").cast("string").alias("week"), "close")


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn FROM daily)
SELECT symbol, rn // 50 AS k, min(epoch_us(ts) // 1000000) AS t, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, count(*) AS rows FROM n GROUP BY 1, 2""")
def downsample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = row_buckets(numbered(daily(spark, sf_dir)), 50)
    return b.select("symbol", "k", secs("ts").alias("t"), "open", "high", "low", "close", "rows")


# --- as-of and interval joins ---------------------------------------------------------------------------------------

_SIDES = f"{TICKS}, bid AS (SELECT * FROM ticks WHERE symbol = 'view'), ask AS (SELECT * FROM ticks WHERE symbol = 'click')"


def _pairs(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    t = ticks(spark, sf_dir)
    bid, ask = side(t, "view").select("seq", "ts", "price"), side(t, "click").select("seq", "ts", "price")
    out = asof_join(bid, ask, "ts", tie="seq", **options)
    return out.select("seq", "price", F.col("r_seq").alias("ask_seq"), F.col("r_price").alias("ask"), r4(F.col("r_price") - F.col("price")).alias("spread"))


_LAST = "(SELECT a.ts, max(a.seq) AS seq, arg_max(a.price, a.seq) AS price FROM ask a GROUP BY a.ts)"
_FIRST = "(SELECT a.ts, min(a.seq) AS seq, arg_min(a.price, a.seq) AS price FROM ask a GROUP BY a.ts)"


@query(f"WITH {_SIDES} SELECT b.seq, b.price, a.seq AS ask_seq, a.price AS ask, round(a.price - b.price, 4) AS spread FROM bid b ASOF LEFT JOIN {_LAST} a ON b.ts >= a.ts")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {_SIDES} SELECT b.seq, b.price, a.seq AS ask_seq, a.price AS ask, round(a.price - b.price, 4) AS spread FROM bid b ASOF LEFT JOIN {_FIRST} a ON b.ts <= a.ts")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, direction="forward")


@query(f"""WITH {_SIDES}, k AS (SELECT b.seq, b.price, b.ts, p.seq AS ps, p.price AS pp, p.ts AS pt, f.seq AS fs, f.price AS fp, f.ts AS ft
 FROM bid b ASOF LEFT JOIN {_LAST} p ON b.ts >= p.ts ASOF LEFT JOIN {_FIRST} f ON b.ts <= f.ts),
m AS (SELECT *, ft IS NULL OR (pt IS NOT NULL AND epoch_us(ts) - epoch_us(pt) <= epoch_us(ft) - epoch_us(ts)) AS back FROM k),
x AS (SELECT seq, price, CASE WHEN back THEN ps ELSE fs END AS s, CASE WHEN back THEN pp ELSE fp END AS p, CASE WHEN back THEN epoch_us(ts) - epoch_us(pt) ELSE epoch_us(ft) - epoch_us(ts) END AS gap FROM m)
SELECT seq, price, CASE WHEN gap <= 300000000 THEN s END AS ask_seq, CASE WHEN gap <= 300000000 THEN p END AS ask, CASE WHEN gap <= 300000000 THEN round(p - price, 4) END AS spread FROM x""")
def asof_nearest_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, direction="nearest", tolerance=300)


@query(f"""WITH {TICKS}, {bars_sql('1 hour', 'h')}, c AS (SELECT symbol, ts + INTERVAL 1 HOUR AS closed, close FROM h)
SELECT t.symbol, t.seq, t.price, c.close AS htf_close, epoch_us(c.closed) // 1000000 AS htf_t FROM ticks t ASOF LEFT JOIN c ON t.symbol = c.symbol AND t.ts >= c.closed""")
def htf_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hourly bar that had closed at each tick."""
    t = ticks(spark, sf_dir)
    closed = to_bars(t, "1 hour").select("symbol", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("closed"), "close")
    out = asof_join(t, closed, "ts", "closed", by=["symbol"])
    return out.select("symbol", "seq", "price", F.col("r_close").alias("htf_close"), secs("r_closed").alias("htf_t"))


_EVENTS = f"{TICKS}, ev AS (SELECT DISTINCT ts AS at FROM ticks WHERE symbol = 'signup'), q AS (SELECT seq, ts FROM ticks WHERE symbol = 'purchase')"


@query(f"""WITH {_EVENTS} SELECT q.seq, least(coalesce((epoch_us(n.at) - epoch_us(q.ts)) / 60000000.0, 1e6), 1440)::DOUBLE AS to_next, least(coalesce((epoch_us(q.ts) - epoch_us(p.at)) / 60000000.0, 1e6), 1440)::DOUBLE AS from_prev
FROM q ASOF LEFT JOIN ev n ON q.ts <= n.at ASOF LEFT JOIN ev p ON q.ts > p.at""")
def event_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes to the next event (its own time included) and from the previous one, a day at most."""
    t = ticks(spark, sf_dir)
    events, q = side(t, "signup").select(F.col("ts").alias("at")).distinct(), side(t, "purchase").select("seq", "ts")
    both = asof_join(q, events, "ts", "at", direction="forward", prefix="n_")
    both = asof_join(both, events, "ts", "at", strict=True, prefix="p_")
    minutes = lambda a, b: F.least(F.coalesce((F.unix_micros(a) - F.unix_micros(b)) / 60_000_000, F.lit(1e6)), F.lit(1440.0))
    return both.select("seq", minutes("n_at", "ts").alias("to_next"), minutes("ts", "p_at").alias("from_prev"))


@query(f"""WITH {_EVENTS}, x AS (SELECT q.seq, (epoch_us(n.at) - epoch_us(q.ts)) / 60000000.0 AS dn, (epoch_us(q.ts) - epoch_us(p.at)) / 60000000.0 AS dp FROM q ASOF LEFT JOIN ev n ON q.ts <= n.at ASOF LEFT JOIN ev p ON q.ts > p.at)
SELECT seq, CASE WHEN dp IS NULL OR dn <= dp THEN -dn ELSE dp END::DOUBLE AS signed FROM x""")
def event_signed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    events, q = side(t, "signup").select(F.col("ts").alias("at")).distinct(), side(t, "purchase").select("seq", "ts")
    both = asof_join(asof_join(q, events, "ts", "at", direction="forward", prefix="n_"), events, "ts", "at", strict=True, prefix="p_")
    dn, dp = (F.unix_micros("n_at") - F.unix_micros("ts")) / 60_000_000, (F.unix_micros("ts") - F.unix_micros("p_at")) / 60_000_000
    return both.select("seq", F.when(dp.isNull() | (dn <= dp), -dn).otherwise(dp).alias("signed"))


@query(f"""WITH {TICKS} SELECT a.symbol, a.seq FROM ticks a WHERE a.symbol <> 'signup' AND EXISTS (SELECT 1 FROM ticks e WHERE e.symbol = 'signup' AND a.ts >= e.ts - INTERVAL 15 MINUTE AND a.ts < e.ts + INTERVAL 15 MINUTE)""")
def blackout_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks within a quarter of an hour of an event: a semi join in time buckets."""
    t = ticks(spark, sf_dir)
    quarter = F.expr("INTERVAL 15 MINUTES")
    spans = side(t, "signup").select((F.col("ts") - quarter).alias("lo"), (F.col("ts") + quarter).alias("hi"))
    return interval_join(t.where("symbol <> 'signup'"), "ts", spans, "lo", "hi", 900, "left_semi").select("symbol", "seq")


@query(f"""WITH {TICKS}, {bars_sql('15 minutes')} SELECT b.symbol, epoch_us(b.ts) // 1000000 AS t, e.seq FROM bars b JOIN (SELECT seq, ts FROM ticks WHERE symbol = 'signup') e ON e.ts >= b.ts AND e.ts < b.ts + INTERVAL 15 MINUTE WHERE b.symbol = 'purchase'""")
def interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that hold an event: an equi-join on the event's bucket with bars that exist."""
    t = ticks(spark, sf_dir)
    bars = to_bars(side(t, "purchase"), "15 minutes").select("symbol", "ts")
    events = side(t, "signup").select(F.window("ts", "15 minutes").start.alias("ts"), "seq")
    return bars.join(events, "ts").select("symbol", secs("ts").alias("t"), "seq")


# --- cleaning -------------------------------------------------------------------------------------------------------

_MONTH = "date_trunc('month', ts)"


@query(f"""WITH {TICKS}, m AS (SELECT *, median(price) OVER (PARTITION BY symbol, date_trunc('day', ts)) AS med FROM ticks),
bad AS (SELECT DISTINCT ts FROM m WHERE price > 3 * med) SELECT symbol, seq, price FROM ticks WHERE ts NOT IN (SELECT ts FROM bad)""")
def anti_bad_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which any side is absurd (over three medians of its day) go from all sides."""
    t = ticks(spark, sf_dir)
    day = F.date_trunc("day", "ts")
    med = t.groupBy("symbol", day.alias("day")).agg(F.median("price").alias("med"))
    bad = t.withColumn("day", day).join(med, ["symbol", "day"]).where("price > 3 * med").select("ts").distinct()
    return t.join(bad, "ts", "left_anti").select("symbol", "seq", "price")


@query(f"""WITH {TICKS}, p AS (SELECT *, lag(price) OVER w AS prev, list(price) OVER (PARTITION BY symbol, {_MONTH} ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS nxt, count(*) OVER (PARTITION BY symbol, {_MONTH}) AS n
 FROM ticks WHERE price > 1.0 WINDOW w AS (PARTITION BY symbol, {_MONTH} ORDER BY ts, seq))
SELECT symbol, seq, price FROM p WHERE n < 3 OR prev IS NULL OR NOT (abs(ln(price / prev)) > 0.5 AND list_min(list_transform(nxt, lambda x: abs(ln(x / prev)))) <= 0.5)""")
def despike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps that return within five ticks go; months are looked at on their own."""
    t = ticks(spark, sf_dir).where("price > 1.0").withColumn("month", F.date_trunc("month", "ts"))
    w = Window.partitionBy("symbol", "month").orderBy("ts", "seq")
    t = t.withColumn("prev", F.lag("price").over(w)).withColumn("nxt", F.collect_list("price").over(w.rowsBetween(0, 5)))
    t = t.withColumn("n", F.count("*").over(Window.partitionBy("symbol", "month")))
    back = F.array_min(F.transform("nxt", lambda x: F.abs(F.log(x / F.col("prev"))))) <= 0.5
    spike = (F.abs(F.log(F.col("price") / F.col("prev"))) > 0.5) & back
    return t.where((F.col("n") < 3) | F.col("prev").isNull() | ~spike).select("symbol", "seq", "price")


@query(f"WITH {TICKS} SELECT symbol, epoch_us(date_trunc('hour', ts)) // 1000000 AS t, max(seq) AS seq, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, the last to come in."""
    hour = secs(F.date_trunc("hour", "ts"))
    return ticks(spark, sf_dir).groupBy("symbol", hour.alias("t")).agg(F.max("seq").alias("seq"), F.max_by("price", "seq").alias("price"))


@query("SELECT DISTINCT user_id, event_type, CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS day FROM events")
def dedupe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return e.dropDuplicates(["user_id", "event_type", "day"])


# --- splits, unions, sets -------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN ts >= '1995-01-01' AND ts < '1999-01-01' THEN 'in_sample' WHEN ts >= '1999-01-01' AND ts < '2000-01-01' THEN 'walk_forward' WHEN ts >= '2000-01-01' AND ts < '2002-01-01' THEN 'out_of_sample' END"


@query(f"WITH {DAILY} SELECT symbol, {_SPLIT} AS split, count(*) AS n, round(avg(close), 4) AS mean_close FROM daily GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir).withColumn("split", split_of(F.col("ts")))
    return d.groupBy("symbol", "split").agg(F.count("*").alias("n"), r4(F.avg("close")).alias("mean_close"))


@query(f"WITH {DAILY} SELECT symbol, epoch_us(ts) // 1000000 AS t, close FROM daily WHERE ts >= '1997-06-01' AND ts < '1999-01-01'")
def load_split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bars(daily(spark, sf_dir), "in_sample", start="1997-06-01").select("symbol", secs("ts").alias("t"), "close")


@query(f"WITH {DAILY} SELECT 'in_sample' AS split, symbol, epoch_us(ts) // 1000000 AS t, close FROM daily WHERE ts >= '1995-01-01' AND ts < '1999-01-01' UNION ALL SELECT 'walk_forward', symbol, epoch_us(ts) // 1000000, close FROM daily WHERE ts >= '1999-01-01' AND ts < '2000-01-01'")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    parts = [load_bars(d, s).withColumn("split", F.lit(s)) for s in ("in_sample", "walk_forward")]
    return parts[0].unionByName(parts[1]).select("split", "symbol", secs("ts").alias("t"), "close")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def set_diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'view'").select("user_id").subtract(e.where("event_type = 'purchase' AND value > 100").select("user_id"))


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'signup'").select("user_id").intersect(e.where("event_type = 'purchase'").select("user_id"))


@query("""WITH old AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < '1998-01-01'), new AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderdate >= '1997-06-01')
SELECT o_orderkey, round(coalesce(n.o_totalprice, o.o_totalprice), 4) AS price FROM old o FULL JOIN new n USING (o_orderkey)""")
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed merge: a union in which the newer source wins."""
    from .sources.sinks import upsert

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    old = o.where("o_orderdate < '1998-01-01'").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = o.where("o_orderdate >= '1997-06-01'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    return upsert(old, new, ["o_orderkey"]).select("o_orderkey", r4("price").alias("price"))


# --- quality reports ------------------------------------------------------------------------------------------------


@query(f"""WITH {TICKS}, h AS (SELECT hour(ts) AS hour, count(*) AS n FROM ticks WHERE symbol = 'purchase' GROUP BY 1)
SELECT CAST(r.hour AS INTEGER) AS hour, coalesce(n, 0) AS n FROM range(24) r(hour) LEFT JOIN h ON h.hour = r.hour""")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = side(ticks(spark, sf_dir), "purchase").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(seen, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {TICKS}, g AS (SELECT symbol, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq))) / 60000000.0 AS gap FROM ticks)
SELECT symbol, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) FILTER (gap >= 60 AND gap <= 240) AS outages, count(*) FILTER (gap > 240) AS long_gaps, round(max(gap), 4)::DOUBLE AS worst FROM g GROUP BY 1""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = windowed(ticks(spark, sf_dir), {"_before": F.lag("ts").over(along())}, back=1, order=("ts", "seq"))
    gap = (F.unix_micros("ts") - F.unix_micros("_before")) / 60_000_000
    g = t.withColumn("gap", gap).groupBy("symbol")
    return g.agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_if(F.col("gap").between(60, 240)).alias("outages"), F.count_if(F.expr("gap > 240")).alias("long_gaps"), r4(F.max("gap")).alias("worst"))


@query("SELECT l_returnflag, year(l_shipdate) AS y, round(median(l_discount), 4) AS med, round(avg(l_extendedprice), 2) AS mean, round(quantile_cont(l_quantity, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY 1, 2")
def spread_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").cast("long").alias("y"))
    return g.agg(r4(F.median("l_discount")).alias("med"), F.round(F.avg("l_extendedprice"), 2).alias("mean"), r4(F.percentile("l_quantity", F.lit(0.9))).alias("p90"), F.count("*").alias("n"))


@query("SELECT y, q AS mode_quantity FROM (SELECT year(l_shipdate) AS y, l_quantity AS q, row_number() OVER (PARTITION BY year(l_shipdate) ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def mode_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("y"))
    return g.agg(F.mode("l_quantity", deterministic=True).alias("mode_quantity"))


@query(f"""WITH {TICKS}, s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS f FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)),
k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, seq) AS sid FROM s)
SELECT user_id, epoch_us(min(ts)) // 1000000 AS t, count(*) AS n, round(sum(price), 4) AS total FROM k GROUP BY user_id, sid""")
def session_window_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ticks(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("s"))
    return s.agg(F.min("ts").alias("ts"), F.count("*").alias("n"), r4(F.sum("price")).alias("total")).select("user_id", secs("ts").alias("t"), "n", "total")


@query("""SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), r4(F.sum("value")).alias("total"))


# --- slices ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(o_totalprice), 2) AS expectancy FROM orders GROUP BY 1""")
def slice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority")
    return o.agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_totalprice") > 200000).cast("double")), 6).alias("win_rate"), F.round(F.avg("o_totalprice"), 2).alias("expectancy"))


@query("""SELECT o_orderpriority, round(avg(hit) FILTER (o_orderstatus = 'F'), 6) AS "F", round(avg(hit) FILTER (o_orderstatus = 'O'), 6) AS "O", round(avg(hit) FILTER (o_orderstatus = 'P'), 6) AS "P"
FROM (SELECT *, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END AS hit FROM orders) GROUP BY 1""")
def pivot_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("hit", (F.col("o_totalprice") > 200000).cast("double"))
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("hit"), 6))


@query("""SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())""")
def grouping_sets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "o_totalprice")
    sets = o.groupingSets([["priority"], ["status"], ["priority", "status"], []], "priority", "status")
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query(f"""WITH {DAILY}, e AS (SELECT unnest(['in_sample', 'walk_forward', 'nowhere']) AS s, unnest([DATE '1995-01-01', DATE '1999-01-01', DATE '2030-01-01']) AS lo, unnest([DATE '1999-01-01', DATE '2000-01-01', DATE '2031-01-01']) AS hi)
SELECT s AS split, count(ts) AS rows, CASE WHEN count(ts) > 100 THEN 'OK' ELSE 'MISMATCH' END AS verdict FROM e LEFT JOIN daily ON ts >= lo AND ts < hi GROUP BY s""")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of each part against what is expected of it."""
    from .sources.sinks import reconcile

    counts = daily(spark, sf_dir).select(split_of(F.col("ts")).alias("split")).groupBy("split").agg(F.count("*").alias("rows"))
    expected = spark.createDataFrame([("in_sample", 100), ("walk_forward", 100), ("nowhere", 100)], "split string, at_least long")
    return reconcile(expected, counts, "split").select("split", "rows", "verdict")
