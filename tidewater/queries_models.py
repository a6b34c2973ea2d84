"""Queries over resampled intervals and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.models import auc_by, fit_boosted, fit_logistic, fit_ridge, permutation_importance
from .functions.resample import block_bootstrap_effect, drawn_sql, merged_ledger, monte_carlo, poisson_at_least
from .functions.stats import stratified_effect
from .registry import query
from .sources.market import table

_ROUNDS = 40
#: Orders of weekends beside those of other days, by priority, within years; blocks of four orders.
_BLOCKS = f"""o AS (SELECT o_orderpriority AS anchor, year(o_orderdate) AS y, isodow(o_orderdate) >= 6 AS one, o_totalprice AS x, o_orderkey AS id, o_orderdate AS ts FROM orders),
g AS (SELECT anchor, y, count(*) FILTER (one) AS n1, count(*) FILTER (NOT one) AS n0, avg(x) FILTER (one) AS m1, avg(x) FILTER (NOT one) AS m0, var_samp(x) FILTER (one) AS v1, var_samp(x) FILTER (NOT one) AS v0 FROM o GROUP BY 1, 2 HAVING count(*) FILTER (one) >= 5 AND count(*) FILTER (NOT one) >= 5),
r AS (SELECT o.*, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY anchor, y, one) AS n, sum(x) OVER (PARTITION BY anchor, y, one ORDER BY ts, id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s4 FROM o JOIN g USING (anchor, y) WINDOW w AS (PARTITION BY anchor, y, one ORDER BY ts, id)),
b AS (SELECT anchor, y, one, id, CASE WHEN n > 4 THEN s4 ELSE x END AS s, CASE WHEN n > 4 THEN 4 ELSE 1 END AS l, rn, n FROM r),
d AS (SELECT anchor, y, one, round, s, l, n / (l * (n - l + 1)) AS rate, {drawn_sql('id', 'round', 7)} AS u FROM b, range(1, {_ROUNDS + 1}) t(round) WHERE rn <= n - l),
k AS (SELECT anchor, y, one, round, sum(k * s) AS total, sum(k * l) AS weight FROM (SELECT *, {poisson_at_least('u', 'rate')} AS k FROM d) GROUP BY 1, 2, 3, 4),
p AS (SELECT anchor, y, round, sum(total) FILTER (one) / nullif(sum(weight) FILTER (one), 0) - sum(total) FILTER (NOT one) / nullif(sum(weight) FILTER (NOT one), 0) AS diff FROM k GROUP BY 1, 2, 3),
e AS (SELECT anchor, round, sum(n1 * diff) / sum(n1) AS e FROM p JOIN g USING (anchor, y) GROUP BY 1, 2 HAVING count(diff) = count(*)),
boot AS (SELECT anchor, stddev_samp(e) AS se, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.975) AS hi, count(*) AS rounds FROM e GROUP BY 1),
point AS (SELECT anchor, sum(n1 * (m1 - m0)) / sum(n1) AS effect, count(*) AS n_strata, sum(n1)::BIGINT AS n_chosen, sqrt(sum(n1 * n1 * (v1 / n1 + v0 / n0))) / sum(n1) AS se FROM g GROUP BY 1)"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("anchor"), F.year(ts).alias("y"), (F.weekday(ts) >= 5).alias("one"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("id"), ts.alias("ts"))


def _boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_bootstrap_effect(_orders(spark, sf_dir), ["anchor"], ["y"], "one", "x", "id", 4, _ROUNDS, order=("ts", "id"))


@query(f"WITH {_BLOCKS} SELECT anchor, round(effect, 4) AS effect, round(boot.se, 4) AS se, round(lo, 4) AS lo, round(hi, 4) AS hi, n_strata, n_chosen, rounds FROM point LEFT JOIN boot USING (anchor)")
def block_bootstrap_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect of weekends with moving-block errors; the draws are hashes, so SQL makes the same."""
    r = lambda c: F.round(c, 4).alias(c)
    return _boot(spark, sf_dir).select("anchor", r("effect"), r("se"), r("lo"), r("hi"), "n_strata", "n_chosen", "rounds")


_KEYS = ["state", "anchor", "bucket", "h", "metric"]


@query(f"WITH {_BLOCKS} SELECT 'weekend' AS state, anchor, 1 AS bucket, 4 AS h, 'price' AS metric, round(effect, 4) AS effect, round(point.se, 4) AS se, round(boot.se, 4) AS se_boot FROM point LEFT JOIN boot USING (anchor)")
def ledger_with_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects and their analytic errors, joined with resampled ones on the five keys of a cell."""
    keyed = lambda df: df.withColumns({"state": F.lit("weekend"), "bucket": F.lit(1), "h": F.lit(4), "metric": F.lit("price")})
    o = _orders(spark, sf_dir)
    sizes = o.groupBy("anchor", "y").agg(F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n0")).where("n1 >= 5 and n0 >= 5")
    ledger = keyed(stratified_effect(o.join(sizes.select("anchor", "y"), ["anchor", "y"]), ["anchor"], ["y"], "one", "x"))
    both = merged_ledger(ledger, keyed(_boot(spark, sf_dir)), _KEYS)
    return both.select(*_KEYS, *[F.round(c, 4).alias(c) for c in ("effect", "se", "se_boot")])


@query(f"""WITH t AS (SELECT o_orderpriority AS symbol, o_totalprice - 150000 AS net_pnl, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
s AS (SELECT symbol, n, rn AS slot, round, CAST(floor({drawn_sql('rn', 'round', 0)} * n) AS BIGINT) AS rn FROM t, range(1, 21) r(round)),
p AS (SELECT s.symbol, round, slot, 1e8 + sum(net_pnl) OVER (PARTITION BY s.symbol, round ORDER BY slot) AS e FROM s JOIN t USING (symbol, rn)),
q AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol, round ORDER BY slot), 1e8) AS top FROM p),
f AS (SELECT symbol, round, arg_max(e, slot) AS final, -min(e / top - 1) * 100 AS fall FROM q GROUP BY 1, 2)
SELECT symbol, round(quantile_cont(final, 0.05), 4) AS final_p05, round(quantile_cont(final, 0.5), 4) AS final_p50, round(quantile_cont(final, 0.95), 4) AS final_p95, round(avg((final > 1e8)::INT), 4) AS prob_profit,
 round(quantile_cont(fall, 0.5), 4) AS fall_p50, round(quantile_cont(fall, 0.95), 4) AS fall_p95, count(*) AS rounds FROM f GROUP BY 1""")
def monte_carlo_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades drawn anew in twenty rounds: final equity and drawdown."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), (F.col("o_totalprice") - 150000).alias("net_pnl"), F.col("o_orderdate").cast("timestamp").alias("exit_ts"), F.col("o_orderkey").alias("entry_i"))
    m = monte_carlo(o, rounds=20, equity=1e8)
    return m.select("symbol", *[F.round(c, 4).alias(c) for c in ("final_p05", "final_p50", "final_p95", "prob_profit", "fall_p50", "fall_p95")], "rounds")


@query("""WITH m AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_discount) AS m2, stddev_pop(l_discount) AS s2 FROM lineitem),
z AS (SELECT (l_quantity - m1) / s1 AS a, (l_discount - m2) / s2 AS b, l_extendedprice AS y FROM lineitem, m),
s AS (SELECT count(*) AS n, sum(a * a) - sum(a) ** 2 / count(*) + 2 AS aa, sum(b * b) - sum(b) ** 2 / count(*) + 2 AS bb, sum(a * b) - sum(a) * sum(b) / count(*) AS ab, sum(a * y) - sum(a) * sum(y) / count(*) AS ay, sum(b * y) - sum(b) * sum(y) / count(*) AS by_, avg(y) AS y, avg(a) AS a, avg(b) AS b FROM z),
w AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb, y, a, b FROM s)
SELECT 'l_quantity' AS feature, round(wa, 4) AS coef FROM w UNION ALL SELECT 'l_discount', round(wb, 4) FROM w UNION ALL SELECT '', round(y - wa * a - wb * b, 4) FROM w""")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of two standardised features under a squared penalty, and the intercept."""
    m = fit_ridge(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([*zip(m.cols, m.coef), ("", m.intercept)], "feature string, coef double").select("feature", F.round("coef", 4).alias("coef"))


@query("""WITH RECURSIVE m AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1 FROM lineitem),
x AS MATERIALIZED (SELECT x, t, count(*) AS n FROM (SELECT (l_quantity - m1) / s1 AS x, (l_returnflag = 'R')::INT AS t FROM lineitem, m) GROUP BY 1, 2),
f AS (SELECT 0 AS k, 0.0::DOUBLE AS b, 0.0::DOUBLE AS w UNION ALL
SELECT k + 1, b - (hww * gb - hbw * gw) / (hbb * hww - hbw * hbw), w - (hbb * gw - hbw * gb) / (hbb * hww - hbw * hbw) FROM (
 SELECT k, b, w, 0.5 * sum(n * (p - t)) AS gb, 0.5 * sum(n * (p - t) * x) + w AS gw, 0.5 * sum(n * p * (1 - p)) AS hbb, 0.5 * sum(n * p * (1 - p) * x) AS hbw, 0.5 * sum(n * p * (1 - p) * x * x) + 1 AS hww
 FROM (SELECT k, b, w, x, t, n, 1 / (1 + exp(-b - w * x)) AS p FROM f, x WHERE k < 12) GROUP BY k, b, w))
SELECT 'l_quantity' AS feature, round(w, 6) AS coef FROM f WHERE k = 12 UNION ALL SELECT '', round(b, 6) FROM f WHERE k = 12""")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression of returned lines on quantity; twelve steps of Newton's method in SQL."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("double").alias("t"))
    m = fit_logistic(rows, ["l_quantity"], "t")
    return spark.createDataFrame([*zip(m.cols, m.coef), ("", m.intercept)], "feature string, coef double").select("feature", F.round("coef", 6).alias("coef"))


_AUC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH l AS (UNPIVOT (SELECT l_returnflag, (l_linestatus = 'O')::INT AS t, {', '.join(_AUC)} FROM lineitem) ON {', '.join(_AUC)} INTO NAME feature VALUE x),
r AS (SELECT *, rank() OVER (PARTITION BY feature, l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY feature, l_returnflag, x) - 1) / 2.0 AS r FROM l)
SELECT feature, l_returnflag AS flag, count(*) AS n, round((sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2.0) / nullif(sum(t) * (count(*) - sum(t)), 0), 6) AS auc FROM r GROUP BY 1, 2""")
def auc_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each column alone ranks open lines, within flags; null where only one label is there."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "O").cast("int").alias("t"), *_AUC)
    long = rows.unpivot(["flag", "t"], list(_AUC), "feature", "x")
    return auc_by(long, ["feature", "flag"], "x", "t").select("feature", "flag", "n", F.round("auc", 6).alias("auc"))


@query()
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees for returned lines, a tenth of quantities missing, and what each feature adds to their AUC."""
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("t", (F.col("l_returnflag") == "R").cast("int"))
    rows = rows.withColumn("shipped", F.unix_date(F.to_date("l_shipdate"))).withColumn("l_quantity", F.when(F.pmod(F.xxhash64("id"), F.lit(10)) > 0, F.col("l_quantity")))
    cols = ["l_quantity", "l_extendedprice", "l_discount", "shipped"]
    m = fit_boosted(rows, cols, "t", "id", trees=6)
    return permutation_importance(rows, m.probability(), cols, "t", "id", repeats=1).select("feature", F.round("importance", 4).alias("importance"))
