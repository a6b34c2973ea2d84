"""Queries over a signal on paper: its book, its verdict and its state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.resample import drawn_sql, poisson_at_least
from .operators.resample import to_bars
from .operators.ordered import same_series
from .plans.impulses import once, quiet_days
from .plans.lead import lead_book, lead_status, verdicts, with_regime
from .queries_trades import _QUIET
from .queries_windows import _ewm_sql
from .registry import query, r4, secs
from .sources.market import ticks

_BOOKS, _FLOOR, _LOOKBACK, _GAP = {"short": 8, "long": 24}, 60.0, 24, 8
_LEAD = _QUIET.replace(
    "b AS MATERIALIZED", f"tq AS (SELECT symbol, ts, greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS tr FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)), {_ewm_sql('tr', '(1.0 / 14)', 'tq', 'ax')},\nb AS MATERIALIZED", 1
).replace("FROM b WHERE quiet AND", f"FROM b JOIN ax USING (symbol, ts) WHERE y >= {_FLOOR} AND quiet AND", 1)
_BOOK = f"""{_LEAD}, sg AS (SELECT symbol, rn, 1 AS side FROM u WHERE rn IS NOT NULL UNION ALL SELECT symbol, rn, -1 FROM v WHERE rn IS NOT NULL),
bk AS MATERIALIZED (SELECT b.symbol, b.rn, b.ts, b.last_seq, side, y AS atr, b.entry, book, x.close AS out, side * (x.close - b.entry) / y AS gross FROM sg JOIN b USING (symbol, rn) JOIN ax ON ax.symbol = b.symbol AND ax.ts = b.ts, (VALUES {', '.join(f"('{n}', {h})" for n, h in _BOOKS.items())}) k(book, h) LEFT JOIN b x ON x.symbol = b.symbol AND x.rn = b.rn + h)"""


def _regime(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = once(to_bars(ticks(spark, sf_dir), "1 hour"))
    days = bars.groupBy("symbol", F.to_date("ts").cast("timestamp").alias("ts")).agg(F.max_by("close", F.col("ts")).alias("close"))
    quiet = once(quiet_days(days, 5, 5))
    return with_regime(bars, quiet), quiet


def _book(regime: DataFrame) -> DataFrame:
    return once(lead_book(regime, _BOOKS, _FLOOR, 0.3, _LOOKBACK, _GAP))


@query(f"{_BOOK} SELECT symbol, rn, side, book, CASE WHEN out IS NULL THEN 'open' ELSE 'resolved' END AS status, round(atr, 4) AS atr, round(entry, 4) AS entry, round(out, 4) AS exit, round(gross, 4) AS gross, round(gross - 0.3, 4) AS net FROM bk")
def lead_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New extremes on quiet days, held for two times."""
    b = _book(_regime(spark, sf_dir)[0])
    return b.select("symbol", "rn", "side", "book", "status", *[r4(c).alias(c) for c in ("atr", "entry", "exit", "gross", "net")])


@query(f"""{_BOOK}, dn AS (SELECT *, gross - 0.3 AS net FROM bk), dk AS (SELECT book, round, net, {poisson_at_least('u', '1.0')} AS k FROM (SELECT *, {drawn_sql('last_seq', 'round', 7)} AS u FROM dn, range(1, 201) t(round) WHERE net IS NOT NULL)),
dm AS (SELECT book, round, sum(k * net) / nullif(sum(k), 0) AS m FROM dk GROUP BY 1, 2), di AS (SELECT book, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM dm GROUP BY 1), dg AS (SELECT book, count(net) AS n, count(*) - count(net) AS n_open, avg(net) AS mean, avg((net > 0)::INT) AS won FROM dn GROUP BY 1),
dz AS (SELECT book, n, n_open, mean, won, CASE WHEN n >= 10 THEN lo END AS lo, CASE WHEN n >= 10 THEN hi END AS hi FROM dg LEFT JOIN di USING (book))
SELECT book, n, n_open, round(mean, 4) AS mean_net, round(won, 4) AS won, round(lo, 4) AS lo, round(hi, 4) AS hi, CASE WHEN n < 40 THEN 'FEW' WHEN mean >= 0.05 AND lo > 0 THEN 'PASS' WHEN mean <= 0 AND hi < 0.1 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM dz""")
def lead_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean result of each book with an interval, and what it amounts to."""
    regime, _ = _regime(spark, sf_dir)
    b = same_series(_book(regime), regime.select("symbol", "rn", "last_seq"), ["symbol", "rn"])
    v = verdicts(b, "last_seq", rounds=200, enough=40)
    return v.select("book", "n", "n_open", *[r4(c).alias(c) for c in ("mean_net", "won", "lo", "hi")], "verdict")


@query(f"""{_BOOK.replace("AS quiet FROM dq)", "AS quiet, lag(CASE WHEN before >= 5 - 1 AND rv IS NOT NULL THEN (SELECT count(*) FROM dv e WHERE e.symbol = dq.symbol AND e.day < dq.day AND e.rv < dq.rv) / before END) OVER (PARTITION BY symbol ORDER BY day) AS share FROM dq)", 1)},
xu AS MATERIALIZED (SELECT symbol, rn FROM b WHERE rn >= 24 AND high >= top), yu AS (SELECT symbol, min(rn) AS rn FROM xu GROUP BY 1 UNION ALL SELECT yu.symbol, (SELECT min(xu.rn) FROM xu WHERE xu.symbol = yu.symbol AND xu.rn >= yu.rn + 8) FROM yu WHERE yu.rn IS NOT NULL),
xd AS MATERIALIZED (SELECT symbol, rn FROM b WHERE rn >= 24 AND low <= bottom AND NOT EXISTS (SELECT 1 FROM yu WHERE yu.symbol = b.symbol AND yu.rn = b.rn)), yd AS (SELECT symbol, min(rn) AS rn FROM xd GROUP BY 1 UNION ALL SELECT yd.symbol, (SELECT min(xd.rn) FROM xd WHERE xd.symbol = yd.symbol AND xd.rn >= yd.rn + 8) FROM yd WHERE yd.rn IS NOT NULL),
ex AS (SELECT symbol, max(rn) AS rn, arg_max(side, rn) AS side FROM (SELECT symbol, rn, 1 AS side FROM yu WHERE rn IS NOT NULL UNION ALL SELECT symbol, rn, -1 FROM yd WHERE rn IS NOT NULL) GROUP BY 1),
la AS (SELECT symbol, max(rn) AS rn, max(ts) AS ts, arg_max(y, rn) AS atr FROM b JOIN ax USING (symbol, ts) GROUP BY 1), dl AS (SELECT symbol, arg_max(share, day) AS share, arg_max(quiet, day) AS quiet FROM ds WHERE share IS NOT NULL GROUP BY 1), ns AS (SELECT symbol, count(DISTINCT rn) AS n, max(rn) AS rn FROM bk GROUP BY 1),
st AS (SELECT la.*, round(share, 6) AS share, coalesce(quiet, false) AS gate_open, ex.rn AS extreme_row, ex.side AS extreme_side, coalesce(quiet AND atr >= {_FLOOR} AND ex.rn = la.rn, false) AS signal_now, coalesce(ns.n, 0) AS n_signals FROM la LEFT JOIN dl USING (symbol) LEFT JOIN ex USING (symbol) LEFT JOIN ns USING (symbol))
SELECT st.symbol, epoch_us(st.ts) // 1000000 AS as_of, share, gate_open, round(atr, 4) AS atr, atr >= {_FLOOR} AS atr_ok, epoch_us(x.ts) // 1000000 AS extreme_ts, extreme_side, signal_now, CASE WHEN signal_now THEN extreme_side END AS signal_side, n_signals FROM st LEFT JOIN b x ON x.symbol = st.symbol AND x.rn = extreme_row""")
def lead_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the signal stands at the last bar of each series."""
    regime, days = _regime(spark, sf_dir)
    s = lead_status(regime, days, _book(regime), _FLOOR, _LOOKBACK, _GAP)
    return s.select("symbol", secs("as_of").alias("as_of"), F.round("share", 6).alias("share"), "gate_open", r4("atr").alias("atr"), "atr_ok", secs("extreme_ts").alias("extreme_ts"), "extreme_side", "signal_now", "signal_side", "n_signals")
