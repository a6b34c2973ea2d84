"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(x: Column | str) -> Column:
    return F.round(x, 4)


def r4_scaled(x: Column | str) -> Column:
    """A double to four places by way of its multiple, as SQL rounds: F.round takes the shortest decimal that stands for a
    double, so halves that the double falls short of go up."""
    return F.round((F.col(x) if isinstance(x, str) else x) * 10_000.0) / 10_000.0


def secs(x: Column | str) -> Column:
    return F.unix_seconds(x)


#: SQL of the sources in tidewater.sources.market.
TICKS = "ticks AS (SELECT event_type AS symbol, ts, epoch_ms(ts) AS time_ms, value AS price, event_id AS seq, user_id FROM events)"
DAILY = """daily AS (SELECT o_orderpriority AS symbol, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS volume, count(*) AS ticks FROM orders GROUP BY 1, 2)"""


def bars_sql(width: str, name: str = "bars") -> str:
    return f"""{name} AS (SELECT symbol, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, seq)) AS close, count(*) AS tick_count, avg(price) AS price_mean, median(price) AS price_median, arg_max(seq, (ts, seq)) AS last_seq FROM ticks GROUP BY 1, 2)"""


def rows_before(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
