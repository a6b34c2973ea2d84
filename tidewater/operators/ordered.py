"""Row numbers and row-count windows over long series, without one task for each series.

A series is numbered in two steps: within calendar buckets, and over the counts of the buckets. Numbered rows are cut
into chunks of equal size; rows near an edge also go to the neighbouring chunk, so that a window of `back` rows before
and `ahead` rows after stays within a chunk. A symbol that holds a third of all rows is then as many tasks as it has
chunks.

A null symbol is a series of its own, and a null ts comes first in its series. NaN counts as missing, as null does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 50_000


def missing_as_null(df: DataFrame, columns) -> DataFrame:
    """NaN as null in those of the columns that are floating."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in dict.fromkeys(columns) if kinds.get(c) in ("double", "float")})


def same_series(df: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """df joined with other on equal keys, where nulls are equal too."""
    right = other.select([F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in other.columns])
    match = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return df.join(right, reduce(lambda a, b: a & b, match), how).drop(*[f"_on_{c}" for c in on])


def numbered(df: DataFrame, by: str = "symbol", order: tuple[str, ...] = ("ts",), bucket: str = "month", out: str = "rn", of: str | None = None) -> DataFrame:
    """Adds the number of each row in its series, from 0, in the order given (which has to be total); of: a name for
    the length of its series, if wanted."""
    cut = df.withColumn("_bucket", F.date_trunc(bucket, order[0]))
    inner = Window.partitionBy(by, "_bucket").orderBy(*order)
    placed = cut.withColumn("_r", F.row_number().over(inner))
    counts = cut.groupBy(by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), *([F.sum("_n").over(Window.partitionBy(by)).alias(of)] if of else []))
    joined = same_series(placed, starts, [by, "_bucket"])
    return joined.withColumn(out, F.col("_start") + F.col("_r") - 1).drop("_bucket", "_r", "_start")


def chunked(df: DataFrame, back: int = 0, ahead: int = 0, size: int = CHUNK, rn: str = "rn", of: str | None = None) -> DataFrame:
    """Adds _chunk and _own: rows that only lend their values to a neighbouring chunk are not its own. of: the column of
    the series' length, if there is one; with it no rows go to a chunk past the series' end."""
    size = max(size, back, ahead)
    at, k = F.pmod(F.col(rn), F.lit(size)), F.floor(F.col(rn) / size)
    places = [F.struct(k.alias("c"), F.lit(True).alias("own"))]
    if back:
        places.append(F.when((at >= size - back) & (F.lit(True) if of is None else F.col(of) > (k + 1) * size), F.struct((k + 1).alias("c"), F.lit(False).alias("own"))))
    if ahead:
        places.append(F.when((at < ahead) & (k > 0), F.struct((k - 1).alias("c"), F.lit(False).alias("own"))))
    each = F.explode(F.array_compact(F.array(*places)))
    return df.withColumn("_x", each).withColumn("_chunk", F.col("_x.c")).withColumn("_own", F.col("_x.own")).drop("_x")


def along(by: str = "symbol", rn: str = "rn") -> WindowSpec:
    """The window order within a chunk."""
    return Window.partitionBy(by, "_chunk").orderBy(rn)


def windowed(df: DataFrame, columns: dict[str, Column], back: int = 0, ahead: int = 0, by: str = "symbol", order: tuple[str, ...] = ("ts",), size: int = CHUNK) -> DataFrame:
    """Adds columns that look at `back` rows before and `ahead` rows after their own, over along(by)."""
    df = missing_as_null(df, df.columns)
    cut = chunked(df, back, ahead, size) if "rn" in df.columns else chunked(numbered(df, by, order, of="_of"), back, ahead, size, of="_of").drop("_of")
    for name, column in columns.items():
        cut = cut.withColumn(name, column)
    return cut.where("_own").drop("_own", "_chunk")


# --- windows of n rows; null until there are enough -----------------------------------------------------------------


def frame(n: int, by: str = "symbol") -> WindowSpec:
    return along(by).rowsBetween(-(n - 1), 0)


def over(agg: Column, x: Column | str, n: int, least: int | None = None, by: str = "symbol") -> Column:
    """agg over the last n rows, null unless `least` of them (all, if not given) have a value."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.count(x).over(frame(n, by)) >= (n if least is None else least), agg.over(frame(n, by)))


def sma(x: str, n: int) -> Column:
    return over(F.avg(x), x, n)


def rolling_std(x: str, n: int) -> Column:
    return over(F.stddev_samp(x), x, n)


def rolling_max(x: str, n: int) -> Column:
    return over(F.max(x), x, n)


def rolling_min(x: str, n: int) -> Column:
    return over(F.min(x), x, n)


def rolling_median(x: str, n: int, least: int | None = None) -> Column:
    return over(F.percentile(x, F.lit(0.5)), x, n, least)


def rank_pct(x: str, n: int, least: int | None = None) -> Column:
    """Average rank of the last value among the values of the window, divided by their number."""
    values = F.collect_list(x).over(frame(n))
    below, same = F.size(F.filter(values, lambda v: v < F.col(x))), F.size(F.filter(values, lambda v: v == F.col(x)))
    return F.when((F.size(values) >= (n if least is None else least)) & F.col(x).isNotNull(), (below + (same + 1) / 2) / F.size(values))


def zscore(x: str, n: int, least: int | None = None) -> Column:
    return (F.col(x) - over(F.avg(x), x, n, least)) / over(F.stddev_samp(x), x, n, least)


def mean_abs_dev(x: str, n: int) -> Column:
    """Mean distance of the window's values from their mean."""
    values = F.collect_list(x).over(frame(n))
    mean = F.avg(x).over(frame(n))
    return F.when(F.size(values) == n, F.aggregate(F.transform(values, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / n)


def lag(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(along())


def forward_max(x: str, h: int) -> Column:
    """The largest of the next h values, null if there are fewer."""
    w = along().rowsBetween(1, h)
    return F.when(F.count(x).over(w) == h, F.max(x).over(w))


def forward_min(x: str, h: int) -> Column:
    w = along().rowsBetween(1, h)
    return F.when(F.count(x).over(w) == h, F.min(x).over(w))


# --- islands --------------------------------------------------------------------------------------------------------


def streaks(df: DataFrame, flag: str, out: str = "streak", by: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds the signed length of the current run of equal flags (true: positive). Two steps: runs are found from
    neighbours, and the start of a run is looked up over the starts only."""
    marked = windowed(df, {"_start": F.when(lag(flag).isNull() | (lag(flag) != F.col(flag)), F.col("rn"))}, back=1, by=by, order=order)
    filled = carry_last(marked, {"_start": "_begin"}, by)
    length = F.col("rn") - F.col("_begin") + 1
    return filled.withColumn(out, F.when(F.col(flag), length).otherwise(-length)).drop("_start", "_begin")


def carry_last(df: DataFrame, columns: dict[str, str], by: str = "symbol", size: int = CHUNK, before: bool = False) -> DataFrame:
    """Adds for each column (name: new name) its last non-null value up to the row (or before it): within chunks, and
    from the last chunk that has one."""
    cut = missing_as_null(df, columns).withColumn("_chunk", F.floor(F.col("rn") / size))
    ends = cut.groupBy(by, "_chunk").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rn"))).alias(f"_e_{c}") for c in columns])
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(by, "_chunk", *[F.last(f"_e_{c}", True).over(earlier).alias(f"_c_{c}") for c in columns])
    w = along(by).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = same_series(cut, ends, [by, "_chunk"])
    for c, new in columns.items():
        out = out.withColumn(new, F.coalesce(F.last(c, True).over(w), F.col(f"_c_{c}")))
    return out.drop("_chunk", *[f"_c_{c}" for c in columns])


def running(df: DataFrame, columns: dict[str, tuple[str, str]], by: str = "symbol", size: int = CHUNK) -> DataFrame:
    """Adds running aggregates, new name: (aggregate, column) with max, min, sum or count, up to and with the row."""
    fn = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, None), "count": (F.count, None)}
    cut = missing_as_null(df, [c for _, c in columns.values()]).withColumn("_chunk", F.floor(F.col("rn") / size))
    parts = cut.groupBy(by, "_chunk").agg(*[fn[a][0](c).alias(f"_p_{new}") for new, (a, c) in columns.items()])
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    again = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}
    parts = parts.select(by, "_chunk", *[again[a](f"_p_{new}").over(earlier).alias(f"_c_{new}") for new, (a, _) in columns.items()])
    w = along(by).rowsBetween(Window.unboundedPreceding, 0)
    out = same_series(cut, parts, [by, "_chunk"])
    for new, (a, c) in columns.items():
        here, carried = fn[a][0](c).over(w), F.col(f"_c_{new}")
        both = fn[a][1](here, carried) if fn[a][1] else F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        out = out.withColumn(new, both)
    return out.drop("_chunk", *[f"_c_{new}" for new in columns])
