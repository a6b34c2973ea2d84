"""Recurrences along a series: exponential means, cool-downs, ratchets.

Exponential means are affine in what comes before, so a series is cut into chunks: each is scanned as if it began with
nothing, the ends of the chunks are composed (one row for each chunk), and each is scanned again from its true start.
Recurrences without such a form are chained: see tidewater.operators.chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import SIZE, chained
from .ordered import CHUNK, numbered, same_series


def ewm(df: DataFrame, means: dict[str, tuple[str, float]], by: str = "symbol", order: tuple[str, ...] = ("ts",), size: int = CHUNK) -> DataFrame:
    """Adds means, new name: (column, alpha): y = (1 - alpha) y + alpha x, started with the series' first x.

    Null inputs at the start of a series are skipped (y null); after it an input has to be there in each row."""
    ready = df if "rn" in df.columns else numbered(df, by, order)
    inputs = sorted({c for c, _ in means.values()})
    rows = ready.select(by, "rn", *[F.col(c).cast("double") for c in inputs]).withColumn("_chunk", F.floor(F.col("rn") / size))
    names = list(means)

    def scan(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
        """Means of x after start (NaN: none yet)."""
        s = pd.Series(x if np.isnan(start) else np.concatenate([[start], x]))
        y = s.ewm(alpha=alpha, adjust=False).mean().to_numpy()
        return y if np.isnan(start) else y[1:]

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        out = {by: g[by].iloc[:1], "_chunk": g["_chunk"].iloc[:1]}
        for name, (c, alpha) in means.items():
            x = g[c].to_numpy()
            x = x[~np.isnan(x)]
            out[f"{name}_n"] = [len(x)]
            out[f"{name}_b"] = [scan(x, alpha, 0.0)[-1] if len(x) else 0.0]  # from nothing
            out[f"{name}_f"] = [scan(x, alpha, np.nan)[-1] if len(x) else np.nan]  # as the series' start
        return pd.DataFrame(out)

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_chunk")
        out = {by: g[by], "_chunk": g["_chunk"]}
        for name, (_, alpha) in means.items():
            y, starts = np.nan, []
            for n, b, f in zip(g[f"{name}_n"], g[f"{name}_b"], g[f"{name}_f"]):
                starts.append(y)
                y = f if np.isnan(y) else (1 - alpha) ** n * y + b
            out[f"_s_{name}"] = starts
        return pd.DataFrame(out)

    def means_of(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        out = {by: g[by], "rn": g["rn"]}
        for name, (c, alpha) in means.items():
            out[name] = scan(g[c].to_numpy(), alpha, g[f"_s_{name}"].iloc[0])
        return pd.DataFrame(out)

    key = df.schema[by].dataType.simpleString()
    end_type = f"{by} {key}, _chunk long, " + ", ".join(f"{n}_n long, {n}_b double, {n}_f double" for n in names)
    start_type = f"{by} {key}, _chunk long, " + ", ".join(f"_s_{n} double" for n in names)
    starts = rows.groupBy(by, "_chunk").applyInPandas(ends, end_type).groupBy(by).applyInPandas(compose, start_type)
    scanned = same_series(rows, starts, [by, "_chunk"]).groupBy(by, "_chunk").applyInPandas(means_of, f"{by} {key}, rn long, " + ", ".join(f"{n} double" for n in names))
    clean = scanned.select(by, "rn", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    return same_series(ready, clean, [by, "rn"])


def cooldown(events: DataFrame, gap: int, by: str = "symbol", rn: str = "rn") -> DataFrame:
    """Events at least `gap` rows after the last one kept. Only the events are scanned. Events that are `gap` rows or
    more from the one before are kept whatever came earlier, so they start groups that are scanned on their own."""
    from .ordered import along, carry_last, windowed

    first = F.lag("_at").over(along(by, "rn"))
    marked = windowed(events.withColumnRenamed(rn, "_at"), {"_before": first}, back=1, by=by, order=("ts",))
    marked = marked.withColumn("_head", F.when(F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= gap), F.col("_at")))
    grouped = carry_last(marked, {"_head": "_group"}, by).drop("_before", "_head", "rn")
    schema = T.StructType(grouped.schema.fields)

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_at")
        last, kept = None, []
        for at in g["_at"]:
            kept.append(last is None or at - last >= gap)
            last = at if kept[-1] else last
        return g[kept]

    return grouped.groupBy(by, "_group").applyInPandas(keep, schema).drop("_group").withColumnRenamed("_at", rn)


def ratchet(df: DataFrame, upper: str, lower: str, close: str, by: str = "symbol", size: int = SIZE) -> DataFrame:
    """Adds line and direction of a trailing band: a bound only moves towards the price until the price closes beyond
    it, which turns the direction. Rows without bounds give null, and the band starts anew after them. df: numbered. A
    band soon forgets where it started, so chunks of a series are scanned at the same time."""
    schema = T.StructType([df.schema[by], *[f for f in df.schema.fields if f.name != by], T.StructField("line", T.DoubleType()), T.StructField("direction", T.DoubleType())])

    def scan(g: pd.DataFrame, state: list, last: bool) -> tuple[pd.DataFrame, list]:
        up, down, way, price = state
        lines, ways = [], []
        for u, d, c in zip(g[upper].tolist(), g[lower].tolist(), g[close].tolist()):
            if u is None or d is None or c is None or not (u == u and d == d and c == c):
                up = down = way = None
            elif up is None:
                up, down, way = u, d, 1.0 if c > u else -1.0
            else:
                way = 1.0 if c > up else -1.0 if c < down else way
                up = u if u < up or (price is not None and price > up) else up
                down = d if d > down or (price is not None and price < down) else down
            lines.append(None if way is None else down if way > 0 else up), ways.append(way)
            price = c if c is not None and c == c else None
        return g.assign(line=lines, direction=ways).astype({"line": float, "direction": float}), [up, down, way, price]

    out = chained(df, scan, [None] * 4, schema, by, size).select(*df.columns, "line", "direction")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("line", "direction")})
