"""Scans of long series in chunks, for states that no formula composes.

Each chunk of a series is first run from the state that a series starts with. The state in which it ends is where the
next chunk has to start; if that chunk was run from another state, it is run again, and so on until the chain of chunks
from the first to the last is known. States soon forget where they came from (a trade closes, a bound is reset), so most
chunks are run once or twice, all of them at the same time; only if every chunk remembers, there are as many rounds as
chunks. A last pass over all chunks, each from its true state, gives the rows.

Where a chunk leaves a state untouched, it need not be run: `leap` names, from summaries of chunks, the next chunk that
can change a state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.shared import Written

from .ordered import same_series

State = list
#: run(rows of a chunk in order, state, whether it is the last) -> (rows to return, state at the end)
Run = Callable[[pd.DataFrame, State, bool], tuple[pd.DataFrame, State]]
#: leap(state, number of the next chunk, summaries of the series by chunk) -> (number of the chunk to go to, state there)
Leap = Callable[[State, int, list], tuple[int, State]]

SIZE = 16_384


def chained(
    rows: DataFrame, run: Run, start: State, schema: str | T.StructType, by: str = "symbol", size: int = SIZE,
    summary: Callable[[pd.DataFrame], list] | None = None, leap: Leap | None = None,
) -> DataFrame:
    """What run returns for all chunks of all series. rows: numbered from 0 in column rn. States and summaries are lists
    of numbers, strings and None. A null `by` is a series. Empty rows give an empty result."""
    written = Written(rows.sparkSession)
    columns = [c for c in rows.columns if c != by]
    cut = written.table(rows.withColumn("_chunk", F.floor(F.col("rn") / size)))
    key = cut.schema[by].dataType.simpleString()
    first = json.dumps(start)
    step = f"{by} {key}, _chunk long, _in string, _out string, _summary string"

    def trial(g: pd.DataFrame) -> pd.DataFrame:
        """A chunk run from the first state, and its summary."""
        g = g.sort_values("rn", ignore_index=True)
        _, state = run(g[columns], list(start), False)
        about = json.dumps(summary(g[columns])) if summary else None
        return pd.DataFrame({by: g[by].iloc[:1], "_chunk": g["_chunk"].iloc[:1], "_in": [first], "_out": [json.dumps(state)], "_summary": [about]})

    def again(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn", ignore_index=True)
        before = g["_in"].iloc[0]
        _, state = run(g[columns], json.loads(before), False)
        return pd.DataFrame({by: g[by].iloc[:1], "_chunk": g["_chunk"].iloc[:1], "_in": [before], "_out": [json.dumps(state)], "_summary": [None]})

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        """The chain as far as it is known (due: false), and runs that are still to be made (due: true). A row for each chunk."""
        g = g.sort_values("_chunk")
        known = {(c, i): o for c, i, o in zip(g["_chunk"], g["_in"], g["_out"])}
        chunks = int(g["_chunk"].max()) + 1
        about = {c: json.loads(s) for c, s in zip(g["_chunk"], g["_summary"]) if s is not None}
        summaries = [about.get(c) for c in range(chunks)]

        def arrival(c: int, out: str) -> tuple[int, str]:
            if not leap or c + 1 >= chunks:
                return c + 1, out
            to, state = leap(json.loads(out), c + 1, summaries)
            return to, json.dumps(state)

        at, path = (0, first), []
        while at[0] < chunks and at in known:
            path.append((*at, False))
            at = arrival(at[0], known[at])
        if at[0] < chunks:  # also what the runs so far lead to: it is needed unless the chain turns out otherwise
            due = {a for (c, _), o in known.items() if (a := arrival(c, o)) not in known and a[0] < chunks}
            path += [(*a, True) for a in sorted(due)]
        return pd.DataFrame(path, columns=["_chunk", "_in", "due"]).assign(**{by: g[by].iloc[0]})[[by, "_chunk", "_in", "due"]]

    known = written.table(cut.groupBy(by, "_chunk").applyInPandas(trial, step))
    while True:
        path = written.table(known.groupBy(by).applyInPandas(follow, f"{by} {key}, _chunk long, _in string, due boolean"))
        due = path.where("due").drop("due")
        if due.isEmpty():
            break
        more = same_series(cut, due, [by, "_chunk"]).groupBy(by, "_chunk", "_in").applyInPandas(again, step)
        known = written.table(known.unionByName(more))

    def final(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn", ignore_index=True)
        out, _ = run(g[columns], json.loads(g["_in"].iloc[0]), bool(g["_last"].iloc[0]))
        return out.assign(**{by: g[by].iloc[0]})

    last = known.groupBy(by).agg(F.max("_chunk").alias("_end"))
    whole = same_series(path.drop("due"), last, [by]).withColumn("_last", F.col("_chunk") == F.col("_end")).drop("_end")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = same_series(cut, whole, [by, "_chunk"]).groupBy(by, "_chunk").applyInPandas(lambda g: final(g)[fields.names], fields)
    done = Written(rows.sparkSession).table(out, keep=True)
    written.drop()
    return done
