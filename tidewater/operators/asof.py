"""As-of joins as a tagged union and windows, in time buckets.

Left and right rows meet in windows over (key, bucket); what a bucket does not hold itself comes from the nearest
bucket that does, found over one row for each bucket. So a long series of one key is many tasks, and no range join or
nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import same_series


def asof_join(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, by: list[str] | None = None, direction: str = "backward", tolerance: float | None = None, strict: bool = False, tie: str | None = None, bucket: str = "day", prefix: str = "r_") -> DataFrame:
    """Each left row with the nearest right row before (backward), after (forward) or around it (nearest).

    Rows at the same time match unless strict. tie orders right rows of one time: backward takes the last of them,
    forward the first; of two equally near rows nearest takes the earlier. Columns of the right row get the prefix and
    are null without a match within tolerance seconds. on and right_on are timestamps; a left row without one matches
    nothing. A null key is a key."""
    by, right_on = by or [], right_on or on
    values = [c for c in right.columns if c not in by]
    right_row = F.struct(F.col(right_on).alias("_t"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(c).alias(f"{prefix}{c}") for c in values])
    r = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_at"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_order"), right_row.alias("_r"))
    ones = left.withColumn("_l", F.struct(*left.columns)).select(*by, F.col(on).alias("_at"), F.lit(None).cast("long").alias("_order"), "_l")
    both = ones.unionByName(r, allowMissingColumns=True).withColumn("_b", F.date_trunc(bucket, "_at"))
    key = [*by, "_b"]
    ends = r.withColumn("_b", F.date_trunc(bucket, "_at")).groupBy(*key).agg(F.max_by("_r", F.struct("_at", "_order")).alias("_last"), F.min_by("_r", F.struct("_at", "_order")).alias("_first"))
    spans = same_series(both.select(*key).distinct(), ends, key, "left")
    over_buckets = Window.partitionBy(*by).orderBy("_b")
    spans = spans.withColumn("_prev", F.last("_last", True).over(over_buckets.rowsBetween(Window.unboundedPreceding, -1)))
    # what follows is looked up backwards: a frame that ends with the partition is gone through anew for every row
    backwards = Window.partitionBy(*by).orderBy(F.desc("_b"))
    spans = spans.withColumn("_next", F.last("_first", True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))).select(*key, "_prev", "_next")
    # at one time: backward wants right rows before left ones, forward after them; strict the other way round
    is_left = F.col("_l").isNotNull().cast("int")
    back_rank, ahead_rank = (is_left, -is_left) if not strict else (-is_left, is_left)
    back = Window.partitionBy(*key).orderBy("_at", back_rank, "_order").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.desc("_at"), -ahead_rank, F.desc("_order")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_back", F.last("_r", True).over(back)) if direction != "forward" else both
    both = both.withColumn("_ahead", F.last("_r", True).over(ahead)) if direction != "backward" else both
    found = same_series(both.where("_l is not null"), spans, key, "left")
    before = F.coalesce("_back", "_prev") if direction != "forward" else None
    after = F.coalesce("_ahead", "_next") if direction != "backward" else None
    pick = before if direction == "backward" else after if direction == "forward" else _nearer(before, after)
    found = found.withColumn("_m", F.when(F.col("_at").isNotNull(), pick))
    if tolerance is not None:
        found = found.withColumn("_m", F.when(_gap(F.col("_m")) <= int(tolerance * 1_000_000), F.col("_m")))
    return found.select("_l.*", *[F.col(f"_m.{prefix}{c}") for c in values])


def _gap(row: Column) -> Column:
    return F.abs(F.unix_micros(row["_t"]) - F.unix_micros("_at"))


def _nearer(before: Column, after: Column) -> Column:
    return F.when(after.isNull() | (_gap(before) <= _gap(after)), before).otherwise(after)


def interval_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, bucket_seconds: int, how: str = "inner") -> DataFrame:
    """Points with the spans [start, end) that hold them: spans are dealt to the time buckets that they touch, which
    makes the range join an equi-join."""
    cell = lambda c: F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000))
    s = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")))))
    p = points.withColumn("_cell", cell(F.col(at)))
    inside = (p["_cell"] == s["_cell"]) & (p[at] >= s[start]) & (p[at] < s[end])
    if how in ("left_semi", "left_anti"):
        return p.join(s, inside, how).drop("_cell")
    return p.join(s, inside, how).drop(p["_cell"]).drop(s["_cell"])
