"""Idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new rows, of which new ones win for the same keys; keys that neither side repeats keep one row."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rest = [c for c in old.columns if c not in keys]
    picked = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("_age")).alias("_v"))
    return picked.select(*keys, "_v.*")


def write_partitions(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str], mode: str = "overwrite") -> None:
    """Parquet by Hive partitions, of which only those in df are replaced; rows sorted for tight row-group statistics."""
    dealt = df.repartition(*partition_by) if partition_by else df
    dealt.sortWithinPartitions(*partition_by, *sort_by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def replace_window(old: DataFrame, new: DataFrame, ts: str = "ts", days: int = 2, may_lose: int = 5) -> DataFrame:
    """Old rows up to `days` before their last time, and new rows from there on. Nothing newer, or more than may_lose
    rows fewer than are replaced, is an error."""
    last = old.agg(F.max(ts)).first()[0]
    if last is None:
        return new
    cut = F.lit(last) - F.expr(f"INTERVAL {days} DAYS")
    fresh = new.where(F.col(ts) >= cut)
    counts = fresh.agg(F.count("*").alias("n"), F.max(ts).alias("last")).first()
    if counts["last"] is None or counts["last"] <= last:
        raise ValueError("nothing newer")
    if counts["n"] < old.where(F.col(ts) >= cut).count() - may_lose:
        raise ValueError("the new rows are fewer than those they replace")
    return old.where(F.col(ts) < cut).unionByName(fresh)


def reconcile(expected: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """expected (key, at_least) against counts (key, rows)."""
    both = expected.join(counts, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return both.withColumn("verdict", F.when(F.col("rows") > F.col("at_least"), "OK").otherwise("MISMATCH"))


def throttle(rows: DataFrame, ts: str, seconds: int, by: list[str]) -> DataFrame:
    """The first row of each interval of so many seconds."""
    w = F.window(ts, f"{seconds} seconds").start
    first = rows.groupBy(*by, w.alias("_w")).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(ts)).alias("_v"))
    return first.select(*by, "_v.*")
