"""Ad-hoc files: months of partitioned folders, CSV and JSON lines, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_months(spark: SparkSession, path: str) -> DataFrame:
    """year, month of the partitions of a folder, in order. Only the partition columns are read."""
    return spark.read.parquet(path).select("year", "month").distinct().orderBy("year", "month")


def read_months(spark: SparkSession, path: str, start: str, end: str, columns: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Rows of [start, end). Partitions beyond these months are pruned, and only the columns named are read."""
    d = spark.read.parquet(path)
    month = F.col("year") * 12 + F.col("month")
    first, last = (int(s[:4]) * 12 + int(s[5:7]) for s in (start, end))
    kept = d.where(month.between(first, last)).where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    return kept.select(*columns) if columns else kept


def read_csv(spark: SparkSession, path: str, dates: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """CSV with a header. What is no date or no number in those columns is null."""
    d = spark.read.csv(path, header=True)
    return d.withColumns({c: F.expr(f"try_cast(`{c}` AS {kind})") for kind, names in (("timestamp", dates), ("double", numbers)) for c in names})


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def tail(log: DataFrame, limit: int, order: str) -> DataFrame:
    """The last rows of a log, oldest first."""
    return log.orderBy(F.desc(order)).limit(limit).orderBy(order)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    """NaN has no JSON form and is written as null."""
    plain = {c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(plain).write.mode("append").option("ignoreNullFields", False).json(path)
