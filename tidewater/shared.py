"""Tables written in the folder that driver and executors share, so later work starts from files that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session that names none (tests) gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside, and collected from tables made inside, leaves no shuffle files. Else Spark deletes them only
    when the driver's garbage collector has come by, which it may not for as long as an operator runs."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Written:
    """Tables of one computation. drop() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = f"{shared_folder(self.spark)}/tidewater-{uuid.uuid4().hex}"
        with swept(self.spark):
            df.write.parquet(path)
        if not keep:
            self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []
