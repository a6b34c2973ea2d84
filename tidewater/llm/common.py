"""What several operators share: words, row keys, tables written in the shared folder."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import swept

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes: A-Z to lower case, and what separates words to spaces. Bytes of what is not ASCII stay.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[str]:
    """Words of a text in Python: A-Z in lower case, runs of letters and digits (and whatever is not ASCII)."""
    return [w for w in (text or "").encode().translate(AS_WORDS).decode().split(" ") if w]


def words(text: Column) -> Column:
    """The same words as a column of arrays. Null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP)  # several times as fast as regexp_extract_all
    return F.array_remove(parts, "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session that names none (tests)
    gets a temporary one; on a cluster each machine would write to a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Tables that one operator writes in the shared folder. Later work starts from files that outlive any executor, and
    the shuffle files that made them are gone."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def settle(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Write df and read it back. keep: the operator's result reads it, so it stays."""
        path = f"{shared_folder(self.spark)}/tidewater-{uuid.uuid4().hex}"
        with swept(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self.tables.append((out, path))
        return out

    def clear(self, *only: DataFrame) -> None:
        """Delete the tables that no result reads; only: those of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone = [path for t, path in self.tables if not only or any(t is x for x in only)]
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.tables = [x for x in self.tables if x[1] not in gone]


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder, and read it back."""
    return Scratch(df.sparkSession).settle(df, keep=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not: name, or name with underscores."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """Texts may be long: Arrow batches of few bytes keep a Python worker's memory small. Spark reads this setting of
    the session when a query runs and has none for a single query, so it stays set."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def give_back() -> None:
    """Return freed memory to the system. A Python worker lives on after a task and would keep it beside the next stage's."""
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
