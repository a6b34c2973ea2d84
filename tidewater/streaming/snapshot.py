"""Latest snapshots that readers always see whole, and a cursor that moves only when its work is done.

A snapshot is written as a version beside the old one; then a small pointer file is replaced in one rename. A batch that comes
again is known by its number and ignored, and one that fails leaves the pointer where it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Pointer:
    """A small JSON file that is replaced at once, in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def read(self) -> dict | None:
        at = self._at(self.path)
        fs = at.getFileSystem(self.conf)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, value: dict) -> None:
        fresh = self._at(f"{self.path}.{uuid.uuid4().hex}")
        out = fresh.getFileSystem(self.conf).create(fresh)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.conf).rename(fresh, self._at(self.path), how)


class Latest:
    """The latest of a stream's snapshots in a folder; `keep` versions stay for readers that have begun."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.pointer = Pointer(spark, f"{self.path}/_latest")

    def publish(self, df: DataFrame, batch: int) -> bool:
        """Write df as the snapshot of a batch. False, and nothing done, if that batch or a later one is out already."""
        now = self.pointer.read()
        if now and now["batch"] >= batch:
            return False
        folder = f"{self.path}/batch={batch}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(folder)
        held = [*(now["held"] if now else []), folder]
        self.pointer.write({"batch": batch, "folder": folder, "held": held[-self.keep :]})
        for old in held[: -self.keep]:
            at = self.pointer._at(old)
            at.getFileSystem(self.pointer.conf).delete(at, True)
        return True

    def read(self) -> DataFrame | None:
        """The latest snapshot; None before the first."""
        now = self.pointer.read()
        return self.spark.read.parquet(now["folder"]) if now else None


class Cursor:
    """How far a job has come, in a file of its own. It starts at the later of what it says and what the sink holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.pointer = Pointer(spark, path)

    def start(self, held: str | None = None) -> str | None:
        said = self.pointer.read()
        return max(filter(None, (said and said["at"], held)), default=None)

    def advance(self, at: str, complete: bool = True) -> None:
        """Move on to `at` if the work up to it is complete, never back."""
        now = self.start()
        if complete and (now is None or at > now):
            self.pointer.write({"at": at})


def publish_latest(df: DataFrame, path: str, checkpoint: str):
    """A stream that keeps its latest batch as a snapshot in path."""
    return df.writeStream.foreachBatch(lambda batch, number: Latest(batch.sparkSession, path).publish(batch, number)).option("checkpointLocation", checkpoint)
