"""Where steps keep what they have read or computed so far."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in the shared place the session names for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share, or pass scratch")
    # A local cluster has executors of its own, and they may sit elsewhere on another master.
    local = spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")
    if str(base).startswith("file:") and not local:
        raise ValueError(f"{base} is a folder of one machine; executors need one they all share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str, scratch: Scratch | None = None) -> DataFrame:
    """The same rows, written once below the scratch folder and read from there."""
    folder = scratch.folder(purpose) if scratch else scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


class Scratch:
    """Owns the snapshots of one run, all below one folder, until it is closed.

    As a context manager it deletes them when the block ends, well or not. What reads
    from them must be done by then.
    """

    def __init__(self, spark: SparkSession, purpose: str = "run", base: str | None = None):
        self.spark, self.base = spark, base or scratch_folder(spark, purpose)

    def folder(self, purpose: str) -> str:
        return f"{self.base}/{purpose}-{uuid.uuid4().hex}"

    def close(self) -> None:
        """Delete everything below the folder; a second call does nothing."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.close()
