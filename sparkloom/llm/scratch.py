"""Where intermediate tables go: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to Python, so that long texts do not pile up in a worker.
ARROW_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a master on this machine alone (as in
    tests) gets a temporary one; on a cluster that would be out of the executors' reach: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local:")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Workspace:
    """A folder for the tables of one piece of work."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str, stay: bool = False) -> DataFrame:
        """`df` as a Parquet table: its lineage ends there, and lost executors cost no more than the
        reading of a file. It goes with the workspace, or (if it is to stay) when the session ends."""
        if stay:
            return written(df, name)
        return _table(df, f"{self.folder}/{name}-{uuid.uuid4().hex}")

    def drop(self) -> None:
        at, files = _path(self.spark, self.folder)
        files.delete(at, True)


@contextmanager
def workspace(spark: SparkSession):
    """A workspace whose tables are deleted at its end, but for those that are to stay."""
    work = Workspace(spark)
    try:
        yield work
    finally:
        work.drop()


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that stays until the session ends: what a caller is given."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out = _table(df, path)
    at, files = _path(spark, path)
    files.deleteOnExit(at)
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end at ARROW_BYTES, whatever their number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from the columns of `df`."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out
