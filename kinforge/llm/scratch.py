"""Intermediate tables in the shared checkpoint folder.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str | None = None, by: str | None = None) -> DataFrame:
        """Write df and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name), compression=compression, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished jobs.

        The JVM learns a moment later that Python has dropped an object, so it is asked twice.
        """
        for _ in range(2):
            gc.collect()
            time.sleep(0.25)
            self.spark.sparkContext._jvm.System.gc()


def partitions_for(df: DataFrame, rows_each: int, rows: int) -> int:
    """A partition count that follows the row count, at least Spark's own setting."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))
