"""Row numbers and row bootstrap."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import draw
from ..functions.values import named

_LOCAL = (1 << 33) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local sessions only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="kinforge-")


def freeze(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and cut off from its lineage.

    Spark deletes the files with the last reference if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def _from_parts(marked: DataFrame, name: str) -> DataFrame:
    """Row numbers from frozen rows with __mid: a row's place in its partition plus the sizes of the partitions before."""
    part = F.shiftright("__mid", 33)
    sizes = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))  # one row a partition
    joined = marked.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return joined.withColumn(name, F.col("__start") + F.col("__mid").bitwiseAND(_LOCAL)).drop("__mid", "__part", "__start")


def number_rows(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with 0, 1, 2, ... in the order of some columns; ranges are sorted apart, so no task sees all rows."""
    columns = [named(c) for c in order]
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return _from_parts(freeze(ranged.withColumn("__mid", F.monotonically_increasing_id())), name)


def number_rows_unordered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """The same in the order in which rows lie, without a shuffle."""
    return _from_parts(freeze(df.withColumn("__mid", F.monotonically_increasing_id())), name)


def bootstrap(source: DataFrame, n: int, count: int, purpose: str, *, keep_all: bool = False, seed: int = 42, row: str = "row_id", pos: str = "pos") -> DataFrame:
    """n rows of a numbered source, each with its position; keep_all: every source row once, the rest drawn."""
    if n == 0:
        return source.withColumnRenamed(row, pos).limit(0)
    if count == 0:
        raise ValueError("rows cannot be drawn from an empty table")
    if keep_all and n < count:
        raise ValueError(f"{n} rows cannot keep all of {count}")
    picked = draw(purpose, F.col(pos), count, seed)
    if keep_all:
        picked = F.when(F.col(pos) < count, F.col(pos)).otherwise(picked)
    spine = source.sparkSession.range(n).select(F.col("id").alias(pos)).withColumn(row, picked)
    return spine.join(source, row).drop(row)
