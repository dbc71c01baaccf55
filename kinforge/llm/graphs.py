"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> with m, the least of u and all its v. A sum and a join, so that a hub's edges can be split."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) links -> (id, component): the least id that each linked id reaches; ids without links are left out."""
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        large = _with_least(both(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large.where("u <> v").distinct())
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        after = scratch.keep(out, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    linked = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return linked.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
