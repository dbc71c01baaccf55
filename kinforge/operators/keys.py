"""New primary keys, maps from old keys to new ones, and foreign keys rewritten through them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.draws import draw
from ..functions.values import any_null, key_capacity, named

PAD = 14


def largest_key(df: DataFrame, column: str) -> int | None:
    """The floor of the largest key; of generated string keys the largest number."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        c = F.regexp_extract(c, rf"^SYN_{column}_(\d+)$", 1).try_cast("long")
    elif isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    found = df.agg(F.max(c)).first()[0]
    return None if found is None else int(found // 1)


def new_key(pos: Column, column: str, kind: T.DataType, start: int, n: int) -> Column:
    """start, start + 1, ... in the key's type; raises if n of them do not fit."""
    limit = key_capacity(kind)
    if limit is not None and n and start + n - 1 > limit:
        raise OverflowError(f"{column}: {start + n - 1} is beyond {kind.simpleString()}, which holds keys up to {limit}")
    number = pos + F.lit(start).cast("long")
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(f"SYN_{column}_"), F.lpad(number.cast("string"), PAD, "0"))
    return number.cast(kind)


def key_start(largest: int | None, n: int, kind: T.DataType, *, band: int = 0, floor: int = 0) -> int | None:
    """The number that new keys follow: a band above the largest, not under floor, but so that n fit if they can."""
    if largest is None:
        return None
    limit = key_capacity(kind)
    start = max(largest + band, floor)
    return start if limit is None else max(largest, min(start, limit - n))


def key_map(work: DataFrame, old: list[str], new: list[str], pos: str = "pos") -> DataFrame:
    """old_*, new_*, rank (by position, from 1) and count of the rows that each old key became."""
    names = [named(c).alias(f"old_{i}") for i, c in enumerate(old)] + [named(c).alias(f"new_{i}") for i, c in enumerate(new)]
    olds = [f"old_{i}" for i in range(len(old))]
    by = W.partitionBy(*olds)
    return work.select(*names, F.col(pos).alias("pos")).withColumns({"rank": F.row_number().over(by.orderBy("pos")), "count": F.count("*").over(by)}).drop("pos")


def remap(child: DataFrame, columns: list[str], mapping: DataFrame, purpose: str, *, pos: str = "pos", seed: int = 42, wide: bool = False) -> DataFrame:
    """child with a foreign key rewritten to one of the rows that its old parent became, drawn by position.

    A key with a null component stays as it is; one without a candidate becomes null. By default a parent's
    candidates travel as one array, in a single join; wide joins on (key, rank) instead, for parents with very many.
    """
    n = len(columns)
    olds, news = [f"old_{i}" for i in range(n)], [f"new_{i}" for i in range(n)]
    match = lambda m: reduce(lambda a, b: a & b, [child[c] == m[o] for c, o in zip(columns, olds)])
    if wide:
        counts = mapping.where("rank = 1").select(*olds, F.col("count").alias("__count"))
        with_count = child.join(counts, match(counts), "left").drop(*olds)
        picked = with_count.withColumn("__rank", 1 + draw(purpose, F.col(pos), F.col("__count"), seed))
        to = mapping.select(*olds, *news, F.col("rank").alias("__to"))
        on = reduce(lambda a, b: a & b, [picked[c] == to[o] for c, o in zip(columns, olds)] + [picked["__rank"] == to["__to"]])
        joined = picked.join(to, on, "left").withColumn("__new", F.struct(*news))
    else:
        to = mapping.groupBy(*olds).agg(F.array_sort(F.collect_list(F.struct("rank", *news))).alias("__all"))
        joined = child.join(to, match(to), "left").withColumn("__new", F.element_at("__all", (1 + draw(purpose, F.col(pos), F.size("__all"), seed)).cast("int")))
    kept = any_null(columns)
    changed = {c: F.when(kept, named(c)).otherwise(F.col(f"__new.new_{i}").cast(child.schema[c].dataType)) for i, c in enumerate(columns)}
    return joined.withColumns(changed).select(*child.columns)


def remap_self(work: DataFrame, columns: list[str], old_key: list[str], new_key_: list[str], mapping: DataFrame, purpose: str, *, pos: str = "pos", seed: int = 42) -> DataFrame:
    """remap within one table; a row that was its own parent stays its own."""
    own = reduce(lambda a, b: a & b, [named(c) == named(k) for c, k in zip(columns, old_key)])
    flagged = work.withColumn("__own", F.coalesce(own, F.lit(False)))
    out = remap(flagged, columns, mapping, purpose, pos=pos, seed=seed)
    return out.withColumns({c: F.when(F.col("__own"), named(k).cast(work.schema[c].dataType)).otherwise(named(c)) for c, k in zip(columns, new_key_)}).drop("__own")
