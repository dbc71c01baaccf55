"""Profiles of single tables and tables made from them, column by column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw, token, unit
from ..functions.values import DATETIMES, named
from .rows import number_rows

MAX_CATEGORIES = 100
POOL_BROADCAST = 1_000_000
#: Logarithm of the buckets of a sketch of distinct values.
LG_BUCKETS = 12


@dataclass(frozen=True)
class Profile:
    name: str
    kind: str  # categorical, token, numeric, datetime, unsupported
    null_share: float
    total: int
    known: int
    values: tuple = ()
    shares: tuple[float, ...] = ()


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.BooleanType)):
        return "text"
    if isinstance(t, DATETIMES):
        return "datetime"
    return "numeric" if isinstance(t, T.NumericType) else "unsupported"


def profile_table(df: DataFrame) -> DataFrame:
    """column_name, kind, total, null_count, null_share, distinct_estimate of all columns in one aggregation."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(named(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)], *[F.approx_count_distinct(named(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(_kind(f.dataType)).alias("kind"), F.col(f"n{i}").alias("null_count"), F.col(f"d{i}").alias("distinct_estimate")) for i, f in enumerate(df.schema)]))
    out = one.select("total", each.alias("x")).select("x.*", "total")
    kind = F.when(F.col("kind") == "text", F.when(F.col("distinct_estimate") <= MAX_CATEGORIES, "categorical").otherwise("token")).otherwise(F.col("kind"))
    return out.withColumn("kind", kind).withColumn("null_share", F.when(F.col("total") > 0, F.col("null_count") / F.col("total")).otherwise(0.0))


def distinct_sketches(df: DataFrame, parts: list[str] = ()) -> DataFrame:
    """The parts' columns, column_name, sketch: of each part a small sketch of every column's distinct values, to be kept
    and merged later with those of other parts, without reading these again."""
    columns = [f for f in df.schema if f.name not in parts]
    plain = (T.StringType, T.BinaryType, T.IntegerType, T.LongType)
    values = [named(f.name) if isinstance(f.dataType, plain) else named(f.name).cast("string") for f in columns]
    grouped = df.groupBy(*[named(p) for p in parts]).agg(*[F.hll_sketch_agg(v, LG_BUCKETS).alias(f"s{i}") for i, v in enumerate(values)])
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, f in enumerate(columns)]))
    return grouped.select(*[named(p) for p in parts], each.alias("x")).select(*[named(p) for p in parts], "x.*")


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """column_name, distinct_estimate, low, high: of all parts together, with bounds of three standard errors."""
    merged = sketches.where("sketch is not null").groupBy("column_name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
    error = 3 * 1.04 / (1 << LG_BUCKETS) ** 0.5
    return merged.withColumns({"low": F.floor(F.col("distinct_estimate") * (1 - error)), "high": F.ceil(F.col("distinct_estimate") * (1 + error))})


def learn(df: DataFrame) -> dict[str, Profile]:
    """Profiles of all columns; of categories the values and shares (at most about MAX_CATEGORIES of them)."""
    out = {}
    for r in profile_table(df).collect():
        values: tuple = ()
        shares: tuple = ()
        if r["kind"] == "categorical":
            c = named(r["column_name"])
            rows = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").collect()
            total = sum(x["n"] for x in rows)
            values, shares = tuple(x[0] for x in rows), tuple(x["n"] / total for x in rows)
        out[r["column_name"]] = Profile(r["column_name"], r["kind"], r["null_share"], r["total"], r["total"] - r["null_count"], values, shares)
    return out


def categorical(u: Column, values: tuple, shares: tuple[float, ...], kind: T.DataType) -> Column:
    """The value whose part of [0, 1) holds u. u must be one column, drawn once."""
    if not values:
        return F.lit(None).cast(kind)
    out, to = None, 0.0
    for v, s in zip(values[:-1], shares):
        to += s
        out = F.when(u < to, F.lit(v).cast(kind)) if out is None else out.when(u < to, F.lit(v).cast(kind))
    last = F.lit(values[-1]).cast(kind)
    return last if out is None else out.otherwise(last)


def pooled(base: DataFrame, source: DataFrame, column: str, pos: str, seed: int = 42) -> DataFrame:
    """base with a column drawn from the source's non-null values."""
    pool = number_rows(source.where(named(column).isNotNull()).select(named(column)), [column], "__at")
    n = pool.count()
    if not n:
        return base.withColumn(column, F.lit(None).cast(source.schema[column].dataType))
    picked = base.withColumn("__at", draw(f"pool|{column}", F.col(pos), n, seed))
    return picked.join(F.broadcast(pool) if n < POOL_BROADCAST else pool, "__at", "left").drop("__at")


def with_nulls(df: DataFrame, column: str, share: float, pos: str, seed: int = 42) -> DataFrame:
    return df.withColumn(column, F.when(unit(f"null|{column}", F.col(pos), seed) >= share, named(column))) if share > 0 else df


def key_values(pos: Column, kind: T.DataType, column: str, seed: int = 42) -> Column:
    """Integers from 1, tokens for text, else the position."""
    if isinstance(kind, T.IntegralType):
        return (pos + 1).cast(kind)
    if isinstance(kind, T.StringType):
        return F.md5(F.concat(F.lit(f"{seed}|key|{column}|"), pos.cast("string")))
    return pos.cast(kind)


def synthesise_table(source: DataFrame, n: int, keys: list[str] = (), seed: int = 42) -> DataFrame:
    """n rows with the source's columns; each column follows its own distribution, independent of the others."""
    profiles = learn(source)
    out = source.sparkSession.range(n).withColumnRenamed("id", "__pos")
    pos = F.col("__pos")
    for f in source.schema:
        p = profiles[f.name]
        if f.name in keys:
            out = out.withColumn(f.name, key_values(pos, f.dataType, f.name, seed))
            continue
        if p.kind == "categorical":
            out = out.withColumn("__u", unit(f"cat|{f.name}", pos, seed)).withColumn(f.name, categorical(F.col("__u"), p.values, p.shares, f.dataType)).drop("__u")
        elif p.kind == "token":
            out = out.withColumn(f.name, token(f"tok|{f.name}", pos, seed))
        elif p.kind in ("numeric", "datetime"):
            out = pooled(out, source, f.name, "__pos", seed)
        else:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
        out = with_nulls(out, f.name, p.null_share, "__pos", seed)
    return out.select(*[named(c) for c in source.columns])
