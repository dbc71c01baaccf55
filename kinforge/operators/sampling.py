"""Referential samples, row caps, and repair of orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw, unit
from ..functions.values import any_null, free_name, named
from .rows import freeze, number_rows

#: Up to so many rows, the first of each partition are merged in one task. Points of the sketch of a key, and its accuracy.
FEW, QUANTILES, ACCURACY = 100, 1000, 100_000


def _keys(parent: DataFrame, columns: list[str]) -> DataFrame:
    return parent.select(*[named(c).alias(f"__p{i}") for i, c in enumerate(columns)]).dropna().distinct()


def _on(child: DataFrame, columns: list[str], to: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [child["`" + c + "`"] == to[f"__p{i}"] for i, c in enumerate(columns)])


def keep_referenced(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child rows whose parent is there, and rows whose key has a null (they refer to nothing)."""
    to = _keys(parent, parent_columns)
    return child.where(~any_null(columns)).join(to, _on(child, columns, to), "left_semi").unionByName(child.where(any_null(columns)))


def _measure(column: str, kind: T.DataType) -> Column | None:
    """A number that never falls while a column rises (nulls as null); None for types that have none."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    if isinstance(kind, T.StringType):  # its first six bytes
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return None


def _near(keys: DataFrame, first: str, n: int) -> tuple[DataFrame, int] | None:
    """Rows among which the n-th lies, and how many rows precede them; None if there are no n rows. A sketch of the
    first column proposes a range, exact counts confirm it; if they do not, all rows are returned."""
    m = _measure(first, keys.schema[first].dataType)
    if m is None:
        return (keys, 0) if keys.count() >= n else None
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    facts = keys.agg(F.count("*").alias("total"), F.percentile_approx(m, points, ACCURACY).alias("q")).first()
    if facts["total"] < n:
        return None
    at = n * QUANTILES // facts["total"]
    low, high = ((facts["q"] or [None])[k] for k in (max(0, at - 2), min(QUANTILES, at + 3))) if facts["q"] else (None, None)
    if low is None or low != low or high != high:  # nothing but nulls; no order among NaN
        return keys, 0
    inside = (m >= low) & (m <= high)
    counts = keys.agg(F.count_if(m.isNull() | (m < low)).alias("before"), F.count_if(inside).alias("inside")).first()
    if counts["before"] < n <= counts["before"] + counts["inside"]:
        return keys.where(inside), counts["before"]
    return keys, 0


def capped(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n rows in key order, nulls first (all if n is None).

    For more than a FEW, no task sees n rows of every partition: the n-th key is found among keys alone (a sketch leaves
    a small range of them, and this is numbered), and rows up to it are a filter of the table.
    """
    if n is None:
        return df
    if n <= FEW:
        return df.orderBy(*[named(c) for c in order]).limit(n)
    keys = freeze(df.select(*[named(c) for c in order]))
    near = _near(keys, order[0], n)
    if near is None:
        return df
    some, before = near
    numbered = freeze(number_rows(some, order, "__at"))
    cut = numbered.where(F.col("__at") == n - before - 1).first()
    like = {c: F.lit(cut[c]).cast(df.schema[c].dataType) for c in order}
    same = reduce(lambda a, b: a & b, [named(c).eqNullSafe(v) for c, v in like.items()])
    ties = numbered.where(same).agg(F.min("__at").alias("first"), F.count("*").alias("n")).first()
    below, equal = F.lit(False), F.lit(True)
    for c, v in like.items():
        x = named(c)
        below = below | (equal & F.when(v.isNull(), F.lit(False)).otherwise(x.isNull() | (x < v)))
        equal = equal & x.eqNullSafe(v)
    wanted = n - before - ties["first"]
    if wanted == ties["n"]:
        return df.where(below | same)
    return df.where(below).unionByName(df.where(same).limit(wanted))  # rows that the order does not tell apart


def first_rows(df: DataFrame, subset: list[str], order: list[str], nulls_first: bool = True) -> DataFrame:
    """One row for each distinct subset of columns (nulls are alike): the first in an order. Rows that the order does not
    tell apart go by their other columns (but for maps), so the result does not depend on partitions. Rows are compared
    where they lie before the shuffle, so a frequent subset sends one row a task."""
    told = [f.name for f in df.schema if f.name not in order and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    keys = [named(c) for c in order] if nulls_first else [x for c in order for x in (named(c).isNull(), named(c))]
    by = F.struct(*[k.alias(f"__o{i}") for i, k in enumerate([*keys, *map(named, told)])])
    whole = F.struct(*[named(c) for c in df.columns])
    best = df.groupBy(*[named(c).alias(f"__g{i}") for i, c in enumerate(subset)]).agg(F.min_by(whole, by).alias("__row"))
    return best.select("__row.*")


def bounded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows, chosen by a hash of the key: the same ones whatever the partitioning."""
    name = free_name(df.columns, "__drawn")
    return capped(df.withColumn(name, F.xxhash64(F.lit(seed), *[named(c) for c in key])), [name, *key], n).drop(name)


def drawn(df: DataFrame, key: str, share: float, purpose: str, seed: int = 42) -> DataFrame:
    """A share of the rows, drawn by their key."""
    return df.where(unit(purpose, F.col(key), seed) < share)


def top_up(sample: DataFrame, full: DataFrame, key: list[str], wanted: int) -> DataFrame:
    """sample and, in key order, as many rows of full that it lacks as it takes to have wanted rows."""
    missing = wanted - sample.count()
    if missing <= 0:
        return sample
    to = _keys(sample, key)
    return sample.unionByName(capped(full.join(to, _on(full, key, to), "left_anti"), key, missing))


def missing_parents(child: DataFrame, columns: list[str], sample: DataFrame, full: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of the full parent table that children refer to and the sample lacks."""
    have = _keys(sample, parent_columns)
    wanted = child.select(*[named(c).alias(f"__p{i}") for i, c in enumerate(columns)]).dropna().distinct().join(have, [f"__p{i}" for i in range(len(columns))], "left_anti")
    return full.join(wanted, _on(full, parent_columns, wanted), "left_semi")


def close_over_parents(child: DataFrame, columns: list[str], sample: DataFrame, full: DataFrame, parent_columns: list[str]) -> DataFrame:
    return sample.unionByName(missing_parents(child, columns, sample, full, parent_columns).select(*[named(c) for c in sample.columns]))


def flag_orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], flag: str = "__orphan") -> DataFrame:
    """child with a flag on rows whose complete key the parent lacks; one join, no second scan."""
    to = _keys(parent, parent_columns).withColumn("__found", F.lit(True))
    joined = child.join(to, _on(child, columns, to), "left")
    return joined.withColumn(flag, F.col("__found").isNull() & ~any_null(columns)).select(*[named(c) for c in child.columns], flag)


def null_orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], nullable: list[str]) -> DataFrame:
    """Orphans lose the nullable columns of their foreign key."""
    lost = [c for c in columns if c in nullable]
    if not lost:
        raise ValueError(f"none of {columns} may be null; reassign instead")
    flagged = flag_orphans(child, columns, parent, parent_columns)
    return flagged.withColumns({c: F.when(~F.col("__orphan"), named(c)) for c in lost}).drop("__orphan")


def reassign_orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], row: list[str], purpose: str, seed: int = 42) -> DataFrame:
    """Orphans get one of all the parent's keys, drawn by their own key (row); without parents, unchanged."""
    known = number_rows(_keys(parent, parent_columns), [f"__p{i}" for i in range(len(parent_columns))], "__at")
    n = known.count()
    if not n:
        return child
    flagged = flag_orphans(child, columns, parent, parent_columns)
    at = F.when(F.col("__orphan"), draw(purpose, F.concat_ws("|", *[named(c).cast("string") for c in row]), n, seed))
    joined = flagged.withColumn("__at", at).join(known, "__at", "left")
    return joined.withColumns({c: F.when(F.col("__orphan"), F.col(f"__p{i}").cast(child.schema[c].dataType)).otherwise(named(c)) for i, c in enumerate(columns)}).select(*[named(c) for c in child.columns])


def repair(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], row: list[str], nullable: list[str], purpose: str, mode: str = "null", seed: int = 42) -> DataFrame:
    """Orphans made harmless: nulled where that is allowed and asked for, else given another parent. No row is lost."""
    if mode == "null" and any(c in nullable for c in columns):
        return null_orphans(child, columns, parent, parent_columns, nullable)
    return reassign_orphans(child, columns, parent, parent_columns, row, purpose, seed)


def bind_shared_key(child: DataFrame, key: list[str], parent: DataFrame, parent_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Children whose key is their parent's, paired one to one with parents in key order; children beyond the
    parents' number are left out. Also returns the map of old keys to new ones (__old_i, __new_i)."""
    known = number_rows(_keys(parent, parent_columns), [f"__p{i}" for i in range(len(parent_columns))], "__at")
    numbered = number_rows(child, key, "__at")
    bound = freeze(numbered.join(known, "__at"))
    olds, news = [F.col(k).alias(f"__old_{i}") for i, k in enumerate(key)], [F.col(f"__p{i}").alias(f"__new_{i}") for i in range(len(key))]
    pairs = bound.groupBy(*olds).agg(F.min(F.struct(*news)).alias("__to")).select(*[f"__old_{i}" for i in range(len(key))], "__to.*")
    out = bound.withColumns({k: F.col(f"__p{i}").cast(child.schema[k].dataType) for i, k in enumerate(key)})
    return out.select(*[named(c) for c in child.columns]), pairs


def translate(child: DataFrame, columns: list[str], pairs: DataFrame) -> DataFrame:
    """Foreign keys taken through a bind map; keys that it lacks stay."""
    on = reduce(lambda a, b: a & b, [child[c].eqNullSafe(pairs[f"__old_{i}"]) for i, c in enumerate(columns)])
    joined = child.join(pairs, on, "left").withColumn("__hit", reduce(lambda a, b: a | b, [F.col(f"__new_{i}").isNotNull() for i in range(len(columns))]))
    return joined.withColumns({c: F.when(F.col("__hit"), F.col(f"__new_{i}").cast(child.schema[c].dataType)).otherwise(named(c)) for i, c in enumerate(columns)}).select(*[named(c) for c in child.columns])


def compose(first: DataFrame, second: DataFrame, n: int = 1) -> DataFrame:
    """The bind map that does one map after another."""
    to = second.select(*[F.col(f"__old_{i}").alias(f"__via_{i}") for i in range(n)], *[F.col(f"__new_{i}").alias(f"__to_{i}") for i in range(n)])
    on = reduce(lambda a, b: a & b, [first[f"__new_{i}"].eqNullSafe(to[f"__via_{i}"]) for i in range(n)])
    return first.join(to, on, "left").select(*[f"__old_{i}" for i in range(n)], *[F.coalesce(f"__to_{i}", f"__new_{i}").alias(f"__new_{i}") for i in range(n)])


def root_filter(df: DataFrame, column: str | None, value: object, is_root: bool) -> DataFrame:
    """Rows with a value in a column of a root table (or whatever table is_root is said of); other tables, and tables
    without the column, stay."""
    return df.where(F.col(column) == F.lit(value)) if is_root and column in df.columns else df
