"""How alike two tables are: shapes of columns, pairs of columns, and relationships."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.values import DATETIMES, any_null, named
from .checks import stack

#: Parts between quantiles, and cells of a part.
QUANTILES, CELLS = 32, 32


def _epoch(df: DataFrame, column: str) -> Column:
    """A numeric or datetime column as a double."""
    if isinstance(df.schema[column].dataType, DATETIMES):
        return F.unix_timestamp(named(column).cast("timestamp")).cast("double")
    return named(column).cast("double")


def _series(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """series, v: named expressions of one type over all rows, in one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), c.alias("v")) for n, c in values.items()]))
    return df.select(each.alias("x")).select("x.series", "x.v")


def _counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """series, v, a, b: how often both sides have each value, from one shuffle of counts that were combined before it."""
    side = lambda df, x, y: df.select("series", "v", F.lit(x).alias("a"), F.lit(y).alias("b"))
    return side(a, 1, 0).unionByName(side(b, 0, 1)).where("v is not null").groupBy("series", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def ks_by_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """series, score: 1 - the two-sample Kolmogorov-Smirnov distance of non-null values (series, v as doubles) of each
    series; null if a side has none. Series without any value on either side are left out.

    Counts by distinct value are cut at quantiles and between these into cells of equal width; sums over cells start
    the running sums inside each cell, so the ordered windows are many, no task sees all values of a series, and a few
    extreme values crowd one part between quantiles at most.
    """
    counts = _counts(a, b).where("not isnan(v)")
    cuts = F.percentile_approx("v", [k / QUANTILES for k in range(1, QUANTILES)], 1000)
    ends = counts.groupBy("series").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb"), cuts.alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    edges = F.concat(F.array("lo"), "cuts", F.array("hi"))
    placed = counts.join(F.broadcast(ends), "series").withColumn("part", part).withColumns({"low": F.get(edges, F.col("part")), "high": F.get(edges, F.col("part") + 1)})  # one row a series
    inner = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS), F.lit(CELLS - 1))).otherwise(0)
    celled = placed.select("series", "v", "a", "b", "na", "nb", (F.col("part") * CELLS + inner).alias("cell"))
    cells = celled.groupBy("series", "cell").agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    before = W.partitionBy("series").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select("series", "cell", F.coalesce(F.sum("ca").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("cb").over(before), F.lit(0)).alias("sb"))
    inside = W.partitionBy("series", "cell").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    run = celled.join(starts, ["series", "cell"]).select("series", "na", "nb", (F.col("sa") + F.sum("a").over(inside)).alias("ra"), (F.col("sb") + F.sum("b").over(inside)).alias("rb"))
    gap = F.max(F.abs(F.col("ra") / F.nullif("na", F.lit(0)) - F.col("rb") / F.nullif("nb", F.lit(0))))
    return run.groupBy("series").agg((1 - gap).alias("score"))


def tv_by_series(a: DataFrame, b: DataFrame) -> DataFrame:
    """series, score: 1 - half the summed distance of the shares of each value (series, v); null if a side has none."""
    counts = _counts(a, b)
    total = counts.groupBy("series").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shares = counts.join(F.broadcast(total), "series")  # one row a series
    return shares.groupBy("series").agg((1 - F.sum(F.abs(F.col("a") / F.nullif("ta", F.lit(0)) - F.col("b") / F.nullif("tb", F.lit(0)))) / 2).alias("score"))


def ks_complement(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """One score of one pair of columns."""
    return ks_by_series(_series(a, {"": _epoch(a, column_a)}), _series(b, {"": _epoch(b, column_b)})).agg(F.max("score").alias("score"))


def tv_complement(a: DataFrame, columns_a: list[str], b: DataFrame, columns_b: list[str]) -> DataFrame:
    """One score of the categories (or tuples of categories) of two sides; nulls do not count."""
    tuples = lambda df, columns: df.select(F.lit("").alias("series"), F.when(~any_null(columns), F.array(*[named(c).cast("string") for c in columns])).alias("v"))
    return tv_by_series(tuples(a, columns_a), tuples(b, columns_b)).agg(F.max("score").alias("score"))


def role(kind: T.DataType, is_key: bool) -> str:
    if is_key:
        return "id"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, DATETIMES):
        return "datetime"
    return "numerical" if isinstance(kind, T.NumericType) else "categorical"


def column_shapes(a: DataFrame, b: DataFrame, keys: set[str] = frozenset()) -> DataFrame:
    """column_name, metric and score of each shared column that is no key; all columns of a kind in one pass."""
    kinds = {f.name: role(f.dataType, f.name in keys) for f in a.schema if f.name in b.columns and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
    spread = [c for c, k in kinds.items() if k in ("numerical", "datetime")]
    labels = [c for c, k in kinds.items() if k in ("boolean", "categorical")]
    names = [(c, "KSComplement") for c in spread] + [(c, "TVComplement") for c in labels]
    base = a.sparkSession.createDataFrame(names, "column_name string, metric string")
    scores = []
    if spread:
        scores.append(ks_by_series(*[_series(df, {c: _epoch(df, c) for c in spread}) for df in (a, b)]))
    if labels:
        scores.append(tv_by_series(*[_series(df, {c: named(c).cast("string") for c in labels}) for df in (a, b)]))
    if not scores:
        return base.withColumn("score", F.lit(None).cast("double"))
    return base.join(stack(scores).withColumnRenamed("series", "column_name"), "column_name", "left").select("column_name", "metric", "score")


def worst(shapes: DataFrame, n: int = 10) -> DataFrame:
    return shapes.orderBy("score", "column_name").limit(n)


def fan_out(child: DataFrame, columns: list[str]) -> DataFrame:
    """Children of each parent key that has any."""
    return child.where(~any_null(columns)).groupBy(*[named(c) for c in columns]).agg(F.count("*").alias("n"))


def fan_out_stats(child: DataFrame, columns: list[str]) -> DataFrame:
    return fan_out(child, columns).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n"), F.percentile("n", 0.5).alias("median_n"))


def children_per_parent(parent: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """Child counts of all parents, zeros too."""
    counts = child.where(named(column).isNotNull()).groupBy(named(column).alias("__k")).agg(F.count("*").alias("n"))
    return parent.join(counts, named(key) == F.col("__k"), "left").select(named(key), F.coalesce("n", F.lit(0)).alias("n"))


def cardinality_similarity(original: tuple[DataFrame, str, DataFrame, str], synthetic: tuple[DataFrame, str, DataFrame, str]) -> DataFrame:
    """KS complement of child counts; each side is (parent, key, child, column)."""
    return ks_complement(children_per_parent(*original), "n", children_per_parent(*synthetic), "n")


def cardinality_boundary(original: tuple[DataFrame, str, DataFrame, str], synthetic: tuple[DataFrame, str, DataFrame, str]) -> DataFrame:
    """Share of synthetic parents whose child count lies in the original's range."""
    ends = children_per_parent(*original).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return children_per_parent(*synthetic).join(F.broadcast(ends)).agg(F.avg(F.col("n").between(F.col("lo"), F.col("hi")).cast("double")).alias("score"))


def referential_integrity(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Share of children with a parent, of those with a key."""
    to = parent.select(named(key).alias("__k")).distinct()
    return child.where(named(column).isNotNull()).join(to, named(column) == F.col("__k"), "left").agg(F.avg(F.col("__k").isNotNull().cast("double")).alias("score"))


def pair_correlation(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """1 - half the difference of Pearson's correlations."""
    of = lambda df, n: df.agg(F.corr(_epoch(df, x), _epoch(df, y)).alias(n))
    return of(a, "ra").join(F.broadcast(of(b, "rb"))).select((1 - F.abs(F.col("ra") - F.col("rb")) / 2).alias("score"))


def pair_contingency(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    return tv_complement(a, [x, y], b, [x, y])


def validity(original: DataFrame, synthetic: DataFrame, keys: set[str] = frozenset()) -> DataFrame:
    """column_name, score: share of synthetic values inside the original's range or set of categories; of a key, of
    unique values."""
    rows = []
    for f in original.schema:
        if f.name not in synthetic.columns:
            continue
        kind, c = role(f.dataType, f.name in keys), named(f.name)
        if kind == "id":
            found = synthetic.groupBy(c).agg(F.count("*").alias("n")).agg((F.count("*") / F.sum("n")).alias("score"))
        elif kind in ("numerical", "datetime"):
            ends = original.agg(F.min(_epoch(original, f.name)).alias("lo"), F.max(_epoch(original, f.name)).alias("hi"))
            found = synthetic.where(c.isNotNull()).select(_epoch(synthetic, f.name).alias("v")).join(F.broadcast(ends)).agg(F.avg(F.col("v").between(F.col("lo"), F.col("hi")).cast("double")).alias("score"))
        else:
            known = original.select(c.cast("string").alias("__k")).distinct()
            found = synthetic.where(c.isNotNull()).groupBy(c.cast("string").alias("v")).agg(F.count("*").alias("n")).join(known, F.col("v") == F.col("__k"), "left").agg((F.sum(F.when(F.col("__k").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
        rows.append(found.select(F.lit(f.name).alias("column_name"), "score"))
    return stack(rows)


def structure_score(original: DataFrame, synthetic: DataFrame) -> float:
    """Overlap of (column, type) sets."""
    a, b = set(map(tuple, original.dtypes)), set(map(tuple, synthetic.dtypes))
    return len(a & b) / len(a | b) if a | b else 1.0


def volumes(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame]) -> DataFrame:
    """Rows on both sides and their ratio."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [n(original[t], "n_original").join(F.broadcast(n(synthetic[t], "n_synthetic"))).select(F.lit(t).alias("table_name"), "*") for t in original if t in synthetic]
    return stack(rows).withColumn("factor", F.round(F.col("n_synthetic") / F.nullif("n_original", F.lit(0)), 4))


def ends_of(df: DataFrame, column: str) -> tuple[float, float] | None:
    """A column's least and greatest value as numbers; None if it has none."""
    r = df.agg(F.min(_epoch(df, column)).alias("lo"), F.max(_epoch(df, column)).alias("hi")).first()
    return None if r["lo"] is None else (r["lo"], r["hi"])


def histogram(df: DataFrame, column: str, bins: int = 25, ends: tuple[float, float] | None = None) -> DataFrame:
    """bucket, n: counts in bins of equal width over the column's range or given ends; values outside are clamped."""
    values = df.select(_epoch(df, column).alias("v")).where("v is not null")
    over = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")) if ends is None else df.sparkSession.range(1).select(F.lit(float(ends[0])).alias("lo"), F.lit(float(ends[1])).alias("hi"))
    at = F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    return values.join(F.broadcast(over)).where("hi > lo").groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The k most frequent values (ties by value) with counts and shares of non-null rows."""
    counts = df.where(named(column).isNotNull()).groupBy(named(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "value").limit(k)


def shares_of(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Shares of given values among non-null rows."""
    c = named(column).cast("string")
    total = df.agg(F.count(named(column)).alias("t"))
    return df.where(c.isin(values)).groupBy(c.alias("value")).agg(F.count("*").alias("n")).join(F.broadcast(total)).select("value", (F.col("n") / F.col("t")).alias("share"))


def chosen_columns(df: DataFrame, k: int) -> list[str]:
    """Up to k columns, in turn categorical, numerical, datetime."""
    kinds: dict[str, list[str]] = {"categorical": [], "numerical": [], "datetime": []}
    for f in df.schema:
        kinds["categorical" if (r := role(f.dataType, False)) == "boolean" else r].append(f.name)
    out: list[str] = []
    while len(out) < k and any(kinds.values()):
        for names in kinds.values():
            if names and len(out) < k:
                out.append(names.pop(0))
    return out


def business_breaks(df: DataFrame, value: str, quantity: str, price: str, tolerance: float = 0.01) -> DataFrame:
    """Rows whose value is not quantity times price."""
    return df.where(F.abs(named(value) - named(quantity) * named(price)) > tolerance)


def order_breaks(child: DataFrame, column: str, child_time: str, parent: DataFrame, key: str, parent_time: str) -> DataFrame:
    """Child rows that are earlier than their parent."""
    to = parent.select(named(key).alias("__k"), named(parent_time).alias("__t"))
    return child.join(to, named(column) == F.col("__k")).where(named(child_time) < F.col("__t")).select(*[named(c) for c in child.columns])
