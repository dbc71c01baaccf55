"""Comparison of an original and a synthetic set as a whole: what can be compared, how alike it is, and what could not be told."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import DATETIMES, named
from ..plans.model import ForeignKey, Specs
from . import metrics
from .checks import references, stack

log = logging.getLogger("kinforge")


def aligned(original: DataFrame, synthetic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns that they share, of one type: the type if it is the same, else double if both are
    numbers, timestamp if both are days or times, else text. Nothing becomes null silently."""
    a, b = [], []
    for f in original.schema:
        if f.name in synthetic.columns:
            x, y = f.dataType, synthetic.schema[f.name].dataType
            if x == y:
                kind = x
            elif isinstance(x, T.NumericType) and isinstance(y, T.NumericType):
                kind = T.DoubleType()
            elif isinstance(x, DATETIMES) and isinstance(y, DATETIMES):
                kind = T.TimestampType()
            else:
                kind = T.StringType()
            for side in (a, b):
                side.append(F.col(f"`{f.name}`").cast(kind).alias(f.name))
    return original.select(*a), synthetic.select(*b)


def metric_schema(tables: Mapping[str, DataFrame], specs: Specs) -> tuple[list[tuple[str, str, str]], list[tuple[str, ForeignKey]]]:
    """(table, column, role) of all columns, and the references that compare: one column, to a parent's whole key."""
    roles = [(t, f.name, metrics.role(f.dataType, f.name in specs[t].key)) for t, df in tables.items() if t in specs for f in df.schema]
    single = [(t, fk) for t, fk in references(specs) if len(fk.columns) == 1 and fk.parent in tables and t in tables and fk.parent_columns == specs[fk.parent].key]
    return roles, single


def preflight(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame], specs: Specs) -> DataFrame:
    """table_name, problem of what would stop a comparison: a missing or empty side, no common column, a reference
    whose column or parent is missing."""
    spark, rows = next(iter(original.values())).sparkSession, []
    for t in specs:
        sides = {"original": original.get(t), "synthetic": synthetic.get(t)}
        for side, df in sides.items():
            if df is None:
                rows.append((t, f"no {side} table"))
            elif df.isEmpty():
                rows.append((t, f"empty {side} table"))
        if all(df is not None for df in sides.values()) and not set(original[t].columns) & set(synthetic[t].columns):
            rows.append((t, "no common column"))
    for t, fk in references(specs):
        for side, tables in (("original", original), ("synthetic", synthetic)):
            if t in tables and (fk.parent not in tables or set(fk.columns) - set(tables[t].columns) or set(fk.parent_columns) - set(tables[fk.parent].columns)):
                rows.append((t, f"reference {fk} does not stand in the {side} set"))
    return spark.createDataFrame(rows, "table_name string, problem string")


def shape_score(shapes: DataFrame) -> DataFrame:
    """One number for all columns: the mean of the scores that could be told."""
    return shapes.agg(F.avg("score").alias("score"), F.count("score").alias("n_columns"))


def across_tables(original: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], fk: ForeignKey, column: str, parent_column: str) -> DataFrame:
    """Whether a child's column goes with its parent's column as it did: the pair metric over joined rows (1 is alike).
    Each side is (child, parent)."""
    on = list(zip(fk.columns, fk.parent_columns))

    def joined(child: DataFrame, parent: DataFrame) -> DataFrame:
        keys = [named(p).alias(f"__p{i}") for i, (_, p) in enumerate(on)]
        to = parent.select(*keys, named(parent_column).alias("y"))
        some = child.select(named(column).alias("x"), *[named(c).alias(f"__p{i}") for i, (c, _) in enumerate(on)])
        return some.join(to, [f"__p{i}" for i in range(len(on))]).select("x", "y")

    a, b = aligned(joined(*original), joined(*synthetic))
    spread = all(metrics.role(f.dataType, False) in ("numerical", "datetime") for f in a.schema)
    return metrics.pair_correlation(a, b, "x", "y") if spread else metrics.pair_contingency(a, b, "x", "y")


def quality_report(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame], specs: Specs) -> DataFrame:
    """property, object, score, note of tables' shapes and structure and of relationships. A property that fails is a
    row with no score and the reason as its note: the rest of the report stands.

    What a table's report consists of is told by one query. Only if this fails are its properties told one by one.
    """
    spark = next(iter(original.values())).sparkSession
    schema = "property string, object string, score double, note string"
    both = [t for t in specs if t in original and t in synthetic]
    parts: dict[str, list[tuple[str, str, Callable[[], DataFrame]]]] = {t: [] for t in both}
    for t in both:
        parts[t].append(("column_shapes", t, lambda t=t: shape_score(metrics.column_shapes(*aligned(original[t], synthetic[t]), set(specs[t].key)))))
        parts[t].append(("structure", t, lambda t=t: spark.range(1).select(F.lit(metrics.structure_score(original[t], synthetic[t])).alias("score"))))
    for t, fk in metric_schema(original, specs)[1]:
        side = lambda tables, t=t, fk=fk: (tables[fk.parent], fk.parent_columns[0], tables[t], fk.columns[0])
        parts.setdefault(t, []).append(("cardinality", f"{t} {fk}", lambda side=side: metrics.cardinality_similarity(side(original), side(synthetic))))
        parts[t].append(("referential_integrity", f"{t} {fk}", lambda t=t, fk=fk: metrics.referential_integrity(synthetic[t], fk.columns[0], synthetic[fk.parent], fk.parent_columns[0])))
    rows = [r for ps in parts.values() for r in _told(ps)]
    return spark.createDataFrame(rows, schema)


def _told(parts: list[tuple[str, str, Callable[[], DataFrame]]]) -> list[tuple[str, str, float | None, str | None]]:
    """Scores of properties (name, object, how it is scored), and why there is none."""
    try:
        asked = stack([score().select(F.lit(i).alias("i"), F.col("score").cast("double").alias("score")) for i, (_, _, score) in enumerate(parts)])
        scores = {r["i"]: r["score"] for r in asked.collect()}
    except Exception as e:
        reason = str(e).splitlines()[0][:200]
        if len(parts) > 1:
            return [r for p in parts for r in _told([p])]
        log.warning("%s of %s: %s", parts[0][0], parts[0][1], reason)
        return [(*parts[0][:2], None, reason)]
    return [(name, what, scores.get(i), None if scores.get(i) is not None else "nothing to compare") for i, (name, what, _) in enumerate(parts)]


def heads(original: DataFrame, synthetic: DataFrame, key: list[str], n: int = 5, seed: int = 42) -> DataFrame:
    """side and the shared columns, as text, of n rows of each side, drawn apart by a hash of the key."""
    shared = [c for c in original.columns if c in synthetic.columns]

    def some(df: DataFrame, side: str) -> DataFrame:
        order = F.xxhash64(F.lit(f"{seed}|{side}"), *key)
        return df.orderBy(order, *key).limit(n).select(F.lit(side).alias("side"), *[F.col(f"`{c}`").cast("string").alias(c) for c in shared])

    return some(original, "original").unionByName(some(synthetic, "synthetic"))


def distribution(original: DataFrame, synthetic: DataFrame, column: str, bins: int = 25, k: int = 8) -> DataFrame:
    """bucket, share_original, share_synthetic: of a number or time over the original's range, of anything else for the
    original's k most frequent values."""
    a, b = aligned(original.select(column), synthetic.select(column))
    if metrics.role(a.schema[column].dataType, False) in ("numerical", "datetime"):
        ends = metrics.ends_of(a, column)
        of = lambda df: metrics.histogram(df, column, bins, ends).select(F.col("bucket").cast("string").alias("bucket"), "n") if ends else df.select(F.lit("").alias("bucket"), F.lit(0).cast("long").alias("n")).limit(0)
        share = lambda df, name: df.join(F.broadcast(df.agg(F.sum("n").alias("t")))).select("bucket", (F.col("n") / F.col("t")).alias(name))
        return share(of(a), "share_original").join(share(of(b), "share_synthetic"), "bucket", "full").select("bucket", F.coalesce("share_original", F.lit(0.0)).alias("share_original"), F.coalesce("share_synthetic", F.lit(0.0)).alias("share_synthetic"))
    top = metrics.top_values(a, column, k).select(F.col("value").alias("bucket"), F.col("share").alias("share_original"))
    other = metrics.shares_of(b, column, [r["bucket"] for r in top.collect()]).select(F.col("value").alias("bucket"), F.col("share").alias("share_synthetic"))  # k values
    return top.join(other, "bucket", "left").select("bucket", "share_original", F.coalesce("share_synthetic", F.lit(0.0)).alias("share_synthetic"))
