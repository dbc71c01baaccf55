"""Keys and references found in the data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import key_text, named
from .checks import reference_facts, stack

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED)]


def value_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_rows, n_most: the non-null values of each column of each table, and how often the most
    frequent one occurs. Values of all columns are told apart by two 64-bit hashes and counted in one shuffle, combined
    before it, so a column of few values costs next to nothing."""
    long = []
    for t, df in tables.items():
        each = [F.struct(F.lit(c).alias("column_name"), F.xxhash64(named(c)).alias("h"), F.xxhash64(F.lit(1), named(c)).alias("g"), named(c).isNotNull().alias("there")) for c in plain_columns(df)]
        # one more entry counts the rows
        rows = F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(True).alias("there"))
        long.append(df.select(F.explode(F.array(rows, *each)).alias("x")).where("x.there").select(F.lit(t).alias("table_name"), "x.column_name", "x.h", "x.g"))
    counted = stack(long).groupBy("table_name", "column_name", "h", "g").agg(F.count("*").alias("n"))
    return counted.groupBy("table_name", "column_name").agg(F.sum("n").alias("n_rows"), F.max("n").alias("n_most"))


def keys_of(tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """Columns of each table that alone are unique and never null, in the tables' order; one job for all."""
    facts = value_counts(tables).collect() if tables else []
    size = {r["table_name"]: r["n_rows"] for r in facts if r["column_name"] is None}
    found = {(r["table_name"], r["column_name"]) for r in facts if r["n_most"] == 1 and r["n_rows"] == size[r["table_name"]]}
    return {t: [c for c in plain_columns(df) if (t, c) in found] for t, df in tables.items()}


def unique_columns(df: DataFrame) -> list[str]:
    """Columns that alone are unique and never null."""
    return keys_of({"": df})[""]


def discover_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name of all single-column keys; names with ID come first in a table, then by name."""
    rows = [(t, c) for t, columns in keys_of(tables).items() for c in sorted(columns, key=lambda c: ("ID" not in c.upper(), c))]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table_name string, column_name string")


def key_ranges(tables: Mapping[str, DataFrame], keys: Mapping[str, str]) -> DataFrame:
    return stack([tables[t].agg(F.min(named(c)).cast("long").alias("min_key"), F.max(named(c)).cast("long").alias("max_key"), F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "*") for t, c in keys.items()])


def values_of(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (table_name, column_name, value as text) of columns, in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), key_text(c, df.schema[c].dataType).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.column_name", "x.value").count().select(F.lit(table).alias("table_name"), "column_name", "value")


def discover_references(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]], *, inclusion: float = 1.0, min_distinct: int = 5, min_coverage: float = 0.05) -> DataFrame:
    """Columns whose values all stand in some key column. Values of all columns meet once, in one equi-join on the
    value, and pairs of columns are counted, instead of one comparison a pair. Only columns with a shared value meet."""
    children = stack([values_of(t, df, c) for t, df in tables.items() if (c := [x for x in plain_columns(df) if x not in keys.get(t, [])])])
    parents = stack([values_of(t, tables[t], k) for t, k in keys.items() if k])
    sizes = lambda v, n: v.groupBy("table_name", "column_name").agg(F.count("*").alias(n))
    n_child = sizes(children, "n_distinct").where(F.col("n_distinct") >= min_distinct).select(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_col"), "n_distinct")
    n_parent = sizes(parents, "n_parent").select(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_col"), "n_parent")
    # one row a value: the few columns that have it, so a frequent value costs no more than it has columns
    held = children.groupBy("value").agg(F.collect_list(F.struct(F.col("table_name").alias("child_table"), F.col("column_name").alias("child_col"))).alias("c"))
    owned = parents.groupBy("value").agg(F.collect_list(F.struct(F.col("table_name").alias("parent_table"), F.col("column_name").alias("parent_col"))).alias("p"))
    both = held.join(owned, "value").select(F.explode("c").alias("c"), "p").select("c.*", F.explode("p").alias("p")).select("child_table", "child_col", "p.*")
    met = both.groupBy("child_table", "child_col", "parent_table", "parent_col").agg(F.count("*").alias("n"))
    found = met.join(n_child, ["child_table", "child_col"]).join(n_parent, ["parent_table", "parent_col"])
    ratio, cover = F.col("n") / F.col("n_distinct"), F.col("n") / F.col("n_parent")
    sure = F.when((cover >= 0.5) & (F.col("n_distinct") >= 20), "high").when(cover >= 0.2, "medium").otherwise("low")
    return found.where((ratio >= inclusion) & (cover >= min_coverage)).select("child_table", "child_col", "parent_table", "parent_col", F.round(ratio, 4).alias("inclusion"), "n_distinct", F.round(cover, 4).alias("coverage"), sure.alias("confidence"))


def resolve_conflicts(candidates: list[dict]) -> list[dict]:
    """Of candidate references the best first (match rate, fewer orphans); a child column is used once."""
    out, used = [], set()
    for c in sorted(candidates, key=lambda c: (-c["match_rate"], c["orphan_keys"], c["child_table"], tuple(c["columns"]))):
        taken = {(c["child_table"], x) for x in c["columns"]}
        if not taken & used:
            out.append(c)
            used |= taken
    return out


def value_differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column that only one side has."""
    left, right = (df.select(named(column)).dropna().distinct() for df in (a, b))
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def inclusion_of(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """inclusion, orphans, n_distinct, coverage of one declared reference (composite too)."""
    f = reference_facts(child, columns, parent, parent_columns)
    return f.select(F.when(F.col("distinct_keys") > 0, F.round(F.col("matched_keys") / F.col("distinct_keys"), 4)).alias("inclusion"), F.col("orphan_keys").alias("orphans"), F.col("distinct_keys").alias("n_distinct"), F.when(F.col("parent_keys") > 0, F.round(F.col("matched_keys") / F.col("parent_keys"), 4)).otherwise(0.0).alias("coverage"))
