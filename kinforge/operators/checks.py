"""Facts about keys: one aggregation per key, one join per foreign key; reports and the final gate read them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import all_null, any_null, key_text, named
from ..plans.model import ForeignKey, Specs

POLICIES = ("allow_any_null", "allow_all_null", "invalid_null")


def checked_rows(columns: Iterable[str], policy: str) -> Column:
    """Which child rows a policy checks: all without a null, all with some value, or all."""
    if policy == "allow_any_null":
        return ~any_null(columns)
    if policy == "allow_all_null":
        return ~all_null(columns)
    if policy == "invalid_null":
        return F.lit(True)
    raise ValueError(f"unknown policy {policy!r}")


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_facts(df: DataFrame, key: Iterable[str], not_null: Iterable[str] = ()) -> DataFrame:
    """total, distinct (null tuples count), null_rows, duplicates of a key, and the nulls of other columns (nulls0, ...),
    in one pass with map-side combining."""
    key, not_null = list(key), list(not_null)
    groups = df.groupBy(*[named(k) for k in key]).agg(F.count("*").alias("__n"), *[F.count_if(named(c).isNull()).alias(f"__nulls{i}") for i, c in enumerate(not_null)])
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(
        sum_of("__n").alias("total"),
        F.count("*").alias("distinct_keys"),
        sum_of(F.when(any_null(key), F.col("__n")).otherwise(0)).alias("null_rows"),
        sum_of(F.col("__n") - 1).alias("duplicates"),
        *[sum_of(f"__nulls{i}").alias(f"nulls{i}") for i in range(len(not_null))],
    )


def key_report(tables: Mapping[str, DataFrame], keys: Mapping[str, Iterable[str]]) -> DataFrame:
    rows = [key_facts(tables[t], k).select(F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("pk_cols"), "*") for t, k in keys.items()]
    ok = (F.col("total") > 0) & (F.col("null_rows") == 0) & (F.col("duplicates") == 0)
    return stack(rows).withColumn("is_valid", ok)


def same_type(child: DataFrame, columns: Iterable[str], parent: DataFrame, parent_columns: Iterable[str]) -> tuple[list[Column], list[Column]]:
    """Both sides' key columns in types that compare: as they are, or as text where the types differ."""
    a, b = [], []
    for c, p in zip(columns, parent_columns):
        kinds = child.schema[c].dataType, parent.schema[p].dataType
        same = kinds[0] == kinds[1]
        a.append(named(c) if same else key_text(c, kinds[0]))
        b.append(named(p) if same else key_text(p, kinds[1]))
    return a, b


def reference_facts(child: DataFrame, columns: Iterable[str], parent: DataFrame, parent_columns: Iterable[str], policy: str = "allow_any_null") -> DataFrame:
    """One row of facts about a foreign key: child_rows, null_rows (any null), checked_rows, distinct_keys,
    matched_keys, orphan_keys, orphan_rows, parent_keys. Keys are combined before they are joined."""
    columns, parent_columns = list(columns), list(parent_columns)
    a, b = same_type(child, columns, parent, parent_columns)
    names = [f"k{i}" for i in range(len(columns))]
    keys = child.select(*[c.alias(n) for c, n in zip(a, names)]).groupBy(*names).agg(F.count("*").alias("__n"))
    known = parent.select(*[c.alias(f"p{i}") for i, c in enumerate(b)]).where(~any_null([f"p{i}" for i in range(len(b))])).distinct()
    on = reduce(lambda x, y: x & y, [F.col(n) == F.col(f"p{i}") for i, n in enumerate(names)])
    joined = keys.join(known.withColumn("__found", F.lit(True)), on, "full")
    is_key, checked, orphan = F.col("__n").isNotNull(), checked_rows(names, policy), F.col("__found").isNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    rows = lambda c: F.coalesce(F.sum(F.when(c, F.col("__n")).otherwise(0)), F.lit(0)).cast("long")
    return joined.agg(
        rows(is_key).alias("child_rows"),
        rows(is_key & any_null(names)).alias("null_rows"),
        rows(is_key & checked).alias("checked_rows"),
        count(is_key & checked).alias("distinct_keys"),
        count(is_key & checked & ~orphan).alias("matched_keys"),
        count(is_key & checked & orphan).alias("orphan_keys"),
        rows(is_key & checked & orphan).alias("orphan_rows"),
        count(~orphan).alias("parent_keys"),
    )


def reference_report(tables: Mapping[str, DataFrame], references: list[tuple[str, ForeignKey]], policy: str = "allow_any_null") -> DataFrame:
    """Facts of many foreign keys; with a missing table or column the counts are -1 (never a silent pass)."""
    rows, spark = [], next(iter(tables.values())).sparkSession
    for child, fk in references:
        label = [F.lit(child).alias("child_table"), F.lit(",".join(fk.columns)).alias("fk_cols"), F.lit(fk.parent).alias("parent_table"), F.lit(",".join(fk.parent_columns)).alias("parent_cols")]
        c, p = tables.get(child), tables.get(fk.parent)
        if c is None or p is None or set(fk.columns) - set(c.columns) or set(fk.parent_columns) - set(p.columns):
            facts = spark.range(1).select(*[F.lit(-1).cast("long").alias(n) for n in ("child_rows", "null_rows", "checked_rows", "distinct_keys", "matched_keys", "orphan_keys", "orphan_rows", "parent_keys")])
        else:
            facts = reference_facts(c, fk.columns, p, fk.parent_columns, policy)
        rows.append(facts.select(*label, "*"))
    return stack(rows)


def references(specs: Specs) -> list[tuple[str, ForeignKey]]:
    return [(t, fk) for t, table in specs.items() for fk in table.foreign_keys]


def integrity(report: DataFrame) -> DataFrame:
    """Shares and a status from reference facts."""
    share = lambda n, of: F.when(of > 0, F.round(100 * n / of, 4)).otherwise(F.lit(0.0))
    valid = F.col("checked_rows") - F.col("orphan_rows")
    return report.select(
        "child_table", "fk_cols", "parent_table", "child_rows", "null_rows", share(F.col("null_rows"), F.col("child_rows")).alias("null_pct"), "orphan_rows",
        F.when(F.col("checked_rows") > 0, F.round(100 * valid / F.col("checked_rows"), 4)).otherwise(F.lit(100.0)).alias("valid_pct"),
        F.when(F.col("child_rows") < 0, "ERRO").when(F.col("orphan_rows") > 0, "FALHA").otherwise("OK").alias("status"),
    )


def within_tolerance(report: DataFrame, most: float) -> DataFrame:
    """Match rate and orphan ratio over distinct keys; valid if anything matches and few enough are orphans."""
    of = F.col("distinct_keys")
    ratio = lambda n: F.when(of > 0, F.round(n / of, 4)).otherwise(F.lit(0.0))
    valid = (F.col("matched_keys") > 0) & (F.col("orphan_keys") <= most * of)
    return report.select("child_table", "fk_cols", "parent_table", "distinct_keys", "matched_keys", "orphan_keys", ratio(F.col("matched_keys")).alias("match_rate"), ratio(F.col("orphan_keys")).alias("orphan_ratio"), valid.alias("is_valid"))


def reference_problems(report: DataFrame, most: float = 0.0) -> DataFrame:
    """Why a foreign key cannot be used: a missing table or column, no match at all, or more orphan keys than allowed.
    A key without any value to check is fine."""
    of = F.col("distinct_keys")
    reason = F.when(F.col("child_rows") < 0, "missing").when(of == 0, "ok").when(F.col("matched_keys") == 0, "no match").when(F.col("orphan_keys") > most * of, "orphans").otherwise("ok")
    return report.select("child_table", "fk_cols", "parent_table", "parent_cols", "distinct_keys", "orphan_keys", reason.alias("reason"))


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], policy: str = "allow_any_null") -> DataFrame:
    """Child rows whose key the parent lacks."""
    to = parent.select(*[named(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    on = reduce(lambda a, b: a & b, [child["`" + c + "`"] == to[f"__p{i}"] for i, c in enumerate(columns)])
    return child.where(checked_rows(columns, policy)).join(to, on, "left_anti")


def orphan_examples(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], n: int = 8) -> DataFrame:
    """The n most frequent orphan keys, then by key."""
    return orphans(child, columns, parent, parent_columns).groupBy(*columns).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), *columns).limit(n)


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, null_count, null_pct and total of every column, from one aggregation."""
    counts = df.agg(F.count("*").alias("__total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count")) for c in df.columns]))
    out = counts.select("__total", each.alias("c")).select("c.*", F.col("__total").alias("total"))
    return out.withColumn("null_pct", F.when(F.col("total") > 0, F.round(F.col("null_count") / F.col("total"), 6)).otherwise(0.0))


def never_null(df: DataFrame) -> DataFrame:
    """Columns of a non-empty table without a null."""
    return null_profile(df).where("total > 0 AND null_count = 0").select("column_name")


def gate(tables: Mapping[str, DataFrame], specs: Specs, not_null: Mapping[str, Iterable[str]] | None = None, expected: Iterable[str] = ()) -> DataFrame:
    """Every constraint with the number of its violations: check, object, violations (-1: cannot be verified)."""
    rows = []
    label = lambda check, what: [F.lit(check).alias("check"), F.lit(what).alias("object")]
    for name, table in specs.items():
        df, key = tables[name], f"{name}({','.join(table.key)})"
        columns = [c for c in dict.fromkeys([*table.not_null, *(not_null or {}).get(name, ())]) if c in df.columns and c not in table.key]
        found = [("null_key", key, F.col("null_rows")), ("duplicate_key", key, F.col("duplicates"))]
        if name in expected:
            found.append(("empty_output", key, (F.col("total") == 0).cast("long")))
        found += [("null_value", f"{name}.{c}", F.col(f"nulls{i}")) for i, c in enumerate(columns)]
        each = F.explode(F.array(*[F.struct(*label(check, what), n.alias("violations")) for check, what, n in found]))
        rows.append(key_facts(df, table.key, columns).select(each.alias("x")).select("x.*"))
    for child, fk in references(specs):
        facts = reference_report(tables, [(child, fk)])
        rows.append(facts.select(*label("orphan_rows", f"{child} {fk}"), F.col("orphan_rows").alias("violations")))
    return stack(rows)


def require(gate_report: DataFrame) -> None:
    """One error that names all violations."""
    bad = gate_report.where("violations <> 0").orderBy("check", "object").collect()
    if bad:
        raise RuntimeError("; ".join(f"{r['check']} {r['object']}: {'cannot be verified' if r['violations'] < 0 else r['violations']}" for r in bad))


def colliding_keys(made: DataFrame, made_key: list[str], existing: DataFrame, key: list[str]) -> DataFrame:
    """Keys of new rows that a target table already has."""
    to = existing.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    on = reduce(lambda a, b: a & b, [made[m] == to[f"__k{i}"] for i, m in enumerate(made_key)])
    return made.select(*made_key).join(to, on, "left_semi").distinct()


def existing_keys(name: str, made: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Keys of new rows that the table they are meant for already has, as a row of the gate."""
    n = colliding_keys(made, key, existing, key).agg(F.count("*").alias("violations"))
    return n.select(F.lit("existing_key").alias("check"), F.lit(f"{name}({','.join(key)})").alias("object"), "violations")


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
