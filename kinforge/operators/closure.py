"""Closure of a sample over foreign keys: whatever its rows refer to, directly or not, is pulled in.

Only columns that references use take part until the end, when the rows found are read once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import ForeignKey
from .rows import freeze

Reference = tuple[str, ForeignKey]
#: Additions to a table's rows after which they are written as one.
UNIONS = 8


def _as_keys(df: DataFrame, columns: list[str], like: DataFrame, names: list[str], prefix: str = "__k") -> DataFrame:
    """Columns under the names __k0, __k1, ... and in the types of a table's own key columns."""
    return df.select(*[F.col(f"`{c}`").cast(like.schema[n].dataType).alias(f"{prefix}{i}") for i, (c, n) in enumerate(zip(columns, names))])


def reached(start: DataFrame, steps: DataFrame) -> DataFrame:
    """start (__k0, ...) and all keys that steps (__k0, ... -> __u0, ...) lead to from there, cycles included.

    By pointer doubling: in round i keys at distances up to 2^i are known, and steps lead 2^i keys on. So a chain of n
    keys takes about log2(n) rounds; steps that lead nowhere drop out of each round. Steps to a key of start are left out
    first (what lies behind it is found from there), so n is the longest way without such a key, and steps soon run out.
    """
    ks = [c for c in start.columns]
    us = [f"__u{i}" for i in range(len(ks))]
    have = freeze(start.dropna().distinct())
    steps = freeze(steps.dropna().distinct().join(have.select(*[F.col(k).alias(u) for k, u in zip(ks, us)]), us, "left_anti"))
    n = have.count()
    while n:
        on = have.join(steps, ks).select(*[F.col(u).alias(k) for u, k in zip(us, ks)])
        more = freeze(have.unionByName(on).distinct())
        found = more.count()
        if found == n:
            break
        have, n = more, found
        further = steps.select(*[F.col(k).alias(u) for k, u in zip(ks, us)], *[F.col(u).alias(f"__v{i}") for i, u in enumerate(us)])
        steps = freeze(steps.join(further, us).select(*ks, *[F.col(f"__v{i}").alias(u) for i, u in enumerate(us)]).distinct())
    return have


def pulled(child: DataFrame, columns: list[str], have: DataFrame, full: DataFrame, parent_columns: list[str], through: bool = False) -> DataFrame:
    """Rows of full that child refers to and that have lacks; through: and what these rows refer to by the same columns.

    through needs have to hold what its rows refer to, but for those of child: their links are not followed again.
    """
    ks = [f"__k{i}" for i in range(len(columns))]
    wanted = _as_keys(child, columns, full, parent_columns).dropna().distinct()
    if through:
        links, known = (df.select(*_columns(df, parent_columns, "__k"), *[F.col(f"`{c}`").cast(full.schema[p].dataType).alias(f"__u{i}") for i, (c, p) in enumerate(zip(columns, parent_columns))]) for df in (full, have))
        wanted = reached(wanted, links.join(known, links.columns, "left_anti"))
    lacking = wanted.join(have.select(*_columns(have, parent_columns, "__k")), ks, "left_anti")
    on = reduce(lambda a, b: a & b, [full[f"`{p}`"] == lacking[k] for p, k in zip(parent_columns, ks)])
    return full.join(lacking, on, "left_semi")


def _columns(df: DataFrame, columns: list[str], prefix: str):
    return [F.col(f"`{c}`").alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def close_over_self(sample: DataFrame, columns: list[str], full: DataFrame, parent_columns: list[str]) -> DataFrame:
    """sample and all the rows of its own table that it refers to, directly or not, however long the chain."""
    return sample.unionByName(pulled(sample, columns, sample, full, parent_columns, through=True).select(*[f"`{c}`" for c in sample.columns]))


def close_over_graph(sampled: Mapping[str, DataFrame], full: Mapping[str, DataFrame], references: list[Reference], order: list[str]) -> dict[str, DataFrame]:
    """Every table with the rows that any reference leads to from the sample.

    A work list of rows that are new to a table: their self references are closed first, then what they refer to in
    other tables is new there. Tables are taken from the end of order (children after parents), so without cycles each
    is taken once; with cycles it goes on until nothing is new. The result is the least set closed over all references,
    whatever their order.
    """
    used = {t: list(dict.fromkeys(c for child, fk in references for name, cs in ((child, fk.columns), (fk.parent, fk.parent_columns)) if name == t for c in cs)) for t in sampled}
    references = [(t, fk) for t, fk in references if t in sampled and fk.parent in sampled]
    slim = lambda t, df: df.select(*[f"`{c}`" for c in used[t]]).distinct()
    have = {t: freeze(slim(t, df)) for t, df in sampled.items() if used[t]}
    new, added = dict(have), {t: [] for t in have}

    def add(t: str, rows: DataFrame) -> bool:
        rows = freeze(slim(t, rows))
        if rows.isEmpty():
            return False
        added[t].append(rows)
        have[t] = have[t].unionByName(rows)
        new[t] = new[t].unionByName(rows) if t in new else rows
        if not len(added[t]) % UNIONS:  # all parts are written already; only plans would grow
            have[t], new[t] = freeze(have[t]), freeze(new[t])
        return True

    while new:
        t = max(new, key=order.index)
        own = [fk for child, fk in references if child == t == fk.parent]
        # several self references may lead on from each other's rows
        more = True
        while more:
            more = any([add(t, pulled(new[t], list(fk.columns), have[t], full[t], list(fk.parent_columns), through=True)) for fk in own]) and len(own) > 1
        rows = new.pop(t)
        for child, fk in references:
            if child == t != fk.parent:
                add(fk.parent, pulled(rows, list(fk.columns), have[fk.parent], full[fk.parent], list(fk.parent_columns)))
    return {t: _with(df, full[t], added.get(t, []), used[t]) for t, df in sampled.items()}


def _with(sample: DataFrame, full: DataFrame, added: list[DataFrame], columns: list[str]) -> DataFrame:
    if not added:
        return sample
    to = reduce(DataFrame.unionByName, added).select(*_columns(added[0], columns, "__a"))
    on = reduce(lambda a, b: a & b, [full[f"`{c}`"].eqNullSafe(to[f"__a{i}"]) for i, c in enumerate(columns)])
    return sample.unionByName(full.join(to, on, "left_semi").select(*[f"`{c}`" for c in sample.columns]))
