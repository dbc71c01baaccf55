"""A set of related tables multiplied: rows drawn, keys renewed, references rewritten."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import gate, reference_problems, reference_report, references, require
from ..operators.dates import DEFAULT_DAYS, rewrite_dates, run_time
from ..operators.keys import key_map, key_start, largest_key, new_key, remap, remap_self
from ..operators.rows import bootstrap, freeze, number_rows
from ..sources.writers import save_tables
from .model import ForeignKey, Hook, Problems, Specs, Table, compile_specs, levels, order, referenced, sanitise, target_rows, validate

#: A parent key that became more rows than this is joined by rank, not as an array.
WIDE = 1000
#: Tables made at the same time.
THREADS = 4


class Synthesis:
    """One run over a set of tables. Every choice is a hash of (seed, purpose, position)."""

    def __init__(self, tables: Mapping[str, DataFrame], specs: Specs, rows: Mapping[str, int], *, seed: int = 42, starts: Mapping[str, int] | None = None, append: bool = True, at: object = None, days: Mapping[str, int] | None = None, default_days: int = DEFAULT_DAYS, rewrite: bool = True):
        self.tables, self.specs, self.rows, self.seed = tables, specs, rows, seed
        self.starts, self.append, self.at = starts or {}, append, run_time(at)
        self.days, self.default_days, self.rewrite = days or {}, default_days, rewrite
        self.maps: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
        self.wide: dict[tuple[str, tuple[str, ...]], bool] = {}
        self.made: dict[str, DataFrame] = {}
        self.users: dict[tuple[str, tuple[str, ...]], set[str]] = {}
        for t in specs.values():
            for fk in t.foreign_keys:
                if fk.parent != t.name:
                    self.users.setdefault((fk.parent, fk.parent_columns), set()).add(t.name)

    def run(self) -> dict[str, DataFrame]:
        """Tables that do not depend on each other are made at the same time."""
        names, deferred = order(self.specs)
        late = {t: [fk for fk in self.specs[t].foreign_keys if (t, fk) in deferred] for t in names}
        wanted = referenced(self.specs)
        work: dict[str, DataFrame] = {}
        with ThreadPoolExecutor(THREADS) as pool:
            for level in levels(self.specs):
                made = pool.map(lambda t: self.make(self.specs[t], late[t], wanted.get(t, set())), level)
                work |= dict(zip(level, made))
                self.made |= {t: work[t].select(*self.tables[t].columns) for t in level}
                for t in level:
                    if not late[t]:
                        self.release(t)
        for name in names:
            for fk in late[name]:
                work[name] = freeze(self.rewrite_key(work[name], name, fk))
            self.release(name)
        return {t: work[t].select(*self.tables[t].columns) for t in names}

    def release(self, name: str) -> None:
        """Maps that no table needs any more are let go, and their files with them (see freeze)."""
        for key, users in self.users.items():
            users.discard(name)
            if not users:
                self.maps.pop(key, None)

    def make(self, table: Table, late: list[ForeignKey], wanted: set[tuple[str, ...]]) -> DataFrame:
        """A table's new rows, still with their positions and old keys; the maps that its children need are kept."""
        work = freeze(self.static(table) if table.static else self.multiply(table, late, wanted))
        for columns in wanted:
            mapping = freeze(key_map(work, [f"__old_{c}" for c in columns], list(columns), "__pos"))
            self.maps[table.name, columns] = mapping
            self.wide[table.name, columns] = (mapping.agg(F.max("count")).first()[0] or 0) > WIDE
        return work

    def dated(self, df: DataFrame, table: Table) -> DataFrame:
        days = table.maturity_days if table.maturity_days is not None else self.days.get(table.name)
        return rewrite_dates(df, self.at, days=days, default_days=self.default_days) if self.rewrite else df

    def hooked(self, df: DataFrame, table: Table) -> DataFrame:
        return table.hook(df, dict(self.made)) if table.hook else df

    def static(self, table: Table) -> DataFrame:
        """Rows as they are; each is its own only candidate."""
        source = number_rows(self.tables[table.name], list(table.key), "__pos")
        source = source.withColumns({f"__old_{c}": F.col(c) for c in source.columns if not c.startswith("__")})
        return self.dated(self.hooked(source, table), table)

    def multiply(self, table: Table, late: list[ForeignKey], wanted: set[tuple[str, ...]]) -> DataFrame:
        name, n = table.name, self.rows[table.name]
        source = self.tables[name]
        numbered = number_rows(source, list(table.key), "__row")
        work = bootstrap(numbered, n, numbered.count(), f"boot|{name}", keep_all=bool(wanted), seed=self.seed, row="__row", pos="__pos")
        olds = dict.fromkeys([*table.key, *(c for columns in wanted for c in columns), *(c for fk in table.foreign_keys for c in fk.columns)])
        work = freeze(work.withColumns({f"__old_{c}": F.col(c) for c in olds}))
        shared = [fk for fk in table.foreign_keys if table.shares_key(fk) and fk.parent != name and fk not in late]
        if shared:
            work = self.bound(work, table, shared[0])
        else:
            column = table.key[-1]
            kind = source.schema[column].dataType
            start = 0
            if self.append:
                start = self.starts.get(name)
                if start is None:
                    start = key_start(largest_key(source, column), n, kind) or 0
            work = work.withColumn(column, new_key(F.col("__pos"), column, kind, start + 1, n))
        for fk in table.foreign_keys:
            if fk.parent == name:
                own = key_map(work, [f"__old_{c}" for c in fk.parent_columns], list(fk.parent_columns), "__pos")
                work = remap_self(work, list(fk.columns), [f"__old_{c}" for c in fk.parent_columns], list(fk.parent_columns), own, self.purpose(name, fk), pos="__pos", seed=self.seed)
            elif fk not in late and fk not in shared[:1]:
                work = self.rewrite_key(work, name, fk)
        return self.dated(self.hooked(work, table), table)

    def purpose(self, name: str, fk: ForeignKey) -> str:
        return f"fk|{name}|{','.join(fk.columns)}"

    def rewrite_key(self, work: DataFrame, name: str, fk: ForeignKey) -> DataFrame:
        key = fk.parent, fk.parent_columns
        return remap(work, list(fk.columns), self.maps[key], self.purpose(name, fk), pos="__pos", seed=self.seed, wide=self.wide[key])

    def bound(self, work: DataFrame, table: Table, fk: ForeignKey) -> DataFrame:
        """A child that shares its parent's key: rows and new parents pair one to one, by position. No row looks a
        new key up among old ones."""
        parents = self.maps[fk.parent, fk.parent_columns].select(*[F.col(f"new_{i}").alias(f"__key_{i}") for i in range(len(fk.columns))])
        numbered = number_rows(parents.distinct(), [f"__key_{i}" for i in range(len(fk.columns))], "__at")
        joined = work.join(numbered, F.col("__pos") == F.col("__at"))
        return joined.withColumns({c: F.col(f"__key_{i}").cast(work.schema[c].dataType) for i, c in enumerate(fk.columns)}).drop("__at", *[f"__key_{i}" for i in range(len(fk.columns))])


def sanitise_by_data(specs: Specs, tables: Mapping[str, DataFrame], problems: Problems, most: float = 0.0, policy: str = "allow_any_null") -> Specs:
    """Specs without foreign keys that the data contradict: none of their keys has a parent, or more than a share lack one."""
    if not references(specs):
        return specs
    found = reference_problems(reference_report(tables, references(specs), policy), most).where("reason <> 'ok'").collect()  # one row a foreign key
    bad = {(r["child_table"], r["fk_cols"], r["parent_table"], r["parent_cols"]): f"{r['reason']} ({r['orphan_keys']} of {r['distinct_keys']} keys are orphans)" for r in found}
    out: Specs = {}
    for name, table in specs.items():
        kept = []
        for fk in table.foreign_keys:
            why = bad.get((name, ",".join(fk.columns), fk.parent, ",".join(fk.parent_columns)))
            if why:
                problems.add(f"{name} {fk}: {why}")
            else:
                kept.append(fk)
        out[name] = replace(table, foreign_keys=tuple(kept))
    return out


def synthesise(tables: Mapping[str, DataFrame], config: Mapping[str, dict] | Specs, *, scale: float = 2.0, rows: Mapping[str, int] | None = None, hooks: Mapping[str, Hook] | None = None, policy: str = "warn", check_references: bool = False, check: bool = True, save_to: str | None = None, save_format: str = "parquet", save_mode: str = "overwrite", **options) -> dict[str, DataFrame]:
    """From tables and a spec to new tables, checked, and saved if asked. check_references: foreign keys that the data
    contradict are left out (or raise, as the policy says)."""
    problems = Problems(policy)
    specs = dict(config) if all(isinstance(t, Table) for t in config.values()) else compile_specs(config, hooks, problems)
    specs = sanitise(specs, problems, {t: df.columns for t, df in tables.items()})
    validate(specs, tables)
    if check_references:
        specs = sanitise_by_data(specs, tables, problems)
    counts = {t: tables[t].count() for t in specs}
    made = Synthesis(tables, specs, {**target_rows(specs, counts, scale), **(rows or {})}, **options).run()
    if check:
        require(gate(made, specs, expected=[t for t in specs if counts[t]]))
    if save_to:
        save_tables(made, save_to, fmt=save_format, mode=save_mode)
    return made


