"""From raw tables to a checked, written set: per group of related tables, sample, close, repair, multiply, gate, write."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.values import key_capacity
from ..operators.checks import existing_keys, gate, never_null, references, require, stack
from ..operators.closure import close_over_graph
from ..operators.dates import DEFAULT_DAYS
from ..operators.keys import key_start, largest_key
from ..operators.rows import freeze
from ..operators.sampling import capped, keep_referenced, repair, root_filter, top_up
from ..sources.readers import join_path, largest_from_footers, read_specs, read_table
from ..sources.writers import save_together
from .model import Problems, Specs, compile_specs, components, normalise, order, sanitise, target_rows
from .synthesis import Synthesis

log = logging.getLogger("kinforge")

# Names of environment variables, and what the command line starts from.
ENVIRONMENT = ("RAW_BASE", "SYNTHETIC_BASE", "SPECS_URI")
SCALE, MIN_ROWS, SEED, BAND = 2.0, 1000, 42, 0


@dataclass(frozen=True)
class Layout:
    raw: str
    out: str
    raw_prefix: str | None = None
    out_prefix: str | None = None
    root_column: str | None = None
    root_value: object = None
    #: Whether the value is asked of every table that has the column, or of tables without parents only.
    everywhere: bool = False

    def source(self, table: str) -> str:
        return join_path(self.raw, self.raw_prefix, table)

    def target(self) -> str:
        return join_path(self.out, self.out_prefix)


class Group:
    """The steps over one connected group of tables."""

    def __init__(self, spark: SparkSession, layout: Layout, specs: Specs, seed: int = SEED, full: Mapping[str, DataFrame] | None = None):
        """full: the tables, where they are not read from the layout."""
        self.spark, self.layout, self.specs, self.seed = spark, layout, specs, seed
        self.names, _ = order(specs)
        self.full = dict(full) if full is not None else {t: read_table(spark, layout.source(t)) for t in specs}

    def sample(self, limit: int | None, min_rows: int = MIN_ROWS) -> dict[str, DataFrame]:
        """Parents first; children keep rows whose parents were kept, up to a limit in key order, filled up to a floor."""
        out: dict[str, DataFrame] = {}
        for t in self.names:
            table = self.specs[t]
            df = root_filter(self.full[t], self.layout.root_column, self.layout.root_value, self.layout.everywhere or not table.foreign_keys)
            for fk in table.foreign_keys:
                if fk.parent in out and fk.parent != t:
                    df = keep_referenced(df, list(fk.columns), out[fk.parent], list(fk.parent_columns))
            df = df if table.static else capped(df, list(table.key), limit)
            out[t] = freeze(df) if limit is None or table.static else freeze(top_up(freeze(df), self.full[t], list(table.key), min(limit, min_rows)))
        return out

    def close(self, sampled: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Every row that the sample refers to, directly or not, is pulled in if it exists."""
        closed = close_over_graph(sampled, self.full, references(self.specs), self.names)
        return {t: freeze(df) for t, df in closed.items()}

    def not_null(self, tables: Mapping[str, DataFrame]) -> dict[str, set[str]]:
        """Declared columns, and those that never are null in the full data."""
        return {t: set(self.specs[t].not_null) | {r[0] for r in never_null(self.full[t]).collect()} for t in tables}

    def repaired(self, tables: dict[str, DataFrame], not_null: Mapping[str, set[str]], mode: str = "null") -> dict[str, DataFrame]:
        out = dict(tables)
        for t in self.names:
            table = self.specs[t]
            for fk in table.foreign_keys:
                nullable = [c for c in fk.columns if c not in not_null[t] and c not in table.key]
                out[t] = freeze(repair(out[t], list(fk.columns), out[fk.parent], list(fk.parent_columns), list(table.key), nullable, f"orphan|{t}|{','.join(fk.columns)}", mode, self.seed))
        return out

    def key_starts(self, rows: Mapping[str, int], band: int = BAND, floor: int = 0) -> dict[str, int]:
        """Where new keys start: above all keys of the unfiltered table."""
        out = {}
        for t, table in self.specs.items():
            kind = self.full[t].schema[table.key[-1]].dataType
            if not table.static:
                if kind.typeName() == "string":
                    largest = largest_key(self.full[t], table.key[-1])
                else:
                    largest = largest_from_footers(self.spark, self.layout.source(t), table.key[-1])
                start = key_start(None if largest is None else int(largest // 1), rows[t], kind, band=band, floor=floor)
                if start is not None:
                    limit = key_capacity(kind)
                    if limit is not None and start + rows[t] > limit:
                        log.warning("%s: %s new keys do not fit above %s", t, rows[t], start)
                    out[t] = start
        return out

    def collisions(self, made: Mapping[str, DataFrame]) -> list[DataFrame]:
        """Generated keys of text that the unfiltered table already has; numbers start above its largest key."""
        own = [t for t in self.specs.values() if not t.static and not any(t.shares_key(fk) for fk in t.foreign_keys)]
        return [existing_keys(t.name, made[t.name], self.full[t.name], list(t.key)) for t in own if self.full[t.name].schema[t.key[-1]].dataType.typeName() == "string"]

    def run(self, scale: float = SCALE, limit: int | None = None, min_rows: int = MIN_ROWS, band: int = BAND, floor: int = 0, days: int = DEFAULT_DAYS, check: bool = True) -> dict[str, str]:
        tables = self.close(self.sample(limit, min_rows))
        not_null = self.not_null(tables)
        tables = self.repaired(tables, not_null)
        counts = {t: df.count() for t, df in tables.items()}
        rows = target_rows(self.specs, counts, scale)
        made = Synthesis(tables, self.specs, rows, seed=self.seed, starts=self.key_starts(rows, band, floor), default_days=days).run()
        made = self.repaired({t: freeze(df) for t, df in made.items()}, not_null)
        if check:
            require(stack([gate(made, self.specs, not_null, [t for t in self.specs if counts[t]]), *self.collisions(made)]))
        return save_together(made, self.layout.target())


def columns_at(spark: SparkSession, layout: Layout, specs: Specs) -> dict[str, list[str]]:
    """Columns of the tables that can be read; the others fail with their group."""
    out = {}
    for t in specs:
        try:
            out[t] = read_table(spark, layout.source(t)).columns
        except AnalysisException as e:
            log.warning("%s: %s", t, str(e).splitlines()[0])
    return out


def run(spark: SparkSession, layout: Layout, config: Mapping[str, dict], *, seed: int = SEED, continue_on_error: bool = False, **options) -> dict[str, str]:
    """All groups; one that fails writes nothing, and stops the rest unless told to go on. Raises at the end if any failed.
    Foreign keys that the tables' columns rule out are left out with a warning."""
    problems = Problems()
    specs = compile_specs(normalise(config), problems=problems)
    specs = sanitise(specs, problems, columns_at(spark, layout, specs))
    written, failed = {}, []
    for names in components(specs):
        began = time.time()
        try:
            written |= Group(spark, layout, {t: specs[t] for t in names}, seed).run(**options)
            log.info("%s: %.1f s", ", ".join(names), time.time() - began)
        except Exception as e:
            log.error("%s: %s", ", ".join(names), e)
            failed.append(e)
            if not continue_on_error:
                break
        finally:
            spark.catalog.clearCache()
    if failed:
        raise RuntimeError(f"{len(failed)} group(s) failed") from failed[0]
    return written


def positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise argparse.ArgumentTypeError(f"{text} is not positive")
    return n


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kinforge", description=__doc__)
    p.add_argument("--scale-factor", type=float, default=SCALE)
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--continue-on-error", action="store_true")
    p.add_argument("--limit", type=positive)
    p.add_argument("--min-rows-per-table", type=positive, default=MIN_ROWS)
    p.add_argument("--pk-offset", type=int, default=0)
    p.add_argument("--pk-safety-band", type=int, default=BAND)
    p.add_argument("--dt-vencimento-prazo-dias", type=positive, default=DEFAULT_DAYS)
    p.add_argument("--skip-final-validation", action="store_true")
    p.add_argument("--root-filter", metavar="COLUMN=VALUE")
    p.add_argument("--filter-every-table", action="store_true")
    p.add_argument("--specs")
    return p.parse_args(argv)


def environment(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    if missing := [n for n in ENVIRONMENT[:2] if not env.get(n)]:
        raise SystemExit(f"set {', '.join(missing)}")
    return {n: env.get(n, "") for n in ENVIRONMENT}


def session(name: str = "kinforge", conf: Mapping[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC, which deletes checkpoints that nothing refers to any more; object
    store settings and sizes come in through conf."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a, env = arguments(argv), environment()
    spark = session()
    column, _, value = (a.root_filter or "").partition("=")
    layout = Layout(env["RAW_BASE"], env["SYNTHETIC_BASE"], root_column=column or None, root_value=value or None, everywhere=a.filter_every_table)
    try:
        run(spark, layout, read_specs(spark, a.specs or env["SPECS_URI"]), seed=a.seed, continue_on_error=a.continue_on_error, scale=a.scale_factor, limit=a.limit, min_rows=a.min_rows_per_table, band=a.pk_safety_band, floor=a.pk_offset, days=a.dt_vencimento_prazo_dias, check=not a.skip_final_validation)
    except Exception as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
