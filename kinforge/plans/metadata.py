"""Specs from a table of metadata: trusted as it stands, or proved on the data first."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import cleaned, truthy
from ..operators.checks import key_facts, reference_facts
from ..operators.discovery import resolve_conflicts, unique_columns

# The columns of a metadata table.
COLUMNS = ("TABLE_NAME", "COLUMN_NAME", "IS_PRIMARY_KEY", "IS_FOREIGN_KEY", "FK_REF_TABLE", "FK_REF_COLUMN", "COLUMN_ID", "IS_INDEXED", "DATA_TYPE")
CONFIDENT = 0.55
Proposals = Callable[[dict[str, list[str]], list[dict]], list[dict]]


def candidates(metadata: DataFrame) -> DataFrame:
    """table_name, column_name, position, is_pk, is_fk, ref_table, ref_column: cleaned metadata, one row a column."""
    have = {c.upper(): c for c in metadata.columns}
    if missing := [c for c in ("TABLE_NAME", "COLUMN_NAME") if c not in have]:
        raise ValueError(f"metadata lacks {missing}")
    of = lambda c: F.col(have[c]) if c in have else F.lit(None).cast("string")
    is_fk = truthy(of("IS_FOREIGN_KEY")) & cleaned(of("FK_REF_TABLE")).isNotNull()
    out = metadata.select(
        F.substring_index(cleaned(of("TABLE_NAME")), ".", -1).alias("table_name"),
        cleaned(of("COLUMN_NAME")).alias("column_name"),
        of("COLUMN_ID").try_cast("int").alias("position"),
        truthy(of("IS_PRIMARY_KEY")).alias("is_pk"),
        is_fk.alias("is_fk"),
        F.when(is_fk, F.substring_index(cleaned(of("FK_REF_TABLE")), ".", -1)).alias("ref_table"),
        F.when(is_fk, cleaned(of("FK_REF_COLUMN"))).alias("ref_column"),
    )
    return out.where("table_name is not null and column_name is not null").distinct()


def constraint_columns(metadata: DataFrame, table: str, column: str) -> DataFrame:
    """Where one foreign key column points to and whether that is the parent's key: a self-join of the metadata."""
    c = candidates(metadata)
    child = c.where((F.col("table_name") == table) & (F.col("column_name") == column) & F.col("is_fk"))
    parent = c.select(F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), F.col("is_pk").alias("ref_is_pk"))
    return child.select("table_name", "column_name", "ref_table", "ref_column").join(parent, ["ref_table", "ref_column"], "left")


def _rows(metadata: DataFrame) -> dict[str, list]:
    tables: dict[str, list] = {}
    for r in candidates(metadata).collect():  # as many rows as there are columns
        tables.setdefault(r["table_name"], []).append(r)
    return {t: sorted(rows, key=lambda r: (r["position"] is None, r["position"] or 0, r["column_name"])) for t, rows in sorted(tables.items())}


def trusted_specs(metadata: DataFrame, on_missing_key: str = "drop") -> dict[str, dict]:
    """A spec dict from metadata alone; the first reference of a column counts. Tables without a key are dropped or raise."""
    out: dict[str, dict] = {}
    tables = _rows(metadata)
    for t, rows in tables.items():
        key = [r["column_name"] for r in rows if r["is_pk"]]
        if not key:
            if on_missing_key == "raise":
                raise ValueError(f"{t}: no primary key in the metadata")
            continue
        fks, used = [], set()
        for r in rows:
            if r["is_fk"] and r["column_name"] not in used and r["ref_table"] in tables:
                used.add(r["column_name"])
                parent_key = [x["column_name"] for x in tables[r["ref_table"]] if x["is_pk"]]
                to = r["ref_column"] or (parent_key[0] if len(parent_key) == 1 else None)
                if to:
                    fks.append({"columns": [r["column_name"]], "parent_table": r["ref_table"], "parent_columns": [to]})
        out[t] = {"pk_cols": key, "foreign_keys": fks}
    for table in out.values():
        table["foreign_keys"] = [f for f in table["foreign_keys"] if f["parent_table"] in out]
    return out


def resolve_name(name: str, tables: Mapping[str, DataFrame]) -> str | None:
    """A table's name, case aside."""
    return name if name in tables else next((t for t in tables if t.lower() == name.lower()), None)


def proved_specs(metadata: DataFrame, tables: Mapping[str, DataFrame], *, max_orphan_ratio: float = 0.0, propose: Proposals | None = None) -> tuple[dict[str, dict], list[dict]]:
    """A spec dict of what metadata claims and data confirm, and a report of every decision.

    Keys that fail are replaced by a single unique column if there is one. References must match something and have
    few enough orphans. For columns left over a source of proposals may be asked; its answers are checked alike and
    its failures ignored.
    """
    report: list[dict] = []
    keys: dict[str, list[str]] = {}
    rows = {resolve_name(t, tables): r for t, r in _rows(metadata).items() if resolve_name(t, tables)}
    for t, table_rows in rows.items():
        claimed = [r["column_name"] for r in table_rows if r["is_pk"] and r["column_name"] in tables[t].columns]
        ok = False
        if claimed:
            f = key_facts(tables[t], claimed).first()
            ok = f["total"] > 0 and not f["null_rows"] and not f["duplicates"]
            report.append({"kind": "key", "table": t, "columns": claimed, "ok": ok, **f.asDict()})
        if ok:
            keys[t] = claimed
        elif found := sorted(unique_columns(tables[t]), key=lambda c: ("ID" not in c.upper(), c)):
            keys[t] = found[:1]
            report.append({"kind": "key_inferred", "table": t, "columns": keys[t], "ok": True})

    def test(child: str, column: str, parent: str, to: str, source: str) -> dict | None:
        if parent not in keys or column not in tables[child].columns or to not in tables[parent].columns:
            return None
        f = reference_facts(tables[child], [column], tables[parent], [to], "allow_all_null").first()
        n = f["distinct_keys"]
        rate, bad = (round(f["matched_keys"] / n, 4), round(f["orphan_keys"] / n, 4)) if n else (0.0, 0.0)
        out = {"kind": source, "child_table": child, "columns": [column], "parent_table": parent, "parent_columns": [to], "match_rate": rate, "orphan_ratio": bad, "orphan_keys": f["orphan_keys"], "ok": f["matched_keys"] > 0 and f["orphan_keys"] <= max_orphan_ratio * n}
        report.append(out)
        return out

    good, open_ = [], []
    for t, table_rows in rows.items():
        if t not in keys:
            continue
        for r in table_rows:
            if r["is_fk"]:
                parent = resolve_name(r["ref_table"], tables)
                to = r["ref_column"] or (keys[parent][0] if parent in keys and len(keys[parent]) == 1 else None)
                found = test(t, r["column_name"], parent, to, "reference") if parent and to else None
                (good if found and found["ok"] else open_).append(found or {"child_table": t, "columns": [r["column_name"]]})
    if propose and open_:
        try:
            for p in propose({t: tables[t].columns for t in keys}, open_):
                if p.get("confidence", 0) >= CONFIDENT and p.get("child_table") in keys:
                    found = test(p["child_table"], p["column"], p["parent_table"], p["parent_column"], "proposal")
                    if found and found["ok"]:
                        good.append(found)
        except Exception as e:  # a source outside this library; what it says is optional
            report.append({"kind": "proposals_failed", "error": str(e), "ok": False})
    specs: dict[str, dict] = {t: {"pk_cols": k, "foreign_keys": []} for t, k in keys.items()}
    for c in resolve_conflicts(good):
        specs[c["child_table"]]["foreign_keys"].append({"columns": c["columns"], "parent_table": c["parent_table"], "parent_columns": c["parent_columns"]})
    return specs, report
