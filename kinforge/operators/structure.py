"""Original and synthetic sets compared: presence, types, keys and references; a verdict over all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import canonical
from ..plans.model import Specs
from .checks import colliding_keys, key_facts, key_report, reference_facts, reference_report, references, stack
from .discovery import discover_references, keys_of

# Names and severities of findings.
CRITICAL, ALERT = "CRITICO", "ALERTA"
FINDING = "severity string, kind string, object string, detail string"


def schema_differences(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Missing and extra tables and columns, and columns of another class; read from schemas alone."""
    out = []
    for t in sorted(set(original) | set(synthetic)):
        if t not in synthetic:
            out.append((CRITICAL, "TABELA_AUSENTE", t, "only in the original"))
        elif t not in original:
            out.append((ALERT, "TABELA_EXTRA", t, "only in the synthetic set"))
        else:
            a = {f.name: canonical(f.dataType) for f in original[t].schema}
            b = {f.name: canonical(f.dataType) for f in synthetic[t].schema}
            for c in sorted(set(a) | set(b)):
                if c not in b:
                    out.append((CRITICAL, "COLUNA_AUSENTE", f"{t}.{c}", "only in the original"))
                elif c not in a:
                    out.append((ALERT, "COLUNA_EXTRA", f"{t}.{c}", "only in the synthetic set"))
                elif a[c] != b[c]:
                    out.append((CRITICAL, "TIPO_DIVERGENTE", f"{t}.{c}", f"{a[c]} became {b[c]}"))
    return out


def findings(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, FINDING)


def key_regressions(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame], keys: Mapping[str, list[str]]) -> DataFrame:
    """Keys that hold in the original and not in the synthetic set are critical; declared keys that never held, an alert."""
    a = key_report(original, keys).select("table_name", "pk_cols", F.col("is_valid").alias("ok_original"))
    b = key_report(synthetic, keys).select("table_name", "pk_cols", F.col("is_valid").alias("ok_synthetic"), "null_rows", "duplicates")
    status = F.when(~F.col("ok_original"), ALERT).when(~F.col("ok_synthetic"), CRITICAL).otherwise("OK")
    return a.join(b, ["table_name", "pk_cols"]).withColumn("status", status)


def reference_regressions(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame], specs: Specs) -> DataFrame:
    """References whose inclusion fell are critical; orphans that the original has already, an alert. No key on either side is fine."""
    keys = ["child_table", "fk_cols", "parent_table", "parent_cols"]
    share = F.when(F.col("distinct_keys") > 0, F.col("matched_keys") / F.col("distinct_keys"))
    a = reference_report(original, references(specs)).select(*keys, share.alias("inclusion_original"))
    b = reference_report(synthetic, references(specs)).select(*keys, share.alias("inclusion_synthetic"), "orphan_keys")
    x, y = F.col("inclusion_original"), F.col("inclusion_synthetic")
    fell = (y.isNull() & x.isNotNull()) | (y < x - 1e-9) | (F.col("orphan_keys") < 0)
    status = F.when(F.coalesce(fell, F.lit(False)), CRITICAL).when(x < 1 - 1e-9, ALERT).otherwise("OK")
    return a.join(b, keys).select(*keys, F.round(x, 4).alias("inclusion_original"), F.round(y, 4).alias("inclusion_synthetic"), "orphan_keys", status.alias("status"))


def structural_validation(original: Mapping[str, DataFrame], synthetic: Mapping[str, DataFrame], specs: Specs | None = None, discover: bool = True) -> dict[str, object]:
    """All findings and a verdict: REPROVADO if any finding is critical, else APROVADO."""
    spark = next(iter(original.values())).sparkSession
    both = [t for t in original if t in synthetic]
    rows = findings(spark, schema_differences(original, synthetic))
    has = lambda t, cols: t in both and not (set(cols) - set(original[t].columns) or set(cols) - set(synthetic[t].columns))
    keys = {t: list(s.key) for t, s in (specs or {}).items() if has(t, s.key)}
    found = keys_of({t: original[t] for t in both}) if discover else {}
    for t, columns in found.items():
        if t not in keys and (usable := [c for c in columns if c in synthetic[t].columns]):
            keys[t] = usable[:1]
    parts = [rows]
    out: dict[str, object] = {}
    if keys:
        out["keys"] = key_regressions({t: original[t] for t in keys}, {t: synthetic[t] for t in keys}, keys)
        parts.append(out["keys"].where("status <> 'OK'").select(F.col("status").alias("severity"), F.when(F.col("status") == CRITICAL, "PK_QUEBRADA").otherwise("PK_DECLARADA_INVALIDA").alias("kind"), F.concat_ws(".", "table_name", "pk_cols").alias("object"), F.concat(F.lit("nulls "), "null_rows", F.lit(", duplicates "), "duplicates").alias("detail")))
    if specs and references(specs):
        out["references"] = reference_regressions(original, synthetic, specs)
        parts.append(out["references"].where("status <> 'OK'").select(F.col("status").alias("severity"), F.when(F.col("status") == CRITICAL, "FK_DEGRADADA").otherwise("FK_DECLARADA_ORFAOS_ORIGINAL").alias("kind"), F.concat("child_table", F.lit("."), "fk_cols", F.lit(" -> "), "parent_table", F.lit("."), "parent_cols").alias("object"), F.concat(F.lit("orphan keys "), "orphan_keys").alias("detail")))
    if discover and any(found.values()):
        out["discovered"] = discover_references({t: original[t] for t in both}, found)
    out["findings"] = stack(parts)
    out["verdict"] = "REPROVADO" if not out["findings"].where(F.col("severity") == CRITICAL).isEmpty() else "APROVADO"
    return out


def pre_append(synthetic: Mapping[str, DataFrame], target: Mapping[str, DataFrame], specs: Specs) -> DataFrame:
    """What would stop an append: check, object, violations, go. Checks duplicate keys, keys that the target has,
    and references to rows that neither side has."""
    rows = []
    for t, table in specs.items():
        if table.static:
            continue
        name = f"{t}({','.join(table.key)})"
        rows.append(key_facts(synthetic[t], table.key).select(F.lit("duplicate_key").alias("check"), F.lit(name).alias("object"), F.col("duplicates").alias("violations")))
        rows.append(colliding_keys(synthetic[t], list(table.key), target[t], list(table.key)).agg(F.count("*").alias("violations")).select(F.lit("key_in_target").alias("check"), F.lit(name).alias("object"), "violations"))
        for fk in table.foreign_keys:
            parents = synthetic[fk.parent].select(*fk.parent_columns).unionByName(target[fk.parent].select(*fk.parent_columns))
            facts = reference_facts(synthetic[t], fk.columns, parents, fk.parent_columns)
            rows.append(facts.select(F.lit("no_parent").alias("check"), F.lit(f"{t} {fk}").alias("object"), F.col("orphan_rows").alias("violations")))
    return stack(rows).withColumn("go", F.when(F.col("violations") == 0, "GO").otherwise("NO-GO"))
