"""One query for each operator, over the test tables, and the same result in SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.draws import token, unit
from .operators import checks, closure, dates, demo, discovery, keys, marginals, metrics, reports, rows, sampling, structure
from .plans import metadata, model, pipeline
from .plans.model import ForeignKey
from .plans.synthesis import synthesise
from .sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Load = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table loader under its own name."""

    def register(f: Callable[[Load], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- inputs that have something wrong, derived alike in both engines

DIRTY_KEY = "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN o_custkey + 1000000 ELSE o_custkey END"
DIRTY = f"(SELECT o_orderkey, {DIRTY_KEY} AS o_custkey, o_totalprice FROM orders)"
PAIR = "(SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TREE = "(SELECT p_partkey, p_name, p_partkey // 3 AS parent_key FROM part)"
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"],
}
STAR = [
    ("nation", ForeignKey(("n_regionkey",), "region", ("r_regionkey",))),
    ("customer", ForeignKey(("c_nationkey",), "nation", ("n_nationkey",))),
    ("supplier", ForeignKey(("s_nationkey",), "nation", ("n_nationkey",))),
    ("orders", ForeignKey(("o_custkey",), "customer", ("c_custkey",))),
    ("lineitem", ForeignKey(("l_orderkey",), "orders", ("o_orderkey",))),
]
CHAIN = {
    "region": {"pk_cols": "r_regionkey", "static": True},
    "nation": {"pk_cols": "n_nationkey", "static": True, "foreign_keys": [{"columns": "n_regionkey", "parent_table": "region"}]},
    "customer": {"pk_cols": "c_custkey", "foreign_keys": [{"columns": "c_nationkey", "parent_table": "nation"}]},
    "orders": {"pk_cols": "o_orderkey", "foreign_keys": [{"columns": "o_custkey", "parent_table": "customer"}]},
}


def dirty_orders(t: Load) -> DataFrame:
    return t("orders").selectExpr("o_orderkey", f"{DIRTY_KEY} AS o_custkey", "o_totalprice")


def order_pairs(t: Load) -> DataFrame:
    both = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.when(F.col("l_linenumber") % 5 != 0, F.col("l_orderkey")).alias("l_orderkey"), "o_custkey")


def part_tree(t: Load) -> DataFrame:
    return t("part").select("p_partkey", "p_name", F.floor(F.col("p_partkey") / 3).alias("parent_key"))


def draw_sql(purpose: str, pos: str, n: str) -> str:
    return f"((('0x' || substr(md5('42|{purpose}|' || ({pos})::VARCHAR), 1, 13))::BIGINT) % ({n}))"


def unit_sql(purpose: str, pos: str) -> str:
    return f"((('0x' || substr(md5('42|{purpose}|' || ({pos})::VARCHAR), 1, 13))::BIGINT) / 4503599627370496.0::DOUBLE)"


def spine_sql(n: str) -> str:
    return f"(SELECT unnest(range(({n})::BIGINT)) AS pos)"


def multiplied_sql(table: str, key: str, keep: bool, factor: int = 2) -> str:
    """Rows of a table drawn factor times over: pos and the old columns."""
    n = f"(SELECT count(*) FROM {table})"
    pick = draw_sql(f"boot|{table}", "pos", n)
    at = f"CASE WHEN pos < {n} THEN pos ELSE {pick} END" if keep else pick
    return f"(SELECT p.pos, s.* EXCLUDE (rn) FROM (SELECT pos, {at} AS at FROM {spine_sql(f'{factor} * {n}')}) p JOIN (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS rn FROM {table}) s ON s.rn = p.at)"


def reference_sql(child: str, columns: list[str], parent: str, parent_columns: list[str], policy: str, label: str = "") -> str:
    on = " AND ".join(f"c.{a} = p.{b}" for a, b in zip(columns, parent_columns))
    null = " OR ".join(f"{c} IS NULL" for c in columns)
    every = " AND ".join(f"{c} IS NULL" for c in columns)
    checked = {"allow_any_null": f"NOT ({null})", "allow_all_null": f"NOT ({every})", "invalid_null": "TRUE"}[policy]
    cols = ", ".join(columns)
    known = f"(SELECT DISTINCT {', '.join(parent_columns)} FROM {parent} WHERE {' AND '.join(c + ' IS NOT NULL' for c in parent_columns)})"
    return f"""SELECT {label} coalesce(sum(n), 0)::BIGINT AS child_rows, coalesce(sum(CASE WHEN nul THEN n ELSE 0 END), 0)::BIGINT AS null_rows,
      coalesce(sum(CASE WHEN chk THEN n ELSE 0 END), 0)::BIGINT AS checked_rows, count(*) FILTER (WHERE chk) AS distinct_keys,
      count(*) FILTER (WHERE chk AND hit) AS matched_keys, count(*) FILTER (WHERE chk AND NOT hit) AS orphan_keys,
      coalesce(sum(CASE WHEN chk AND NOT hit THEN n ELSE 0 END), 0)::BIGINT AS orphan_rows, (SELECT count(*) FROM {known}) AS parent_keys
    FROM (SELECT c.n, ({null}) AS nul, ({checked}) AS chk, EXISTS (SELECT 1 FROM {known} p WHERE {on}) AS hit
      FROM (SELECT {cols}, count(*) AS n FROM {child} GROUP BY {cols}) c)"""


def labelled_sql(child: str, fk: ForeignKey, policy: str, source: str | None = None) -> str:
    label = f"'{child}' AS child_table, '{','.join(fk.columns)}' AS fk_cols, '{fk.parent}' AS parent_table, '{','.join(fk.parent_columns)}' AS parent_cols,"
    return reference_sql(source or child, list(fk.columns), fk.parent, list(fk.parent_columns), policy, label)


def union_sql(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


# ---- sources and sinks


def _round_trip(t: Load, fmt: str, name: str = "nation") -> DataFrame:
    """A table written and read in a format, below the session's shared folder."""
    df = t(name)
    spark = df.sparkSession
    path = readers.join_path(rows.shared_folder(spark), f"round-trip-{fmt}-{spark.sparkContext.applicationId}", name)
    writers.save_table(df, path, fmt)
    return readers.read_table(spark, path, fmt)


NATION_SQL = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _nation(df: DataFrame) -> DataFrame:
    return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query(NATION_SQL)
def source_sink_csv(t):
    return _nation(_round_trip(t, "csv"))


@query(NATION_SQL)
def source_sink_orc(t):
    return _nation(_round_trip(t, "orc"))


@query(NATION_SQL)
def source_sink_json(t):
    return _nation(_round_trip(t, "json"))


@query(NATION_SQL)
def source_sink_parquet(t):
    return _nation(_round_trip(t, "parquet"))


@query('SELECT n_nationkey::BIGINT AS "a_b", n_name AS "a_b_1" FROM nation')
def column_name_sanitiser(t):
    return writers.safe_columns(t("nation").select(F.col("n_nationkey").cast("long").alias("a b"), F.col("n_name").alias("a;b")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def root_domain_filter(t):
    return sampling.root_filter(t("customer"), "c_mktsegment", "BUILDING", True).select("c_custkey", "c_name")


# ---- keys and references: reports


@query(union_sql([f"SELECT '{t}' AS table_name, '{','.join(k)}' AS pk_cols, sum(n)::BIGINT AS total, count(*) AS distinct_keys, sum(CASE WHEN {' OR '.join(c + ' IS NULL' for c in k)} THEN n ELSE 0 END)::BIGINT AS null_rows, sum(n - 1)::BIGINT AS duplicates, (sum(n) > 0 AND sum(n - 1) = 0) AS is_valid FROM (SELECT {', '.join(k)}, count(*) AS n FROM {t} GROUP BY {', '.join(k)})" for t, k in KEYS.items()]))
def pk_report(t):
    return checks.key_report({n: t(n) for n in KEYS}, KEYS)


POLICY_FKS = [("orders", STAR[3][1], DIRTY), ("lineitem", ForeignKey(("l_orderkey", "o_custkey"), "orders", ("o_orderkey", "o_custkey")), PAIR)]


def _policy(policy: str) -> None:
    def f(t):
        tables = {"orders": dirty_orders(t), "customer": t("customer")}
        one = checks.reference_report(tables, [("orders", STAR[3][1])], policy)
        two = checks.reference_report({"lineitem": order_pairs(t), "orders": t("orders")}, [("lineitem", POLICY_FKS[1][1])], policy)
        return one.unionByName(two)

    f.__name__ = "fk_report_" + policy.removeprefix("allow_")
    query(union_sql([labelled_sql(c, fk, policy, s) for c, fk, s in POLICY_FKS]))(f)


for _p in checks.POLICIES:
    _policy(_p)

CUSTOMER_OF = (["o_custkey"], ["c_custkey"])


@query(f"SELECT o_orderkey, o_custkey FROM {DIRTY} d WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = d.o_custkey)")
def fk_orphan_rows(t):
    return checks.orphans(dirty_orders(t), CUSTOMER_OF[0], t("customer"), CUSTOMER_OF[1]).select("o_orderkey", "o_custkey")


@query(f"SELECT o_custkey, count(*) AS n_rows FROM {DIRTY} d WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = d.o_custkey) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def fk_rejected_rows(t):
    return checks.orphan_examples(dirty_orders(t), CUSTOMER_OF[0], t("customer"), CUSTOMER_OF[1])


@query(f"SELECT child_table, fk_cols, parent_table, distinct_keys, matched_keys, orphan_keys, round(matched_keys / distinct_keys, 4) AS match_rate, round(orphan_keys / distinct_keys, 4) AS orphan_ratio, matched_keys > 0 AND orphan_keys <= 0.05 * distinct_keys AS is_valid FROM ({labelled_sql('orders', STAR[3][1], 'allow_any_null', DIRTY)})")
def fk_match_rate_tolerance(t):
    return checks.within_tolerance(checks.reference_report({"orders": dirty_orders(t), "customer": t("customer")}, STAR[3:4]), 0.05)


@query(f"SELECT child_table, fk_cols, parent_table, child_rows, null_rows, round(100 * null_rows / child_rows, 4) AS null_pct, orphan_rows, round(100 * (checked_rows - orphan_rows) / checked_rows, 4) AS valid_pct, CASE WHEN orphan_rows > 0 THEN 'FALHA' ELSE 'OK' END AS status FROM ({union_sql([labelled_sql(c, fk, 'allow_any_null', DIRTY if c == 'orders' else None) for c, fk in STAR])})")
def direct_integrity(t):
    tables = {n: t(n) for n in ("region", "nation", "customer", "supplier", "lineitem")}
    first = checks.reference_report(tables | {"orders": dirty_orders(t)}, STAR[:4])
    return checks.integrity(first.unionByName(checks.reference_report(tables | {"orders": t("orders")}, STAR[4:])))


DIRTY_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice"]
NULLS_SQL = union_sql([f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS total, round((count(*) - count({c})) / count(*), 6) AS null_pct FROM {DIRTY}" for c in DIRTY_COLUMNS])


@query(NULLS_SQL)
def null_profile(t):
    return checks.null_profile(dirty_orders(t))


@query(f"SELECT column_name FROM ({NULLS_SQL}) WHERE null_count = 0")
def not_null_inference(t):
    return checks.never_null(dirty_orders(t))


# ---- discovery

COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "events": ["event_id", "user_id", "event_type"],
}
DISCOVERED_KEYS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "orders": ["o_orderkey"], "events": ["event_id"]}


@query(union_sql([f"SELECT '{t}' AS table_name, '{c}' AS column_name FROM {t} HAVING count(*) > 0 AND count(*) = count(DISTINCT {c})" for t, cs in COLUMNS.items() for c in cs]))
def pk_discovery(t):
    return discovery.discover_keys({n: t(n).select(*c) for n, c in COLUMNS.items()})


@query(union_sql([f"SELECT '{t}' AS table_name, '{c}' AS column_name, min({c})::BIGINT AS min_key, max({c})::BIGINT AS max_key, count(*) AS n_rows FROM {t}" for t, c in (("customer", "c_custkey"), ("orders", "o_orderkey"), ("part", "p_partkey"))]))
def pk_ranges(t):
    return discovery.key_ranges({n: t(n) for n in ("customer", "orders", "part")}, {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"})


def _melt(columns: dict[str, list[str]], a: str, b: str) -> str:
    return union_sql([f"SELECT DISTINCT '{t}' AS {a}_table, '{c}' AS {a}_col, {c}::VARCHAR AS {b} FROM {t} WHERE {c} IS NOT NULL" for t, cs in columns.items() for c in cs])


@query(f"""WITH c AS ({_melt({t: [x for x in cs if x not in DISCOVERED_KEYS[t]] for t, cs in COLUMNS.items()}, 'child', 'v')}), p AS ({_melt(DISCOVERED_KEYS, 'parent', 'v')}),
nc AS (SELECT child_table, child_col, count(*) AS n_distinct FROM c GROUP BY ALL), np AS (SELECT parent_table, parent_col, count(*) AS n_parent FROM p GROUP BY ALL),
m AS (SELECT child_table, child_col, parent_table, parent_col, count(*) AS n FROM c JOIN p USING (v) GROUP BY ALL)
SELECT child_table, child_col, parent_table, parent_col, round(n / n_distinct, 4) AS inclusion, n_distinct, round(n / n_parent, 4) AS coverage,
 CASE WHEN n / n_parent >= 0.5 AND n_distinct >= 20 THEN 'high' WHEN n / n_parent >= 0.2 THEN 'medium' ELSE 'low' END AS confidence
FROM m JOIN nc USING (child_table, child_col) JOIN np USING (parent_table, parent_col) WHERE n_distinct >= 5 AND n = n_distinct AND n / n_parent >= 0.05""")
def inclusion_discovery(t):
    return discovery.discover_references({n: t(n).select(*c) for n, c in COLUMNS.items()}, DISCOVERED_KEYS)


@query(f"SELECT round(matched_keys / distinct_keys, 4) AS inclusion, orphan_keys AS orphans, distinct_keys AS n_distinct, round(matched_keys / parent_keys, 4) AS coverage FROM ({reference_sql('events', ['user_id'], 'customer', ['c_custkey'], 'allow_any_null')})")
def declared_inclusion(t):
    return discovery.inclusion_of(t("events"), ["user_id"], t("customer"), ["c_custkey"])


@query("(SELECT DISTINCT c_nationkey::BIGINT AS k, 'left' AS side FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) UNION ALL (SELECT DISTINCT s_nationkey, 'right' FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer))")
def value_set_difference(t):
    key = lambda n, c: t(n).select(F.col(c).cast("long").alias("k"))
    return discovery.value_differences(key("customer", "c_nationkey"), key("supplier", "s_nationkey"), "k")


def _altered(t: Load) -> DataFrame:
    return t("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate", F.lit(1).alias("o_extra"))


@query("SELECT * FROM (VALUES ('CRITICO', 'COLUNA_AUSENTE', 'orders.o_orderpriority'), ('ALERTA', 'COLUNA_EXTRA', 'orders.o_extra'), ('CRITICO', 'TIPO_DIVERGENTE', 'orders.o_custkey'), ('CRITICO', 'TABELA_AUSENTE', 'region'), ('ALERTA', 'TABELA_EXTRA', 'supplier')) AS x(severity, kind, object)")
def structure_differences(t):
    o = t("orders")
    return structure.findings(o.sparkSession, structure.schema_differences({"orders": o, "region": t("region")}, {"orders": _altered(t), "supplier": t("supplier")})).drop("detail")


@query("""SELECT * FROM (VALUES ('customer', 'c_custkey', TRUE, FALSE, 'CRITICO'), ('lineitem', 'l_orderkey,l_linenumber', FALSE, FALSE, 'ALERTA'), ('orders', 'o_orderkey', TRUE, TRUE, 'OK')) AS x(table_name, pk_cols, ok_original, ok_synthetic, status)""")
def key_regressions(t):
    original = {n: t(n) for n in ("customer", "lineitem", "orders")}
    synthetic = original | {"customer": original["customer"].unionByName(original["customer"].where("c_custkey < 10"))}
    return structure.key_regressions(original, synthetic, {n: KEYS[n] for n in original}).drop("null_rows", "duplicates")


@query(f"""SELECT 'orders' AS child_table, 'o_custkey' AS fk_cols, 'customer' AS parent_table, 'c_custkey' AS parent_cols, 1.0::DOUBLE AS inclusion_original, round(matched_keys / distinct_keys, 4) AS inclusion_synthetic, orphan_keys, 'CRITICO' AS status FROM ({reference_sql(DIRTY, ['o_custkey'], 'customer', ['c_custkey'], 'allow_any_null')})""")
def reference_regressions(t):
    specs = model.compile_specs({"customer": {"pk_cols": "c_custkey"}, "orders": CHAIN["orders"]})
    original = {"customer": t("customer"), "orders": t("orders")}
    return structure.reference_regressions(original, original | {"orders": dirty_orders(t)}, specs)


# ---- rows and keys


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def contiguous_row_id(t):
    return rows.number_rows(t("orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT count(*) AS n, count(DISTINCT i) AS n_distinct, min(i) AS first_id, max(i) AS last_id FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def row_id_physical(t):
    out = rows.number_rows_unordered(t("lineitem").select("l_orderkey"))
    return out.agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("n_distinct"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id"))


def _boot(t: Load, table: str, key: str, keep: bool) -> DataFrame:
    numbered = rows.number_rows(t(table), [key])
    n = numbered.count()
    return rows.bootstrap(numbered, 2 * n, n, f"boot|{table}", keep_all=keep)


@query(f"SELECT pos, o_orderkey, o_custkey, o_totalprice FROM {multiplied_sql('orders', 'o_orderkey', False)}")
def bootstrap_child(t):
    return _boot(t, "orders", "o_orderkey", False).select("pos", "o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT pos, c_custkey, c_nationkey FROM {multiplied_sql('customer', 'c_custkey', True)}")
def bootstrap_parent(t):
    return _boot(t, "customer", "c_custkey", True).select("pos", "c_custkey", "c_nationkey")


def _generated(t: Load, kind: str) -> DataFrame:
    source = rows.number_rows(t("part").select(F.col("p_partkey").cast(kind).alias("p_partkey")), ["p_partkey"], "pos")
    dtype, n = source.schema["p_partkey"].dataType, source.count()
    start = keys.key_start(keys.largest_key(source, "p_partkey"), n, dtype) or 0
    made = source.select("pos", keys.new_key(F.col("pos"), "p_partkey", dtype, start + 1, n).alias("new_key"))
    return made if kind == "string" else made.withColumn("new_key", F.col("new_key").cast("double"))


GENERATED = "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_partkey) AS k FROM part"


@query(f"SELECT pos, k::DOUBLE AS new_key FROM ({GENERATED})")
def pk_generate_int(t):
    return _generated(t, "int")


@query(f"SELECT pos, k::DOUBLE AS new_key FROM ({GENERATED})")
def pk_generate_decimal(t):
    return _generated(t, "decimal(18,0)")


@query(f"SELECT pos, k::DOUBLE AS new_key FROM ({GENERATED})")
def pk_generate_float(t):
    return _generated(t, "double")


@query("SELECT row_number() OVER (ORDER BY p_partkey::VARCHAR) - 1 AS pos, 'SYN_p_partkey_' || lpad((row_number() OVER (ORDER BY p_partkey::VARCHAR))::VARCHAR, 14, '0') AS new_key FROM part")
def pk_generate_string(t):
    return _generated(t, "string")


@query("SELECT 'customer' AS table_name, max(c_custkey) + 1000 AS start FROM customer UNION ALL SELECT 'nation', 2147483647 - 50 UNION ALL SELECT 'orders', greatest(max(o_orderkey), 5000000) FROM orders")
def pk_start_plan(t):
    c, o = keys.largest_key(t("customer"), "c_custkey"), keys.largest_key(t("orders"), "o_orderkey")
    plan = [("customer", keys.key_start(c, 10, T.LongType(), band=1000)), ("nation", keys.key_start(24, 50, T.IntegerType(), floor=2**31 - 10)), ("orders", keys.key_start(o, 10, T.LongType(), floor=5_000_000))]
    return t("region").sparkSession.createDataFrame(plan, "table_name string, start long")


@query("SELECT 'part' AS table_name, max(p_partkey) AS start FROM part")
def pk_start_string(t):
    """Text keys go on above the highest generated one of the whole table."""
    named = t("part").select(F.concat(F.lit("SYN_p_partkey_"), F.lpad(F.col("p_partkey").cast("string"), keys.PAD, "0")).alias("p_partkey"))
    start = keys.key_start(keys.largest_key(named, "p_partkey"), 10, T.StringType())
    return t("region").sparkSession.createDataFrame([("part", start)], "table_name string, start long")


CUSTOMER_MAP = f"(SELECT c_custkey AS old_0, (SELECT max(c_custkey) FROM customer) + 1 + pos AS new_0, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS rank, count(*) OVER (PARTITION BY c_custkey) AS count FROM {multiplied_sql('customer', 'c_custkey', True)})"


def _customer_map(t: Load) -> DataFrame:
    top = keys.largest_key(t("customer"), "c_custkey")
    work = _boot(t, "customer", "c_custkey", True).withColumn("new", F.col("pos") + top + 1)
    return keys.key_map(work, ["c_custkey"], ["new"])


@query(f'SELECT old_0, new_0, rank::INTEGER AS rank, "count" FROM {CUSTOMER_MAP}')
def key_mapping(t):
    return _customer_map(t)


REMAPPED = f"""SELECT o.pos, o.o_orderkey, m.new_0 AS o_custkey FROM {multiplied_sql('orders', 'o_orderkey', False)} o
JOIN (SELECT DISTINCT old_0, "count" FROM {CUSTOMER_MAP}) n ON n.old_0 = o.o_custkey
JOIN {CUSTOMER_MAP} m ON m.old_0 = o.o_custkey AND m.rank = 1 + {draw_sql('fk|orders|o_custkey', 'o.pos', 'n."count"')}"""


@query(REMAPPED)
def fk_remap_single(t):
    return keys.remap(_boot(t, "orders", "o_orderkey", False).select("pos", "o_orderkey", "o_custkey"), ["o_custkey"], _customer_map(t), "fk|orders|o_custkey")


@query(REMAPPED)
def fk_remap_wide(t):
    return keys.remap(_boot(t, "orders", "o_orderkey", False).select("pos", "o_orderkey", "o_custkey"), ["o_custkey"], _customer_map(t), "fk|orders|o_custkey", wide=True)


@query(f"""WITH w AS (SELECT pos, o_orderkey, o_custkey FROM {multiplied_sql('orders', 'o_orderkey', True)}),
m AS (SELECT o_orderkey AS a, o_custkey AS b, (SELECT max(o_orderkey) FROM orders) + 1 + pos AS x, o_custkey + 7 AS y, row_number() OVER (PARTITION BY o_orderkey, o_custkey ORDER BY pos) AS r, count(*) OVER (PARTITION BY o_orderkey, o_custkey) AS n FROM w),
l AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT l.pos, l.l_orderkey, l.o_custkey, m.x, m.y FROM l LEFT JOIN m ON m.a = l.l_orderkey AND m.b = l.o_custkey AND m.r = 1 + {draw_sql('fk|pair', 'l.pos', 'm.n')})
SELECT coalesce(x, l_orderkey) AS l_orderkey, coalesce(y, o_custkey) AS o_custkey, count(*) AS n FROM j GROUP BY 1, 2""")
def fk_remap_composite(t):
    work = _boot(t, "orders", "o_orderkey", True).withColumn("x", F.col("pos") + keys.largest_key(t("orders"), "o_orderkey") + 1).withColumn("y", F.col("o_custkey") + 7)
    mapping = keys.key_map(work, ["o_orderkey", "o_custkey"], ["x", "y"])
    l = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "o_custkey")  # noqa: E741
    numbered = rows.number_rows(l, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "pos").withColumn("l_orderkey", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_orderkey")))
    out = keys.remap(numbered.select("pos", "l_orderkey", "o_custkey"), ["l_orderkey", "o_custkey"], mapping, "fk|pair")
    return out.groupBy("l_orderkey", "o_custkey").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT pos, p_partkey AS old, p_partkey // 3 AS parent, (SELECT max(p_partkey) FROM part) + 1 + pos AS new FROM {multiplied_sql('part', 'p_partkey', True)}),
m AS (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY pos) AS r, count(*) OVER (PARTITION BY old) AS n FROM w)
SELECT w.pos, w.new AS p_partkey, CASE WHEN w.parent = w.old THEN w.new ELSE m.new END AS parent_key FROM w JOIN m ON m.old = w.parent AND m.r = 1 + {draw_sql('fk|part|parent_key', 'w.pos', 'm.n')}""")
def self_fk_remap(t):
    numbered = rows.number_rows(part_tree(t), ["p_partkey"])
    n, top = numbered.count(), keys.largest_key(t("part"), "p_partkey")
    work = rows.bootstrap(numbered, 2 * n, n, "boot|part", keep_all=True).withColumn("old", F.col("p_partkey")).withColumn("p_partkey", F.col("pos") + top + 1)
    own = keys.key_map(work, ["old"], ["p_partkey"])
    return keys.remap_self(work, ["parent_key"], ["old"], ["p_partkey"], own, "fk|part|parent_key").select("pos", "p_partkey", "parent_key")


CYCLE = {
    "nation": {"pk_cols": "n_nationkey", "foreign_keys": [{"columns": "n_regionkey", "parent_table": "region"}]},
    "region": {"pk_cols": "r_regionkey", "foreign_keys": [{"columns": "lead_nation", "parent_table": "nation"}]},
}


@query(f"""WITH n AS (SELECT pos, n_nationkey AS old, n_regionkey AS r, 24 + 1 + pos AS new FROM {multiplied_sql('nation', 'n_nationkey', True)}),
r AS (SELECT pos, r_regionkey AS old, r_regionkey * 5 AS lead, 4 + 1 + pos AS new FROM {multiplied_sql('region', 'r_regionkey', True)}),
nm AS (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY pos) AS k, count(*) OVER (PARTITION BY old) AS c FROM n),
rm AS (SELECT old, new, row_number() OVER (PARTITION BY old ORDER BY pos) AS k, count(*) OVER (PARTITION BY old) AS c FROM r)
SELECT 'nation' AS t, n.new::BIGINT AS key, rm.new::BIGINT AS ref FROM n JOIN rm ON rm.old = n.r AND rm.k = 1 + {draw_sql('fk|nation|n_regionkey', 'n.pos', 'rm.c')}
UNION ALL SELECT 'region', r.new, nm.new FROM r JOIN nm ON nm.old = r.lead AND nm.k = 1 + {draw_sql('fk|region|lead_nation', 'r.pos', 'nm.c')}""")
def cycle_deferred(t):
    tables = {"nation": t("nation"), "region": t("region").withColumn("lead_nation", F.col("r_regionkey") * 5)}
    made = synthesise(tables, CYCLE)
    pick = lambda n, k, r: made[n].select(F.lit(n).alias("t"), F.col(k).cast("long").alias("key"), F.col(r).cast("long").alias("ref"))
    return pick("nation", "n_nationkey", "n_regionkey").unionByName(pick("region", "r_regionkey", "lead_nation"))


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def static_passthrough(t):
    made = synthesise({"region": t("region")}, {"region": {"pk_cols": "r_regionkey", "static": True}})
    return made["region"].withColumn("r_regionkey", F.col("r_regionkey").cast("long"))


@query(f"SELECT (SELECT max(o_orderkey) FROM orders) + 1 + pos AS o_orderkey, o_custkey, o_totalprice FROM (SELECT x.pos, x.o_custkey, o.o_totalprice FROM ({REMAPPED}) x JOIN (SELECT o_orderkey, o_totalprice FROM orders) o USING (o_orderkey))")
def synthesis_chain(t):
    made = synthesise({n: t(n) for n in CHAIN}, CHAIN, scale=2.0, check=False)
    return made["orders"].select("o_orderkey", "o_custkey", "o_totalprice")


DATED = "SELECT o_orderkey, o_orderdate AS DT_EMISSAO, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 40 DAY WHEN 1 THEN o_orderdate - INTERVAL 5 DAY END AS DT_VENCIMENTO FROM orders"


def _dated(t: Load) -> DataFrame:
    day = F.col("o_orderdate")
    due = F.when(F.col("o_orderkey") % 3 == 0, day + F.expr("INTERVAL 40 DAYS")).when(F.col("o_orderkey") % 3 == 1, day - F.expr("INTERVAL 5 DAYS"))
    return t("orders").select("o_orderkey", day.alias("DT_EMISSAO"), due.alias("DT_VENCIMENTO"), day.cast("string").alias("DAT_INCLUSAO"))


@query("SELECT o_orderkey, TIMESTAMP '2026-01-15' AS DT_EMISSAO, TIMESTAMP '2026-01-15' + INTERVAL 90 DAY AS DT_VENCIMENTO, '2026-01-15 10:30:00' AS DAT_INCLUSAO FROM orders")
def date_rules_fixed(t):
    return dates.rewrite_dates(_dated(t), "2026-01-15 10:30:00", days=90)


@query(f"SELECT o_orderkey, TIMESTAMP '2026-01-15' AS DT_EMISSAO, TIMESTAMP '2026-01-15' + INTERVAL 1 DAY * (CASE WHEN date_diff('day', DT_EMISSAO::DATE, DT_VENCIMENTO::DATE) >= 1 THEN date_diff('day', DT_EMISSAO::DATE, DT_VENCIMENTO::DATE) ELSE 30 END) AS DT_VENCIMENTO, '2026-01-15 10:30:00' AS DAT_INCLUSAO FROM ({DATED})")
def date_rules_term(t):
    return dates.rewrite_dates(_dated(t), "2026-01-15 10:30:00")


@query("SELECT s_suppkey, coalesce(upper(n_name), 'UNK') || lpad(s_suppkey::VARCHAR, 6, '0') AS code, 'BR' || lpad(s_suppkey::VARCHAR, 10, '0') AS isin FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON n_nationkey = s_nationkey")
def derived_codes(t):
    """The lookup is meant to lack some nations, so that suppliers without a code are shown."""
    kinds = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.upper("n_name").alias("c"))
    return dates.derived_codes(t("supplier"), kinds, key="s_suppkey", kind="s_nationkey", code="c", out="code", isin="isin").select("s_suppkey", "code", "isin")


# ---- sampling and repair


@query("""WITH r AS (SELECT * FROM region WHERE r_name = 'ASIA'), n AS (SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM r)),
c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n) ORDER BY c_custkey LIMIT 100)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) ORDER BY o_orderkey LIMIT 200""")
def referential_sample(t):
    r = sampling.root_filter(t("region"), "r_name", "ASIA", True)
    n = sampling.keep_referenced(t("nation"), ["n_regionkey"], r, ["r_regionkey"])
    c = sampling.capped(sampling.keep_referenced(t("customer"), ["c_nationkey"], n, ["n_nationkey"]), ["c_custkey"], 100)
    return sampling.capped(sampling.keep_referenced(t("orders"), ["o_custkey"], c, ["c_custkey"]), ["o_orderkey"], 200).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 40 = 0 UNION ALL (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0 ORDER BY c_custkey LIMIT (SELECT greatest(0, 100 - count(*)) FROM customer WHERE c_custkey % 40 = 0))")
def floor_topup(t):
    return sampling.top_up(t("customer").where("c_custkey % 40 = 0"), t("customer"), ["c_custkey"], 100).select("c_custkey")


@query(f"SELECT c_custkey FROM customer WHERE {unit_sql('sample|customer', 'c_custkey')} < 0.1 OR c_custkey IN (SELECT o_custkey FROM orders WHERE {unit_sql('sample|orders', 'o_orderkey')} < 0.1)")
def parent_closure(t):
    orders, customers = sampling.drawn(t("orders"), "o_orderkey", 0.1, "sample|orders"), sampling.drawn(t("customer"), "c_custkey", 0.1, "sample|customer")
    return sampling.close_over_parents(orders, ["o_custkey"], customers, t("customer"), ["c_custkey"]).select("c_custkey")


@query(f"WITH RECURSIVE c AS (SELECT p_partkey, parent_key FROM {TREE} WHERE p_partkey % 37 = 5 UNION SELECT p.p_partkey, p.parent_key FROM c JOIN {TREE} p ON p.p_partkey = c.parent_key) SELECT p_partkey, parent_key FROM c")
def self_closure(t):
    tree = part_tree(t).select("p_partkey", "parent_key")
    return closure.close_over_self(tree.where("p_partkey % 37 = 5"), ["parent_key"], tree, ["p_partkey"])


# customers have a boss, 40 keys before them (a chain), and sponsor an order of the customer three keys on (a cycle with orders)
CLOSED = {
    "region": {"pk_cols": "r_regionkey"},
    "nation": {"pk_cols": "n_nationkey", "foreign_keys": [{"columns": "n_regionkey", "parent_table": "region"}]},
    "customer": {"pk_cols": "c_custkey", "foreign_keys": [{"columns": "sponsored", "parent_table": "orders"}, {"columns": "c_nationkey", "parent_table": "nation"}, {"columns": "boss", "parent_table": "customer"}]},
    "orders": {"pk_cols": "o_orderkey", "foreign_keys": [{"columns": "o_custkey", "parent_table": "customer"}]},
}


@query("""WITH RECURSIVE s AS (SELECT o_custkey - 3 AS c, max(o_orderkey) AS o FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
e AS (SELECT 'orders' AS t, o_orderkey AS k, 'customer' AS to_t, o_custkey AS to_k FROM orders UNION ALL SELECT 'customer', c_custkey, 'customer', c_custkey - 40 FROM customer
  UNION ALL SELECT 'customer', c, 'orders', o FROM s UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer UNION ALL SELECT 'nation', n_nationkey, 'region', n_regionkey FROM nation),
there AS (SELECT 'orders' AS to_t, o_orderkey AS to_k FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'nation', n_nationkey FROM nation UNION ALL SELECT 'region', r_regionkey FROM region),
r AS (SELECT 'orders' AS t, o_orderkey AS k FROM orders WHERE o_orderkey % 211 = 0 UNION SELECT e.to_t, e.to_k FROM r JOIN e USING (t, k) JOIN there USING (to_t, to_k))
SELECT t AS table_name, k::BIGINT AS key FROM r""")
def graph_closure(t):
    sponsors = t("orders").where("o_custkey % 4 <> 0").groupBy((F.col("o_custkey") - 3).alias("c_custkey")).agg(F.max("o_orderkey").alias("sponsored"))
    full = {n: t(n) for n in CLOSED} | {"customer": t("customer").withColumn("boss", F.col("c_custkey") - 40).join(sponsors, "c_custkey", "left")}
    group = pipeline.Group(t("region").sparkSession, pipeline.Layout("", ""), model.compile_specs(CLOSED), full=full)
    closed = group.close({n: df.where("o_orderkey % 211 = 0" if n == "orders" else "false") for n, df in full.items()})
    return checks.stack([closed[n].select(F.lit(n).alias("table_name"), F.col(spec["pk_cols"]).cast("long").alias("key")) for n, spec in CLOSED.items()])


LOST = "(SELECT o_orderkey, o_custkey + 1000000000 AS o_custkey FROM orders)"
SUSPECT = [("events", ForeignKey(("user_id",), "customer", ("c_custkey",)), "events"), ("dirty", ForeignKey(("o_custkey",), "customer", ("c_custkey",)), DIRTY), ("lost", ForeignKey(("o_custkey",), "customer", ("c_custkey",)), LOST)]


@query("SELECT child_table, fk_cols, parent_table, parent_cols, distinct_keys, orphan_keys, CASE WHEN distinct_keys = 0 THEN 'ok' WHEN matched_keys = 0 THEN 'no match' WHEN orphan_keys > 0 THEN 'orphans' ELSE 'ok' END AS reason FROM (" + union_sql([labelled_sql(n, fk, "allow_any_null", source) for n, fk, source in SUSPECT]) + ")")
def fk_sanitise_report(t):
    """Why foreign keys would be left out: of real, dirty and unrelated references."""
    lost = t("orders").select("o_orderkey", (F.col("o_custkey") + 1_000_000_000).alias("o_custkey"))
    tables = {"events": t("events"), "dirty": dirty_orders(t), "lost": lost, "customer": t("customer")}
    return checks.reference_problems(checks.reference_report(tables, [(n, fk) for n, fk, _ in SUSPECT]))


@query(f"SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey END AS o_custkey FROM {DIRTY}")
def orphan_null(t):
    return sampling.null_orphans(dirty_orders(t), ["o_custkey"], t("customer"), ["c_custkey"], ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(f"""SELECT o_orderkey, CASE WHEN o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey ELSE k.c_custkey END AS o_custkey
FROM {DIRTY} d JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS at FROM customer) k ON k.at = {draw_sql('orphan|orders|o_custkey', 'o_orderkey', '(SELECT count(*) FROM customer)')}""")
def orphan_reassign(t):
    return sampling.reassign_orphans(dirty_orders(t), ["o_custkey"], t("customer"), ["c_custkey"], ["o_orderkey"], "orphan|orders|o_custkey").select("o_orderkey", "o_custkey")


BOUND = "(SELECT l.doc_id AS old, d.doc_id + 5000000 AS new, quality FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM labels) l JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d USING (r))"


def _bound(t: Load) -> tuple[DataFrame, DataFrame]:
    return sampling.bind_shared_key(t("labels"), ["doc_id"], t("documents").select((F.col("doc_id") + 5_000_000).alias("doc_id")), ["doc_id"])


@query(f"SELECT new AS doc_id, quality FROM {BOUND}")
def bind_shared_key(t):
    return _bound(t)[0].select("doc_id", "quality")


@query(f"SELECT d.doc_id AS row_key, coalesce(b.new, d.doc_id) AS doc_id FROM documents d LEFT JOIN {BOUND} b ON b.old = d.doc_id")
def translate_after_bind(t):
    return sampling.translate(t("documents").select(F.col("doc_id").alias("row_key"), "doc_id"), ["doc_id"], _bound(t)[1])


@query(f"SELECT old AS __old_0, new + 1 AS __new_0 FROM {BOUND}")
def compose_bind_maps(t):
    pairs = _bound(t)[1]
    return sampling.compose(pairs, pairs.select(F.col("__new_0").alias("__old_0"), (F.col("__new_0") + 1).alias("__new_0")))


GATE_SPECS = {"customer": {"pk_cols": "c_custkey"}, "orders": {"pk_cols": "o_orderkey", "not_null": ["o_totalprice"], "foreign_keys": [{"columns": "o_custkey", "parent_table": "customer"}]}}


@query(f"""SELECT * FROM (VALUES ('null_key', 'customer(c_custkey)', 0), ('duplicate_key', 'customer(c_custkey)', 0), ('empty_output', 'customer(c_custkey)', 0), ('null_key', 'orders(o_orderkey)', 0), ('duplicate_key', 'orders(o_orderkey)', 0), ('null_value', 'orders.o_totalprice', 0)) AS x("check", object, violations)
UNION ALL SELECT 'null_value', 'orders.o_custkey', count(*) FROM {DIRTY} WHERE o_custkey IS NULL
UNION ALL SELECT 'orphan_rows', 'orders (o_custkey) -> customer (c_custkey)', count(*) FROM {DIRTY} d WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def gate_report(t):
    return checks.gate({"customer": t("customer"), "orders": dirty_orders(t)}, model.compile_specs(GATE_SPECS), {"orders": ["o_custkey"]}, ["customer"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 100 = 0")
def pk_collision_exists(t):
    made = t("customer").select((F.col("c_custkey") * 100).alias("k"))
    return checks.colliding_keys(made, ["k"], t("customer"), ["c_custkey"]).withColumnRenamed("k", "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_duplicates(t):
    return checks.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""SELECT 'duplicate_key' AS "check", 'customer(c_custkey)' AS object, 0::BIGINT AS violations, 'GO' AS go
UNION ALL SELECT 'key_in_target', 'customer(c_custkey)', count(*), CASE WHEN count(*) = 0 THEN 'GO' ELSE 'NO-GO' END FROM customer WHERE c_custkey % 100 = 0
UNION ALL SELECT 'duplicate_key', 'orders(o_orderkey)', 0, 'GO' UNION ALL SELECT 'key_in_target', 'orders(o_orderkey)', 0, 'GO'
UNION ALL SELECT 'no_parent', 'orders (o_custkey) -> customer (c_custkey)', count(*), 'NO-GO' FROM {DIRTY} d WHERE o_custkey NOT IN (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey * 100 FROM customer)""")
def preappend_verdict(t):
    made = {"customer": t("customer").withColumn("c_custkey", F.col("c_custkey") * 100), "orders": dirty_orders(t).withColumn("o_orderkey", F.col("o_orderkey") + 10**9)}
    return structure.pre_append(made, {"customer": t("customer"), "orders": t("orders")}, model.compile_specs({"customer": CHAIN["customer"] | {"foreign_keys": []}, "orders": CHAIN["orders"]}))


# ---- profiles and single tables


@query("""SELECT column_name, kind, total, null_count, null_count / total AS null_share FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'token'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) AS k(column_name, kind), (SELECT count(*) AS total, 0::BIGINT AS null_count FROM customer)""")
def profile_columns(t):
    return marginals.profile_table(t("customer")).drop("distinct_estimate")


@query(union_sql([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, true AS within FROM events" for c in ("event_id", "user_id", "value", "ts")]))
def approx_cardinality(t):
    """Whether estimates from sketches that were kept by event_type and merged lie within their bounds, beside exact counts."""
    events = t("events").select("event_type", "event_id", "user_id", "value", "ts")
    merged = marginals.merged_distinct(marginals.distinct_sketches(events, ["event_type"]))
    columns = [c for c in events.columns if c != "event_type"]
    exact = events.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).where("x.v is not null").groupBy("x.column_name", "x.v").count().groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    return exact.join(merged, "column_name").select("column_name", "n_distinct", F.col("n_distinct").between(F.col("low"), F.col("high")).alias("within"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) = 1")
def first_row_wins(t):
    """Rows that the SQL's order leaves tied go by their place in the table: file, then row."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    placed = t("lineitem").select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row_index"))
    return sampling.first_rows(placed, ["l_orderkey"], ["l_shipdate", "l_linenumber", "__file", "__row_index"], nulls_first=False).select(*columns)


@query("SELECT event_type AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_k_freq(t):
    return metrics.top_values(t("events"), "event_type", 3)


@query("SELECT event_type AS value, count(*) / (SELECT count(*) FROM events) AS share FROM events WHERE event_type IN ('click', 'view', 'none of these') GROUP BY 1")
def category_shares(t):
    return metrics.shares_of(t("events"), "event_type", ["click", "view", "none of these"])


@query(f"SELECT pos, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS v FROM (SELECT pos, {unit_sql('cat|v', 'pos')} AS u FROM {spine_sql('5000')})")
def sample_categorical(t):
    base = t("region").sparkSession.range(5000).withColumnRenamed("id", "pos").withColumn("u", unit("cat|v", F.col("pos")))
    return base.withColumn("v", marginals.categorical(F.col("u"), ("a", "b", "c"), (0.5, 0.3, 0.2), base.select(F.lit("")).schema[0].dataType)).drop("u")


@query(f"SELECT pos, c_acctbal FROM (SELECT pos, {draw_sql('pool|c_acctbal', 'pos', '(SELECT count(*) FROM customer)')} AS place FROM {spine_sql('5000')}) JOIN (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS place FROM customer) USING (place)")
def sample_bootstrap_pool(t):
    return marginals.pooled(t("region").sparkSession.range(5000).withColumnRenamed("id", "pos"), t("customer"), "c_acctbal", "pos")


@query(f"SELECT c_custkey, CASE WHEN {unit_sql('null|c_name', 'c_custkey')} >= 0.25 THEN c_name END AS c_name FROM customer")
def inject_nulls(t):
    return marginals.with_nulls(t("customer").select("c_custkey", "c_name"), "c_name", 0.25, "c_custkey")


@query("SELECT 3000::BIGINT AS n, 3000::BIGINT AS n_keys, 0::BIGINT AS unknown_segments")
def single_table_synthesis(t):
    made = marginals.synthesise_table(t("customer"), 3000, ["c_custkey"])
    known = t("customer").select(F.col("c_mktsegment").alias("m")).distinct()
    return made.join(known, F.col("c_mktsegment") == F.col("m"), "left").agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("n_keys"), F.count_if(F.col("m").isNull()).alias("unknown_segments"))


# ---- metrics


@query("SELECT least(greatest(floor((l_quantity - lo) / ((hi - lo) / 25)), 0), 24)::INTEGER AS bucket, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) GROUP BY 1")
def hist_numeric(t):
    return metrics.histogram(t("lineitem"), "l_quantity")


@query("SELECT least(greatest(floor((e - lo) / ((hi - lo) / 25)), 0), 24)::INTEGER AS bucket, count(*) AS n FROM (SELECT floor(epoch(ts))::DOUBLE AS e FROM events), (SELECT min(floor(epoch(ts)))::DOUBLE AS lo, max(floor(epoch(ts)))::DOUBLE AS hi FROM events) GROUP BY 1")
def hist_datetime(t):
    return metrics.histogram(t("events"), "ts")


def ks_sql(a: str, b: str) -> str:
    """1 - KS distance of column v of two selects."""
    return f"SELECT 1 - max(abs(ra / na - rb / nb)) AS score FROM (SELECT sum(sum(a)) OVER (ORDER BY v) AS ra, sum(sum(b)) OVER (ORDER BY v) AS rb FROM (SELECT v, 1 AS a, 0 AS b FROM ({a}) UNION ALL SELECT v, 0, 1 FROM ({b})) GROUP BY v), (SELECT count(*) AS na FROM ({a})), (SELECT count(*) AS nb FROM ({b}))"


def tv_sql(a: str, b: str) -> str:
    return f"SELECT 1 - sum(abs(coalesce(x.n, 0) / (SELECT count(*) FROM ({a})) - coalesce(y.n, 0) / (SELECT count(*) FROM ({b})))) / 2 AS score FROM (SELECT v, count(*) AS n FROM ({a}) GROUP BY v) x FULL JOIN (SELECT v, count(*) AS n FROM ({b}) GROUP BY v) y ON x.v = y.v"


@query(ks_sql("SELECT c_acctbal AS v FROM customer", "SELECT s_acctbal AS v FROM supplier"))
def ks_complement(t):
    return metrics.ks_complement(t("customer"), "c_acctbal", t("supplier"), "s_acctbal")


@query(tv_sql("SELECT c_nationkey AS v FROM customer", "SELECT s_nationkey AS v FROM supplier"))
def tv_complement(t):
    return metrics.tv_complement(t("customer"), ["c_nationkey"], t("supplier"), ["s_nationkey"])


HALVES = ("orders", "(SELECT * FROM orders WHERE o_orderkey % 3 = 0)")


@query(union_sql([
    *[f"SELECT '{c}' AS column_name, 'KSComplement' AS metric, score FROM ({ks_sql(f'SELECT {e} AS v FROM {HALVES[0]}', f'SELECT {e} AS v FROM {HALVES[1]}')})" for c, e in (("o_totalprice", "o_totalprice"), ("o_orderdate", "floor(epoch(o_orderdate))"), ("o_custkey", "o_custkey"))],
    *[f"SELECT '{c}' AS column_name, 'TVComplement' AS metric, score FROM ({tv_sql(f'SELECT {c} AS v FROM {HALVES[0]}', f'SELECT {c} AS v FROM {HALVES[1]}')})" for c in ("o_orderstatus", "o_orderpriority")],
]))
def column_shapes(t):
    return metrics.column_shapes(t("orders"), t("orders").where("o_orderkey % 3 = 0"), {"o_orderkey"})


THIRD = "o_orderkey % 3 = 0"


@query(f"SELECT avg(score) AS score, count(score) AS n_columns FROM ({ORACLES['column_shapes']})")
def shape_score(t):
    return reports.shape_score(metrics.column_shapes(t("orders"), t("orders").where(THIRD), {"o_orderkey"}))


@query(f"SELECT * FROM ({ORACLES['column_shapes']}) ORDER BY score, column_name LIMIT 2")
def worst_columns(t):
    return metrics.worst(metrics.column_shapes(t("orders"), t("orders").where(THIRD), {"o_orderkey"}), 2)


def _trend_sql(x: str, y: str, where: str) -> str:
    return f"(SELECT {x} AS x, {y} AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE {where})"


@query(f"SELECT 1 - abs((SELECT corr(x, y) FROM {_trend_sql('o_totalprice', 'c_acctbal', 'true')}) - (SELECT corr(x, y) FROM {_trend_sql('o_totalprice', 'c_acctbal', THIRD)})) / 2 AS score")
def inter_table_trend(t):
    fk = ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    return reports.across_tables((t("orders"), t("customer")), (t("orders").where(THIRD), t("customer")), fk, "o_totalprice", "c_acctbal")


@query("SELECT 1 - sum(abs(coalesce(x.n, 0) / (SELECT count(*) FROM orders) - coalesce(y.n, 0) / (SELECT count(*) FROM " + HALVES[1] + "))) / 2 AS score FROM " + " FULL JOIN ".join(f"(SELECT x || '|' || y AS k, count(*) AS n FROM {_trend_sql('o_orderpriority', 'c_mktsegment', w)} GROUP BY k) {n}" for n, w in (("x", "true"), ("y", THIRD))) + " ON x.k = y.k")
def inter_table_categories(t):
    fk = ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    return reports.across_tables((t("orders"), t("customer")), (t("orders").where(THIRD), t("customer")), fk, "o_orderpriority", "c_mktsegment")


@query(ks_sql("SELECT o_totalprice AS v FROM orders", f"SELECT round(o_totalprice) AS v FROM orders WHERE {THIRD}"))
def aligned_shapes(t):
    """Numbers of different types on both sides are compared as numbers."""
    other = t("orders").where(THIRD).select(F.round("o_totalprice").cast("long").alias("o_totalprice"))
    return metrics.column_shapes(*reports.aligned(t("orders").select("o_totalprice"), other)).select("score")


@query("SELECT * FROM (VALUES ('customer', 'no synthetic table'), ('orders', 'empty synthetic table'), ('orders', 'reference (o_custkey) -> customer (c_custkey) does not stand in the synthetic set'), ('nation', 'no common column')) x(table_name, problem)")
def metric_preflight(t):
    specs = {n: model.compile_specs(CHAIN)[n] for n in ("nation", "customer", "orders")}
    specs = model.sanitise(specs, model.Problems())
    original = {n: t(n) for n in specs}
    return reports.preflight(original, {"orders": t("orders").where("false"), "nation": t("nation").select(F.lit(1).alias("other"))}, specs)


REPORT_SPECS = {"customer": {"pk_cols": "c_custkey"}, "orders": {"pk_cols": "o_orderkey", "foreign_keys": [{"columns": "o_custkey", "parent_table": "customer"}]}}


@query(f"""SELECT 'column_shapes' AS property, 'orders' AS object, avg(score) AS score FROM ({ORACLES['column_shapes']})
UNION ALL SELECT 'column_shapes', 'customer', 1.0 UNION ALL SELECT 'structure', 'orders', 1.0 UNION ALL SELECT 'structure', 'customer', 1.0
UNION ALL SELECT 'cardinality', 'orders (o_custkey) -> customer (c_custkey)', score FROM ({ks_sql("SELECT count(o_custkey)::DOUBLE AS v FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", f"SELECT count(o_custkey)::DOUBLE AS v FROM customer LEFT JOIN {HALVES[1]} ON o_custkey = c_custkey GROUP BY c_custkey")})
UNION ALL SELECT 'referential_integrity', 'orders (o_custkey) -> customer (c_custkey)', 1.0""")
def quality_report(t):
    sides = {"customer": t("customer"), "orders": t("orders")}, {"customer": t("customer"), "orders": t("orders").where(THIRD)}
    return reports.quality_report(*sides, model.compile_specs(REPORT_SPECS)).drop("note")


@query("SELECT coalesce(x.b, y.b)::VARCHAR AS bucket, coalesce(x.n, 0) / (SELECT count(*) FROM orders) AS share_original, coalesce(y.n, 0) / (SELECT count(*) FROM " + HALVES[1] + ") AS share_synthetic FROM " + " FULL JOIN ".join(f"(SELECT least(greatest(floor((o_totalprice - lo) / ((hi - lo) / 25)), 0), 24)::INTEGER AS b, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) WHERE {w} GROUP BY 1) {n}" for n, w in (("x", "true"), ("y", THIRD))) + " ON x.b = y.b")
def distribution_numeric(t):
    return reports.distribution(t("orders"), t("orders").where(THIRD), "o_totalprice")


@query(f"SELECT o_orderstatus AS bucket, count(*) / (SELECT count(*) FROM orders) AS share_original, count(*) FILTER (WHERE {THIRD}) / (SELECT count(*) FROM {HALVES[1]}) AS share_synthetic FROM orders GROUP BY 1")
def distribution_categories(t):
    return reports.distribution(t("orders"), t("orders").where(THIRD), "o_orderstatus")


@query("SELECT l_orderkey * 10 + l_linenumber AS pos, 'tok_' || substr(md5('42|line|' || (l_orderkey * 10 + l_linenumber)::VARCHAR), 1, 12) AS token FROM lineitem")
def sample_tokens(t):
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return t("lineitem").select(pos.alias("pos"), token("line", pos).alias("token"))


@query("SELECT p_partkey AS pos, p_partkey + 1 AS number, md5('42|key|k|' || p_partkey::VARCHAR) AS text FROM part")
def sample_keys(t):
    pos = F.col("p_partkey")
    return t("part").select(pos.alias("pos"), marginals.key_values(pos, T.LongType(), "k").alias("number"), marginals.key_values(pos, T.StringType(), "k").alias("text"))


@query("SELECT * FROM (VALUES ('orders', 'o_custkey', 'customer', 'c_custkey'), ('nation', 'n_regionkey', 'region', 'r_regionkey')) x(child_table, fk_cols, parent_table, parent_cols)")
def conflict_resolution(t):
    """Of references that claim one column, the one that the data bear out best."""
    claims = [("orders", "o_custkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey")]
    tables = {n: t(n) for n in ("orders", "customer", "supplier", "nation", "region")}
    report = checks.within_tolerance(checks.reference_report(tables, [(c, ForeignKey((x,), p, (y,))) for c, x, p, y in claims]), 1.0).collect()  # one row a claim
    to = {(c, x, p): y for c, x, p, y in claims}
    found = discovery.resolve_conflicts([{"child_table": r["child_table"], "columns": [r["fk_cols"]], "parent": r["parent_table"], "match_rate": r["match_rate"], "orphan_keys": r["orphan_keys"]} for r in report])
    return t("region").sparkSession.createDataFrame([(f["child_table"], f["columns"][0], f["parent"], to[f["child_table"], f["columns"][0], f["parent"]]) for f in found], "child_table string, fk_cols string, parent_table string, parent_cols string")


@query("SELECT min(n) AS min_n, max(n) AS max_n, avg(n) AS avg_n, quantile_cont(n, 0.5)::DOUBLE AS median_n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def fanout_stats(t):
    return metrics.fan_out_stats(t("orders"), ["o_custkey"])


COUNTS = "SELECT count(o_custkey)::DOUBLE AS v FROM customer LEFT JOIN {} ON o_custkey = c_custkey GROUP BY c_custkey"


def _sides(t: Load):
    return (t("customer"), "c_custkey", t("orders"), "o_custkey"), (t("customer"), "c_custkey", t("orders").where("o_orderkey % 3 = 0"), "o_custkey")


@query(ks_sql(COUNTS.format("orders"), COUNTS.format(HALVES[1])))
def fanout_ks(t):
    return metrics.cardinality_similarity(*_sides(t))


@query(f"SELECT avg(CASE WHEN v BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS score FROM ({COUNTS.format(HALVES[1])}), (SELECT min(v) AS lo, max(v) AS hi FROM ({COUNTS.format('orders')}))")
def cardinality_boundary(t):
    return metrics.cardinality_boundary(*_sides(t))


@query(f"SELECT avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1.0::DOUBLE ELSE 0 END) AS score FROM {DIRTY} WHERE o_custkey IS NOT NULL")
def referential_integrity(t):
    return metrics.referential_integrity(dirty_orders(t), "o_custkey", t("customer"), "c_custkey")


@query("SELECT round(1 - abs(x - y) / 2, 9) AS score FROM (SELECT corr(l_quantity, l_extendedprice) AS x FROM lineitem), (SELECT corr(l_quantity, l_extendedprice) AS y FROM lineitem WHERE l_orderkey % 3 = 0)")
def pair_corr(t):
    return metrics.pair_correlation(t("lineitem"), t("lineitem").where("l_orderkey % 3 = 0"), "l_quantity", "l_extendedprice").select(F.round("score", 9).alias("score"))


@query(tv_sql("SELECT l_returnflag || '|' || l_linestatus AS v FROM lineitem", "SELECT l_returnflag || '|' || l_linestatus AS v FROM lineitem WHERE l_orderkey % 3 = 0"))
def pair_contingency(t):
    return metrics.pair_contingency(t("lineitem"), t("lineitem").where("l_orderkey % 3 = 0"), "l_returnflag", "l_linestatus")


@query("""SELECT 'c_custkey' AS column_name, count(DISTINCT c_custkey // 2) / count(*) AS score FROM customer UNION ALL SELECT 'c_acctbal', avg(CASE WHEN 2 * c_acctbal BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) UNION ALL SELECT 'c_mktsegment', 1.0""")
def data_validity(t):
    c = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return metrics.validity(c, c.withColumns({"c_custkey": F.floor(F.col("c_custkey") / 2), "c_acctbal": 2 * F.col("c_acctbal")}), {"c_custkey"})


@query("SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS n_original, count(*) AS n_synthetic, round(count(*) / (SELECT count(*) FROM orders), 4) AS factor FROM orders WHERE o_orderkey % 3 = 0")
def volume_table(t):
    return metrics.volumes({"orders": t("orders")}, {"orders": t("orders").where("o_orderkey % 3 = 0")})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - l_quantity * 1000) > 500")
def business_rule_breaks(t):
    l = t("lineitem").withColumn("price", F.lit(1000))  # noqa: E741
    return metrics.business_breaks(l, "l_extendedprice", "l_quantity", "price", 500).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def temporal_breaks(t):
    return metrics.order_breaks(t("lineitem"), "l_orderkey", "l_shipdate", t("orders"), "o_orderkey", "o_orderdate").select("l_orderkey", "l_linenumber")


# ---- specs

META = [("OWN.REGION", "R_ID", "Y", "N", None, None, "1"), ("OWN.NATION", "N_ID", "sim", "", None, None, "1"), ("OWN.NATION", "R_ID", "0", "true", "OWN.REGION", "R_ID", "2"), ("OWN.NATION", "NAME", "nan", "S", "none", None, "3")]


@query("SELECT * FROM (VALUES ('REGION', 'R_ID', 1, TRUE, FALSE, NULL, NULL), ('NATION', 'N_ID', 1, TRUE, FALSE, NULL, NULL), ('NATION', 'R_ID', 2, FALSE, TRUE, 'REGION', 'R_ID'), ('NATION', 'NAME', 3, FALSE, FALSE, NULL, NULL)) AS x(table_name, column_name, position, is_pk, is_fk, ref_table, ref_column)")
def metadata_to_specs(t):
    df = t("region").sparkSession.createDataFrame(META, "TABLE_NAME string, COLUMN_NAME string, IS_PRIMARY_KEY string, IS_FOREIGN_KEY string, FK_REF_TABLE string, FK_REF_COLUMN string, COLUMN_ID string")
    return metadata.candidates(df)


@query("SELECT 'NATION' AS table_name, 'R_ID' AS column_name, 'REGION' AS ref_table, 'R_ID' AS ref_column, TRUE AS ref_is_pk")
def constraint_lookup(t):
    df = t("region").sparkSession.createDataFrame(META, "TABLE_NAME string, COLUMN_NAME string, IS_PRIMARY_KEY string, IS_FOREIGN_KEY string, FK_REF_TABLE string, FK_REF_COLUMN string, COLUMN_ID string")
    return metadata.constraint_columns(df, "NATION", "R_ID")


@query("SELECT * FROM (VALUES (0, 'region'), (1, 'nation'), (2, 'customer'), (3, 'orders')) AS x(place, table_name)")
def topological_order(t):
    names, _ = model.order(model.compile_specs(CHAIN))
    return t("region").sparkSession.createDataFrame(list(enumerate(names)), "place int, table_name string")


@query("SELECT * FROM (VALUES (0, 'customer'), (0, 'nation'), (0, 'orders'), (0, 'region'), (1, 'part')) AS x(component, table_name)")
def connected_components(t):
    groups = model.components(model.compile_specs(CHAIN | {"part": {"pk_cols": "p_partkey"}}))
    return t("region").sparkSession.createDataFrame([(i, n) for i, g in enumerate(groups) for n in g], "component int, table_name string")


@query("SELECT * FROM (VALUES ('customer', 1500::BIGINT), ('nation', 25), ('orders', 450), ('region', 5)) AS x(table_name, n_rows)")
def row_count_plan(t):
    plan = model.target_rows(model.compile_specs(CHAIN), {"region": 5, "nation": 25, "customer": 1500, "orders": 15_000}, 0.03)
    return t("region").sparkSession.createDataFrame(sorted(plan.items()), "table_name string, n_rows long")


PLAN_SQL = "(SELECT i::INTEGER AS plan_id, 'P' || i AS plan_code, (250 + 500 * i * i)::BIGINT AS seat_cents FROM range(1, 7) r(i))"


def contract_sql(n: int) -> str:
    pick = lambda what, of: draw_sql(f"demo|contract|{what}", "contract_id", of)
    base = f"(SELECT i AS contract_id, (1 + least({pick('plan', '6')}, {pick('other plan', '6')}))::INTEGER AS plan_id FROM (SELECT i, i AS contract_id FROM range(1, {n + 1}) r(i)))"
    return f"(SELECT contract_id, plan_code || '-' || lpad(contract_id::VARCHAR, 9, '0') AS contract_code, plan_id, DATE '2021-03-01' + ({pick('start', '1460')})::INTEGER AS started, (1 + {pick('seats', '50')}) * seat_cents AS monthly_cents FROM {base} JOIN {PLAN_SQL} p USING (plan_id))"


def payment_sql(contracts: int, n: int) -> str:
    pick = lambda what, of: draw_sql(f"demo|payment|{what}", "payment_id", of)
    base = f"(SELECT i AS payment_id, 1 + least({pick('contract', str(contracts))}, {pick('other contract', str(contracts))}) AS contract_id FROM (SELECT i, i AS payment_id FROM range(1, {n + 1}) r(i)))"
    state = pick("state", "100")
    return f"""(SELECT payment_id, contract_id, contract_code, started + ({pick('day', '730')})::INTEGER AS paid_on, 1 + {pick('months', '12')} AS months, monthly_cents,
        (1 + {pick('months', '12')}) * monthly_cents AS cents, CASE WHEN {state} < 80 THEN 'paid' WHEN {state} < 95 THEN 'open' ELSE 'void' END AS state
        FROM {base} JOIN {contract_sql(contracts)} c USING (contract_id))"""


@query(f"SELECT * FROM {PLAN_SQL}")
def demo_plans(t):
    return demo.plans(t("region").sparkSession)


@query(f"SELECT * FROM {contract_sql(1000)}")
def demo_contracts(t):
    return demo.contracts(t("region").sparkSession)


@query(f"SELECT * FROM {payment_sql(1000, 50_000)}")
def demo_payments(t):
    return demo.payments(demo.contracts(t("region").sparkSession))


@query(f"SELECT 'contracts_of_plan' AS what, plan_id::VARCHAR AS value, count(*) AS n FROM {contract_sql(300)} GROUP BY plan_id UNION ALL SELECT 'payments_in_state', state, count(*) FROM {payment_sql(300, 5000)} GROUP BY state")
def demo_distributions(t):
    return demo.demo_distributions(demo.demo(t("region").sparkSession, 300, 5000))


@query(f"""WITH p AS (SELECT * FROM {payment_sql(300, 5000)}), c AS (SELECT * FROM {contract_sql(300)})
SELECT 'contract_without_plan' AS "check", count(*) AS n FROM c WHERE plan_id NOT IN (SELECT plan_id FROM {PLAN_SQL})
UNION ALL SELECT 'payment_without_contract', count(*) FROM p WHERE contract_id NOT IN (SELECT contract_id FROM c)
UNION ALL SELECT 'number_and_code_disagree', count(*) FROM p ANTI JOIN c USING (contract_id, contract_code)
UNION ALL SELECT 'cents_are_not_months_times_price', count(*) FROM p WHERE cents <> months * monthly_cents
UNION ALL SELECT 'payment_before_start', count(*) FROM p JOIN c USING (contract_id) WHERE paid_on < started""")
def demo_integrity(t):
    return demo.demo_report(demo.demo(t("region").sparkSession, 300, 5000))


@query("SELECT 'duplicate_key' AS \"check\", 0::BIGINT AS violations UNION ALL SELECT 'null_key', 0 UNION ALL SELECT 'orphan_rows', 0")
def flagship_gate(t):
    made = synthesise({n: t(n) for n in CHAIN}, CHAIN, check=False)
    return checks.gate(made, model.compile_specs(CHAIN)).groupBy("check").agg(F.sum("violations").alias("violations"))
