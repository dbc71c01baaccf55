"""Closure over references and row caps against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinforge.operators import closure, sampling
from kinforge.plans import model, pipeline


def plain_closure(rows, start, references):
    """rows: table -> {key: row}; start: table -> keys; references: (child, column, parent)."""
    have = {t: set(start.get(t, ())) for t in rows}
    while True:
        more = [(p, rows[t][k][c]) for t, c, p in references for k in have[t] if rows[t][k][c] in rows[p] and rows[t][k][c] not in have[p]]
        if not more:
            return have
        for p, k in more:
            have[p].add(k)


def group_of(spark, tables, config):
    return pipeline.Group(spark, pipeline.Layout("", ""), model.compile_specs(config), full=tables)


@pytest.mark.parametrize("order", list(itertools.permutations([("boss", "employee"), ("customer", "customer")])))
def test_pulled_in_rows_have_their_own_parents(spark, order):
    """Employee 3 has boss 2, who has boss 1, and each has a customer: none of these is lost, whatever comes first."""
    tables = {"employee": spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 2, 3)], "id int, boss int, customer int"), "customer": spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")}
    group = group_of(spark, tables, {"employee": {"pk_cols": "id", "foreign_keys": [{"columns": c, "parent_table": t, "parent_columns": "id"} for c, t in order]}, "customer": {"pk_cols": "id"}})
    closed = group.close({"employee": tables["employee"].where("id = 3"), "customer": tables["customer"].where("id = 3")})
    assert sorted(r.id for r in closed["customer"].collect()) == [1, 2, 3]
    repaired = group.repaired(closed, {"employee": set(), "customer": set()})
    assert sorted(repaired["employee"].collect(), key=str) == sorted(tables["employee"].collect(), key=str)


def test_cycles_are_closed(spark):
    tables = {"a": spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "id int, b int"), "b": spark.createDataFrame([(10, 2), (20, 3), (30, None), (40, 4)], "id int, a int")}
    group = group_of(spark, tables, {"a": {"pk_cols": "id", "foreign_keys": [{"columns": "b", "parent_table": "b", "parent_columns": "id"}]}, "b": {"pk_cols": "id", "foreign_keys": [{"columns": "a", "parent_table": "a", "parent_columns": "id"}]}})
    closed = group.close({"a": tables["a"].where("id = 1"), "b": tables["b"].where("false")})
    assert {t: sorted(r.id for r in df.collect()) for t, df in closed.items()} == {"a": [1, 2, 3], "b": [10, 20, 30]}


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c"]
    references = [("a", "x", "b"), ("a", "y", "a"), ("a", "z", "a"), ("b", "x", "c"), ("b", "y", "b"), ("c", "x", "a")]
    rng.shuffle(references)
    rows = {t: {k: {c: rng.choice([None, rng.randrange(45)]) for c in "xyz"} for k in range(40)} for t in names}
    start = {t: set(rng.sample(range(40), 2)) for t in names}
    full = {t: spark.createDataFrame([(k, *r.values()) for k, r in rows[t].items()], "id long, x long, y long, z long") for t in names}
    config = {t: {"pk_cols": "id", "foreign_keys": [{"columns": c, "parent_table": p, "parent_columns": "id"} for child, c, p in references if child == t]} for t in names}
    closed = group_of(spark, full, config).close({t: df.where(F.col("id").isin(list(start[t]))) for t, df in full.items()})
    assert {t: sorted(r.id for r in df.collect()) for t, df in closed.items()} == {t: sorted(v) for t, v in plain_closure(rows, start, references).items()}
    assert all(closed[t].columns == full[t].columns for t in names)


def test_references_to_other_keys_and_composite_ones(spark):
    """A parent that is referred to by two different keys, one of two columns with nulls; repeated rows stay."""
    parents = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (2, "a", 2), (3, "b", None)], "id int, code string, n int")
    children = spark.createDataFrame([(1, 1, None, None), (2, None, "a", 2), (3, None, "b", None), (4, 3, None, None)], "k int, p int, code string, n int")
    fks = [{"columns": "p", "parent_table": "p", "parent_columns": "id"}, {"columns": ["code", "n"], "parent_table": "p", "parent_columns": ["code", "n"]}]
    specs = {"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": fks}}
    closed = group_of(spark, {"p": parents, "c": children}, specs).close({"c": children.where("k < 4"), "p": parents.where("false")})
    assert sorted(r.id for r in closed["p"].collect()) == [1, 2, 2]


def test_a_chain_of_a_thousand_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = closure.freeze
    monkeypatch.setattr(closure, "freeze", lambda df: rounds.append(1) or real(df))
    chain = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up")).repartition(2)
    assert closure.close_over_self(chain.where("id = 999"), ["up"], chain, ["id"]).count() == 1000
    assert len(rounds) <= 1 + 2 * 12  # keys, then rows and steps of each round
    loop = spark.range(64).select("id", ((F.col("id") + 1) % 64).alias("up"))
    assert closure.close_over_self(loop.where("id = 5"), ["up"], loop, ["id"]).count() == 64


KEYS = {
    "long": ("k long", lambda r: r.randrange(-50, 50)),
    "double": ("k double", lambda r: r.choice([0.5, -1.25, float("inf"), float("-inf"), r.uniform(-3, 3)])),
    "string": ("k string", lambda r: "".join(r.choice("abé𝔘z") for _ in range(r.randrange(0, 9)))),
    "date": ("k date", lambda r: __import__("datetime").date(2000 + r.randrange(40), 1, 1 + r.randrange(28))),
    "boolean": ("k boolean", lambda r: r.random() < 0.5),
}


@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("n", [100, 101, 399, 640, 900, 1200])
def test_caps_take_the_first_rows_in_key_order(spark, kind, n):
    schema, value = KEYS[kind]
    rng = random.Random(kind)
    rows = [(None if rng.random() < 0.1 else value(rng), i // 2) for i in range(1000)]
    df = spark.createDataFrame(rows, f"{schema}, `odd name` int").repartition(5)
    order = ["k", "odd name"]
    want = [tuple(r) for r in df.orderBy(*[F.col(f"`{c}`") for c in order]).limit(n).collect()]
    got = sampling.capped(df, order, n)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_caps_send_no_rows_of_every_partition_to_one_task(spark):
    df = spark.range(0, 5000, 1, 7).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    for n in (sampling.FEW + 1, 4999):
        plan = sampling.capped(df, ["id"], n)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "Exchange" not in plan
    assert "TakeOrdered" in sampling.capped(df, ["id"], sampling.FEW)._jdf.queryExecution().executedPlan().toString()
    topped = sampling.top_up(df.where("id % 10 = 0"), df, ["id"], 3000)
    assert "TakeOrdered" not in topped._jdf.queryExecution().executedPlan().toString()
    assert topped.count() == 3000 and topped.select("id").distinct().count() == 3000


def test_ties_and_short_tables(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    assert sampling.capped(same, ["k"], 200).count() == 200
    assert sampling.capped(same, ["k"], 500).count() == 500 and sampling.capped(same, ["k"], 700).count() == 500
    assert sampling.capped(same.where("false"), ["k"], 200).count() == 0
    nothing = same.withColumn("k", F.lit(None).cast("int"))
    assert sampling.capped(nothing, ["k", "id"], 150).agg(F.max("id")).first()[0] == 149


def test_bounded_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("__drawn", F.lit(1))
    a, b = (sorted(r.id for r in sampling.bounded_sample(df.repartition(p), ["id"], 400, seed=7).collect()) for p in (1, 6))
    assert a == b and len(a) == 400 and a != sorted(r.id for r in sampling.bounded_sample(df, ["id"], 400, seed=8).collect())


def test_a_filter_on_every_table_or_on_roots_alone(spark):
    tables = {"p": spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string"), "c": spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x")], "k int, p int, kind string"), "d": spark.createDataFrame([(1, 1)], "k int, c int")}
    config = {"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "p"}]}, "d": {"pk_cols": "k", "foreign_keys": [{"columns": "c", "parent_table": "c"}]}}
    for everywhere, want in ((False, [1, 2]), (True, [1])):
        group = pipeline.Group(spark, pipeline.Layout("", "", root_column="kind", root_value="x", everywhere=everywhere), model.compile_specs(config), full=tables)
        sampled = group.sample(None)
        assert sorted(r.k for r in sampled["c"].collect()) == want and sampled["d"].count() == 1


def test_closure_does_not_follow_known_links_again(spark, monkeypatch):
    from kinforge.operators import closure

    full = spark.range(201).select("id", (F.col("id") - 1).alias("up"))
    written, freeze = [], closure.freeze
    monkeypatch.setattr(closure, "freeze", lambda df: written.append(1) or freeze(df))
    known, new = full.where("id < 200"), full.where("id = 200")
    assert closure.pulled(new, ["up"], known, full, ["id"], through=True).count() == 0
    assert len(written) <= 4
    assert {r["id"] for r in closure.close_over_self(full.where("id in (7, 3, 12)"), ["up"], full, ["id"]).collect()} == set(range(13))
