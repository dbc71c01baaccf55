import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.operators import checks, keys, rows, sampling
from kinforge.plans import model
from kinforge.plans.synthesis import synthesise


def tables(spark):
    a = spark.range(10).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    b = spark.range(30).select(F.col("id"), (F.col("id") % 10).cast("int").alias("a_id"), F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("boss"))
    return {"a": a, "b": b}


CONFIG = {"a": {"pk_cols": "id"}, "b": {"pk_cols": "id", "foreign_keys": [{"columns": "a_id", "parent_table": "a"}, {"columns": "boss", "parent_table": "b"}]}}


def violations(made, config):
    return {(r["check"], r["object"]): r["violations"] for r in checks.gate(made, model.compile_specs(config)).collect() if r["violations"]}


def test_counts_keys_references_nulls(spark):
    made = synthesise(tables(spark), CONFIG, scale=3.0)
    assert made["a"].count() == 30 and made["b"].count() == 90
    assert not violations(made, CONFIG)
    assert made["b"].where("id < 30").count() == 0
    assert made["b"].where("boss is null").count() > 0
    assert made["b"].columns == ["id", "a_id", "boss"] and made["b"].schema["a_id"].dataType == T.IntegerType()


def test_same_result_whatever_the_partitions(spark):
    one = synthesise(tables(spark), CONFIG, check=False)["b"].orderBy("id").collect()
    other = {t: df.repartition(7) for t, df in tables(spark).items()}
    assert one == synthesise(other, CONFIG, check=False)["b"].orderBy("id").collect()


def test_cycle_and_self_loop(spark):
    a = spark.createDataFrame([(i, i % 4) for i in range(6)], "id long, b_id long")
    b = spark.createDataFrame([(i, i % 6, i if i == 2 else None) for i in range(4)], "id long, a_id long, own long")
    config = {"a": {"pk_cols": "id", "foreign_keys": [{"columns": "b_id", "parent_table": "b"}]}, "b": {"pk_cols": "id", "foreign_keys": [{"columns": "a_id", "parent_table": "a"}, {"columns": "own", "parent_table": "b"}]}}
    made = synthesise({"a": a, "b": b}, config)
    assert not violations(made, config)
    assert made["b"].where("own is not null and own <> id").count() == 0 and made["b"].where("own = id").count() >= 1


def test_shared_key_child_is_bound(spark):
    a = spark.range(10)
    s = spark.range(8).withColumn("v", F.col("id") * 2)
    g = spark.range(20).select((F.col("id") + 100).alias("g"), (F.col("id") % 8).alias("s_id"))
    config = {"a": {"pk_cols": "id"}, "s": {"pk_cols": "id", "foreign_keys": [{"columns": "id", "parent_table": "a"}]}, "g": {"pk_cols": "g", "foreign_keys": [{"columns": "s_id", "parent_table": "s"}]}}
    made = synthesise({"a": a, "s": s, "g": g}, config)
    assert not violations(made, config)
    assert made["s"].count() == 16 and made["g"].where("s_id is null").count() == 0


def test_composite_key_with_a_null_part_stays(spark):
    mapping = spark.createDataFrame([(1, 1, 101, 201, 1, 2), (1, 1, 102, 202, 2, 2)], "old_0 long, old_1 long, new_0 long, new_1 long, rank int, count long")
    child = spark.createDataFrame([(0, 1, 1), (1, 1, None), (2, 9, 9)], "pos long, x long, y long")
    for wide in (False, True):
        got = {r["pos"]: (r["x"], r["y"]) for r in keys.remap(child, ["x", "y"], mapping, "p", wide=wide).collect()}
        assert got[0] in ((101, 201), (102, 202)) and got[1] == (1, None) and got[2] == (None, None)


@pytest.mark.parametrize(("kind", "limit"), [("tinyint", 127), ("smallint", 32767), ("int", 2**31 - 1), ("decimal(4,0)", 9999), ("float", 2**24), ("double", 2**53)])
def test_key_types_have_limits(spark, kind, limit):
    dtype = spark.range(1).select(F.col("id").cast(kind).alias("k")).schema["k"].dataType
    keys.new_key(F.lit(0), "k", dtype, limit, 1)
    with pytest.raises(OverflowError):
        keys.new_key(F.lit(0), "k", dtype, limit, 2)


def test_dates_are_no_keys():
    with pytest.raises(TypeError):
        keys.new_key(F.lit(0), "k", T.DateType(), 1, 1)


def test_string_keys_go_on_above_earlier_ones(spark):
    df = spark.createDataFrame([("SYN_k_00000000000007",), ("other",)], "k string")
    assert keys.largest_key(df, "k") == 7


def test_bootstrap_edges(spark):
    numbered = rows.number_rows(spark.range(5), ["id"])
    assert rows.bootstrap(numbered, 0, 5, "x").count() == 0
    with pytest.raises(ValueError):
        rows.bootstrap(numbered, 3, 5, "x", keep_all=True)
    with pytest.raises(ValueError):
        rows.bootstrap(numbered, 3, 0, "x")
    assert {r["id"] for r in rows.bootstrap(numbered, 7, 5, "x", keep_all=True).where("pos < 5").collect()} == set(range(5))


def test_sample_keeps_partly_null_keys(spark):
    parent = spark.createDataFrame([(1, 1)], "a long, b long")
    child = spark.createDataFrame([(1, 1), (1, None), (None, None), (2, 2)], "a long, b long")
    assert sampling.keep_referenced(child, ["a", "b"], parent, ["a", "b"]).count() == 3


def test_repair_never_loses_rows(spark):
    parent = spark.range(3)
    child = spark.createDataFrame([(i, i) for i in range(8)], "k long, p long")
    for nullable in (["p"], []):
        out = sampling.repair(child, ["p"], parent, ["id"], ["k"], nullable, "x")
        assert out.count() == 8
        assert out.where("p is not null and p > 2").count() == 0
        assert (out.where("p is null").count() == 5) == bool(nullable)


def test_closure_of_a_loop_ends(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "id long, up long")
    assert {r["id"] for r in sampling.close_over_self(loop.where("id = 1"), ["up"], loop, ["id"]).collect()} == {1, 2, 3}


def test_gate_names_what_it_cannot_verify(spark):
    specs = {"c": model.Table("c", ("k",), (model.ForeignKey(("missing",), "c", ("k",)),))}
    report = checks.gate({"c": spark.createDataFrame([(1,), (1,)], "k long")}, specs)
    with pytest.raises(RuntimeError, match="cannot be verified"):
        checks.require(report)
