"""Readers that stop early, guards, and names that need quoting."""

import os

import pytest
from pyspark.sql import functions as F

from kinforge.operators import checks, discovery, marginals, metrics, sampling
from kinforge.sources import readers, writers


def parts(spark, tmp_path, n=8, each=50):
    path = f"file://{tmp_path}/t"
    spark.range(0, n * each, 1, n).select("id", (F.col("id") % 3).alias("k")).write.parquet(path)
    return path


def test_only_parts_that_are_needed_are_read(spark, tmp_path, monkeypatch):
    path = parts(spark, tmp_path)
    footers = []
    real = readers.rows_in
    monkeypatch.setattr(readers, "rows_in", lambda s, f: footers.append(f) or real(s, f))
    df = readers.read_parts(spark, path, 120)
    assert len(df.inputFiles()) == len(footers) == 3 and df.count() == 120
    ids = sorted(r.id for r in df.collect())
    assert ids == sorted(r.id for r in readers.read_parts(spark, path, 120).collect()) and len(set(ids)) == 120
    assert ids != sorted(r.id for r in readers.read_parts(spark, path, 120, seed=7).collect())
    assert len(readers.read_parts(spark, path, 100).inputFiles()) == 2
    assert [readers.read_parts(spark, path, n).count() for n in (0, 1, 50, 400, 1000)] == [0, 1, 50, 400, 400]


def test_parts_of_a_partitioned_table_keep_their_columns(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.range(90).select("id", (F.col("id") % 3).alias("day")).repartition(3, "day").write.partitionBy("day").parquet(path)
    df = readers.read_parts(spark, path, 40)
    assert set(df.columns) == {"id", "day"} and df.count() == 40 and df.where("id % 3 <> day").count() == 0
    assert readers.is_parquet(spark, path) and readers.read_parquet(spark, path).count() == 90


def test_caps_of_sets_and_paths(spark, tmp_path, caplog):
    path = parts(spark, tmp_path, 2, 30)
    spark.range(9).write.csv(f"file://{tmp_path}/c", header=True)
    paths = {"a": path, "b": f"file://{tmp_path}/c", "other": path}
    made = readers.read_tables(spark, paths, formats={"b": "csv"}, limit=5, wanted=["a", "b"])
    assert {t: df.count() for t, df in made.items()} == {"a": 5, "b": 5}
    assert "other: nobody wants" in caplog.text
    with pytest.raises(ValueError, match="no path for"):
        readers.read_tables(spark, paths, wanted=["gone"])


def test_other_formats_are_refused(spark, tmp_path):
    os.makedirs(tmp_path / "x")
    (tmp_path / "x" / "part.parquet").write_text("a,b\n1,2\n")
    for path in (f"file://{tmp_path}/x", f"file://{tmp_path}/x/part.parquet"):
        with pytest.raises(ValueError, match="not Parquet"):
            readers.read_parquet(spark, path)


def test_paths():
    assert readers.object_uri("oci", "b", "n", "/x/") == "oci://b@n/x" and readers.object_uri("s3a", "b") == "s3a://b"
    assert writers.is_local("/x") and writers.is_local("file:///x") and not writers.is_local("s3a://b/x")


def test_names_with_dots_and_spaces(spark):
    rows = [(i, i % 7, f"c{i % 3}", None if i % 5 == 0 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "`a.id` long, `b.ref` long, `c d` string, `e.f` double")
    other = df.where("`a.id` % 2 = 0")
    assert discovery.unique_columns(df) == ["a.id"]
    assert {r.column_name: r.null_count for r in marginals.profile_table(df).collect()} == {"a.id": 0, "b.ref": 0, "c d": 0, "e.f": 12}
    assert {r.column_name for r in metrics.column_shapes(df, other, {"a.id"}).where("score > 0.8").collect()} == {"b.ref", "c d", "e.f"}
    assert metrics.validity(df, other, {"a.id"}).where("score = 1").count() == 4
    assert metrics.fan_out_stats(df, ["b.ref"]).first()["max_n"] == 9 and metrics.histogram(df, "e.f").agg(F.sum("n")).first()[0] == 48
    assert checks.key_facts(df, ["a.id"], ["e.f"]).first()["nulls0"] == 12 and checks.null_profile(df).count() == 4
    parents = spark.createDataFrame([(k,) for k in range(5)], "`p.id` long")
    assert checks.reference_facts(df, ["b.ref"], parents, ["p.id"]).first()["orphan_keys"] == 2
    assert checks.orphans(df, ["b.ref"], parents, ["p.id"]).count() == sampling.flag_orphans(df, ["b.ref"], parents, ["p.id"]).where("__orphan").count()
    assert sampling.keep_referenced(df, ["b.ref"], parents, ["p.id"]).count() == sum(r[1] < 5 for r in rows)
    assert set(sampling.null_orphans(df, ["b.ref"], parents, ["p.id"], ["b.ref"]).columns) == set(df.columns)
    assert marginals.synthesise_table(df, 10, ["a.id"]).columns == df.columns


def test_uniqueness_takes_one_shuffle_for_all_columns(spark):
    a = spark.createDataFrame([(1, "x", None, 5), (2, "x", 1, 6), (3, "y", 2, 6)], "k int, s string, n int, t int")
    assert discovery.keys_of({"a": a, "none": a.where("false"), "once": a.limit(1)}) == {"a": ["k"], "none": [], "once": ["k", "s", "t"]}
    plan = discovery.value_counts({"a": a, "b": a})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_first_rows_of_subsets(spark):
    rows = [(1, 5, "b"), (1, None, "a"), (None, 2, "c"), (None, 1, "d"), (2, 7, "e"), (2, 7, "e")]
    df = spark.createDataFrame(rows, "`k.x` int, o int, v string")
    assert sorted(map(tuple, sampling.first_rows(df, ["k.x"], ["o", "v"]).collect()), key=str) == [(1, None, "a"), (2, 7, "e"), (None, 1, "d")]
    assert sampling.first_rows(df.where("false"), ["k.x"], ["o"]).count() == 0


def test_sketches_of_parts_merge_within_their_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 4).alias("part"), (F.col("id") * 7919 % 9000).alias("n"), F.md5((F.col("id") % 123).cast("string")).alias("s"), F.lit(None).cast("date").alias("d"))
    kept = marginals.distinct_sketches(df, ["part"])
    assert kept.count() == 12
    found = {r.column_name: r for r in marginals.merged_distinct(kept).collect()}
    assert found["n"].low <= 9000 <= found["n"].high and found["s"].low <= 123 <= found["s"].high and found["d"].distinct_estimate == 0


def test_chosen_columns(spark):
    df = spark.createDataFrame([], "a string, b int, c date, d string, e double, f boolean")
    assert metrics.chosen_columns(df, 4) == ["a", "b", "c", "d"] and metrics.chosen_columns(df, 9) == ["a", "b", "c", "d", "e", "f"]
    assert metrics.structure_score(df, df.drop("a")) == 5 / 6 and metrics.structure_score(df.select(), df.select()) == 1.0


def test_first_rows_that_the_order_leaves_tied(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "d"), (1, 5, "b"), (1, 5, "c")], "k int, o int, v string")
    for n in (1, 3):
        for order in ("v", "v desc"):
            rows = df.orderBy(*[F.expr(order.split()[0]).desc() if " " in order else F.col("v")]).coalesce(1).repartition(n)
            assert [tuple(r) for r in sampling.first_rows(rows, ["k"], ["o"], nulls_first=False).collect()] == [(1, 5, "b")]
