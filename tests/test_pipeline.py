import json

import pytest
from pyspark.sql import functions as F

from kinforge.operators import checks, closure, marginals, metrics, reports, sampling, structure
from kinforge.plans import metadata, model, pipeline, synthesis
from kinforge.sources import readers, writers
from kinforge.streaming import incremental


def test_whole_run(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    parents = spark.range(50).select("id", F.lit(49).alias("kind"))
    children = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 11 == 0, F.col("id") + 900).otherwise(F.col("id") % 50)).alias("p"))
    writers.save_tables({"P": parents, "C": children}, raw)
    config = {"O.P": {"pk_cols": "id"}, "O.C": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "O.P", "parent_columns": "id"}]}}
    (tmp_path / "specs.json").write_text(json.dumps(config))
    specs = readers.read_specs(spark, f"file://{tmp_path}/specs.json")
    written = pipeline.run(spark, pipeline.Layout(raw, out), specs, limit=100, min_rows=20, band=1000)
    made = {t: spark.read.parquet(p) for t, p in written.items()}
    assert made["C"].count() == 200 and made["C"].agg(F.min("k")).first()[0] == 1400
    assert made["C"].where("p is not null").join(made["P"], F.col("p") == F.col("id"), "left_anti").count() == 0
    assert readers.discover_tables(spark, out).keys() == {"C", "P"}


def test_failing_group_writes_nothing(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    writers.save_tables({"A": spark.createDataFrame([(1,), (1,)], "id tinyint"), "B": spark.range(3)}, raw)
    with pytest.raises(RuntimeError):
        pipeline.run(spark, pipeline.Layout(raw, out), {"A": {"pk_cols": "id", "n_rows": 200}, "B": {"pk_cols": "id"}}, continue_on_error=True)
    assert list(readers.discover_tables(spark, out)) == ["B"]


def test_text_keys_go_on_above_the_whole_table(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    source = spark.range(1, 201).select(F.concat(F.lit("SYN_k_"), F.lpad(F.col("id").cast("string"), 14, "0")).alias("k"))
    writers.save_tables({"T": source}, raw)
    written = pipeline.run(spark, pipeline.Layout(raw, out), {"T": {"pk_cols": "k"}}, limit=50, min_rows=20)
    made = spark.read.parquet(written["T"])
    assert made.count() == 100 and made.join(source, "k", "left_semi").count() == 0
    assert checks.existing_keys("T", source.limit(3), source, ["k"]).first()["violations"] == 3


def test_keys_that_the_columns_rule_out_are_skipped(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    writers.save_tables({"A": spark.range(5), "B": spark.range(9).select(F.col("id").alias("k"), (F.col("id") % 5).alias("a"))}, raw)
    config = {"A": {"pk_cols": "id"}, "B": {"pk_cols": "k", "foreign_keys": [{"columns": "gone", "parent_table": "A"}, {"columns": "a", "parent_table": "A"}]}}
    written = pipeline.run(spark, pipeline.Layout(raw, out), config)
    assert spark.read.parquet(written["B"]).join(spark.read.parquet(written["A"]), F.col("a") == F.col("id")).count() == 18


def test_references_that_the_data_contradict(spark):
    tables = {"p": spark.range(10), "c": spark.range(30).select(F.col("id").alias("k"), (F.col("id") % 10).alias("good"), (F.col("id") % 20).alias("half"), (F.col("id") + 100).alias("none"))}
    fks = [{"columns": c, "parent_table": "p"} for c in ("good", "half", "none")]
    specs = model.compile_specs({"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": fks}})
    problems = model.Problems()
    kept = synthesis.sanitise_by_data(specs, tables, problems)
    assert [fk.columns for fk in kept["c"].foreign_keys] == [("good",)]
    assert "orphans (10 of 20" in problems.found[0] and "no match (30 of 30" in problems.found[1]
    with pytest.raises(model.SpecError):
        synthesis.sanitise_by_data(specs, tables, model.Problems("raise"))
    assert len(synthesis.sanitise_by_data(specs, tables, model.Problems(), most=0.5)["c"].foreign_keys) == 2
    made = synthesis.synthesise(tables, {"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": fks}}, check_references=True)
    assert made["c"].count() == 60


def test_closure_over_a_long_chain(spark):
    chain = spark.range(45).select("id", (F.col("id") - 1).alias("up"))
    assert closure.close_over_self(chain.where("id = 44"), ["up"], chain, ["id"]).count() == 45


def test_a_failed_move_puts_old_tables_back(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/set"
    writers.save_together({"a": spark.range(1), "b": spark.range(1)}, base)
    real = writers.move

    def fails(s, source, target):
        if "staging" in source and target.endswith("/b"):
            raise OSError("no")
        real(s, source, target)

    monkeypatch.setattr(writers, "move", fails)
    with pytest.raises(OSError):
        writers.save_together({"a": spark.range(7), "b": spark.range(7)}, base)
    monkeypatch.setattr(writers, "move", real)
    assert [spark.read.parquet(f"{base}/{t}").count() for t in "ab"] == [1, 1]
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == ["a", "b"]
    writers.save_together({"a": spark.range(7), "b": spark.range(7)}, base)
    assert [spark.read.parquet(f"{base}/{t}").count() for t in "ab"] == [7, 7]


def test_hooks_see_the_tables_made_before(spark):
    tables = {"p": spark.range(4).select("id", F.concat(F.lit("c"), "id").alias("code")), "c": spark.range(8).select(F.col("id").alias("k"), (F.col("id") % 4).alias("p"), F.lit("").alias("code"))}

    def code(df, made):
        return df.drop("code").join(made["p"].select(F.col("id").alias("p"), "code"), "p")

    config = {"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "p"}]}}
    made = synthesis.synthesise(tables, config, hooks={"c": code})
    assert made["c"].join(made["p"], (F.col("p") == F.col("id")) & (made["c"]["code"] == made["p"]["code"])).count() == 16


def test_command_line():
    a = pipeline.arguments(["--limit", "5", "--scale-factor", "1.5"])
    assert a.limit == 5 and a.scale_factor == 1.5 and a.seed == 42
    with pytest.raises(SystemExit):
        pipeline.arguments(["--limit", "0"])
    with pytest.raises(SystemExit):
        pipeline.environment({})


def test_messy_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("nome;valor\njosé;1\nana;2\n".encode("latin-1"))
    df = readers.read_messy_csv(spark, f"file://{tmp_path}/x.csv")
    assert df.columns == ["nome", "valor"] and {r["nome"] for r in df.collect()} == {"josé", "ana"}
    late = "a,b;c|d;e\n" + '"x,y";1;2\n' * 3000 + "é;3;4\n"
    (tmp_path / "late.csv").write_bytes(late.encode("latin-1"))
    df = readers.read_messy_csv(spark, f"file://{tmp_path}/late.csv")
    assert len(df.columns) == 3 and df.count() == 3001 and df.where(f"`{df.columns[0]}` = 'é'").count() == 1
    spark.range(3).coalesce(1).write.parquet(f"file://{tmp_path}/p")
    assert readers.is_parquet(spark, f"file://{tmp_path}/p") and not readers.is_parquet(spark, f"file://{tmp_path}/late.csv")
    (tmp_path / "meta.csv").write_bytes("TABLE_NAME,COLUMN_NAME\nAÇÃO,id\n".encode("latin-1"))
    assert readers.read_metadata(spark, f"file://{tmp_path}/meta.csv").first()["TABLE_NAME"] == "AÇÃO"


def test_footers_give_the_largest_key(spark, tmp_path):
    spark.range(77).write.parquet(f"file://{tmp_path}/t")
    assert readers.largest_from_footers(spark, f"file://{tmp_path}/t", "id") == 76


def test_proved_specs(spark):
    tables = {"P": spark.range(10), "C": spark.range(20).select(F.col("id").alias("c_id"), (F.col("id") % 10).alias("p"), F.col("id").alias("bad"))}
    rows = [("P", "id", "Y", "", None, None), ("C", "c_id", "N", "", None, None), ("C", "p", "", "Y", "P", "id"), ("C", "bad", "", "Y", "P", "id")]
    meta = spark.createDataFrame(rows, "TABLE_NAME string, COLUMN_NAME string, IS_PRIMARY_KEY string, IS_FOREIGN_KEY string, FK_REF_TABLE string, FK_REF_COLUMN string")
    asked = []
    specs, report = metadata.proved_specs(meta, tables, propose=lambda schema, left: asked.append(left) or [])
    assert specs["P"]["pk_cols"] == ["id"] and specs["C"]["foreign_keys"] == [{"columns": ["p"], "parent_table": "P", "parent_columns": ["id"]}]
    assert asked and any(r["kind"] == "key_inferred" for r in report)
    assert metadata.trusted_specs(meta) == {"P": {"pk_cols": ["id"], "foreign_keys": []}}


def test_structural_verdict(spark):
    a = {"p": spark.range(30), "c": spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 30).alias("p"))}
    specs = model.compile_specs({"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "p"}]}})
    assert structure.structural_validation(a, a, specs)["verdict"] == "APROVADO"
    b = a | {"c": a["c"].withColumn("p", F.col("p") + 1)}
    assert structure.structural_validation(a, b, specs)["verdict"] == "REPROVADO"


def test_report_with_a_property_that_fails(spark):
    a = {"p": spark.range(30), "c": spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 30).alias("p"), F.col("id").alias("v"))}
    specs = model.compile_specs({"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "p"}]}})
    b = a | {"c": a["c"].drop("p").withColumn("v", F.col("v").cast("string"))}
    rows = {(r["property"], r["object"]): r for r in reports.quality_report(a, b, specs).collect()}
    assert rows["cardinality", "c (p) -> p (id)"]["score"] is None and "p" in rows["cardinality", "c (p) -> p (id)"]["note"]
    assert rows["column_shapes", "c"]["score"] == 1.0 and rows["structure", "c"]["score"] == 0.25
    assert {r["problem"] for r in reports.preflight(a, b, specs).collect()} == {"reference (p) -> p (id) does not stand in the synthetic set"}
    seen = reports.heads(a["c"], b["c"], ["k"], 3).collect()
    assert [r["side"] for r in seen] == ["original"] * 3 + ["synthetic"] * 3 and set(seen[0].asDict()) == {"side", "k", "v"}
    roles, single = reports.metric_schema(a, specs)
    assert ("c", "k", "id") in roles and [t for t, _ in single] == ["c"]


def test_ks_with_extreme_values(spark):
    import numpy as np

    g = np.random.default_rng(5)
    x, y = np.append(g.normal(0, 1, 800), [1e12, -1e9]), np.append(g.normal(0.3, 1, 700), [1e11])
    got = metrics.ks_complement(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", spark.createDataFrame([(float(v),) for v in y], "v double"), "v").first()[0]
    every = np.concatenate([x, y])
    gap = max(abs((x <= v).mean() - (y <= v).mean()) for v in every)
    assert abs(got - (1 - gap)) < 1e-12


def test_null_against_null_reference_is_fine(spark):
    a = {"p": spark.range(3), "c": spark.range(3).select(F.col("id").alias("k"), F.lit(None).cast("long").alias("p"))}
    specs = model.compile_specs({"p": {"pk_cols": "id"}, "c": {"pk_cols": "k", "foreign_keys": [{"columns": "p", "parent_table": "p"}]}})
    assert structure.reference_regressions(a, a, specs).first()["status"] == "OK"


def test_single_table(spark):
    source = spark.range(200).select(F.col("id"), F.when(F.col("id") % 4 != 0, F.lit("x")).alias("c"), (F.col("id") * 1.5).alias("v"), F.array("id").alias("arr"))
    made = marginals.synthesise_table(source, 500, ["id"])
    assert made.count() == 500 and made.columns == source.columns
    assert made.where("arr is not null").count() == 0
    assert 0.15 < made.where("c is null").count() / 500 < 0.35


def test_one_draw_decides_a_category(spark):
    made = spark.range(20_000).withColumn("u", (F.col("id") + 0.5) / 20_000)
    c = marginals.categorical(F.col("u"), ("a", "b", "c"), (0.5, 0.3, 0.2), spark.range(1).select(F.lit("")).schema[0].dataType)
    assert {r[0]: r[1] for r in made.groupBy(c).count().collect()} == {"a": 10_000, "b": 6000, "c": 4000}


def test_ks_of_empty_sides(spark):
    e = spark.createDataFrame([], "v double")
    assert metrics.ks_complement(e, "v", spark.range(3).toDF("v"), "v").first()[0] is None


def test_safe_columns_and_save_policies(spark, tmp_path):
    df = spark.range(2).toDF("a b").withColumn("a_b", F.lit(1))
    assert writers.safe_columns(df).columns == ["a_b", "a_b_1"]
    assert writers.save_tables({"t": df}, f"file://{tmp_path}/s", fmt="nonsense") == {}
    with pytest.raises(Exception):
        writers.save_tables({"t": df}, f"file://{tmp_path}/s", fmt="nonsense", on_error="raise")


def test_stream_of_children(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 99), (3, None)], "k long, p long").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("k long, p long").parquet(f"file://{tmp_path}/in")
    incremental.check_stream(stream, ["p"], spark.range(5), ["id"], f"file://{tmp_path}/facts", f"file://{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/facts").first()["orphan_rows"] == 1
