"""The rows that a mix returns against its decision for each document."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinforge.llm import mixing


@pytest.mark.parametrize("seed", range(4))
def test_each_document_as_often_as_it_is_taken(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40]))) if rng.random() < 0.9 else None, rng.choice(["a", "b", "c", None])) for i in range(150)]
    # copies, so that the end of a source falls among them
    rows += [rows[k] for k in range(10)] * 4 + [(999, "same text here", "d")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"__cut": F.lit(1), "odd name": F.lit("x"), "__n": F.lit(2)}).repartition(4)
    mixed = mixing.mix(mixing.measured(df))
    want = Counter()
    for r in mixed.where("__taken > 0").collect():
        want[(r.doc_id, r.text, r.source)] += r["__epochs"]
    got = mixing.repeated(df)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == want
    assert mixing.repeated(df.limit(0)).count() == 0


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    plan = mixing.repeated(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan
