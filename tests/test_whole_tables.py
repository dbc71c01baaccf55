"""Queries over whole tables give every row of them."""

import os

import pytest

from kinforge import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("kind", ["int", "decimal", "float", "string"])
def test_every_part_gets_a_key(spark, kind):
    parts = spark.read.parquet(f"{SF}/part.parquet").count()
    found = queries.QUERIES[f"pk_generate_{kind}"](spark, SF)
    assert parts > 200 and found.count() == found.select("new_key").distinct().count() == parts


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_closure_grows_with_the_tables(spark):
    found = [queries.QUERIES["parent_closure"](spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")]
    assert found[1] > 5 * found[0] > 0
