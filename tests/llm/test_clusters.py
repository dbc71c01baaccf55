"""Hamerly's bounds against plain rounds over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.llm import clusters


def plain(rows, k, rounds, dimensions, scale, seed):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        now = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, now) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=repr)


@pytest.mark.parametrize("seed,spread", [(1, 0.0), (2, 0.05), (3, 3.0)])
def test_same_rows_as_plain_rounds(spark, seed, spread):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + rng.uniform(-spread, spread) for x in rng.choice(middle)]) for i in range(200)]
    rows += [(i, v) for i, v in rows[:30]] + [(None, rows[5][1]), (900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [0.0, float("inf"), 0.0, 0.0]), (905, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("row", "v", "cluster", "upper", "kind", "sums")}).repartition(3)
    got = sorted((tuple(r) for r in clusters.cluster(df, k=5, rounds=6, dimensions=4, scale=100, seed=3).collect()), key=repr)
    assert got == plain(rows, 5, 6, 4, 100, 3)


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(4)
    middle = rng.integers(-5000, 5000, (8, 64))
    v = middle[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    centroids, drift = v[:8].copy(), np.zeros(8)
    now, upper, lower = np.full(3000, -1), np.full(3000, np.inf), np.zeros(3000)
    scans = []
    for _ in range(8):
        step = clusters.Round(centroids, drift)
        now, upper, lower, n = step.assign(v, now, upper, lower)
        scans.append(n)
        d = ((v[:, None] - centroids[None]) ** 2).sum(2)
        assert (now == d.argmin(1)).all()
        exact = np.sqrt(d.astype(float))
        own = exact[np.arange(3000), now]
        exact[np.arange(3000), now] = np.inf
        assert (upper >= own).all() and (lower <= exact.min(1)).all()
        new = np.array([v[now == c].sum(0) // (now == c).sum() if (now == c).any() else centroids[c] for c in range(8)])
        drift, centroids = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)) * (1 + clusters.SLACK), new
    assert scans[0] == 3000 and sum(scans[1:]) < 7 * 3000 / 4


def test_ties_few_vectors_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema)).count() == 0
    assert clusters.cluster(spark.createDataFrame([(1, None)], schema)).count() == 0
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]
    got = sorted((tuple(r) for r in clusters.cluster(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == plain(rows, 8, 10, 64, 1024, 3) and {r[2] for r in got} == {0}


def test_rounds_join_buckets_without_a_shuffle(spark):
    from kinforge.llm.scratch import Scratch

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = clusters.Tables(Scratch(spark, "plan"), 3)
        points = tables.write(spark.range(50).select(F.col("id").alias("row"), F.array(F.col("id").cast("int")).alias("v")).repartition(3, "row"), "vectors")
        first = points.withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
        step = clusters.Round(np.array([[0], [40]]), np.zeros(2))
        state = tables.write(clusters.assigned(first, step, 1).withColumn("kind", F.when(F.col("row").isNull(), "sums").otherwise("state")), "state0", "kind")
        joined = points.join(state.where("kind = 'state'").drop("kind", "sums"), "row")
        assert joined.count() == 50
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        tables.drop("vectors", "state0")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_components_too_large_are_an_error(spark):
    with pytest.raises(Exception, match="a component beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).collect()
