"""Clustering around centroids with Hamerly's bounds, exact in integers.

Vectors are scaled to integers once and written as a table bucketed by a row number.
Beside it lies a small table, bucketed alike and written anew each round, of each
vector's cluster, an upper bound on the distance to its centroid and a lower bound on
the distance to any other. The two are joined bucket by bucket, so no round shuffles
vectors. Once centroids have moved, the upper bound grows by its own centroid's
drift and the lower bound shrinks by the greatest. A vector whose upper bound lies below
its lower bound, or below half the way from its centroid to the nearest other, stays. For
the rest the upper bound is first made exact, and whatever is still ambiguous is scanned
against all centroids in integers. Only vectors that change their cluster are added
to and taken from the centroids' sums, within each batch, so a round sends a few rows
a task to the driver's k centroids. Rounds end early once no vector moves, since all later
ones would be alike.

Bounds are floating-point distances, loosened at each step by a share (SLACK) that exceeds
rounding errors by far; what decides is always an integer comparison or a strict bound.

Defined cases: vectors that are null, of another number of components, or hold
null or non-finite components take no part; equal vectors and repeated rows each count;
rows with null ids are clustered like others and start no centroid unless ids run out;
starting rows whose ids are equal go by their components; fewer vectors than
centroids make as many centroids; an empty table gives an empty result; other columns
are ignored. Scaled components beyond 2^27 raise an error, since squared distances
would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions_for

K, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
SLACK = 1e-9
LARGEST = 1 << 27
#: Vectors of a bucket.
BUCKET = 500_000
STATE = "row long, cluster int, upper double, lower double, sums array<long>"


def integers(column: Column, dimensions: int, scale: int) -> Column:
    """Scaled components as integers; null for vectors that take no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.transform(column, lambda x: F.floor(scale * x.cast("double")))
    small = F.forall(column, lambda x: F.abs(scale * x.cast("double")) <= LARGEST)
    fits = F.when(small, x.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} / {scale}")).cast("array<int>"))
    return F.when((F.size(column) == dimensions) & F.forall(column, finite), fits)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; centroids: one for all vectors, or one for each."""
    return ((v - centroids) ** 2).sum(1)


class Round:
    """One assignment of vectors to centroids that have moved by some drift."""

    def __init__(self, centroids: np.ndarray, drift: np.ndarray):
        self.centroids, self.drift = centroids, drift
        apart = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2).astype(float))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK)

    def assign(self, v: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds from those of the round before (-1: none yet), and how many vectors were scanned."""
        now = was.copy()
        upper = (upper + self.drift[was]) * (1 + SLACK)
        lower = (lower - self.drift.max()) * (1 - SLACK)
        enough = np.maximum(lower, self.half[was])
        known = was >= 0
        unsure = np.flatnonzero(known & (upper >= enough))
        upper[unsure] = np.sqrt(squared(v[unsure], self.centroids[was[unsure]]).astype(float)) * (1 + SLACK)
        scan = np.concatenate([np.flatnonzero(~known), unsure[upper[unsure] >= enough[unsure]]])
        if len(scan):
            d = np.stack([squared(v[scan], c) for c in self.centroids], 1)
            best = d.argmin(1)  # the first of equal ones
            each = np.arange(len(scan))
            now[scan], upper[scan] = best, np.sqrt(d[each, best].astype(float)) * (1 + SLACK)
            d[each, best] = np.iinfo(np.int64).max
            lower[scan] = np.sqrt(d.min(1).astype(float)) * (1 - SLACK)
        return now, upper, lower, len(scan)

    def moved(self, v: np.ndarray, was: np.ndarray, now: np.ndarray) -> dict[int, np.ndarray]:
        """By cluster, the sums of the components and the number of vectors that came less those that left."""
        out = {}
        changed = np.flatnonzero(was != now)
        rows = np.column_stack([v[changed], np.ones(len(changed), np.int64)])
        for c in range(len(self.centroids)):
            came, left = now[changed] == c, was[changed] == c
            if came.any() or left.any():
                out[c] = rows[came].sum(0) - rows[left].sum(0)
        return out


class Tables:
    """Tables of one call, bucketed by row."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.spark, self.buckets, self.own = scratch, scratch.spark, buckets, uuid.uuid4().hex

    def name(self, which: str) -> str:
        return f"kinforge_{which}_{self.own}"

    def write(self, df: DataFrame, which: str, *parts: str) -> DataFrame:
        writer = df.write.format("parquet").option("path", self.scratch.path(which)).bucketBy(self.buckets, "row").sortBy("row")
        (writer.partitionBy(*parts) if parts else writer).saveAsTable(self.name(which))
        return self.spark.table(self.name(which))

    def drop(self, *which: str) -> None:
        for w in which:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(w)}")
            self.scratch.drop(w)


def batch_of(columns: dict[str, object], like: pa.Schema) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in like], schema=like)


STATE_ARROW = pa.schema([("row", pa.int64()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("sums", pa.list_(pa.int64()))])


def assigned(joined: DataFrame, step: Round, dimensions: int) -> DataFrame:
    """New clusters and bounds of row, v, cluster, upper, lower; beside them rows of sums, whose row is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v, was = matrix(b.column("v"), dimensions), b.column("cluster").to_numpy().copy()
                now, upper, lower, _ = step.assign(v, was, b.column("upper").to_numpy(), b.column("lower").to_numpy())
                yield batch_of({"row": b.column("row"), "cluster": now, "upper": upper, "lower": lower}, STATE_ARROW)
                if sums := step.moved(v, was, now):
                    yield batch_of({"cluster": list(sums), "sums": [s.tolist() for s in sums.values()]}, STATE_ARROW)

    return joined.select("row", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def measured(joined: DataFrame, step: Round, dimensions: int) -> DataFrame:
    """vec_id, cluster and exact squared distance after a last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), dimensions)
                now, *_ = step.assign(v, b.column("cluster").to_numpy().copy(), b.column("upper").to_numpy(), b.column("lower").to_numpy())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(now, pa.int32()), pa.array(squared(v, step.centroids[now]), pa.int64())], ["vec_id", "cluster", "distance"])

    return joined.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    buckets = partitions_for(vectors, BUCKET, vectors.count())
    tables = Tables(scratch, buckets)
    scaled = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), dimensions, scale).alias("v")).where("v is not null")
    points = tables.write(scaled.withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row"), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = points.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r.v for r in chosen], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    totals = [[0] * (dimensions + 1) for _ in centroids]
    joined = points.withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    drift = np.zeros(len(centroids))
    for n in range(rounds):
        state = tables.write(assigned(joined, Round(centroids, drift), dimensions).withColumn("kind", F.when(F.col("row").isNull(), "sums").otherwise("state")), f"state{n}", "kind")
        change = state.where("kind = 'sums'").groupBy("cluster").agg(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions + 1)]).collect()
        for r in change:
            totals[r.cluster] = [t + int(r[f"s{i}"]) for i, t in enumerate(totals[r.cluster])]
        # Python's integers and its floor: exact for any sum
        new = np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals, centroids, strict=True)], np.int64)
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK)
        centroids = new
        joined = points.join(state.where("kind = 'state'").drop("kind", "sums"), "row")
        if n:
            tables.drop(f"state{n - 1}")
        if not change:
            break
    found = scratch.keep(measured(joined, Round(centroids, drift), dimensions), "distances")
    tables.drop("vectors", *[f"state{n}" for n in range(rounds)])
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    # one row a centroid
    return found.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
