"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(SCALE * x). The top of the index is flat and lives on
the driver: up to CELLS centres, fitted on a bounded sample of SAMPLE rows; every row
is placed in the cell of its nearest centre, and of each cell only counts and covering
radii (of all rows, of queries) are gathered. Below it, tasks build cover trees: a node's
children are centres that cover its points within half its radius and lie further apart
than what they cover.

Queries search their most promising cells first, which gives each a kth score. A pair
of a query cell and a row cell is then left out, before any row is shuffled, when the
most that its centres and covering radii allow,
<q, x> <= <cq, cx> + rq |cx| + rx |cq| + rq rx, is under the worst kth score that any
query of the cell has. What is left meets in tasks of a block of queries and a block of
rows (small cells share a block, large ones are dealt into several by a hash), where
both sides' trees are visited together, from the most promising pair of nodes, and pairs
are pruned by the same bound against what each query group has by then. Blocks' best
rows are merged per query. All rows are indexed; nothing is approximate.

Defined cases: vectors that are null, empty, or hold a null or non-finite component
take no part, nor do null ids; of rows that share an id the least vector counts;
vectors of other lengths than the query's are no candidates (each length has cells of
its own; lengths that the sample lacks have one cell); ties go to the smaller id; with
fewer candidates than k there are fewer rows; an empty table gives an empty result;
other columns are ignored. Scores must fit 63 bits.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .scratch import Scratch

SCALE, K, LEAF, FAN = 64, 20, 128, 8
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
CELLS, CELL_ROWS, SAMPLE = 256, 1024, 4096
_NONE = np.iinfo(np.int64).max


class Node:
    __slots__ = ("centre", "radius", "norm", "points", "children")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray, children: list):
        self.centre, self.radius, self.norm = centre, radius, float(np.sqrt(centre @ centre))
        self.points, self.children = points, children


def cover_tree(x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Node:
    """A cover tree of the rows of x; leaves hold up to leaf rows, or equal rows.

    Children's centres are taken farthest first until they cover their node's rows within half its radius, or there
    are fan of them: then the scale shrinks by less, and the centres are still further apart than what they cover.
    """
    square = np.einsum("ij,ij->i", x, x)
    slack = 1e-6 * (1 + float(np.sqrt(square.max(initial=0))))

    def distances(points: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[points] - 2 * (x[points] @ c) + c @ c, 0))

    def build(points: np.ndarray, centre: np.ndarray) -> Node:
        away = distances(points, centre)
        radius = float(away.max()) + slack
        if len(points) <= leaf or radius <= 2 * slack:
            return Node(centre, radius, points, [])
        first = x[points[away.argmax()]]
        nearest, owner, centres = distances(points, first), np.zeros(len(points), np.int64), [first]
        while len(centres) < fan and nearest.max() > radius / 2:
            centres.append(x[points[nearest.argmax()]])
            d = distances(points, centres[-1])
            owner[d < nearest] = len(centres) - 1
            nearest = np.minimum(nearest, d)
        parts = [points[owner == k] for k in range(len(centres))]
        if max(map(len, parts)) == len(points):
            return Node(centre, radius, points, [])
        return Node(centre, radius, points, [build(p, c) for p, c in zip(parts, centres) if len(p)])

    return build(np.arange(len(x)), x.mean(0))


def most(product, q_radius, q_norm, x_radius, x_norm):
    """No vectors of two balls have a greater inner product, given that of the centres."""
    reach = product + q_radius * x_norm + x_radius * q_norm + q_radius * x_radius
    return reach + 1e-6 * (1 + abs(reach))


class DualTree:
    """least: what each query has as its kth score already; lower ones are of no use to it."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: list | None = None):
        self.q, self.qi, self.x, self.xi, self.k = queries, query_ids, rows, row_ids, k
        most = max(1.0, float(np.abs(queries).max(initial=0))) * max(1.0, float(np.abs(rows).max(initial=0))) * queries.shape[1]
        self.exact = most < 2**53
        self.scores = np.full((len(queries), k), -np.inf) if self.exact else np.full((len(queries), k), -(2**63), object)
        for i, known in enumerate(least or ()):
            if known is not None:
                self.scores[i, :] = known
        self.ids = np.full((len(queries), k), _NONE)
        self.visited = 0

    def _leaf(self, q: Node, x: Node) -> None:
        self.visited += 1
        worst = self.scores[q.points, -1]
        found = self.q[q.points] @ self.x[x.points].T if self.exact else np.array([[sum(int(a) * int(b) for a, b in zip(u, v)) for v in self.x[x.points]] for u in self.q[q.points]], object)
        row, col = np.nonzero((found >= worst[:, None]) & (self.qi[q.points][:, None] != self.xi[x.points][None, :]))
        if not len(row):
            return
        hit = np.unique(row)
        own = np.repeat(hit, self.k)
        scores = np.concatenate([found[row, col], self.scores[q.points[hit]].ravel()])
        ids = np.concatenate([self.xi[x.points][col], self.ids[q.points[hit]].ravel()])
        rows = np.concatenate([row, own])
        order = np.lexsort((ids, -scores, rows)) if self.exact else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])))
        place = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
        best = order[place < self.k]
        self.scores[q.points[hit]] = scores[best].reshape(len(hit), self.k)
        self.ids[q.points[hit]] = ids[best].reshape(len(hit), self.k)

    @staticmethod
    def bound(q: Node, x: Node) -> float:
        return float(most(q.centre @ x.centre, q.radius, q.norm, x.radius, x.norm))

    def search(self, leaf: int = LEAF) -> None:
        if not len(self.q) or not len(self.x):
            return
        roots = cover_tree(self.q, leaf), cover_tree(self.x, leaf)
        heap, tick = [(-self.bound(*roots), 0, *roots)], 1
        while heap:
            least, _, q, x = heapq.heappop(heap)
            if -least < self.scores[q.points, -1].min():
                continue
            if not q.children and not x.children:
                self._leaf(q, x)
                continue
            if q.children and (not x.children or q.radius >= x.radius):
                pairs = [(c, x) for c in q.children]
            else:
                pairs = [(q, c) for c in x.children]
            for a, b in pairs:
                heapq.heappush(heap, (-self.bound(a, b), tick, a, b))
                tick += 1


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        is_query = np.array(table.column("is_query").to_pylist(), bool)
        ids = table.column("vec_id").to_numpy()
        least = table.column("least").to_pylist()
        vectors = table.column("v").combine_chunks()
        dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
        for d in np.unique(dims[is_query]).tolist():
            q, x = np.flatnonzero(is_query & (dims == d)), np.flatnonzero(~is_query & (dims == d))
            of = lambda i: vectors.take(pa.array(i)).flatten().to_numpy().reshape(-1, d)  # noqa: E731,B023
            tree = DualTree(of(q), ids[q], of(x), ids[x], k, [least[i] for i in q.tolist()])
            tree.search()
            row, col = np.nonzero(tree.ids != _NONE)
            found.append([ids[q][row], tree.ids[row, col], tree.scores[row, col].astype(np.int64)])
        return pa.table([np.concatenate(c) for c in zip(*found)], names=["query_id", "vec_id", "score"])

    return run


def centres_of(x: np.ndarray, n: int) -> np.ndarray:
    """n or fewer centres of the rows of x: farthest first, then moved to the middle of what is nearest to them."""
    centres = [x.mean(0)]
    nearest = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(n, len(x)) and nearest.max() > 0:
        centres.append(x[nearest.argmax()])
        nearest = np.minimum(nearest, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(4):
        own = to_centres(x, c).argmin(1)
        c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
    return c


def to_centres(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centres."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :], 0))


def _place(centres: dict[int, np.ndarray]):
    """Rows with the cell of their nearest centre and their distance to it; a length without centres has one cell around 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            cell, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                i = np.flatnonzero(dims == d)
                c = centres.get(d, np.zeros((1, d)))
                for part in np.array_split(i, -(-len(i) // 1024)):
                    x = vectors.take(pa.array(part)).flatten().to_numpy().reshape(-1, d)
                    far = to_centres(x, c)
                    cell[part] = far.argmin(1)
                    away[part] = np.sqrt(((x - c[cell[part]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "is_query")), pa.array(dims), pa.array(cell), pa.array(away)], ["vec_id", "v", "is_query", "d", "cell", "away"])

    return run


class Cell:
    """What the driver knows of a cell."""

    def __init__(self, centre: np.ndarray, rows: int, radius: float, queries: int, query_radius: float):
        self.centre, self.norm = centre, float(np.sqrt(centre @ centre))
        self.rows, self.radius, self.queries, self.query_radius = rows, radius, queries, query_radius


def dealt(sizes: dict[tuple[int, int], int], block: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(d, cell) -> its group, and the blocks that the group is dealt into; neighbours of one d share a group up to a block."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    group, held, of = -1, 0, None
    for key, n in sorted(sizes.items()):
        if not n:
            continue
        if of != key[0] or held + n > block:
            group, held, of = group + 1, 0, key[0]
        held += n
        out[key] = group, max(1, -(-n // block))
    return out


class Search:
    """One search; share is the part of all pairs of a query and a row whose blocks met, result the answer."""

    def __init__(self, vectors: DataFrame, is_query: F.Column, k: int = K, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, cell_rows: int = CELL_ROWS):
        self.spark, self.k = vectors.sparkSession, k
        scratch = self.scratch = Scratch(self.spark, "topk")
        v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
        finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
        usable = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(finite)
        one = usable.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))
        one = scratch.keep(one.select("vec_id", v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")
        centres = self.fitted(one, cell_rows)
        self.placed = scratch.keep(one.mapInArrow(_place(centres), "vec_id long, v array<double>, is_query boolean, d long, cell long, away double"), "placed")
        scratch.drop("vectors")
        stats = self.placed.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.count_if("is_query").alias("q"), F.max(F.when(F.col("is_query"), F.col("away"))).alias("qr"))
        slack = lambda r, c: r + 1e-6 * (1 + r + float(np.abs(c).max(initial=0)))
        self.cells: dict[tuple[int, int], Cell] = {}
        for x in stats.collect():
            centre = centres.get(x["d"], np.zeros((1, x["d"])))[x["cell"]]
            self.cells[x["d"], x["cell"]] = Cell(centre, x["n"], slack(x["r"], centre), x["q"], slack(x["qr"] or 0.0, centre))
        self.rows_in = dealt({key: c.rows for key, c in self.cells.items()}, row_block)
        self.queries_in = dealt({key: c.queries for key, c in self.cells.items()}, query_block)
        self.share, self.result = 0.0, self.run()

    def fitted(self, one: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
        """Centres for each length of vectors in a sample of SAMPLE rows; the count follows the rows, up to CELLS."""
        n = one.count()
        by: dict[int, list] = defaultdict(list)
        for r in one.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect():
            by[len(r["v"])].append(r["v"])
        cells = max(1, min(CELLS, n // cell_rows))
        return {d: centres_of(np.array(x), max(1, cells * len(x) // min(n, SAMPLE))) for d, x in by.items()}

    def reach(self) -> dict[tuple[int, int], list[tuple[float, tuple[int, int]]]]:
        """Of each query cell all row cells of its length, the most promising first."""
        out = {}
        by = defaultdict(list)
        for key in self.cells:
            by[key[0]].append(key)
        for a in self.queries_in:
            q, there = self.cells[a], by[a[0]]
            x = [self.cells[b] for b in there]
            bounds = most(np.array([c.centre for c in x]) @ q.centre, q.query_radius, q.norm, np.array([c.radius for c in x]), np.array([c.norm for c in x]))
            out[a] = sorted(zip(bounds.tolist(), there), key=lambda z: (-z[0], z[1]))
        return out

    def met(self, pairs: set[tuple[int, int]], least: DataFrame | None, name: str) -> DataFrame:
        """The best rows of each query among the pairs of groups, and what is known of it before."""
        table = lambda rows, schema: F.broadcast(self.spark.createDataFrame(rows, schema))  # noqa: E731 (CELLS squared rows at most a length)
        spread = lambda of, cells: table([(d, c, g, n) for (d, c), (g, n) in cells.items()], f"d long, cell long, {of} int, {of}n int")
        met = table(sorted(pairs), "qg int, xg int")
        rows = self.placed.select("vec_id", "v", "is_query", "d", "cell").join(spread("xg", self.rows_in), ["d", "cell"])
        asked = self.placed.where("is_query").select("vec_id", "v", "d", "cell").join(spread("qg", self.queries_in), ["d", "cell"])
        asked = asked.join(least, asked["vec_id"] == least["query_id"], "left").drop("query_id") if least is not None else asked.withColumn("least", F.lit(None).cast("long"))
        blocks = lambda of, cells: table(sorted({(g, n) for g, n in cells.values()}), f"{of} int, {of}n int")
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        a = asked.join(met, "qg").join(blocks("xg", self.rows_in), "xg").withColumn("qb", own("qgn")).withColumn("xb", every("xgn")).withColumn("is_query", F.lit(True))
        b = rows.join(met, "xg").join(blocks("qg", self.queries_in), "qg").withColumn("xb", own("xgn")).withColumn("qb", every("qgn")).withColumns({"is_query": F.lit(False), "least": F.lit(None).cast("long")})
        columns = ["qg", "qb", "xg", "xb", "vec_id", "v", "is_query", "least"]
        found = a.select(*columns).unionByName(b.select(*columns)).groupBy("qg", "qb", "xg", "xb").applyInArrow(_search(self.k), "query_id long, vec_id long, score long")
        return self.scratch.keep(self.ranked(found), name)

    def ranked(self, found: DataFrame) -> DataFrame:
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")

    def run(self) -> DataFrame:
        reach = self.reach()
        groups = lambda pairs: {(self.queries_in[a][0], self.rows_in[b][0]) for a, b in pairs}
        first = set()
        for a, there in reach.items():
            held = 0
            for _, b in there:
                if held > self.k:
                    break
                first.add((a, b))
                held += self.cells[b].rows
        done = groups(first)
        found = self.met(done, None, "first")
        least = found.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("least"))
        worst = self.placed.where("is_query").join(least, F.col("vec_id") == F.col("query_id"), "left").groupBy("d", "cell").agg(F.min(F.coalesce(F.col("least").cast("double"), F.lit(float("-inf")))).alias("w"))
        worst = {(r["d"], r["cell"]): r["w"] for r in worst.collect()}
        rest = groups({(a, b) for a, there in reach.items() for bound, b in there if bound >= worst[a]}) - done
        sizes: tuple[dict, dict] = defaultdict(int), defaultdict(int)
        for key, c in self.cells.items():
            if key in self.queries_in:
                sizes[0][self.queries_in[key][0]] += c.queries
            sizes[1][self.rows_in[key][0]] += c.rows
        whole = sum(sizes[0].values()) * sum(sizes[1].values())
        self.share = sum(sizes[0][a] * sizes[1][b] for a, b in done | rest) / whole if whole else 0.0
        if not rest:
            return found
        return self.ranked(found.unionByName(self.met(rest, least, "rest").select(*found.columns)))


def search(vectors: DataFrame, is_query: F.Column, k: int = K) -> DataFrame:
    """The k best other rows of each query row of vectors (vec_id, embedding): query_id, rank, vec_id, score."""
    return Search(vectors, is_query, k).result
