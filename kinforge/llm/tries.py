"""The prefix trie of conversations, built as a Patricia tree over their sorted order.

A conversation becomes its path: a digest of 16 bytes for each turn, and beside it
the turns' word counts. Texts are read once and never shuffled. Paths are sorted by
range, so that neighbours share the longest prefixes, and each task walks its run with
a stack of open points. It creates only points where conversations branch, end or
stop (leaves); the turns between two points are an edge. Sums over a point's subtree need
no walk up the tree: the members of a point are neighbours in the sorted order, so
its leaves, and the words that it saves, are differences of running sums at its first and
last member. (A turn saves its words once for each member whose predecessor has the same
prefix.) Edges are expanded at last: a node inside an edge has the members and
leaves of the point below it, and saves what that point saves plus a suffix sum of the edge.

Runs meet at their ends. Points that hold the first or last path of a run may go on in the
next, so all nodes along these two paths are written singly and merged by the digest of their
prefix; all others are finished within their run. What a run adds to the running sums of
later ones is one row a run. Ends of a point that two runs share are hashed from chunks of
text in a stream.

Rows that one task must see together: a conversation's turns, at 50 bytes each, and the ids of
equal conversations as one text where they are hashed, as SHA-256 demands.

Defined cases: null conv_ids take no part; null roles and texts are empty; turns that
are tied go by role, then by the digest of role and text; repeated rows are turns of their
own; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .mixing import size_of
from .scratch import Scratch, partitions_for

DIGEST = 16
#: Conversations of a run; ids in a chunk of text, rows in an Arrow batch.
RUN, CHUNK, BATCH = 100_000, 50_000, 2_000
NOTHING = hashlib.sha256(b"").hexdigest()
# kind: point, ends (a chunk of ids of a point that runs may share) or run (its ends and totals)
MADE = (
    "part int, shared boolean, open boolean, key binary, parent binary, depth long, lo long, hi long, s_lo long, s_hi long, l_lo long, l_hi long, before long, below array<long>, "
    "conv_id long, ends string, seq int, first_path binary, last_path binary, first_words array<long>, kind string"
)


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words of each conversation (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), size_of(text).cast("long").alias("words"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return each.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.words").alias("words"))


def rebuilt(each: DataFrame, siblings: int = 20, heads: int = 4) -> DataFrame:
    """Conversations c whose first h turns are those of c - c % siblings, h = crc32(c) % heads."""
    head = each.where(F.col("conv_id") % siblings == 0).select(F.col("conv_id").alias("head"), F.substr("path", F.lit(1), F.lit(DIGEST * heads)).alias("hp"), F.slice("words", 1, heads).alias("hw"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = each.withColumns({"head": F.col("conv_id") - F.col("conv_id") % siblings, "h": h}).join(head, "head", "left")
    path = F.concat(F.coalesce(F.substr("hp", F.lit(1), DIGEST * F.col("h")), F.lit(b"")), F.substr("path", DIGEST * F.col("h") + 1, F.greatest(F.length("path") - DIGEST * F.col("h"), F.lit(0))))
    words = F.concat(F.coalesce(F.slice("hw", F.lit(1), F.col("h")), F.array().cast("array<long>")), F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0))))
    return joined.select("conv_id", path.alias("path"), words.alias("words"))


def shared_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, "<u8", 2 * n).reshape(n, 2) for p in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


@dataclass
class Point:
    """An open node: what precedes its first member, and its least member so far."""

    depth: int
    lo: int
    s_lo: int
    l_lo: int
    least: int
    ends: str | None = None


@dataclass
class Run:
    """The Patricia tree of one sorted run of (conv_id, path, words)."""

    part: int
    stack: list[Point] = field(default_factory=list)
    place: int = -1
    saved: int = 0  # words of the turns that each conversation shares with its predecessor
    leaves: int = 0  # conversations that no later one repeats or continues
    path: bytes = b""
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: list[int] = field(default_factory=list)
    ends_at: int = 0

    def tree(self, rows: Iterable[tuple[int, bytes, np.ndarray]]) -> Iterator[dict]:
        first: tuple[bytes, np.ndarray] | None = None
        for conv, path, words in rows:
            if first is None:
                first = path, words
                self.stack = [Point(d, 0, 0, 0, conv) for d in range(len(path) // DIGEST + 1)]
                self.place = 0
            else:
                common = shared_turns(self.path, path)
                if path != self.path:
                    yield from self.end()
                    self.leaves += common < len(self.path) // DIGEST
                    yield from self.close(common)
                self.place += 1
                self.saved += int(words[:common].sum())
                if path != self.path:
                    self.ends, self.ends_at = [], self.place
                    self.stack.append(Point(len(path) // DIGEST, self.place, self.saved, self.leaves, conv))
            self.path, self.words = path, words
            self.stack[-1].least = min(self.stack[-1].least, conv)
            self.ends.append(conv)
        if first is not None:
            yield from self.end(last=True)
            yield from self.finish()
            yield {"kind": "run", "part": self.part, "hi": self.place + 1, "s_hi": self.saved, "l_hi": self.leaves, "first_path": first[0], "last_path": self.path, "first_words": first[1]}

    def end(self, last: bool = False) -> Iterator[dict]:
        """The ids that end where the current path ends, ascending; as chunks if another run may have more."""
        if not last and self.ends_at:
            self.stack[-1].ends = hashlib.sha256(",".join(map(str, self.ends)).encode()).hexdigest()
        else:
            key = hashlib.md5(self.path).digest()
            for k in range(0, len(self.ends), CHUNK):
                yield {"kind": "ends", "part": self.part, "seq": k, "key": key, "ends": ",".join(map(str, self.ends[k : k + CHUNK]))}

    def row(self, p: Point, up: int, keys: dict[int, bytes], is_open: bool = False) -> dict:
        edge = self.words[up : p.depth][::-1]
        return {
            "kind": "point", "part": self.part, "shared": is_open or p.lo == 0, "open": is_open, "key": keys[p.depth], "parent": keys[up] if p.depth else None, "depth": p.depth,
            "lo": p.lo, "hi": self.place, "s_lo": p.s_lo, "s_hi": self.saved, "l_lo": p.l_lo, "l_hi": self.leaves, "before": int(self.words[: max(p.depth - 1, 0)].sum()),
            "below": np.cumsum(edge) - edge[0] if p.depth else [0], "conv_id": p.least, "ends": p.ends,
        }

    def keys(self, depths: set[int]) -> dict[int, bytes]:
        """Digests of the current path's prefixes."""
        out, h, at = {}, hashlib.md5(), 0
        for d in sorted(depths):
            h.update(self.path[at * DIGEST : d * DIGEST])
            out[d], at = h.copy().digest(), d
        return out

    def close(self, depth: int) -> Iterator[dict]:
        """Points below a depth of the current path leave the stack; a branch point appears where an edge is left."""
        closed = []
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, p.lo, p.s_lo, p.l_lo, p.least))
            up = self.stack[-1]
            up.least = min(up.least, p.least)
            closed.append((p, up.depth))
        keys = self.keys({d for p, up in closed for d in (p.depth, up)})
        yield from (self.row(p, up, keys) for p, up in closed)

    def finish(self) -> Iterator[dict]:
        """All nodes along the last path, edges included."""
        keys = self.keys(set(range(self.stack[-1].depth + 1)))
        while self.stack:
            p = self.stack.pop()
            if self.stack:
                self.stack[-1].least = min(self.stack[-1].least, p.least)
            for d in range(p.depth, self.stack[-1].depth if self.stack else -1, -1):
                yield self.row(Point(d, p.lo, p.s_lo, p.l_lo, p.least, p.ends if d == p.depth else None), max(d - 1, 0), keys, True)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in MADE.split(", "))])

    def rows() -> Iterator[tuple[int, bytes, np.ndarray]]:
        for b in batches:
            words = b.column("words")
            flat, at = words.flatten().to_numpy(), np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            for i, (conv, path) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("path").to_pylist(), strict=True)):
                yield conv, path, flat[at[i] : at[i + 1]]

    out = []
    for made in Run(TaskContext.get().partitionId()).tree(rows()):
        out.append(made)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of chunks joined by commas; chunks of a key stand together and in order."""
    key, h, out = None, None, []
    for b in batches:
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k == key:
                h.update(b",")
            else:
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            h.update(text.encode())
    if key is not None:
        out.append((key, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["key", "ends"])


def common_turns(a: Column, b: Column) -> Column:
    """Turns that two paths share."""
    n = (F.least(F.length(a), F.length(b)) / DIGEST).cast("int")
    turn = lambda path, i: F.substr(path, (i - 1) * DIGEST + 1, F.lit(DIGEST))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: turn(a, i) == turn(b, i))
    differs = F.array_position(same, False)
    return F.when(a.isNull() | (n == 0), 0).when(differs == 0, n).otherwise((differs - 1).cast("int"))


def starts_of(runs: DataFrame) -> DataFrame:
    """What stands before each run: conversations, saved words, leaves; and whether its last one is a leaf. One row a run."""
    order = W.orderBy("part")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    common = common_turns(F.lag("last_path").over(order), F.col("first_path"))
    met = runs.withColumn("common", common)
    met = met.withColumn("entry", F.coalesce(F.aggregate(F.slice("first_words", F.lit(1), F.col("common")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)))
    met = met.withColumn("leaf", F.coalesce(F.lead("common").over(order) < F.length("last_path") / DIGEST, F.lit(True)).cast("long"))
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return met.select("part", "leaf", total("hi", before).alias("rows0"), (total("s_hi", before) + total("entry", order.rowsBetween(W.unboundedPreceding, 0))).alias("s0"), total(F.col("l_hi") + F.col("leaf"), before).alias("l0"))


def trie(conversations: DataFrame, siblings: int | None = None, heads: int = 4) -> DataFrame:
    """One row for each distinct sequence of first turns; with siblings, of conversations rebuilt by them."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "tries")
    each = scratch.keep(paths(conversations), "paths")
    if siblings:
        each = scratch.keep(rebuilt(each, siblings, heads), "rebuilt")
    runs = partitions_for(each, RUN, each.count())
    ordered = each.repartitionByRange(runs, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    scratch.keep(ordered.mapInArrow(walk, MADE), "made", by="kind")
    made = spark.read.schema(MADE).parquet(scratch.path("made"))
    scratch.drop("paths", "rebuilt")

    starts = scratch.keep(starts_of(made.where("kind = 'run'").select("part", "hi", "s_hi", "l_hi", "first_path", "last_path", "first_words")), "starts")
    placed = made.where("kind = 'point'").join(F.broadcast(starts), "part").select(
        "key", "parent", "depth", "shared", "conv_id", "before", "below", "ends",
        F.struct((F.col("lo") + F.col("rows0")).alias("i"), (F.col("s_lo") + F.col("s0")).alias("s"), (F.col("l_lo") + F.col("l0")).alias("l")).alias("lo"),
        F.struct((F.col("hi") + F.col("rows0")).alias("i"), (F.col("s_hi") + F.col("s0")).alias("s"), (F.col("l_hi") + F.col("l0") + F.when(F.col("open"), F.col("leaf")).otherwise(0)).alias("l")).alias("hi"),
    )
    same = ("parent", "depth", "before", "below")
    merged = placed.where("shared").groupBy("key").agg(*[F.first(c).alias(c) for c in same], F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # at most two keys a run have chunks
    chunks = made.where("kind = 'ends'").select("key", "part", "seq", "ends").repartition("key").sortWithinPartitions("key", "part", "seq")
    hashed = chunks.select("key", "ends").mapInArrow(streamed, "key binary, ends string").withColumnRenamed("ends", "streamed")
    merged = merged.join(F.broadcast(hashed), "key", "left").withColumn("ends", F.coalesce("streamed", "ends")).drop("streamed")
    points = placed.where("not shared").drop("shared").unionByName(merged).select(
        "key", "parent", "depth", "conv_id", "below", "ends",
        (F.col("hi.i") - F.col("lo.i") + 1).alias("n_convs"), (F.col("hi.l") - F.col("lo.l")).alias("n_leaves"), (F.col("hi.s") - F.col("lo.s") - (F.col("hi.i") - F.col("lo.i")) * F.col("before")).alias("saved"),
    )
    points = scratch.keep(points, "points")
    children = points.groupBy("parent").agg(F.count("*").alias("n_children")).select(F.col("parent").alias("key"), "n_children")
    above = points.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv"))
    full = points.join(children, "key", "left").join(above, "parent", "left")
    inner = F.col("pos") > 0
    return full.select("*", F.posexplode("below")).select(
        "conv_id", (F.col("depth") - F.col("pos")).alias("depth"), F.when(F.col("pos") == F.size("below") - 1, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(inner, 1).otherwise(F.coalesce("n_children", F.lit(0))).alias("n_children"), "n_leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("col")).alias("saved_tokens"),
        F.when(inner, F.lit(NOTHING)).otherwise(F.coalesce("ends", F.lit(NOTHING))).alias("ends_sha256"),
    )
