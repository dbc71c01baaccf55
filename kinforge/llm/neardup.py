"""MinHash near-duplicates with tensored banding, confirmed on full shingle sets.

Texts with the same shingle set are one class from the start. A class has two
collections of ENTRIES keys, each made of two minhashes; a table key joins an entry
of the first with one of the second, so n * n tables need only 4 * n minhashes. The
number of entries makes a pair at the threshold share no table with probability
MISS at most. Entries that no other class has cannot join into a shared key and are
dropped before the keys are formed.

Members of a table key are never paired with each other outright:
1. each class is compared with the least class among its keys;
2. of keys that still hold several components, and more than SMALL classes, the
   first entries are looked at: all that share such an entry are compared with its
   centre, a class that shares many keys. Two classes that are linked to one centre
   need no further look. Of others, a pair has
   at most as many shingles in common as both share with the centre, plus what they
   share beside it. So it is compared if the first number alone is enough, or if it has
   a shingle beside the centre in common among the first (100 - percent) % of both (a
   prefix filter; any order is right, and one that has shingles last that recur in a
   sample of the centre's classes gives few pairs). Only these first shingles become
   rows;
3. in small keys, classes of different components are compared.
What steps 2 and 3 find is compared only if it shares a finer key as well, of up to twelve
minhashes: texts that are all parts of one long text, and little alike, share none.
Steps 2 and 3 skip only pairs that cannot reach the threshold, but for finer keys,
which again miss a pair at the threshold with probability MISS at most.
All compared pairs are confirmed on full sets; links join into components, and links
found last join the components so far.

Defined cases: a null or wordless text has an empty set and is linked with nothing;
fewer words than a shingle are one shingle; rows with a null id are linked with
nothing, have a null component and stay; rows that share an id are one document,
of which the least text is compared, and linked if any of its texts is; an empty table
gives an empty result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .fingerprints import shingles
from .graphs import components
from .scratch import Scratch
from .words import U, blocks, join, mix

MISS, SMALL = 1e-5, 8
#: Shingles of a centre that come last, under the 1,000 up to which Spark ranks rows before it shuffles them.
SAMPLED, FREQUENT = 16, 999
#: Finer keys of a class at most.
FINER = 110
_MULTIPLIERS = mix(np.arange(1, 4096, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def entries_for(percent: int) -> int:
    """Entries of a collection so that a pair at the threshold is missed with probability MISS at most."""
    return max(2, math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** 2)))


def finer_for(percent: int) -> tuple[int, int]:
    """Finer keys, and minhashes of each: as many minhashes as leave no more than FINER keys, of which a pair at the
    threshold shares none with probability MISS at most."""
    keys = lambda r: math.ceil(math.log(MISS) / math.log(1 - (min(percent, 99) / 100) ** r))
    rows = max(r for r in range(1, 13) if r == 1 or keys(r) <= FINER)
    return keys(rows), rows


def _finer(keys: int, rows: int):
    """id, shingles -> id, finer keys; their minhashes are others than those of the entries."""
    multipliers = mix(np.arange(5000, 5000 + keys * rows, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column("shingles").to_pylist():
                flat, found = np.frombuffer(s, U), np.arange(keys, dtype=U)
                for least in np.array([(flat * m).min() for m in multipliers], U).reshape(rows, keys):
                    found = join(found, least)
                out.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.int64()))], ["id", "keys"])

    return run


def _sets(column: pa.Array, length: int) -> list[np.ndarray]:
    hashes, rows = shingles(column, length)
    order = np.argsort(rows, kind="stable")
    hashes, at = hashes[order], np.searchsorted(rows[order], np.arange(len(column) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]


def _signatures(length: int, entries: int):
    """doc_id, text -> n, digest of the set, keys of both collections (odd ones are of the second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column):
                sets = _sets(column.slice(low, high - low), length)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                keys = np.zeros((len(some), 2 * entries), U)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    start = np.cumsum(size[some]) - size[some]
                    least = lambda k: np.minimum.reduceat(flat * _MULTIPLIERS[k], start)
                    for e in range(2 * entries):
                        key = join(join(least(2 * e), least(2 * e + 1)), np.full(len(some), e, U))
                        keys[:, e] = (key & ~U(1)) | U(e & 1)
                lists: list = [None] * len(sets)
                for i, k in zip(some.tolist(), keys.view(np.int64)):
                    lists[i] = k
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(size), pa.array(digest, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "keys"])

    return run


def _shingle_sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column):
                sets = [s.tobytes() for s in _sets(column.slice(low, high - low), length)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("u", "v")], ["u", "v"])

    return run


def _beside(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked, beside = [], [], []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                own = x[~np.isin(x, y, assume_unique=True)]
                n = len(x) - len(own)
                both.append(n)
                linked.append(100 * n >= percent * (len(x) + len(y) - n))
                beside.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "v", "n")), pa.array(both, pa.int64()), pa.array(linked, pa.bool_()), pa.array(beside, pa.list_(pa.int64()))], ["u", "v", "n", "both", "linked", "beside"])

    return run


def _first(percent: int):
    """beside, later: shingles that come last in the order, ascending -> the first (100 - percent) % of n, and one, of beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, beside, later in zip(*(batch.column(c) for c in ("n", "beside", "later"))):
                x = beside.values.to_numpy()
                if later.is_valid and len(later):
                    y = later.values.to_numpy()
                    x = np.concatenate([x[~np.isin(x, y)], y[np.isin(y, x)]])
                out.append(x[: n.as_py() * (100 - percent) // 100 + 1])
            kept = [c for c in batch.schema.names if c not in ("beside", "later")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([len(x) for x in batch.column("beside")], pa.int64()), pa.array(out, pa.list_(pa.int64()))], [*kept, "m", "first"])

    return run


class Search:
    """The classes of one table and the steps over them."""

    def __init__(self, docs: DataFrame, length: int, percent: int):
        self.percent, self.length = percent, length
        self.scratch = Scratch(docs.sparkSession, "neardup")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        signed = self.docs.mapInArrow(_signatures(length, entries_for(percent)), "doc_id long, n long, digest binary, keys array<long>")
        self.signed = self.scratch.keep(signed, "signed")
        known = self.signed.where("doc_id is not null and digest is not null")
        classes = known.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
        self.classes = self.scratch.keep(classes, "classes")

    def near_size(self, a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def members(self) -> DataFrame:
        """(key, l, id, n) of the table keys that two classes or more have; l is the key's first entry."""
        entry = self.classes.select("id", "n", F.explode("keys").alias("e"))
        shared = entry.groupBy("e").agg(F.count("*").alias("c")).where("c > 1").select("e")
        kept = entry.join(shared, "e").groupBy("id", "n").agg(F.collect_list("e").alias("e"))
        left, right = F.filter("e", lambda x: x % 2 == 0), F.filter("e", lambda x: x % 2 != 0)
        keyed = kept.select("id", "n", F.explode(left).alias("l"), right.alias("r")).select("id", "n", "l", F.explode("r").alias("r")).select(F.xxhash64("l", "r").alias("key"), "l", "id", "n")
        keyed = self.scratch.keep(keyed, "keyed")
        many = keyed.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("least")).where("c > 1")
        return self.scratch.keep(keyed.join(many, "key"), "members")

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """id -> its shingles; one text stands for a class."""
        one = self.docs.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
        return self.scratch.keep(one.groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")).mapInArrow(_shingle_sets(self.length), "id long, shingles binary"), "sets")

    def confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        a = self.sets.select(F.col("id").alias("u"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("id").alias("v"), F.col("shingles").alias("sb"))
        return self.scratch.keep(pairs.select("u", "v").distinct().join(a, "u").join(b, "v").mapInArrow(_confirm(self.percent), "u long, v long"), name)

    def with_component(self, members: DataFrame, label: DataFrame) -> DataFrame:
        return members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))

    def components(self) -> DataFrame:
        """(id, component) of linked classes."""
        keep = self.scratch.keep
        members = self.members()
        self.scratch.drop("keyed")
        self.sets = self.sets_of(members.select("id"))
        self.scratch.release()
        around = members.where(F.col("id") > F.col("least.id")).where(self.near_size("n", "least.n"))
        first = keep(around.groupBy("id").agg(F.min("least.id").alias("v")).select(F.col("id").alias("u"), "v"), "pairs1")
        links = self.confirmed(first, "links1")
        # two steps up its links stand for a class's component: at worst, some keys are looked at for nothing
        up = links.select(F.col("u").alias("id"), F.col("v").alias("to"))
        twice = up.join(up.select(F.col("id").alias("to"), F.col("to").alias("top")), "to", "left")
        label = twice.select("id", F.coalesce("top", "to").alias("component"))

        labelled = self.with_component(members.select("key", "l", "id", "n", "c"), label)
        several = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        open_ = keep(labelled.drop("component").join(several, "key"), "open")
        compared = self.around_centres(open_.where(F.col("c") > SMALL))
        links = links.unionByName(compared.where("linked").select("u", "v"))
        label = keep(components(links, self.scratch, "c2"), "label2")

        small = self.with_component(open_.where(F.col("c") <= SMALL), label)
        group = self.with_component(compared.withColumnRenamed("u", "id"), label)
        finer = self.with_finer(group)
        tested = first.unionByName(compared.select("u", "v"))
        tested = tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        found = self.across(small).unionByName(self.by_shingle(group, finer)).distinct()
        found = self.with_finer_key(keep(found.join(tested, ["u", "v"], "left_anti"), "found"))
        rest = keep(found.unionByName(self.by_size(finer).join(tested, ["u", "v"], "left_anti")).distinct(), "pairs3")
        more = self.confirmed(rest, "links3")
        # links found last join components: they become links between these
        of = lambda side: label.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
        between = more.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct()
        merged = components(between, self.scratch, "c3").select(F.col("id").alias("component"), F.col("component").alias("top"))
        labelled = self.with_component(self.classes.select("id").distinct(), label)
        return labelled.join(merged, "component", "left").select("id", F.coalesce("top", "component").alias("component"))

    def around_centres(self, large: DataFrame) -> DataFrame:
        """(u, v, n, both, linked, beside) of each class u and the centres v of its entries: shingles in common, and those of u alone."""
        placed = self.scratch.keep(large.groupBy("l", "id").agg(F.first("n").alias("n"), F.sum("c").alias("part")), "placed")
        scored = placed.join(placed.groupBy("id").agg(F.sum("part").alias("score")), "id")
        # written tables on both sides: a join that reads an aggregate directly can't be split for a frequent entry
        centre = self.scratch.keep(scored.groupBy("l").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("top")), "centre")
        # any class can be a centre; the best one that a member knows from its entries serves many entries at once
        met = scored.select("l", "id", "n").join(centre, "l")
        best = met.groupBy("id").agg(F.max("top").alias("best"))
        chosen = self.scratch.keep(met.select("l", "id").join(best, "id").groupBy("l").agg(F.max("best").alias("best")).select("l", (-F.col("best.minus")).alias("v")), "chosen")
        pairs = placed.select("l", "id", "n").join(chosen, "l").where("id <> v").select(F.col("id").alias("u"), "v", "n").distinct()
        a = self.sets.select(F.col("id").alias("u"), F.col("shingles").alias("sa"))
        b = self.sets.select(F.col("id").alias("v"), F.col("shingles").alias("sb"))
        return self.scratch.keep(pairs.join(a, "u").join(b, "v").select("u", "v", "n", "sa", "sb").mapInArrow(_beside(self.percent), "u long, v long, n long, both long, linked boolean, beside array<long>"), "compared")

    def _reach(self, both: F.Column, n: F.Column) -> F.Column:
        """Whether so many common shingles can link sets of n shingles together."""
        return (100 + self.percent) * both >= self.percent * n

    def finer_keys(self, ids: DataFrame) -> DataFrame:
        return self.sets.join(ids.select("id").distinct(), "id").mapInArrow(_finer(*finer_for(self.percent)), "id long, keys array<long>")

    def with_finer_key(self, pairs: DataFrame) -> DataFrame:
        """Pairs that share a finer key; it is shorter than what confirms them."""
        ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))
        keys = self.scratch.keep(self.finer_keys(ids), "finer2")
        a, b = (keys.select(F.col("id").alias(side), F.col("keys").alias(f"k{side}")) for side in ("u", "v"))
        return pairs.join(a, "u").join(b, "v").where(F.arrays_overlap("ku", "kv")).select("u", "v")

    def with_finer(self, group: DataFrame) -> DataFrame:
        """group's classes with each finer key that they share with a class of another component, one of them not linked
        to their centre."""
        some = group.select("id", "v", "n", "both", "linked", "component")
        some = self.scratch.keep(some.join(some.where("not linked").select("v").distinct(), "v", "left_semi"), "around")
        keys = self.finer_keys(some)
        each = self.scratch.keep(some.join(keys, "id").withColumn("key", F.explode("keys")).drop("keys"), "finer")
        shared = each.groupBy("v", "key").agg(F.max(~F.col("linked")).alias("x"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("x and c0 < c1").select("v", "key")
        return self.scratch.keep(each.join(shared, ["v", "key"]), "shared")

    def by_size(self, finer: DataFrame) -> DataFrame:
        """Pairs around a centre for which what both share with it is enough; one of them is not linked to it."""
        x = finer.where("not linked").select("v", "key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("both").alias("ba"), F.col("component").alias("ca"))
        y = finer.select("v", "key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("both").alias("bb"), F.col("component").alias("cb"))
        found = x.join(y, ["v", "key"]).where("ca <> cb").where(self.near_size("na", "nb")).where(self._reach(F.least("ba", "bb"), F.col("na") + F.col("nb")))
        return found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def later(self, compared: DataFrame) -> DataFrame:
        """(v, later): the shingles beside a centre that recur most in a sample of its classes, ascending."""
        some = compared.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("v", F.explode("beside").alias("h"))
        often = some.groupBy("v", "h").agg(F.count("*").alias("k")).where("k > 1")
        most = often.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("k"), "h"))).where(F.col("r") <= FREQUENT)
        return self.scratch.keep(most.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("kh")).select("v", F.col("kh.h").alias("later")), "later")

    def by_shingle(self, group: DataFrame, finer: DataFrame) -> DataFrame:
        """Pairs around a centre with a shingle beside it in common among the first of both; one of them is not linked to it.
        Classes that share no finer key are in no such pair."""
        ordered = group.select("id", "v", "n", "both", "linked", "component", "beside").join(self.later(group), "v", "left")
        first = ordered.select("id", "v", "n", "both", "linked", "component", "beside", "later").mapInArrow(_first(self.percent), "id long, v long, n long, both long, linked boolean, component long, m long, first array<long>")
        each = self.scratch.keep(first.withColumn("h", F.explode("first")).drop("first"), "first")
        each = each.join(finer.select("id", "v").distinct(), ["id", "v"], "left_semi")
        x = each.where(~F.col("linked")).select("v", "h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("both").alias("ba"), F.col("component").alias("ca"), F.col("m").alias("ma"))
        y = each.select("v", "h", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("both").alias("bb"), F.col("component").alias("cb"), F.col("m").alias("mb"))
        found = x.join(y, ["v", "h"]).where("ca <> cb").where(self.near_size("na", "nb")).where(self._reach(F.least("ba", "bb") + F.least("ma", "mb"), F.col("na") + F.col("nb")))
        return found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()

    def across(self, m: DataFrame) -> DataFrame:
        """Pairs of one small key and two components."""
        a = m.select("key", F.col("id").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"))
        b = m.select("key", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"))
        return a.join(b, "key").where("cu <> cv and u > v").where(self.near_size("nu", "nv")).select("u", "v").distinct()


def link(docs: DataFrame, length: int = 3, percent: int = 85) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_shingles, component_id, kept."""
    search = Search(docs, length, percent)
    found = search.components().withColumnsRenamed({"id": "class_id"})
    classes = search.classes.select("digest", F.col("id").alias("class_id")).join(found, "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = search.signed.select("doc_id", "n", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
