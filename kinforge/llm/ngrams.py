"""Perplexity by an interpolated modified Kneser-Ney trigram model.

Tokens are hashed to 64 bits. Tasks count the bigrams of their share of the texts,
sort them and send them on as packed blocks, one a bucket; a bucket is chosen by
the first word, and for a frequent one by the second too: words with more than half
a bucket's share of a sample of the texts are spread over as many buckets as their
share asks for, so that no bucket grows with the corpus. A bucket's task merges its
blocks and writes the bigrams as sorted hash arrays into the shared folder; a bigram's
bucket and place there are its number. One that was seen once has 31 bits of the only
word that stood before it: the trigram that ends in it is known by these, and needs no
entry. Others have their place in a table of the counts of bigrams that recur.

The buckets' arrays are then laid end to end in one file, with an index of keys by
their first bits: a block of texts looks up all its keys at once, whatever the number
of buckets, and a key costs about as much in a large model as in a small one.

The texts are read again for trigrams. One that ends in a bigram seen once was seen
once itself and is merely counted; the others are sent on as the numbers of their two
bigrams, which need fewer bytes than hashes. Buckets are those of the last two words, and
for a frequent pair of the first two as well. They give each pair the number of different
words before it, which is the count that a bigram has in the model (its own for a pair
at the start of a text), and each trigram its count. With least = 1 every trigram counts
in full; with least = 2 those seen once are pruned: they take part in counts and
discounts, but have no entry, and what they would have had goes to the bigrams. Last
rounds of buckets sum by context, into the table of bigrams that recur, and by word.

Workers that score map the files into memory. Training returns where each bucket
begins in them: a worker that misses one of the files fails. The folder in spark.checkpoint.dir must be mounted by driver and executors, as
arrays are mapped, not read.

Defined cases: a null text is empty and has one token, its end; unknown words get
the share that the unigram discount leaves for one unseen word; repeated rows count
as often as they stand; null ids are learned from; with nothing to learn from every
token has probability 1 / (V + 1); texts of any length are counted and scored whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import shutil
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import U, blocks, join, mix, words

START, END, LAST = U(0x5354415254), U(0x454E44), U((1 << 64) - 1)
FLUSH, BUCKET_TOKENS, SCORED, SAMPLED = 1_500_000, 1_400_000, 1 << 22, 64
STATS = ("count", "before", "total", "one", "two", "more")
#: Of a bigram that recurs: its count, the count that it has in the model, and as a context the sum of the counts of its trigrams
#: that recur, how many of them were seen twice, and how many more often.
OPEN = 5
#: Buckets whose trigrams are counted send on what they know of bigrams by groups of two to the power SETTLED buckets.
SETTLED = 3


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's words and its end, what stands before each, and where rows begin."""
    w = words(column, lower=True)
    n = len(column)
    now = np.empty(len(w.hashes) + n, U)
    now[np.arange(len(w.hashes)) + w.rows] = w.hashes
    now[w.at[1:] + np.arange(n)] = END
    before = np.empty_like(now)
    before[1:] = now[:-1]
    start = w.at[:-1] + np.arange(n)
    before[start] = START
    return now, before, start


class Buckets:
    """How n-grams are dealt out: n buckets, the frequent words (sorted hashes) with the buckets that each is spread over,
    and how many of a pair's trigrams one bucket should have at most."""

    def __init__(self, n: int, frequent: np.ndarray, spread: np.ndarray, most: int = BUCKET_TOKENS // 4):
        self.n, self.frequent, self.spread, self.most = n, frequent, spread, most

    def of(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        return self.of_coded(*self.first(before), np.arange(len(before)), now)

    def first(self, words_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bucket of each first word, and how many it is spread over."""
        home, spread = mix(words_ ^ U(0xB0CCE7)) % U(self.n), np.ones(len(words_), U)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, words_), len(self.frequent) - 1)
            hit = self.frequent[at] == words_
            spread[hit] = self.spread[at[hit]]
        return home.astype(np.int64), spread

    def of_coded(self, home: np.ndarray, spread: np.ndarray, code: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Buckets of bigrams whose first word is the code-th of those that first() was asked for."""
        out, over = home[code], spread[code]
        hit = np.flatnonzero(over > 1)
        out[hit] = (out[hit] + (mix(now[hit]) % over[hit]).astype(np.int64)) % self.n
        return out

    def of_triples(self, home: np.ndarray, context: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Buckets of trigrams whose last two words have this bucket and occur so often together; context: number of the first two."""
        out = home.copy()
        hot = np.flatnonzero(count > self.most)
        spread = np.minimum(-(-count[hot] // self.most), self.n).astype(U)
        out[hot] = (out[hot] + (mix(context[hot]) % spread).astype(np.int64)) % self.n
        return out


def _frequent(least: float):
    """text -> (word, count) of words with at least this share of a batch, and all words' count as word null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in blocks(batch.column("text"), SCORED):
                _, before, _ = tokens(batch.column("text").slice(low, high - low))
                word, count = np.unique(before, return_counts=True)
                ok = count >= least * len(before)
                yield pa.RecordBatch.from_arrays([pa.array([None, *word[ok].view(np.int64).tolist()], pa.int64()), pa.array([len(before), *count[ok].tolist()], pa.int64())], ["word", "count"])

    return run


def dealt(docs: DataFrame, n: int, most: int = BUCKET_TOKENS // 4) -> Buckets:
    """Buckets for the texts, as one in SAMPLED of them (by hash) has words. Any choice is right; a good one is even."""
    share = 1 / (2 * n)
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(_frequent(share / 4), "word long, count long").groupBy("word").agg(F.sum("count").alias("c"))
    whole = counts.where("word is null").agg(F.sum("c")).first()[0] or 0
    found = sorted((r["word"] % (1 << 64), r["c"] / whole) for r in counts.where(F.col("word").isNotNull() & (F.col("c") >= share * whole)).collect()) if whole else []
    return Buckets(n, np.array([w for w, _ in found], U), np.array([min(n, math.ceil(4 * s * n)) for _, s in found], U), most)


def near_order(keys: np.ndarray) -> np.ndarray:
    """Places of keys, ascending by as many of their first bits as a place leaves room for: numpy sorts numbers several
    times as fast as it finds the order of numbers, so places are sorted as the last bits of the keys."""
    if len(keys) < 2:
        return np.arange(len(keys))
    low = U((1 << (len(keys) - 1).bit_length()) - 1)
    spare = U(64 - int(keys.max()).bit_length())
    return (np.sort(((keys << spare) & ~low if spare < 64 else keys) | np.arange(len(keys), dtype=U)) & low).astype(np.int64)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in ascending order, and the keys in that order."""
    order = near_order(keys)
    out = keys[order]
    if (out[1:] < out[:-1]).any():  # keys that differ in their last bits only
        order = np.argsort(keys)
        out = keys[order]
    return order, out


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, a place of each, and sums of values."""
    order, keys = ordered(keys)
    start = _starts(keys)
    return keys[start], order[start], [np.add.reduceat(v[order], start) if len(start) else v[:0] for v in values]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and how often each occurs."""
    order, keys = ordered(keys)
    start = _starts(keys)
    return keys[start], order[start], np.diff(start, append=len(keys))


def _beside(shard: np.ndarray, shards: int, keys: np.ndarray) -> np.ndarray:
    """Numbers that ascend by shard, and within one by the first bits of a key."""
    bits = U(max(1, (shards - 1).bit_length()))
    return (shard.astype(U) << (U(64) - bits)) | (keys >> bits)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    out, at = [], 0
    for t in types:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, t, n, at + 8))
        at += 8 + n * np.dtype(t).itemsize
    return out


def _squeeze(x: np.ndarray, small: zstandard.ZstdCompressor) -> np.ndarray:
    """Numbers in the narrowest type, byte by byte (all lowest ones first), compressed; the type's width comes first."""
    x = _narrow(x)
    return np.frombuffer(bytes([x.itemsize]) + small.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()), np.uint8)


def _widen(data: np.ndarray, kind) -> np.ndarray:
    width = int(data[0])
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:].tobytes()), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(f"u{width}").reshape(-1).astype(kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first as it is; cumsum is the way back."""
    return np.diff(x, prepend=x.dtype.type(0))


def _mark(word: np.ndarray) -> np.ndarray:
    """31 bits of a word."""
    return (mix(word) >> U(33)).astype(np.uint32)


PARTS = pa.schema([("bucket", pa.int64()), ("block", pa.binary()), ("of_counts", pa.list_(pa.int64())), ("made", pa.int64()), ("size", pa.int64()), ("most", pa.int64()), ("recur", pa.int64())])
PARTS_DDL = "bucket long, block binary, of_counts array<long>, made long, size long, most long, recur long"


def _counted(buckets: Buckets):
    """text -> (bucket, block): a block has first words, their numbers of followers, followers, counts, and
    marks of the words before the bigrams that it counts once."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        now, before, mark = (np.concatenate(x) for x in zip(*held))
        _, first, count = numbered(join(before, now))
        now, before, mark = now[first], before[first], mark[first]
        bucket = buckets.of(before, now)
        order = near_order(_beside(bucket, buckets.n, before))
        now, before, mark, count, bucket = now[order], before[order], mark[order], count[order].astype(np.uint32), bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets.n + 1))
        ids, packed = [], []
        small = zstandard.ZstdCompressor(level=1)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[b], edges[b + 1]
            run = np.flatnonzero(np.concatenate([[True], before[i + 1 : j] != before[i : j - 1]]))
            lengths = np.diff(np.append(run, j - i)).astype(np.uint32)
            squeezed = [np.frombuffer(small.compress(x.tobytes()), np.uint8) for x in (lengths, count[i:j])]
            ids.append(b)
            packed.append(_pack(before[i:j][run], squeezed[0], now[i:j], squeezed[1], mark[i:j][count[i:j] == 1]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column):
                now, before, _ = tokens(column.slice(low, high - low))
                mark = np.zeros(len(now), np.uint32)
                mark[1:] = _mark(before[:-1])
                held.append((now, before, mark))
                size += len(now)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _save(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Written under another name first: a task that runs twice leaves the same files."""
    os.makedirs(folder, exist_ok=True)
    for k, a in enumerate(arrays):
        own = f"{folder}/.{name}.{k}.{os.getpid()}.{os.urandom(4).hex()}.npy"
        np.save(own, a)
        os.replace(own, f"{folder}/{name}.{k}.npy")


def _merged(folder: str, word_bits: int):
    """All blocks of a bucket -> bigram arrays on disk (hashes; places among those that recur or, below zero, marks of those
    seen once; counts of those that recur; first words of those that trigrams will count); (word bucket, block of its words' sums)."""

    def run(table: pa.Table) -> pa.Table:
        before, now, count, mark = [], [], [], []
        large = zstandard.ZstdDecompressor()
        for data in table.column("block").to_pylist():
            first, lengths, follow, counts, marks = _unpack(data, U, np.uint8, U, np.uint8, np.uint32)
            before.append(np.repeat(first, np.frombuffer(large.decompress(lengths.tobytes()), np.uint32)))
            now.append(follow)
            count.append(np.frombuffer(large.decompress(counts.tobytes()), np.uint32))
            mark.append(np.zeros(len(follow), np.int64))
            mark[-1][count[-1] == 1] = marks
        before, now, count, mark = (np.concatenate(x) for x in (before, now, count, mark))
        keys, first, (count,) = summed(join(before, now), count.astype(np.int64))
        before, now = before[first], now[first]
        own = table.column("bucket")[0].as_py()
        recur = count > 1
        _save(folder, f"pairs-{own}", keys, np.where(recur, np.cumsum(recur) - 1, -1 - mark[first]).astype(np.int32), count[recur])
        _save(folder, f"heads-{own}", before[recur & (before != START)])
        closed = (count == 1) | (before == START)
        done = np.where(closed, count, 0)
        zero, one = np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64)
        words_ = np.concatenate([now, before])
        sums = [np.concatenate(x) for x in ((count, zero), (one, zero), *((zero, x) for x in _followed(done)))]
        words_, _, sums = summed(words_, *sums)
        out = _sorted_blocks(words_, sums, word_bits)
        out.append({"bucket": -1, "of_counts": _seen(done), "made": own, "size": len(keys), "most": int(count.max()), "recur": int(recur.sum())})
        return pa.Table.from_pylist(out, PARTS)

    return run


def _followed(count: np.ndarray) -> list[np.ndarray]:
    """What a pair of this count adds to its first word: the last four of STATS."""
    return [count] + [x.astype(np.int64) for x in (count == 1, count == 2, count > 2)]


def _seen(count: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5].tolist()


def _sorted_blocks(keys: np.ndarray, sums: list[np.ndarray], bits: int) -> list[dict]:
    """Rows of PARTS: sorted keys and their sums, a block for each value of a key's first bits."""
    edges = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    small = zstandard.ZstdCompressor(level=1)
    out = []
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i, j = edges[b], edges[b + 1]
        body = np.frombuffer(small.compress(np.concatenate([s[i:j] for s in sums]).tobytes()), np.uint8)
        out.append({"bucket": b, "block": _pack(keys[i:j], body)})
    return out


def _summed_blocks(table: pa.Table, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and sums over all blocks that _sorted_blocks made for one bucket."""
    large = zstandard.ZstdDecompressor()
    all_keys, sums = [], []
    for data in table.column("block").to_pylist():
        k, body = _unpack(data, U, np.uint8)
        all_keys.append(k)
        sums.append(np.frombuffer(large.decompress(body.tobytes()), np.int64).reshape(width, -1))
    keys, _, out = summed(np.concatenate(all_keys), *np.concatenate(sums, 1))
    return keys, out


@dataclass
class Shelf:
    """How the shards of a kind stand in its files: where each begins (its keys and then LAST), and by how many of a key's first
    bits, after those that the keys of a shard share, the index knows its place; where each shard's bigrams that recur begin."""

    start: np.ndarray
    bits: int
    shared: int
    recur: np.ndarray | None = None


def _shelf(sizes: dict[int, int], shards: int, shared: int = 0, recur: dict[int, int] | None = None) -> Shelf:
    starts = lambda x, more: np.cumsum([0, *(x.get(b, 0) + more for b in range(shards))])
    each = sum(sizes.values()) // shards
    return Shelf(starts(sizes, 1), max(1, each.bit_length() - 2), shared, None if recur is None else starts(recur, 0))


def _laid(parts: str, folder: str, kind: str, shelf: Shelf):
    """Numbers of shards -> the same, when their arrays have their places in the files of the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [np.load(f"{folder}/{kind}-all.{k}.npy", mmap_mode="r+") for k in range(3 if shelf.recur is None else 4)]
        slots = np.arange(1 << shelf.bits, dtype=U) << U(64 - shelf.bits)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                i, j = int(shelf.start[b]), int(shelf.start[b + 1]) - 1
                files[0][j] = LAST
                if i < j:
                    keys = np.load(f"{parts}/{kind}-{b}.0.npy")
                    files[0][i:j] = keys
                    files[1][i:j] = np.load(f"{parts}/{kind}-{b}.1.npy").reshape(j - i, -1)
                    files[2][b << shelf.bits : (b + 1) << shelf.bits] = np.searchsorted(keys << U(shelf.shared), slots)
                if shelf.recur is not None and shelf.recur[b] < shelf.recur[b + 1]:
                    files[3][shelf.recur[b] : shelf.recur[b + 1], :2] = np.load(f"{parts}/{kind}-{b}.2.npy")[:, None]
            yield batch

    return run


def lay(spark: SparkSession, parts: str, folder: str, kind: str, shelf: Shelf, values: np.dtype, width: int = 1, counts: np.dtype | None = None) -> None:
    """The arrays that tasks wrote for the shards of a kind, laid end to end; they are deleted in turn, so that few stand twice."""
    n, total = len(shelf.start) - 1, int(shelf.start[-1])
    os.makedirs(folder, exist_ok=True)
    shapes = [(U, (total,)), (values, (total, width)), (np.uint32, (n << shelf.bits,))] + ([] if shelf.recur is None else [(counts, (int(shelf.recur[-1]), OPEN))])
    for k, (dtype, shape) in enumerate(shapes):
        # a file that ends after its header can't be mapped, so an empty one has a row
        np.lib.format.open_memmap(f"{folder}/{kind}-all.{k}.npy", "w+", dtype, (max(shape[0], 1), *shape[1:]))
    rounds = 1 + min(3, total >> 22)
    for r in range(rounds):
        low, high = n * r // rounds, n * (r + 1) // rounds
        if low < high:
            spark.range(low, high, 1, max(1, min(high - low, total >> 20, n // 4))).mapInArrow(_laid(parts, folder, kind, shelf), "id long").agg(F.count("*")).first()
        for b in range(low, high):
            for k in range(3):
                if os.path.exists(path := f"{parts}/{kind}-{b}.{k}.npy"):
                    os.remove(path)


class Arrays:
    """Mapped arrays of a folder; shelves: how each kind stands in its files. One that can't be seen here is an error."""

    #: Mapped files at a time.
    MAPS = 64

    def __init__(self, folder: str, buckets: Buckets, bits: int, shelves: dict[str, Shelf]):
        self.folder, self.buckets, self.bits, self.shelves, self.mapped = folder, buckets, bits, shelves, OrderedDict()

    def _map(self, kind: str, k: int) -> np.ndarray:
        name = f"{kind}-all.{k}"
        if name not in self.mapped:
            if len(self.mapped) >= self.MAPS:
                self.mapped.popitem(last=False)
            self.mapped[name] = np.asarray(np.load(f"{self.folder}/{name}.npy", mmap_mode="r"))  # a plain view is read with less overhead
        self.mapped.move_to_end(name)
        return self.mapped[name]

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(64 - self.bits)).astype(np.int64)

    def place(self, kind: str, shard: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the kind's files have the keys, and whether they have them."""
        shelf = self.shelves.get(kind)
        if shelf is None or not len(keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        have, index = self._map(kind, 0), self._map(kind, 2)
        slot = (shard << shelf.bits) + ((keys << U(shelf.shared)) >> U(64 - shelf.bits)).astype(np.int64)
        at = shelf.start[shard] + index[slot]
        got = have[at]
        left = np.flatnonzero(got < keys)
        while len(left):
            at[left] += 1
            got[left] = have[at[left]]
            left = left[got[left] < keys[left]]
        return at, (got == keys) & (keys != LAST)

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        """The values of keys, 0 where there are none."""
        at, has = self.place(kind, shard, keys)
        out = np.zeros((len(keys), width), np.int64)
        if has.any():
            out[has] = self._map(kind, 1)[at[has]]
        return out

    def find_pairs(self, bucket: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of bigrams: their count (0: none), the mark of what stands before one that was seen once (else -1), their number;
        which of them recur, and where they stand in the table of those."""
        at, has = self.place("pairs", bucket, keys)
        seen, mark = has.astype(np.int64), np.full(len(keys), -1, np.int64)
        if not has.any():
            return seen, mark, np.zeros(len(keys), U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        shelf = self.shelves["pairs"]
        value = self._map("pairs", 1)[at, 0]
        number = (bucket << 32 | (at - shelf.start[bucket])).view(U)
        number[~has] = 0
        once = has & (value < 0)
        mark[once] = -1 - value[once]
        recur = np.flatnonzero(has & (value >= 0))
        row = shelf.recur[bucket[recur]] + value[recur]
        if len(recur):
            seen[recur] = self._map("pairs", 3)[row, 0]
        return seen, mark, number, recur, row


_lookups: dict[str, Arrays] = {}


def _extended(of: tuple):
    """of: folder, buckets, bits and shelf of the bigrams. text -> (bucket, block): a block has the numbers of last two words, how many
    contexts each has, contexts (numbers of the first two words), counts. Bucket -1 has, in column alone, how many trigrams
    end in bigrams seen once."""

    def flush(held: list[tuple[np.ndarray, ...]], alone: int, n: int) -> pa.RecordBatch:
        context, pair, bucket = (np.concatenate(x) for x in zip(*held))
        _, first, count = numbered(join(context, pair))
        place = pair[first] & U(0xFFFFFFFF)
        order = near_order((bucket[first].astype(U) << U(int(place.max(initial=0)).bit_length())) | place)
        at, count = first[order], count[order].astype(np.uint32)
        context, pair, bucket = context[at], pair[at], bucket[at]
        edges = np.searchsorted(bucket, np.arange(n + 1))
        ids, packed = [-1], [None]
        small = zstandard.ZstdCompressor(level=1)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[b], edges[b + 1]
            run = np.flatnonzero(np.concatenate([[True], pair[i + 1 : j] != pair[i : j - 1]]))
            ids.append(b)
            packed.append(_pack(*(_squeeze(x, small) for x in (_steps(pair[i:j][run]), np.diff(np.append(run, j - i)), context[i:j], count[i:j]))))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array([alone] + [None] * (len(ids) - 1), pa.int64())], ["bucket", "block", "alone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if of[0] not in _lookups:
            _lookups.clear()
            _lookups[of[0]] = Arrays(*of)
        lookup = _lookups[of[0]]
        held, size, alone = [], 0, 0
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column, SCORED):
                now, before, _ = tokens(column.slice(low, high - low))
                home = lookup.buckets.of(before, now)
                count, _, number, _, _ = lookup.find_pairs(home, join(before, now))
                later = before != START
                at = np.flatnonzero(later & (count > 1))
                alone += int(later.sum()) - len(at)
                context = number[at - 1]
                held.append((context, number[at], lookup.buckets.of_triples(home[at], context, count[at])))
                size += len(at)
                if size >= FLUSH:
                    yield flush(held, alone, lookup.buckets.n)
                    held, size, alone = [], 0, 0
        if held:
            yield flush(held, alone, lookup.buckets.n)

    return run


def _joined(folder: str, least: int):
    """All blocks of a trigram bucket -> arrays of the trigrams seen so often on disk; (group of buckets, block) of its pairs, and
    of its contexts, whose blocks say so in made."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("bucket")[0].as_py()
        if own < 0:
            alone = sum(table.column("alone").to_pylist())
            return pa.Table.from_pylist([{"bucket": -1, "of_counts": [alone, 0, 0, 0]}], PARTS)
        parts = []
        for data in table.column("block").to_pylist():
            pair, lengths, context, counts = (_widen(x, kind) for x, kind in zip(_unpack(data, *[np.uint8] * 4), (U, np.uint32, U, np.uint32)))
            parts.append((context, np.repeat(np.cumsum(pair, dtype=U), lengths), counts.astype(np.int64)))
        context, pair, count = (np.concatenate(x) for x in zip(*parts))
        keys, first, (seen,) = summed(join(context, pair), count)
        kept = seen >= least
        if kept.any():
            _save(folder, f"triples-{own}", keys[kept], _narrow(seen[kept]))
        out = [{"bucket": -1, "of_counts": _seen(seen), "made": own, "size": int(kept.sum()), "most": int(seen.max()), "recur": None}]
        small = zstandard.ZstdCompressor(level=1)

        def send(numbers: np.ndarray, sums: list[np.ndarray], made: int | None) -> None:
            """A block for each group of buckets of bigrams, which are given by their numbers in order."""
            group = numbers >> U(32 + SETTLED)
            start = _starts(group)
            for b, i, j in zip(group[start].tolist(), start.tolist(), [*start[1:].tolist(), len(group)]):
                out.append({"bucket": b, "block": _pack(*(_squeeze(x, small) for x in (_steps(numbers[i:j]), *(s[i:j] for s in sums)))), "made": made})

        again = seen > 1
        contexts, _, sums = summed(context[first][again], seen[again], *(x[again].astype(np.int64) for x in (seen == 2, seen > 2)))
        send(contexts, sums, own)
        pairs, _, different = numbered(pair[first])
        send(pairs, [different], None)
        return pa.Table.from_pylist(out, PARTS)

    return run


def _settled(parts: str, folder: str, shelf: Shelf, bits: int):
    """All blocks of a group of buckets of bigrams -> what the table of those that recur has of them, on disk; (word bucket, block of sums)."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("bucket")[0].as_py()
        of_pairs, of_contexts = [], []
        for data, made in zip(table.column("block").to_pylist(), table.column("made").to_pylist()):
            held = of_pairs if made is None else of_contexts
            numbers, *sums = _unpack(data, *[np.uint8] * (2 if made is None else 4))
            held.append((np.cumsum(_widen(numbers, U), dtype=U), *(_widen(x, np.int64) for x in sums)))
        rank = np.load(f"{folder}/pairs-all.1.npy", mmap_mode="r")
        recur = np.load(f"{folder}/pairs-all.3.npy", mmap_mode="r+")

        def put(held: list[tuple[np.ndarray, ...]], column: int) -> list[np.ndarray]:
            if not held:
                return [np.zeros(0, np.int64)]
            numbers, *sums = (np.concatenate(x) for x in zip(*held))
            numbers, _, sums = summed(numbers, *sums)
            bucket = (numbers >> U(32)).astype(np.int64)
            row = shelf.recur[bucket] + rank[shelf.start[bucket] + (numbers & U(0xFFFFFFFF)).astype(np.int64), 0]
            for k, x in enumerate(sums):
                recur[row, column + k] = x
            return sums

        put(of_contexts, 2)
        (different,) = put(of_pairs, 1)
        heads = [f"{parts}/heads-{b}.0.npy" for b in range(own << SETTLED, min((own + 1) << SETTLED, len(shelf.start) - 1)) if shelf.start[b] + 1 < shelf.start[b + 1]]
        word = np.concatenate([np.load(name) for name in heads])
        if len(word) != len(different):
            raise RuntimeError(f"group {own}: {len(word)} bigrams that recur, trigrams of {len(different)}")
        zero = np.zeros(len(word), np.int64)
        words_, _, sums = summed(word, zero, zero, *_followed(different))
        out = _sorted_blocks(words_, sums, bits)
        out.append({"bucket": -1, "of_counts": _seen(different), "made": own})
        return pa.Table.from_pylist(out, PARTS)

    return run


def _words(folder: str):
    """All blocks of a word bucket -> word arrays on disk; numbers that the driver sums."""

    def run(table: pa.Table) -> pa.Table:
        w, s = _summed_blocks(table, len(STATS))
        b = table.column("bucket")[0].as_py()
        _save(folder, f"words-{b}", w, _narrow(np.stack(s, 1)))
        before = s[1][s[1] > 0]
        of_counts = _seen(before)
        return pa.Table.from_pylist([{"tokens": int(s[0].sum()), "words": int((s[0] > 0).sum()), "pairs": int(before.sum()), "more": int((before > 2).sum()), "of_counts": of_counts, "made": b, "size": len(w), "most": max(int(x.max()) for x in s)}], NUMBERS)

    return run


NUMBERS = pa.schema([("tokens", pa.int64()), ("words", pa.int64()), ("pairs", pa.int64()), ("more", pa.int64()), ("of_counts", pa.list_(pa.int64())), ("made", pa.int64()), ("size", pa.int64()), ("most", pa.int64())])


def discounts(n: list[int]) -> list[float]:
    """D(0), D(1), D(2), D(3 and more) from the numbers of things seen once to four times."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[0] else k / 2
        out.append(min(max(d, 0.0), float(k)) or k / 2)
    return out


class Model(Arrays):
    """Mapped arrays and the model's numbers."""

    def __init__(self, folder: str, buckets: Buckets, bits: int, numbers: dict, shelves: dict[str, Shelf]):
        super().__init__(folder, buckets, bits, shelves)
        self.numbers = numbers
        self.d3, self.d2, self.d1 = (np.array(discounts(numbers[f"{x}_counts"])) for x in ("triple", "pair", "word"))
        self.d3[1 : numbers["least"]] = 1  # a pruned trigram loses its whole count

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each row."""
        now, before, start = tokens(column)
        coded = pa.array(np.concatenate([now, [START]])).dictionary_encode()
        distinct, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        stats = self.find("words", self.shard(distinct), distinct, len(STATS))
        vocabulary, pairs = self.numbers["words"], self.numbers["pairs"]
        n = self.numbers["word_counts"]
        if pairs:
            left = (self.d1[1] * n[0] + self.d1[2] * n[1] + self.d1[3] * self.numbers["more"]) / pairs
            single = np.maximum(stats[:, 1] - self.d1[np.minimum(stats[:, 1], 3)], 0) / pairs + left / (vocabulary + 1)
        else:
            single = np.full(len(distinct), 1 / (vocabulary + 1))
        total = stats[:, 2]
        gamma = np.where(total > 0, (self.d2[1] * stats[:, 3] + self.d2[2] * stats[:, 4] + self.d2[3] * stats[:, 5]) / np.maximum(total, 1), 1.0)
        of_now = back[:-1]
        of_before = np.empty_like(of_now)
        of_before[1:] = of_now[:-1]
        of_before[start] = back[-1]
        home = self.buckets.of_coded(*self.buckets.first(distinct), of_before, now)
        seen, mark, number, recur, row = self.find_pairs(home, join(before, now))
        adjusted, rest = seen.copy(), self.d3[1] * seen  # what a bigram seen once has in the model, and leaves as a context
        if len(recur):
            whole, adjusted[recur], kept, two, more = self._map("pairs", 3)[row].T.astype(np.int64)
            rest[recur] = self.d3[1] * (whole - kept) + self.d3[2] * two + self.d3[3] * more
        p = np.maximum(adjusted - self.d2[np.minimum(adjusted, 3)], 0) / np.maximum(total[of_before], 1) + gamma[of_before] * single[of_now]
        at = np.flatnonzero(before != START)
        at = at[seen[at - 1] > 0]
        whole, thrice = seen[at - 1], np.zeros(len(at), np.int64)
        thrice[mark[at] == _mark(before[at - 1])] = 1
        again = np.flatnonzero(seen[at] > 1)
        k = at[again]
        context = number[k - 1]
        thrice[again] = self.find("triples", self.buckets.of_triples(home[k], context, seen[k]), join(context, number[k]), 1)[:, 0]
        p[at] = np.maximum(thrice - self.d3[np.minimum(thrice, 3)], 0) / whole + rest[at - 1] / whole * p[at]
        count = stats[:, 0]
        base = np.log10((count + 1) / (self.numbers["tokens"] + (vocabulary + 1)))[of_now]
        sums = lambda x: np.add.reduceat(x, start)
        return sums(np.ones(len(now), np.int64)), sums((count > 0).astype(np.int64)[of_now]), sums(base), sums(np.log10(p))


_models: dict[str, Model] = {}


def train(docs: DataFrame, scratch: Scratch, bucket_tokens: int = BUCKET_TOKENS, least: int = 1) -> tuple[str, Buckets, int, dict, dict[str, Shelf]]:
    """Folder, buckets, bits of words, numbers and shelves of the model of docs (text); least: 1, or 2 to prune
    trigrams seen once."""
    if least not in (1, 2):
        raise ValueError("least must be 1 or 2")
    folder = scratch.path("model")
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("spark.checkpoint.dir must be a mounted folder for arrays to be mapped into memory")
    folder = folder.removeprefix("file://").removeprefix("file:")
    chars = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = max(8, int(chars) // (6 * bucket_tokens))
    buckets = dealt(docs, n, bucket_tokens // 4)
    bits = max(2, (n // 4).bit_length())
    spread = max(8, n)  # partitions grow with the buckets, so that tasks do not
    spark, parts = docs.sparkSession, f"{folder}-parts"
    sizes = lambda rows, column="size": {r["made"]: r[column] for r in rows if r[column]}
    most = lambda rows: max((r["most"] or 0 for r in rows), default=0)

    def step(df: DataFrame, run, name: str) -> tuple[DataFrame, list[int], list[Row]]:
        """The written blocks of a step, how much was seen once to four times, what it says of its files."""
        out = scratch.keep(df.repartition(spread, "bucket").groupBy("bucket").applyInArrow(run, PARTS_DDL), name)
        scratch.release()
        told = out.where("bucket < 0")
        counts = [r or 0 for r in told.agg(*[F.sum(F.col("of_counts")[k]) for k in range(4)]).first()]
        return out.where("bucket >= 0"), counts, told.where("made is not null").select("made", "size", "most", "recur").collect()

    shelves = {}
    counted = docs.select("text").mapInArrow(_counted(buckets), "bucket long, block binary")
    closed, closed_counts, pairs = step(counted, _merged(parts, bits), "closed")
    shelves["pairs"] = _shelf(sizes(pairs), n, recur=sizes(pairs, "recur"))
    lay(spark, parts, folder, "pairs", shelves["pairs"], np.int32, counts=np.uint32 if most(pairs) < 1 << 32 else np.int64)
    extended = docs.select("text").mapInArrow(_extended((folder, buckets, bits, dict(shelves))), "bucket long, block binary, alone long")
    joined, triple_counts, triples = step(extended, _joined(parts, least), "joined")
    settled, open_counts, _ = step(joined, _settled(parts, folder, shelves["pairs"], bits), "settled")
    scratch.drop("joined")
    sums = closed.unionByName(settled).repartition(spread, "bucket").groupBy("bucket").applyInArrow(_words(parts), "tokens long, words long, pairs long, more long, of_counts array<long>, made long, size long, most long")
    row = sums.agg(*[F.sum(c).alias(c) for c in ("tokens", "words", "pairs", "more")], *[F.sum(F.col("of_counts")[k]).alias(f"n{k}") for k in range(4)], F.collect_list(F.struct("made", "size", "most")).alias("made")).first()
    numbers = {c: row[c] or 0 for c in ("tokens", "words", "pairs", "more")}
    numbers |= {"least": least, "word_counts": [row[f"n{k}"] or 0 for k in range(4)], "pair_counts": [a + b for a, b in zip(closed_counts, open_counts)], "triple_counts": triple_counts}
    scratch.drop("closed", "settled")
    scratch.release()
    for kind, rows, shards, shared, width in (("words", row["made"] or [], 1 << bits, bits, len(STATS)), ("triples", triples, n, 0, 1)):
        if held := sizes(rows):
            shelves[kind] = _shelf(held, shards, shared)
            lay(spark, parts, folder, kind, shelves[kind], np.min_scalar_type(most(rows)), width)
    shutil.rmtree(parts, ignore_errors=True)
    return folder, buckets, bits, numbers, shelves


def score(docs: DataFrame, learn_from: DataFrame, bucket_tokens: int = BUCKET_TOKENS, least: int = 1) -> DataFrame:
    """One row for each document (doc_id, text): n_tokens, n_known, train_tokens, base_score, score."""
    made = train(learn_from, Scratch(docs.sparkSession, "ngrams"), bucket_tokens, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if made[0] not in _models:
            _models.clear()
            _models[made[0]] = Model(*made)
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column, SCORED):
                n, known, base, found = _models[made[0]].score(column.slice(low, high - low))
                arrays = [batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(known), pa.array(np.full(len(n), made[3]["tokens"], np.int64)), pa.array(base), pa.array(found)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
