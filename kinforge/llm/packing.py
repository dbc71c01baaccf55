"""Variable-capacity best-fit packing of documents into training sequences.

Documents longer than the largest permitted length are cut into pieces of that
length. Pieces are spread over shards by a hash, so a shard has a bounded count
whatever the corpus is, and each shard is packed longest first: a piece goes to
the open bin that it leaves least room in. If none has room, a bin is opened in
the permitted length of least cost per word, for the words that the bin can hope
for: the piece and what shorter pieces, none of them placed yet, can add to it.

A sequence of c words costs c + c * c / ATTENTION + OVERHEAD: its words, attention
that grows with the square of its length, and what every sequence costs. Neither
long nor short bins are always cheapest. The permitted lengths are optimised jointly:
each set of lengths to open makes a plan, all bins of a plan are at last downsized
to the least permitted length that holds their contents, and the cheapest plan wins
(of equal ones that with fewer lengths, then the one with shorter lengths).

Defined cases: a null or wordless text gives one row with no words and a null
bin; null ids and repeated rows are packed like any others, spread over shards by
their text and their number; an empty table gives an empty result; other columns
are ignored; a text of any length is cut whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import size_of
from .scratch import Scratch

CAPACITIES = (256, 512, 1024, 2048)
OVERHEAD, ATTENTION = 16, 4096
SHARD = 4096
#: Of more lengths than this, only ranges of neighbours are tried as lengths to open.
ALL_SETS = 6
SCHEMA = "doc_id long, piece int, first_word long, n_words long, bin_id long, bin_capacity int, bin_used int, bin_offset int"


def cost_of(capacity: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return capacity + capacity * capacity / attention + overhead


def sets_to_open(capacities: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    n = len(capacities)
    if n <= ALL_SETS:
        for k in range(1, n + 1):
            yield from combinations(capacities, k)
    else:
        for k in range(1, n + 1):
            yield from (capacities[i : i + k] for i in range(n - k + 1))


def best_fit(lengths: list[int], capacities: tuple[int, ...], to_open: tuple[int, ...], cost: dict[int, float]) -> list[list[int]]:
    """Bins (lists of positions) for lengths that are sorted, longest first."""
    after = [*accumulate(reversed(lengths), initial=0)][::-1]  # words of all pieces from a position on
    ascending = [-n for n in lengths]
    fitting = [capacities[bisect_left(capacities, n)] for n in range(capacities[-1] + 1)]
    room = 0  # bit r is set if an open bin has r words left
    open_: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for i, n in enumerate(lengths):
        fits = room >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_[left].pop()
            if not open_[left]:
                room &= ~(1 << left)
        else:
            price = None
            for c in to_open:
                if c >= n:
                    hoped = n + min(c - n, after[max(i + 1, bisect_left(ascending, n - c))])
                    if price is None or cost[fitting[hoped]] / hoped < price:
                        price, left = cost[fitting[hoped]] / hoped, c
            if price is None:
                left = fitting[n]
            b = len(bins)
            bins.append([])
        bins[b].append(i)
        left -= n
        if left:
            open_.setdefault(left, []).append(b)
            room |= 1 << left
    return bins


def pack_shard(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> list[tuple[int, list[int]]]:
    """(capacity, positions) of the cheapest plan; lengths are sorted, longest first."""
    cost = {c: cost_of(c, overhead, attention) for c in capacities}
    best: tuple[float, list[tuple[int, list[int]]]] | None = None
    for to_open in sets_to_open(capacities):
        plan = []
        for items in best_fit(lengths, capacities, to_open, cost):
            plan.append((capacities[bisect_left(capacities, sum(lengths[i] for i in items))], items))
        total = sum(cost[c] for c, _ in plan)
        if best is None or total < best[0]:
            best = total, plan
    return best[1] if best else []


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> DataFrame:
    """One row for each piece of each document (doc_id, text), with its place in a bin."""
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    scratch = Scratch(docs.sparkSession, "packing")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("own")
    each = docs.select(F.col("doc_id").cast("long"), size_of(F.col("text")).alias("words"), own)
    # rows that are alike are counted before they are numbered, so that they spread over shards
    sized = scratch.keep(each.groupBy("doc_id", "words", "own").agg(F.count("*").alias("copies")), "sizes")
    pieces = (
        sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("words") / top) - 1, F.lit(0)).cast("int"))))
        .withColumn("first_word", (F.col("piece") * top).cast("long"))
        .withColumn("n_words", F.least(F.lit(top).cast("long"), F.col("words") - F.col("first_word")))
    )
    full = sized.agg(F.sum(F.col("copies") * F.greatest(F.ceil(F.col("words") / top), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(full) // SHARD))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "own", "piece", "copy"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        out = {"bin_id": [None] * len(pdf), "bin_capacity": [None] * len(pdf), "bin_used": [None] * len(pdf), "bin_offset": [None] * len(pdf)}
        lengths = [int(n) for n in pdf["n_words"] if n > 0]
        shard = int(pdf["shard"].iloc[0])
        for b, (capacity, items) in enumerate(pack_shard(lengths, capacities, overhead, attention)):
            offset, used = 0, sum(lengths[i] for i in items)
            for i in items:
                out["bin_id"][i], out["bin_capacity"][i], out["bin_used"][i], out["bin_offset"][i] = (shard << 32) + b, capacity, used, offset
                offset += lengths[i]
        for k, v in out.items():
            pdf[k] = pd.array(v, dtype="Int64")
        return pdf[["doc_id", "piece", "first_word", "n_words", "bin_id", "bin_capacity", "bin_used", "bin_offset"]]

    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "own", "piece", "copy"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(packed, SCHEMA)
