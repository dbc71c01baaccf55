"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once. The top bits choose one of BINS bins, the
rest is a value of which a bin keeps the least. Empty bins borrow from the first
non-empty bin of a fixed pseudo-random sequence of their own (optimal
densification). A fingerprint packs the lowest BITS bits of each bin as hex.
Likeness is the share of equal bins, less what chance makes equal.

``edited_pairs`` compares each document with the next one in descending doc_id and
with an edit that takes text over from it. Rows are sorted by range partitions;
each task keeps back only its first and last row, and a second step joins each
partition's last row with the first one of the next partition that has rows; the
driver sees the partitions' numbers only.

Defined cases: a null text is empty; a text without words has the empty
fingerprint; fewer than five words are one shingle; two equal fingerprints, empty
ones too, have likeness 1, an empty and another 0; null ids come last; rows that
share an id follow each other by text; the only row is its own next; an empty
table gives an empty result; texts of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, partitions_for
from .words import BLOCK, U, join, mix, row_windows, window_hashes, words

BINS, BITS, SHINGLE = 256, 4, 5
TRIES = 4096
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_donors = (mix(np.arange(BINS * TRIES, dtype=U) + U(77)) % U(BINS)).astype(np.int64).reshape(TRIES, BINS)


def shingles(column: pa.Array, length: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles and their rows; a shorter text is one shingle, a text without words none."""
    w = words(column, lower=lower)
    at, rows = row_windows(w.counts, w.at, length)
    hashes = window_hashes(w.hashes, length)[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((w.counts > 0) & (w.counts < length))
    if len(short):
        whole = w.hashes[w.at[short]]
        for k in range(1, length):
            more = w.counts[short] > k
            whole[more] = join(whole[more], w.hashes[w.at[short][more] + k])
        hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    return hashes, rows


def sketches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of each bin (rows x BINS), and which rows have any word."""
    n = len(column)
    hashes, rows = shingles(column, SHINGLE)
    grid = np.full(n * BINS, _EMPTY, U)
    np.minimum.at(grid, rows * BINS + (hashes >> U(56)).astype(np.int64), hashes & U((1 << 56) - 1))
    grid = grid.reshape(n, BINS)
    filled = grid != _EMPTY
    some = filled.any(1)
    row, bin_ = np.nonzero(~filled & some[:, None])
    for t in range(TRIES):
        if not len(row):
            break
        donor = _donors[t, bin_]
        ok = filled[row, donor]
        grid[row[ok], bin_[ok]] = grid[row[ok], donor[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    for r, b in zip(row.tolist(), bin_.tolist()):  # as good as never
        full = np.flatnonzero(filled[r])
        grid[r, b] = grid[r, full[np.searchsorted(full, b) % len(full)]]
    return (mix(grid) & U((1 << BITS) - 1)).astype(np.uint8), some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 1 / (1 << BITS)
    near = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, near, np.where(some_a | some_b, 0.0, 1.0))


def packed(low: np.ndarray, some: np.ndarray) -> list[str]:
    pairs = ((low[:, ::2] << 4) | low[:, 1::2]).astype(np.uint8)
    return [p.tobytes().hex() if s else "" for p, s in zip(pairs, some.tolist())]


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def rows_of(ids: list, texts: list[str]) -> dict[str, list]:
    """Results for all texts but the last, which is only the next of the one before it."""
    edited = [edit(a, b) for a, b in zip(texts, texts[1:])]
    low, some = sketches(pa.array(texts, pa.large_string()))
    low_e, some_e = sketches(pa.array(edited, pa.large_string()))
    return {
        "doc_id": ids[: len(edited)],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited],
        "fingerprint": packed(low[:-1], some[:-1]),
        "edited_fingerprint": packed(low_e, some_e),
        "near_edited": likeness(low[:-1], low_e, some[:-1], some_e).tolist(),
        "near_next": likeness(low[:-1], low[1:], some[:-1], some[1:]).tolist(),
    }


TYPES = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = SCHEMA + ", edge int, part int, text string"


def in_blocks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Runs of about BLOCK characters; each run's last text opens the next run."""
    low, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if i > low and (size >= BLOCK or i == len(texts) - 1):
            yield ids[low : i + 1], texts[low : i + 1]
            low, size = i, len(t)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*TYPES, ("edge", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        if last is None:
            yield pa.RecordBatch.from_pylist([{"doc_id": ids[0], "edge": 0, "part": part, "text": texts[0]}], schema)
        else:
            ids, texts = [last[0], *ids], [last[1], *texts]
        last = ids[-1], texts[-1]
        for some_ids, some_texts in in_blocks(ids, texts):
            found = rows_of(some_ids, some_texts)
            n = len(found["doc_id"])
            yield pa.RecordBatch.from_pydict(found | {"edge": [None] * n, "part": [None] * n, "text": [None] * n}, schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": last[0], "edge": 1, "part": part, "text": last[1]}], schema)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
            yield pa.RecordBatch.from_pydict(rows_of([doc_id, None], [text, following]), TYPES)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text) and of their edits; see the module."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    n = partitions_for(docs, 20_000, docs.count())
    order = [F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit(""))]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    done = scratch.keep(rows.mapInArrow(_sorted, EDGE), "rows")
    scratch.release()
    edges = done.where("edge is not null").select("doc_id", "text", "edge", "part")
    parts = sorted(r[0] for r in edges.where("edge = 1").select("part").collect())  # numbers of the partitions that have rows
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    firsts = edges.where("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    pairs = edges.where("edge = 1").join(following, "part").join(firsts, "next_part").select("doc_id", "text", "following")
    return done.where("edge is null").drop("edge", "part", "text").unionByName(pairs.mapInArrow(_edges, SCHEMA))
