"""Removal of word sequences that an earlier document has, by level-wise doubling.

The lengths are the one asked for and its halves, down to SHORTEST words or more.
At the least length every window could be counted; but equal longer windows have the
same least hash among their windows of that length, so only these (anchors) are, which
misses no repeat and counts about one position in thirteen. Anchors that stand in one
document only are dropped. Windows of twice the length are looked at only where their
own anchor survived, and so on, until no candidates survive or the length asked for is
reached, where all windows that are left are counted; longer ones cannot remove a
further word. There a window is told by hashes of 64 and 32 bits, so that windows that differ
do not meet by chance in a large corpus. Windows that also stand in a document with a
smaller doc_id are removed; all windows are judged on the input.

Counts are sums over (hash, doc_id) with map-side combining, and survivors return
to documents by joins that Spark splits if skewed; a passage that a third of all
documents have never meets in one task.

Defined cases: a null text is empty; texts shorter than a window, and texts that
repeat nothing, keep all words; rows with a null id keep all words and count for
nothing; rows that share an id do not remove each other's words; texts of any length
are taken whole; an empty table gives an empty result; other columns are carried along,
whatever their names (but those asked for in the result).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import U, Words, blocks, mix, row_windows, sliding_min, window_hashes, words

LENGTH, SHORTEST = 50, 20
_CHECK = U(0x5EC0DD0FA11C0DE5)


def lengths(length: int) -> list[int]:
    """The length asked for and its halves, shortest first; at least one half."""
    out = [length]
    while out[0] > 1 and (len(out) == 1 or out[0] > 2 * SHORTEST):
        out.insert(0, -(-out[0] // 2))
    return out


def _anchors(hashes: np.ndarray, short: int, long: int) -> np.ndarray:
    """The least hash of the short windows of each long window."""
    return sliding_min(window_hashes(hashes, short), long - short + 1)


def candidates(w: Words, steps: list[int], k: int, given: np.ndarray, of_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, second hashes and rows of what is counted at the k-th length; given: each row's survivors of the one before."""
    at, rows = row_windows(w.counts, w.at, steps[k])
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int32), rows
    if k:
        ok = _in_row(_anchors(w.hashes, steps[k - 1], steps[k])[at], rows, given, of_rows)
        at, rows = at[ok], rows[ok]
    own = window_hashes(w.hashes, steps[k])[at]
    if k == len(steps) - 1:
        return own, (window_hashes(mix(w.hashes ^ _CHECK), steps[k])[at] >> U(32)).astype(np.uint32).view(np.int32), rows
    longer, of_longer = row_windows(w.counts, w.at, steps[k + 1])
    if not len(longer):
        return np.zeros(0, U), np.zeros(0, np.int32), of_longer
    anchor = _anchors(w.hashes, steps[k], steps[k + 1])[longer]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of_longer[1:] != of_longer[:-1])
    anchor, of_longer = anchor[new], of_longer[new]
    if k:
        ok = _in_row(anchor, of_longer, own, rows)
        anchor, of_longer = anchor[ok], of_longer[ok]
    return anchor, np.zeros(len(anchor), np.int32), of_longer


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """Values of each row (rows ascend) as lists of longs."""
    offsets = np.searchsorted(rows, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == U else values))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and their rows."""
    counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U)
    return values, np.repeat(np.arange(len(lists)), counts)


def _in_row(values: np.ndarray, rows: np.ndarray, of: np.ndarray, of_rows: np.ndarray) -> np.ndarray:
    """Whether each row's value is among the same row's given ones."""
    return np.isin(values ^ mix(rows.astype(U)), of ^ mix(of_rows.astype(U)))


def _distinct(values: np.ndarray, checks: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((checks, values, rows))
    values, checks, rows = values[order], checks[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (checks[1:] != checks[:-1]) | (rows[1:] != rows[:-1])
    return values[keep], checks[keep], rows[keep]


def _level(steps: list[int], k: int):
    """Rows with the hashes to be counted at the k-th length; at the last one with second hashes."""
    last = k == len(steps) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for low, high in blocks(column):
                n = high - low
                given = _flat(batch.column("survivors").slice(low, n)) if k else (np.zeros(0, U), np.zeros(0, np.int64))
                values, checks, rows = _distinct(*candidates(words(column.slice(low, n)), steps, k, *given))
                arrays = [batch.column("doc_id").slice(low, n), _lists(values, rows, n)]
                yield pa.RecordBatch.from_arrays([*arrays, _lists(checks, rows, n)] if last else arrays, ["doc_id", "hashes", "checks"][: 2 + last])

    return run


def _repeated(level: DataFrame) -> DataFrame:
    """doc_id -> the hashes that stand in two documents or more; if they have second hashes, not in the first of them."""
    last = "checks" in level.columns
    key = ["h", "g"] if last else ["h"]
    each = level.select("doc_id", F.explode(F.arrays_zip("hashes", "checks")).alias("z")).select("doc_id", F.col("z.hashes").alias("h"), F.col("z.checks").alias("g")) if last else level.select("doc_id", F.explode("hashes").alias("h"))
    shared = each.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    found = each.join(shared.select(*key, "first"), key)
    return (found.where("doc_id > first") if last else found).groupBy("doc_id").agg(F.collect_list("h").alias("survivors"))


def survivors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id -> hashes of its windows that an earlier document has too (documents with none are left out)."""
    scratch = Scratch(docs.sparkSession, "substrings")
    known = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    steps = lengths(length)
    found = None
    for k in range(len(steps)):
        source = known if found is None else known.join(found, "doc_id")
        last = k == len(steps) - 1
        counted = scratch.keep(source.mapInArrow(_level(steps, k), "doc_id long, hashes array<long>" + ", checks array<int>" * last), f"level{k}")
        scratch.drop(f"survivors{k - 1}")
        scratch.release()
        found = scratch.keep(_repeated(counted), f"survivors{k}")
        scratch.drop(f"level{k}")
        scratch.release()
        if not last and found.isEmpty():
            break
    return found


def dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = True, names: tuple[str, str, str] = ("__n_words", "__n_removed", "__kept_sha256")) -> DataFrame:
    """docs with words, removed words and digest under names; text loses the removed words (or is left out).

    A text that keeps all its words stays as it is; from others the kept words remain, joined by one space.
    """
    found = survivors(docs, length)
    columns = [c for c in docs.columns if c not in names and (with_text or c != "text")]
    inner = {c: f"k{i}" for i, c in enumerate(dict.fromkeys([*columns, "text", "doc_id"]))}  # whatever the columns are called
    given = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in inner.items()])
    joined = given.join(found.withColumnRenamed("doc_id", "id"), F.col(inner["doc_id"]).cast("long") == F.col("id"), "left").drop("id")
    carried = [inner[c] for c in columns]
    schema = given.select(*carried).withColumns({"n": F.lit(0).cast("long"), "removed": F.lit(0).cast("long"), "digest": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, lists = batch.column(inner["text"]), batch.column("survivors")
            total, removed, digest, texts = [], [], [], []
            for low, high in blocks(column):
                rows = column.slice(low, high - low)
                given, of_rows = _flat(lists.slice(low, high - low))
                hit = np.unique(of_rows)
                covered: dict[int, np.ndarray] = {}
                if len(hit):
                    part = rows.take(pa.array(hit))
                    w = words(part)
                    at, at_rows = row_windows(w.counts, w.at, length)
                    ok = _in_row(window_hashes(w.hashes, length)[at], at_rows, given, np.searchsorted(hit, of_rows)) if len(at) else np.zeros(0, bool)
                    edge = np.zeros(len(w.hashes) + 1, np.int64)
                    np.add.at(edge, at[ok], 1)
                    np.add.at(edge, at[ok] + length, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    covered = {r: out[w.at[i] : w.at[i + 1]] for i, r in enumerate(hit.tolist())}
                for i, text in enumerate(rows.to_pylist()):
                    kept = (text or "").encode("utf-8", "replace").split()
                    total.append(len(kept))
                    gone = covered.get(i)
                    if gone is not None and gone.any():
                        kept = [x for x, g in zip(kept, gone.tolist()) if not g]
                    removed.append(total[-1] - len(kept))
                    flat = b" ".join(kept)
                    digest.append(hashlib.sha256(flat).hexdigest())
                    if with_text:
                        texts.append(flat.decode("utf-8") if removed[-1] else text)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(inner[c]) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], [*carried, "n", "removed", "digest"])

    return joined.mapInArrow(run, schema).toDF(*columns, *names)
