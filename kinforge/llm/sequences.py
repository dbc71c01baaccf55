"""Best-fit decreasing packing of tokenised documents into windows of one length.

Documents become token ids once and are written as packed integers. Only their
lengths go through the packing: hash shards of a bounded number of documents, each
packed alone. In a shard, a document longer than a window is first cut into full
windows; what remains of each is placed longest first, into the open window with
least room that still suffices. A segment tree indexed by remaining capacity finds
it in a step for each of its levels. Windows that this leaves emptier than a
tolerance are filled instead: their pieces are laid end to end and cut where a window
ends, and what is left at the end of a shard is cut at powers of two, lengths that need
no padding. Places are then joined with the ids, of which each piece keeps a checksum.

White space is never part of a token of the permitted vocabularies, nor does it change
how the words beside it are read, so words are encoded once and looked up afterwards;
a worker forgets those that it has not met for long. Tests hold this against whole texts.

Defined cases: a null or empty text is its end token alone; null ids and repeated rows
are packed like others, each row for itself; an empty table gives an empty result; other
columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .scratch import Scratch

WINDOW, END = 4096, 2
#: Documents of a shard; tokens that a window may lack before its pieces are cut anew.
SHARD, TOLERANCE = 16_384, 64
#: Words below this letter (Latin ones) are split here, all others by the tokenizer as a whole.
SIMPLE = "\u0250"
#: White space beside blanks, as any reading of it has it.
ODD = regex.compile(r"[\x00-\x1f\x7f-\xa0]")
#: Words that a worker remembers, and the bytes of ids in an Arrow batch.
KNOWN, BATCH = 700_000, 8 << 20
PLACES = "row long, start long, length long, sequence_id long, offset long"


class Vocabulary:
    """A worker's tokenizer and the ids of words that it has met; those that did not come up again while it met KNOWN
    others are forgotten."""

    def __init__(self, spec: str, kind: np.dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind = Tokenizer.from_str(spec), kind
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lately, self.before, self.parts = {}, {}, {}
        steps = json.loads(spec)
        split = [s["pattern"]["Regex"] for s in (steps["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        self.splits = regex.compile(f"{split[0]}| ") if len(split) == 1 else None
        self.lowers = any(s["type"] == "Lowercase" for s in (steps["normalizer"] or {}).get("normalizers", []))

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def simple(self, text: str) -> bool:
        """Whether a text of words between blanks has only letters and signs that all versions of Unicode know alike, no
        other white space, and no added token."""
        return self.splits is not None and max(text) < SIMPLE and not ODD.search(text) and not any(a in text for a in self.added)

    def whole(self, words: list[bytes]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def by_parts(self, words: list[bytes]) -> list[bytes]:
        """The ids of words that are simple, normalised and split as one text, then part by part, since words share parts."""
        text = b" ".join(words).decode()
        if not self.simple(text):
            if len(words) == 1:
                return self.whole(words)
            alone = [self.simple(w.decode()) for w in words]
            if not all(alone):
                ids = iter(self.by_parts([w for w, s in zip(words, alone) if s])) if any(alone) else iter(())
                rest = iter(self.whole([w for w, s in zip(words, alone) if not s]))
                return [next(ids if s else rest) for s in alone]
            return self.whole(words)
        text = text.lower() if self.lowers and text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if text.count(" ") != len(words) - 1:
            return self.whole(words)
        if len(self.parts) > KNOWN:
            self.parts = {}
        parts, tokenize = self.parts, self.tokenizer.model.tokenize
        found = self.splits.findall(text)
        for part in set(found).difference(parts, " "):
            # printable ASCII stands for itself where bytes are written as letters
            pieces = [part] if part.isascii() and part.isprintable() else [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
            parts[part] = self.packed([t.id for x in pieces for t in tokenize(x)])
            if not parts[part]:
                return self.whole(words)
        parts[" "] = b""
        each = list(map(parts.__getitem__, found))
        sizes, joined = np.fromiter(map(len, each), np.int64, len(each)), b"".join(each)
        ends = np.cumsum(sizes)[sizes == 0].tolist()  # blanks alone have no ids
        return [joined[a:b] for a, b in zip([0, *ends], [*ends, len(joined)])]

    def ids(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of texts, given as their words, as packed integers."""
        if len(self.lately) > KNOWN:
            self.lately, self.before = {}, self.lately
        known, before = self.lately, self.before
        new = set().union(*texts).difference(known)
        again = [w for w in new if w in before] if before else ()
        known.update((w, before[w]) for w in again)
        new.difference_update(again)
        plain = [w for w in new if w.isascii()]
        for words in (plain, list(new.difference(plain))):
            for k in range(0, len(words), 4096):
                some = words[k : k + 4096]
                known.update(zip(some, self.by_parts(some), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in texts]


_loaded: dict[tuple[int, str], Vocabulary] = {}


def encode(texts: list[bytes], spec: str, kind: np.dtype) -> Iterator[bytes]:
    """The ids of each text as packed integers."""
    key = zlib.crc32(spec.encode()), str(kind)
    if key not in _loaded:
        _loaded[key] = Vocabulary(spec, kind)
    for k in range(0, len(texts), 256):
        yield from _loaded[key].ids([t.split() for t in texts[k : k + 256]])


def tokenised(docs: DataFrame, spec: str, end: int = END) -> DataFrame:
    """doc_id, n, ids (packed unsigned integers, of two bytes if the vocabulary allows) of each row."""
    kind = np.dtype("<u2" if max(Tokenizer.from_str(spec).get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    last = np.array([end], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, ids, size = [], [], 0
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for d, x in zip(batch.column(0).to_pylist(), encode(texts, shared.value, kind), strict=True):
                doc.append(d)
                ids.append(x + last)
                size += len(x)
                if size > BATCH:
                    yield rows(doc, ids)
                    doc, ids, size = [], [], 0
            yield rows(doc, ids)

    def rows(doc: list, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "n": pa.array([len(x) // kind.itemsize for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


class Rooms:
    """Open windows by what they have left; a segment tree counts them, so that the least sufficient room is found by descent."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: dict[int, list[int]] = {}

    def _add(self, left: int, n: int) -> None:
        k = left + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def put(self, left: int, window: int) -> None:
        self.windows.setdefault(left, []).append(window)
        self._add(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with least room of at least need, and its room; it is open no longer."""
        k = need + self.size
        while not self.count[k]:
            while k & 1 and k > 1:
                k >>= 1
            if k == 1:
                return None
            k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        left = k - self.size
        self._add(left, -1)
        return self.windows[left].pop(), left


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows, as lists of positions; lengths are at most a window and sorted, longest first."""
    rooms, out = Rooms(window), []
    for i, n in enumerate(lengths):
        w, left = rooms.take(n) or (len(out), window)
        if w == len(out):
            out.append([])
        out[w].append(i)
        if left > n:
            rooms.put(left - n, w)
    return out


def cut_anew(pieces: list[tuple[int, int, int]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Pieces (row, start, length) laid end to end and cut into full windows, the rest at powers of two."""
    rest = sum(n for _, _, n in pieces)
    out, room = [], 0
    for row, start, n in pieces:
        while n:
            if not room:
                room = window if rest >= window else 1 << (rest.bit_length() - 1)
                out.append([])
            part = min(n, room)
            out[-1].append((row, start, part))
            start, n, room, rest = start + part, n - part, room - part, rest - part
    return out


def plan(rows: list[int], sizes: list[int], window: int = WINDOW, tolerance: int = TOLERANCE) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (row, start, length) for documents of some sizes."""
    out, rests = [], []
    for row, n in zip(rows, sizes, strict=True):
        full = n // window * window
        out += [[(row, start, window)] for start in range(0, full, window)]
        if n > full:
            rests.append((row, full, n - full))
    rests.sort(key=lambda p: (-p[2], p[0]))
    loose = []
    for items in best_fit_decreasing([p[2] for p in rests], window):
        pieces = [rests[i] for i in items]
        if window - sum(p[2] for p in pieces) <= tolerance:
            out.append(pieces)
        else:
            loose += pieces
    return out + cut_anew(loose, window)


def places(sizes: DataFrame, documents: int, window: int = WINDOW, tolerance: int = TOLERANCE, shard: int = SHARD) -> DataFrame:
    """The place of each piece of each document (row, n); shards are packed apart."""

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        sequences = plan(pdf["row"].tolist(), pdf["n"].tolist(), window, tolerance)
        lengths = [len(s) for s in sequences]
        row, start, length = np.array([p for s in sequences for p in s], np.int64).reshape(-1, 3).T
        sequence = np.repeat(np.arange(len(sequences)), lengths)
        before = np.cumsum(length) - length
        first = np.repeat(before[np.cumsum(lengths) - lengths], lengths)
        return pd.DataFrame({"row": row, "start": start, "length": length, "sequence_id": (int(pdf["shard"].iloc[0]) << 32) + sequence, "offset": before - first})

    shards = max(1, -(-documents // shard))
    return sizes.select("row", "n", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(packed, PLACES)


def pack(docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, tolerance: int = TOLERANCE, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document (doc_id, text): where it lies in its document and in a sequence, and the
    CRC of its ids as 32-bit integers; with_ids adds the ids themselves. tokenizer: path of a tokenizer's JSON file."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    scratch = Scratch(docs.sparkSession, "sequences")
    rows = scratch.keep(tokenised(docs, spec, end).withColumn("row", F.monotonically_increasing_id()), "tokens", compression="zstd")
    placed = places(rows.select("row", "n"), rows.count(), window, tolerance)
    # the pieces of a document travel together, so that its ids are sent once
    each = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, n, ids, pieces in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                whole = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                for p in pieces:
                    part = whole[p["start"] : p["start"] + p["length"]]
                    out.append((doc, p["start"], p["length"], zlib.crc32(part.tobytes()), n, p["sequence_id"], p["offset"], *([part.astype(np.int32)] if with_ids else [])))
            columns = list(zip(*out, strict=True)) or [[]] * (7 + with_ids)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), *(pa.array(list(c), pa.list_(pa.int32())) for c in columns[7:])], [f.split()[0] for f in schema.split(", ")])

    return rows.join(each, "row").select("doc_id", "n", "ids", "pieces").mapInArrow(cut, schema)
