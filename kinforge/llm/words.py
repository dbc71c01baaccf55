"""Words of Arrow string columns as 64-bit hashes, without a Python step per word.

A word's hash is a polynomial over fixed random byte values modulo 2**64, taken
from one running sum per chunk of bytes, then mixed. Words of more than LONG_WORD
bytes, where such polynomials have known collisions, are hashed one by one. Texts
are UTF-8; separators are ASCII, so no code point is ever cut.

A text of any length is taken whole; what is held beside it are three flags a byte
and three numbers a word, and sums over CHUNK bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK = 1 << 20
CHUNK, LONG_WORD = 1 << 16, 256
_BASE = U(0x9E3779B97F4A7C13)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**64, 256, dtype=U)
_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: ``[^\x20\x09-\x0D]+`` are words.
SPACES = separators([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` are words (of lower-cased text).
NON_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, CHUNK + LONG_WORD), _BASE if which == "up" else _INVERSE, U)
        step[0] = 1
        _powers[which] = np.cumprod(step)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b; not symmetric."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b + U(0x165667B19E3779F9)))


@dataclass
class Words:
    """Words of consecutive rows: row r has hashes[at[r]:at[r + 1]]; start and end are bytes of data."""

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: memoryview

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def _buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, memoryview(data) if data is not None else memoryview(b"")


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes."""
    at, _ = _buffers(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = int(np.searchsorted(at, at[low] + size, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def words(column: pa.Array, lower: bool = False, seps: np.ndarray = SPACES) -> Words:
    """The words of every row; a null row has none."""
    at, whole = _buffers(column)
    data = whole[at[0] : at[-1]]
    at = at - at[0]
    text = np.frombuffer(data, np.uint8)
    n, rows = len(text), len(at) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), np.zeros(rows + 1, np.int64), none, none, data)
    if lower:
        seps = seps[_LOWER]
    inside = ~seps[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    edge = at[1:][at[:-1] < at[1:]] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hashes(text, data, start, end, lower), np.searchsorted(start, at), start, end, data)


def _hashes(text: np.ndarray, data: memoryview, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    values = _VALUES[_LOWER] if lower else _VALUES
    out = np.empty(len(start), U)
    stop = np.minimum(end, start + LONG_WORD)
    edges = np.unique(np.searchsorted(start, np.arange(0, len(text) + CHUNK, CHUNK)))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        low, high = start[i], stop[j - 1]
        total = np.zeros(high - low + 1, U)
        np.cumsum(values[text[low:high]] * _power("up", high - low), out=total[1:])
        a, b = start[i:j] - low, stop[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * _power("down", high - low)[a] + (b - a).astype(U))
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        word = bytes(data[start[k] : end[k]])
        out[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return out


def one_hash(words_: list[str]) -> np.ndarray:
    """Hashes of given words, as words() would have them."""
    return words(pa.array(words_, pa.string()), seps=np.zeros(256, bool)).hashes


def row_windows(counts: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (in all words) of windows of so many words that stay in a row, and their rows."""
    each = np.maximum(counts - length + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    first = np.cumsum(each) - each
    return np.arange(each.sum()) - np.repeat(first - at[:-1], each), rows


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of so many words, by doubling; positions near the end are cut off."""
    if length == 1 or len(h) < length:
        return h if length == 1 else h[:0]
    half = -(-length // 2)
    lower = window_hashes(h, half)
    shift = length - half
    return join(lower[: len(lower) - shift], lower[shift:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i where that fits."""
    span, out = 1, x
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out
