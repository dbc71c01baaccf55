"""Random choices as hashes of (seed, purpose, position): pure, portable, independent of partitioning."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def stable_seed(base: int, *parts: object) -> int:
    return zlib.crc32("|".join(map(str, (base, *parts))).encode()) % 2_000_000_000


def bits(purpose: str, pos: Column, seed: int = 42) -> Column:
    """52 hash bits of seed|purpose|pos as a long."""
    text = F.concat(F.lit(f"{seed}|{purpose}|"), pos.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def draw(purpose: str, pos: Column, n: Column | int, seed: int = 42) -> Column:
    """One of 0 .. n - 1."""
    return bits(purpose, pos, seed) % (F.lit(n) if isinstance(n, int) else n)


def unit(purpose: str, pos: Column, seed: int = 42) -> Column:
    """In [0, 1)."""
    return bits(purpose, pos, seed) / F.lit(float(1 << BITS))


def token(purpose: str, pos: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("tok_"), F.substring(F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), pos.cast("string"))), 1, 12))
