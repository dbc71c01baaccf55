"""Writers."""

from __future__ import annotations

import logging
import os
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .readers import _fs, join_path

log = logging.getLogger("kinforge")
UNSAFE = re.compile(r"[ ,;{}()\n\t=]")

# What parts of error messages usually mean.
HINTS = {
    "permission": "check the rights on the target folder",
    "no space": "the disk is full",
    "already exists": "choose save mode overwrite or append",
    "invalid character": "rename the columns",
    "no filesystem for scheme": "the store's connector is not on the class path",
    "connection refused": "the store cannot be reached",
}


def safe_columns(df: DataFrame) -> DataFrame:
    """Column names without characters that Parquet refuses; clashes get a number."""
    out: list[str] = []
    for c in df.columns:
        name, n = UNSAFE.sub("_", c), 1
        while name.lower() in (x.lower() for x in out):
            name, n = f"{UNSAFE.sub('_', c)}_{n}", n + 1
        out.append(name)
    if out != df.columns:
        log.warning("columns renamed: %s", {a: b for a, b in zip(df.columns, out) if a != b})
    return df.toDF(*out)


def clean_path(path: str) -> str:
    if not str(path).strip():
        raise ValueError("empty path")
    path = path.strip()
    return path.rstrip("/") if "://" in path else os.path.abspath(os.path.expanduser(path))


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file:")


def hint(error: Exception) -> str:
    text = str(error).lower()
    return next((h for k, h in HINTS.items() if k in text), "see the error")


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", options: Mapping[str, str] | None = None, files: int | None = None) -> None:
    out = safe_columns(df)
    (out.coalesce(files) if files else out).write.mode(mode).options(**({"header": "true"} if fmt == "csv" else {}), **(options or {})).format(fmt).save(path)


def save_tables(tables: Mapping[str, DataFrame], base: str, *, fmt: str = "parquet", mode: str = "overwrite", options: Mapping[str, str] | None = None, single_file: bool = False, on_error: str = "warn_and_continue") -> dict[str, str]:
    """Tables that could be written, with their paths; what could not is warned about with a hint, or raised."""
    if on_error not in ("warn_and_continue", "raise"):
        raise ValueError(f"unknown policy {on_error!r}")
    out = {}
    for t, df in tables.items():
        path = join_path(clean_path(base), t)
        try:
            save_table(df, path, fmt, mode, options, 1 if single_file else None)
            out[t] = path
        except Exception as e:
            if on_error == "raise":
                raise
            log.warning("%s was not written (%s): %s", t, hint(e), e)
    return out


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def save_together(tables: Mapping[str, DataFrame], base: str) -> dict[str, str]:
    """All tables or none: written beside their places first, then moved. Old tables are set aside until all new ones
    stand, and moved back if one can't; readers may meet a mixed set only while tables are being moved."""
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    staging, aside = join_path(base, f".staging-{run}"), join_path(base, f".old-{run}")
    old, placed = [], []
    try:
        for t, df in tables.items():
            save_table(df, join_path(staging, t))
        fs, p = _fs(spark, aside)
        fs.mkdirs(p)
        try:
            for t in tables:
                if exists(spark, join_path(base, t)):
                    move(spark, join_path(base, t), join_path(aside, t))
                    old.append(t)
                move(spark, join_path(staging, t), join_path(base, t))
                placed.append(t)
        except Exception:
            for t in placed:
                delete(spark, join_path(base, t))
            for t in old:
                move(spark, join_path(aside, t), join_path(base, t))
            old.clear()
            raise
        old.clear()
    finally:
        delete(spark, staging)
        if not old:  # else what was set aside is all that is left of a table
            delete(spark, aside)
    return {t: join_path(base, t) for t in tables}
