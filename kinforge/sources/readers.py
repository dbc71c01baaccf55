"""Readers. Paths keep their scheme: local, HDFS and object stores read alike."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import stable_seed

log = logging.getLogger("kinforge")
CSV = {"header": "true", "inferSchema": "true"}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """A table in any format that Spark knows; CSV has a header and its types are inferred unless options say else."""
    if fmt == "parquet" and limit is not None:
        return read_parts(spark, path, limit, options=options)
    reader = spark.read.format(fmt).options(**({**CSV, **(options or {})} if fmt == "csv" else options or {}))
    df = reader.load(path)
    return df if limit is None else df.limit(limit)


def read_tables(
    spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet", formats: Mapping[str, str] | None = None, options: Mapping[str, Mapping[str, str]] | None = None,
    limit: int | None = None, wanted: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Several tables, each with its own format and options where given, and up to a number of rows; wanted: their names,
    of which none may lack a path (paths of others are left alone)."""
    if not paths:
        raise ValueError("no paths")
    if wanted is not None:
        for other in check_paths(paths, wanted):
            log.warning("%s: nobody wants this table", other)
    return {t: read_table(spark, paths[t], (formats or {}).get(t, fmt), (options or {}).get(t), limit) for t in (wanted if wanted is not None else paths)}


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The files below a path, but for those whose name or folder is hidden; sorted. A glob or a single file will do."""
    fs, p = _fs(spark, path)
    out = []
    for top in fs.globStatus(p) or []:
        root = top.getPath().toString()
        found = fs.listFiles(top.getPath(), True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if not any(x.startswith(("_", ".")) for x in name[len(root) :].split("/")):
                out.append(name)
    return sorted(out)


def rows_in(spark: SparkSession, file: str) -> int:
    """Rows of a Parquet file, from its footer alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


def read_parts(spark: SparkSession, path: str, n: int, seed: int = 42, options: Mapping[str, str] | None = None) -> DataFrame:
    """n rows of a Parquet table (all if it has fewer) from as few parts as it takes: parts are drawn in an order that
    depends on the seed and their names, their footers tell how many rows each has, and neither footers nor parts beyond
    the last one needed are read. Of that one the first rows are taken. The rows are the same each time, but whole parts:
    a sample of rows is bounded_sample of operators.sampling."""
    files = data_files(spark, path)
    if not files:
        return spark.read.options(**(options or {})).parquet(path).limit(0)
    below = path.rstrip("/")
    whole, left, cut = [], n, None
    for file in sorted(files, key=lambda f: (stable_seed(seed, f.rpartition("/")[2]), f)):
        rows = rows_in(spark, file)
        if rows > left:
            cut = file
            break
        whole.append(file)
        left -= rows
        if not left:
            break
    base = {} if len(files) == 1 or any(c in below for c in "*?[{") else {"basePath": below}  # so that folders make columns
    read = lambda files: spark.read.options(**{**base, **(options or {})}).parquet(*files)
    if cut is None:
        return read(whole)
    first = read([cut]).where(F.col("_metadata.row_index") < left) if left else read([cut]).limit(0)
    return read(whole).unionByName(first, allowMissingColumns=True) if whole else first


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table that has to be Parquet: anything else is an error before any of it is read."""
    if not is_parquet(spark, path):
        raise ValueError(f"{path}: not Parquet")
    return spark.read.parquet(path)


def check_paths(paths: Mapping[str, str], wanted: list[str]) -> list[str]:
    """Raises if a wanted table has no path; returns tables that nobody wants."""
    if missing := sorted(set(wanted) - set(paths)):
        raise ValueError(f"no path for {missing}")
    return sorted(set(paths) - set(wanted))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discover_tables(spark: SparkSession, base: str) -> dict[str, str]:
    """Each folder or Parquet file under a path is a table."""
    fs, p = _fs(spark, base)
    out = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if not name.startswith(("_", ".")) and (s.isDirectory() or name.endswith(".parquet")):
            out[name.removesuffix(".parquet")] = s.getPath().toString()
    return dict(sorted(out.items()))


def join_path(base: str, *parts: str | None) -> str:
    return "/".join([base.rstrip("/"), *[p.strip("/") for p in parts if p]])


def object_uri(scheme: str, bucket: str, namespace: str | None = None, path: str = "") -> str:
    return join_path(f"{scheme}://{bucket}{'@' + namespace if namespace else ''}", path)


def read_specs(spark: SparkSession, path: str) -> dict:
    """One JSON object of tables."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path}: expected one file")
    config = json.loads(rows[0][0])
    if not isinstance(config, dict) or not config:
        raise ValueError(f"{path}: expected a JSON object of tables")
    return config


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a file, or the first file of a folder, starts with Parquet's magic bytes; no more than these are read."""
    files = data_files(spark, path)
    if not files:
        return False
    fs, p = _fs(spark, files[0])
    if fs.getFileStatus(p).getLen() < 4:
        return False
    stream = fs.open(p)
    try:
        return bytes(stream.read() for _ in range(4)) == b"PAR1"
    finally:
        stream.close()


def fitting_encoding(spark: SparkSession, path: str, encodings: tuple[str, ...]) -> str:
    """The first encoding in which no line of the text has a broken character (the last one if all have)."""
    for encoding in encodings[:-1]:
        # one column a line: no text has the separator
        lines = spark.read.csv(path, sep="\u0001", encoding=encoding, quote="", schema="line string")
        if lines.where(F.contains("line", F.lit("\ufffd"))).isEmpty():
            return encoding
    return encodings[-1]


def read_messy_csv(spark: SparkSession, path: str, separators: str = ",;\t|", encodings: tuple[str, ...] = ("UTF-8", "ISO-8859-1")) -> DataFrame:
    """A CSV of unknown separator and encoding. All lines decide: the first encoding without broken characters, then the
    separator that the header has and that most lines have as often as the header (then the one that it has most
    often); rows that do not fit are dropped. A Parquet file under a CSV name is read as what it is."""
    if is_parquet(spark, path):
        return spark.read.parquet(path)
    encoding = fitting_encoding(spark, path, encodings)
    lines = spark.read.csv(path, sep="\u0001", encoding=encoding, quote="", schema="line string")
    header = (lines.first() or [None])[0]
    if not header:
        raise ValueError(f"{path}: nothing to read")
    inside = {s: header.lstrip("\ufeff").count(s) for s in separators}
    plain = F.regexp_replace("line", '"[^"]*"', "")  # separators inside quotes are none
    as_often = lines.agg(*[F.count_if(F.length(plain) - F.length(F.replace(plain, F.lit(s))) == n).alias(str(i)) for i, (s, n) in enumerate(inside.items())]).first()
    sep = max(separators, key=lambda s: (inside[s] > 0, as_often[str(separators.index(s))], inside[s]))
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding, mode="DROPMALFORMED")


def read_metadata(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """The table of tables and columns, as text, in UTF-8 or else in Latin-1; XLSX needs pandas with a reader for it."""
    if path.lower().endswith((".xls", ".xlsx")):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
    return spark.read.csv(path, header=True, encoding=encoding or fitting_encoding(spark, path, ("UTF-8", "ISO-8859-1")))


def largest_from_footers(spark: SparkSession, path: str, column: str):
    """max(column) from Parquet footers alone (needs the second data source version, switched on for this read)."""
    names = ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")
    old = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], ",".join(x for x in old[names[0]].split(",") if x != "parquet"))
        spark.conf.set(names[1], "true")
        return spark.read.parquet(path).agg(F.max(column)).first()[0]
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
