"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions.values import free_name
from kinforge.llm import langid, mixing, neardup, packing, substrings
from kinforge.llm.scratch import Scratch


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; texts that are null or without letters go."""
    label, score = (free_name(docs.columns, c) for c in ("__lang", "__sure"))
    found = langid.identify(docs, names=(label, score))
    return found.where(F.col(label) != "und").select(*columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group linked by five-word shingles, 0.8 and more alike."""
    gone = neardup.link(docs, length=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has."""
    names = tuple(free_name(docs.columns, c) for c in ("__n_words", "__n_removed", "__kept_sha256"))
    found = substrings.dedup(docs, names=names)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(names[1]) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return found.select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models and minhashes can't be expressed in SQL; tests/llm holds run() against its stages, each of which is held against
#: hand-worked rows or the operator's own brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
