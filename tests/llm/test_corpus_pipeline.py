"""The pipeline's stages against brute force on a small corpus."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinforge.llm import mixing

LONG = " ".join(f"w{i}" for i in range(300))
PASSAGE = " ".join(f"p{i}" for i in range(70))
ROWS = [(1, LONG, "en", "a"), (2, LONG + " more", "en", "a"), (3, "one " + PASSAGE, "en", "a"), (4, "two " + PASSAGE + "".join(f" t{i}" for i in range(30)), "en", "b"), (5, "123", "en", "b"), (6, None, "en", "b"), (7, "clean text of its own", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit(1))


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stages(spark, docs, tmp_path):
    base = f"file://{tmp_path}"
    docs.write.parquet(f"{base}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, base)
    assert ids(kept) == [1, 2, 3, 4, 7] and kept.columns == docs.columns
    near = corpus_pipeline.near_duplicates(spark, kept, base)
    assert ids(near) == [1, 3, 4, 7] and near.columns == docs.columns
    cut = corpus_pipeline.repeated_passages(spark, near, base)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    assert texts[4] == ("two" + "".join(f" t{i}" for i in range(30)), 113) and texts[3] == (ROWS[2][1], len(ROWS[2][1])) and cut.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, cut, base)
    taken = {r["doc_id"]: r["__epochs"] for r in mixing.mix(mixing.measured(cut)).collect() if r["__taken"]}
    assert Counter(ids(mixed)) == Counter(taken) and mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, base)
    words = sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert packed.agg(F.sum("n_words")).first()[0] == words
    whole = corpus_pipeline.run(spark, base)
    assert Counter((r["doc_id"], r["n_words"]) for r in whole.collect()) == Counter((r["doc_id"], r["n_words"]) for r in packed.collect())
