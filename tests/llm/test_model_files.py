"""A model's files and lookups do not grow with its buckets."""

import os

import numpy as np
import pyarrow as pa

from kinforge.llm import ngrams
from kinforge.llm.scratch import Scratch


def test_many_buckets_have_as_few_files_as_one(spark):
    rows = [(i, " ".join(f"w{(i * k) % 97} the x{i % 7}" for k in range(30))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = pa.array([t for _, t in rows] + ["the unknown w1 the", "", None])
    found = []
    for each in (ngrams.BUCKET_TOKENS, 60):
        folder, *made = ngrams.train(df, Scratch(spark, "ngrams"), each)
        model = ngrams.Model(folder, *made)
        found.append((made[0].n, len(os.listdir(folder)), len(model.score(texts)), [x.tolist() for x in model.score(texts)], len(model.mapped)))
        assert not os.path.exists(f"{folder}-parts")
    few, many = found
    assert many[0] > 3 * few[0] and many[1] == few[1] <= 10 and many[4] <= 10
    assert np.allclose(few[3], many[3], rtol=0, atol=1e-9)


def test_keys_that_stand_at_the_ends_of_shards(tmp_path):
    shelf = ngrams._shelf({0: 3, 2: 1}, 4)
    keys = np.array([5, 9, 1 << 63, ngrams.LAST, ngrams.LAST, (1 << 64) - 2, ngrams.LAST, ngrams.LAST], np.uint64)
    index = np.zeros(4 << shelf.bits, np.uint32)
    index[1] = 2
    for k, x in enumerate((keys, np.arange(1, 9)[:, None], index)):
        np.save(f"{tmp_path}/triples-all.{k}.npy", x)
    arrays = ngrams.Arrays(str(tmp_path), None, 2, {"triples": shelf})
    ask = [(0, 5), (0, 6), (0, 9), (0, 1 << 63), (0, (1 << 63) + 1), (1, 5), (2, (1 << 64) - 2), (2, 1), (3, (1 << 64) - 1)]
    got = arrays.find("triples", np.array([s for s, _ in ask]), np.array([k for _, k in ask], np.uint64), 1)
    assert got[:, 0].tolist() == [1, 0, 2, 3, 0, 0, 6, 0, 0]
